"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]), linear in the features.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, small_batches, staged

BUCKETS = 1 << 14
FACTORS = 8
#: Labelled documents that the model is fitted on at most, those with the smallest hashes of their ids.
MAX_TRAIN = 8_000
THRESHOLD = 0.7
_UPPER, _LOWER, _DIGIT = (np.array(sorted(x)) for x in (range(65, 91), range(97, 123), range(48, 58)))
_SPACE = np.array([9, 10, 11, 12, 13, 32])
STATS = 20
_STEP = 1 << 20


def _structure(text: bytes, words: Counter, n_chars: int | None) -> np.ndarray:
    n = len(text)
    counts = np.zeros(256)
    for at in range(0, n, _STEP):  # bincount widens what it counts
        counts += np.bincount(np.frombuffer(text[at : at + _STEP], dtype=np.uint8), minlength=256)
    n_words = sum(words.values())
    upper, lower = counts[_UPPER].sum(), counts[_LOWER].sum()
    high = counts[128:].sum()
    letters = upper + lower + high
    space, digits = counts[_SPACE].sum(), counts[_DIGIT].sum()
    marks = n - letters - space - digits
    lines = counts[10] + 1
    some = max(n, 1)
    length = sum(len(w) * c for w, c in words.items()) / max(n_words, 1)
    top = max(words.values(), default=0)
    return np.array([
        1.0, math.log1p(n) / 10, math.log1p(n_words) / 8, min(length, 30) / 10, upper / max(letters, 1), 4 * digits / some,
        4 * marks / some, 2 * high / some, 2 * space / some, len(words) / max(n_words, 1), 2 * top / max(n_words, 1),
        math.log1p(lines) / 5, min(n_words / lines, 100) / 50, *(min(20 * counts[b] / some, 3) for b in b"!|#$."),
        math.log1p(max(n_chars or 0, 0)) / 10, float(n == 0),
    ], dtype=np.float32)


def features(text: bytes, n_chars: int | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's features: hashed words, damped and scaled to length 1, then statistics."""
    words = Counter(text.lower().split())
    sums: dict[int, float] = {}
    for word, n in words.items():
        h = zlib.crc32(word)
        sums[h % buckets] = sums.get(h % buckets, 0.0) + (1 + math.log(n)) * (1 if h & 0x80000000 else -1)
    values = np.fromiter(sums.values(), dtype=np.float32, count=len(sums))
    values *= 1 / max(float(np.sqrt((values**2).sum())), 1e-6)
    stats = _structure(text, words, n_chars)
    return np.concatenate([np.fromiter(sums, dtype=np.int32, count=len(sums)), buckets + np.arange(len(stats), dtype=np.int32)]), np.concatenate([values, stats])


@dataclass
class Model:
    bias: float
    w: np.ndarray
    v: np.ndarray
    buckets: int = BUCKETS

    def logits(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits of rows that begin at ``starts``, and the factor sums."""
        xv = self.v[index] * value[:, None]
        sums = np.add.reduceat(xv, starts, axis=0)
        pairs = 0.5 * (sums**2 - np.add.reduceat(xv**2, starts, axis=0)).sum(axis=1)
        return self.bias + np.add.reduceat(self.w[index] * value, starts) + pairs, sums


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray, int]], buckets: int = BUCKETS, factors: int = FACTORS, epochs: int = 12, least_steps: int = 1_000, rate: float = 0.01, decay: float = 1e-4, seed: int = 5) -> Model:
    """Adam on the logistic loss over (index, value, label) rows, ``epochs`` times or more for few rows. Rows of one label only give that label's share as bias."""
    n = buckets + STATS
    positives = sum(y for _, _, y in rows)
    share = (positives + 1) / (len(rows) + 2)
    rng = np.random.default_rng(seed)
    model = Model(math.log(share / (1 - share)), np.zeros(n, np.float32), (rng.standard_normal((n, factors)) * 0.02).astype(np.float32), buckets)
    if not 0 < positives < len(rows):
        model.v[:] = 0
        return model
    params = [model.w, model.v]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(max(epochs, -(-least_steps * 64 // len(rows)))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            some = [rows[i] for i in order[at : at + 64]]
            index, value = (np.concatenate([r[k] for r in some]) for k in (0, 1))
            sizes = np.array([len(r[0]) for r in some])
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            z, sums = model.logits(index, value, starts)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - np.array([r[2] for r in some])) / len(some)
            gx = (np.repeat(error, sizes) * value).astype(np.float32)
            gv = gx[:, None] * (np.repeat(sums, sizes, axis=0) - model.v[index] * value[:, None])
            grads = [np.bincount(index, gx, n).astype(np.float32), np.stack([np.bincount(index, gv[:, f], n) for f in range(factors)], axis=1).astype(np.float32)]
            step += 1
            for p, g, a, b in zip(params, grads, first, second):
                g += decay * p
                a *= 0.9
                a += 0.1 * g
                b *= 0.999
                b += 0.001 * g * g
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
            model.bias -= rate * float(error.sum())
    return model


def held_out(id_col: str = "doc_id"):
    """True for rows that no model is fitted on: crc32 of the id as text leaves 2 when divided by 4. Null ids: false."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, buckets: int = BUCKETS, factors: int = FACTORS) -> Model:
    """A model of ``labels.quality`` from at most ``max_train`` labelled documents that aren't held out.

    Only this bounded sample's features reach the driver, one row for each id. An id labelled twice counts by its mean
    (0.5: 1), one with several documents by the last of their features in order; null labels and ids are left out;
    without any label the score is 0.5 everywhere."""
    known = labels.filter("doc_id is not null and quality is not null").filter(~held_out()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    known = staged(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train), "labels")
    rows = docs.select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars")).join(F.broadcast(known), "doc_id").select("doc_id", "y", "n_chars", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 256):
            found = [features(t, n, buckets) for t, n in zip(as_bytes(batch.column(3)), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32()))], ["doc_id", "y", "index", "value"])

    kind = dict(docs.dtypes)["doc_id"]
    found = rows.mapInArrow(run, f"doc_id {kind}, y int, index array<int>, value array<float>")
    got = found.groupBy("doc_id").agg(F.max(F.struct("y", "index", "value")).alias("row")).select("doc_id", "row.*").toArrow()
    seen, order = [], np.argsort(got["doc_id"].to_numpy(), kind="stable")
    index, value, y = got["index"].combine_chunks(), got["value"].combine_chunks(), got["y"].to_pylist()
    for i in order:
        seen.append((index[int(i)].values.to_numpy(), value[int(i)].values.to_numpy(), y[i]))
    return fit_rows(seen, buckets, factors)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """(id, score) of every row from its whole text and n_chars; null and empty texts are scored like any other."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(chars_col).cast("long").alias("n_chars"))
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.w, model.v, model.buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in small_batches(batches, 64):
            found = [features(t, n, own.buckets) for t, n in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist())]
            if not found:
                continue
            starts = np.r_[0, np.cumsum([len(f[0]) for f in found])[:-1]]
            z, _ = own.logits(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), starts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30))), pa.float64())], ["id", "score"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score ``threshold`` or more, all columns kept. Scored and filtered in one pass."""
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.w, model.v, model.buckets))
    text, chars = names.index("text"), names.index("n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in small_batches(batches, 64):
            found = [features(t, n, own.buckets) for t, n in zip(as_bytes(batch.column(text)), batch.column(chars).to_pylist())]
            if not found:
                continue
            starts = np.r_[0, np.cumsum([len(f[0]) for f in found])[:-1]]
            z, _ = own.logits(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), starts)
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
