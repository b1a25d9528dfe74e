"""Vector code compression: product codebooks of integers, learned over all vectors.

Components become integers and vectors are cut into equal parts. Each part position has a codebook that
starts as that part of the first vectors. In each round the codebooks are broadcast, Arrow batches compute all
squared distances as |a|^2 - 2ab + |b|^2 with exact 64-bit matrix products, a task sums the parts that fall to
each entry, and a grouped shuffle merges the tasks' sums. Nothing is rounded, so that neither partitions nor
reruns change a result.

Vectors that are null or hold null or non-finite components are left out. Vectors of several lengths in one
table have codebooks of their own for each length; where parts can't be equal, the last is filled up with
zeros. Components so large that 64 bits can't hold a distance (beyond about 65,000 at 64 components) stop at
the largest that they can. Equal ids are ordered by their vectors, null ids come last; an empty table has no codes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Vectors whose distances are worked out at once.
AT_ONCE = 4_096
#: Entries (entries x components) by length of the vectors.
Codebooks = dict[int, np.ndarray]


def integers(vectors: DataFrame, vec: str, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """The rows that take part, with ``dim`` and the integer components ``v`` in place of ``vec``, filled up to whole parts."""
    x = F.col(vec)
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.filter(x.isNotNull() & whole).withColumn("dim", F.size(x))
    most = F.floor(F.sqrt(F.lit(2.0**62) / F.greatest("dim", F.lit(1))) / 2)
    ints = F.transform(x, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, most.cast("double")), -most.cast("double"))).cast("long"))
    fill = F.array_repeat(F.lit(0).cast("long"), F.pmod(-F.col("dim"), F.lit(parts)))
    return rows.withColumn("v", F.concat(ints, fill)).drop(vec)


def _cut(column: pa.Array, parts: int) -> np.ndarray:
    """Rows of one length as (rows, parts, width)."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, parts, -1) if len(flat) else np.zeros((n, parts, 0), np.int64)


def _by_length(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The batch in slices, and those in rows of one length each."""
    for at in range(0, batch.num_rows, AT_ONCE):
        some = batch.slice(at, AT_ONCE)
        lengths = some.column(dims).to_numpy(zero_copy_only=False)
        for dim in np.unique(lengths):
            yield int(dim), some if (lengths == dim).all() else some.filter(pa.array(lengths == dim))


def nearest(rows: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each part's nearest entry, the first of equals, and the squared distances; rows (n, parts, width), books (parts, entries, width)."""
    n, parts, _ = rows.shape
    index, error = np.empty((n, parts), np.int64), np.empty((n, parts), np.int64)
    for p in range(parts):
        a, b = rows[:, p, :], books[p]
        d = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]
        index[:, p] = d.argmin(axis=1)
        error[:, p] = np.take_along_axis(d, index[:, p, None], axis=1)[:, 0]
    return index, error


def _start(rows: DataFrame, id_col: str, entries: int, parts: int) -> Codebooks:
    """Parts of the first vectors of each length; one small heap a task, ``entries`` rows a length reach the driver."""
    order = Window.partitionBy("dim").orderBy(F.col(id_col).asc_nulls_last(), "v")
    first = rows.select("dim", id_col, "v").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= entries)
    found: dict[int, list] = {}
    for r in sorted(first.select("dim", "k", "v").collect()):
        found.setdefault(r["dim"], []).append(np.array(r["v"], np.int64).reshape(parts, -1))
    return {dim: np.stack(books, axis=1) for dim, books in found.items()}


def learn(rows: DataFrame, id_col: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks (parts, entries, width) by length, of staged rows that ``integers`` made.

    Each round the driver gets one row for each entry and component; an entry that nothing falls to stays."""
    context = rows.sparkSession.sparkContext
    books = _start(rows, id_col, entries, parts)

    for _ in range(rounds):
        shared = context.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                for dim, some in _by_length(batch, 0):
                    own, book = _cut(some.column(1), parts), shared.value[dim]
                    index, _ = nearest(own, book)
                    count, total = totals.setdefault(dim, (np.zeros(book.shape[:2], np.int64), np.zeros(book.shape, np.int64)))
                    for p in range(parts):
                        falls = (index[:, p] == np.arange(book.shape[1])[:, None]).astype(np.int64)
                        count[p] += falls.sum(axis=1)
                        total[p] += falls @ own[:, p, :]
            for dim, (count, total) in totals.items():
                p, e, at = (x.ravel() for x in np.indices(total.shape))
                columns = [np.full(p.size, dim), p, e, at, np.broadcast_to(count[:, :, None], total.shape).ravel(), total.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["dim", "part", "entry", "at", "n", "total"])

        merged = rows.select("dim", "v").mapInArrow(sums, "dim long, part long, entry long, at long, n long, total long")
        merged = merged.groupBy("dim", "part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).filter("n > 0")
        after = {dim: book.copy() for dim, book in books.items()}
        for r in merged.collect():
            after[r["dim"]][r["part"], r["entry"], r["at"]] = r["total"] // r["n"]
        shared.unpersist()
        same = all((after[dim] == books[dim]).all() for dim in books)
        books = after
        if same:  # and so would be all that follow
            break
    return books


def digest(book: np.ndarray) -> str:
    """SHA-256 of a length's entries: their components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def encode(rows: DataFrame, books: Codebooks, parts: int = PARTS) -> DataFrame:
    """The rows with ``code`` (two hex digits a part), ``error`` and ``codebooks_sha256`` in place of dim and v."""
    others = [c for c in rows.columns if c not in ("dim", "v")]
    kinds = dict(rows.dtypes)
    shared = rows.sparkSession.sparkContext.broadcast((books, {dim: digest(book) for dim, book in books.items()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, digests = shared.value
        for batch in batches:
            for dim, some in _by_length(batch, len(others)):
                index, error = nearest(_cut(some.column(len(others) + 1), parts), own[dim])
                codes = [bytes(x).hex() for x in index.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([*(some.column(i) for i in range(len(others))), pa.array(codes, pa.string()), pa.array(error.sum(axis=1), pa.int64()), pa.array([digests[dim]] * len(codes), pa.string())], [*others, "code", "error", "codebooks_sha256"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "code string", "error long", "codebooks_sha256 string"])
    return rows.select(*others, "dim", "v").mapInArrow(run, schema)


def decode(coded: DataFrame, books: Codebooks, dim: int, scale: int = SCALE, code_col: str = "code") -> DataFrame:
    """The rows with ``decoded``: the entries of a code put together and scaled back; null for a null code."""
    book = books[dim]
    kinds, others = dict(coded.dtypes), [c for c in coded.columns if c != code_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for code in batch.column(len(others)).to_pylist():
                out.append(None if code is None else (np.concatenate([book[p, e] for p, e in enumerate(bytes.fromhex(code))])[:dim] / scale).tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(others))), pa.array(out, pa.list_(pa.float64()))], [*others, "decoded"])

    return coded.select(*others, code_col).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "decoded array<double>"]))


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every vector that takes part.

    ``label_error`` sums the errors of equal labels, null ones together. The sums, one row a label, are staged
    like the coded rows that they are joined to, so that a label that many rows have can be split."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vector"))
    rows = staged(integers(rows, "vector", scale, parts), "vectors")
    coded = staged(encode(rows, learn(rows, "id", parts, entries, rounds), parts), "codes")
    sums = staged(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "of")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("id", "code", "error", "label_error", "codebooks_sha256")
