"""Packing token units into fixed-length samples, labels and token accounts."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Mapping, Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

IGNORE = -100
LOOKAHEAD = 100
#: Tokens of a shard, about: one is packed in a second or two.
SHARD_TOKENS = 1 << 20


def char_tokens(text: Column) -> Column:
    """Code points of a text, the default tokenizer."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))


def truncated(tokens: Column, seq_len: int, cut: bool = True) -> Column:
    """At most seq_len - 1 tokens, so that a separator fits behind; with ``cut`` off, longer ones become null."""
    return F.when(F.size(tokens) <= seq_len - 1, tokens).otherwise(F.slice(tokens, 1, seq_len - 1) if cut else F.lit(None))


def finalize(tokens: Column, seq_len: int, pad: int) -> Column:
    """A sample of seq_len tokens: the unit, a separator (the pad token) and padding."""
    return F.concat(tokens, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(seq_len) - F.size(tokens))))


def labels(sample: Column, real_length: Column) -> Column:
    """Each position's next token; the last one, and all from the last real token on, are ignored."""
    nxt = F.concat(F.slice(sample, F.lit(2), F.greatest(F.size(sample) - 1, F.lit(0))), F.array(F.lit(IGNORE)))
    return F.transform(nxt, lambda x, i: F.when(i >= real_length - 1, F.lit(IGNORE)).otherwise(x))


def trailing(sample: Column, pad: int) -> Column:
    """Length of the run of pad tokens at the end."""
    last = F.aggregate(F.transform(sample, lambda x, i: F.when(x != pad, i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
    return F.size(sample) - last


def running_total(df: DataFrame, order: list[str], value: str) -> DataFrame:
    """``start`` and ``stop`` of each row's stretch when all values are laid end to end in order: sums of earlier ranges plus the own range's."""
    dealt = staged(df.repartitionByRange(*order, F.xxhash64(*order)).withColumn("_part", F.spark_partition_id()), "total")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range
    offsets = dealt.groupBy("_part").agg(F.sum(value).alias("_s")).withColumn("_offset", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    within = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.join(F.broadcast(offsets), "_part").withColumn("stop", F.col("_offset") + within).withColumn("start", F.col("stop") - F.col(value)).drop("_part", "_offset")


def pack_chunks(units: DataFrame, order: list[str], seq_len: int, drop_last: bool = False) -> DataFrame:
    """(block, *order, from, to): units laid end to end and cut into blocks of seq_len + 1 tokens; ``from`` and ``to`` within the unit.

    The last block may be short, or is left out with ``drop_last``; a sample is its first seq_len tokens, the labels its last."""
    size = seq_len + 1
    laid = running_total(units, order, "n_tokens").filter("n_tokens > 0")
    if drop_last:
        whole = staged(laid.agg(F.floor(F.coalesce(F.max("stop"), F.lit(0)) / size).alias("_blocks")), "blocks").first()["_blocks"]
        laid = laid.filter(F.col("start") < whole * size).withColumn("stop", F.least("stop", F.lit(whole * size)))
    cut = laid.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("stop") - 1) / size))))
    return cut.select("block", *order, (F.greatest("start", F.col("block") * size) - F.col("start")).alias("from"), (F.least("stop", (F.col("block") + 1) * size) - F.col("start")).alias("to"))


def chunk_pairs(units: DataFrame, order: list[str], tokens: str, seq_len: int) -> DataFrame:
    """(block, x, y): the inputs and next tokens of every full block of seq_len + 1 tokens; what is left at the end is dropped.

    A unit's tokens go to the blocks that hold some of them, a slice to each."""
    rows = staged(units.select(*order, tokens, F.size(tokens).cast("long").alias("n_tokens")).filter("n_tokens > 0"), "tokens")
    pieces = pack_chunks(rows.select(*order, "n_tokens"), order, seq_len, drop_last=True)
    cut = pieces.join(rows, order).select("block", *order, F.slice(tokens, (F.col("from") + 1).cast("int"), (F.col("to") - F.col("from")).cast("int")).alias("_t"))
    whole = cut.groupBy("block").agg(F.sort_array(F.collect_list(F.struct(*order, "_t"))).alias("_p")).select("block", F.flatten(F.col("_p._t")).alias("_b"))
    return whole.select("block", F.slice("_b", 1, seq_len).alias("x"), F.slice("_b", 2, seq_len).alias("y"))


class BestFit:
    """Bins of ``capacity`` tokens: of the first ``lookahead`` waiting units the one that leaves least room goes in, the first of equals."""

    def __init__(self, capacity: int, lookahead: int = LOOKAHEAD):
        self.capacity, self.lookahead = capacity, lookahead
        self.waiting: deque[tuple[int, int]] = deque()
        self.bin: list[int] = []
        self.used = self.number = 0

    def add(self, unit: int, size: int) -> Iterator[tuple[int, list[int], int]]:
        """Take a unit whose size includes its separator; yields the bins (number, units, used) that this completes."""
        if size <= self.capacity:  # longer ones never fit: they are left out
            self.waiting.append((unit, size))
        while len(self.waiting) > self.lookahead:
            yield from self.step()

    def step(self) -> Iterator[tuple[int, list[int], int]]:
        room, best, left = self.capacity - self.used, -1, None
        for k, (_, size) in enumerate(self.waiting):
            if k >= self.lookahead:
                break
            if size <= room and (left is None or room - size < left):
                best, left = k, room - size
                if not left:
                    break
        if best < 0:
            yield self.close()
            return
        unit, size = self.waiting[best]
        del self.waiting[best]
        self.bin.append(unit)
        self.used += size

    def close(self) -> tuple[int, list[int], int]:
        out = (self.number, self.bin, self.used)
        self.bin, self.used, self.number = [], 0, self.number + 1
        return out

    def finish(self) -> Iterator[tuple[int, list[int], int]]:
        while self.waiting:
            yield from self.step()
        if self.bin:
            yield self.close()


def shards_for(units: DataFrame) -> int:
    """How many shards units (with n_tokens) are dealt into: by their tokens alone, so that bins don't depend on the cluster."""
    return max(1, -(-(units.agg(F.sum("n_tokens")).first()[0] or 0) // SHARD_TOKENS))


def pack_best_fit(units: DataFrame, unit: str, order: str, seq_len: int, shards: int, lookahead: int = LOOKAHEAD, by: Column | None = None) -> DataFrame:
    """(shard, bin, units, used): units (with n_tokens) packed into samples of seq_len, each unit followed by a separator.

    ``by`` says the shard of a unit, otherwise a hash of it does.

    Shards are packed apart, so their number is the parallelism and should grow with the input (``shards_for``). A task
    streams a shard's units in order and holds ``lookahead`` of them and one bin."""
    own = F.pmod(F.xxhash64(unit), F.lit(shards)) if by is None else by
    dealt = units.select(own.cast("int").alias("shard"), F.col(order).alias("o"), F.col(unit).cast("long").alias("unit"), (F.col("n_tokens") + 1).cast("long").alias("size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, packer = None, None

        def out(shard: int, bins: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard] * len(bins), pa.int32()), pa.array([b[0] for b in bins], pa.int64()), pa.array([b[1] for b in bins], pa.list_(pa.int64())), pa.array([b[2] for b in bins], pa.int64())], ["shard", "bin", "units", "used"])

        for batch in batches:
            bins: list = []
            for shard, unit_id, size in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                if shard != at:
                    if packer:
                        yield out(at, bins + list(packer.finish()))
                        bins = []
                    at, packer = shard, BestFit(seq_len, lookahead)
                bins.extend(packer.add(unit_id, size))
            if bins:
                yield out(at, bins)
        if packer:
            yield out(at, list(packer.finish()))

    return dealt.repartition("shard").sortWithinPartitions("shard", "o", "unit").mapInArrow(run, "shard int, bin long, units array<long>, used long")


def accounts(bins: DataFrame, seq_len: int) -> DataFrame:
    """Samples, items, tokens, padding and utilisation of (items, used) bins."""
    total = F.count("*") * seq_len
    return bins.agg(F.count("*").alias("samples"), F.sum("items").alias("items"), F.sum("used").alias("tokens"), (total - F.sum("used")).alias("padding"), F.round(F.sum("used") / total, 6).alias("utilization"))


def extrapolate(sampled: int, valid: int, lines: int, per_sample: float, batch: int, seq_len: int) -> dict[str, float]:
    """What a sample says of all lines: valid ones, samples, batches, tokens."""
    ratio = valid / sampled if sampled else 0.0
    valid_lines = int(lines * ratio)
    samples = int(valid_lines / per_sample) if per_sample else 0
    return {"valid_ratio": ratio, "valid_lines": valid_lines, "samples": samples, "batches": -(-samples // batch), "tokens": samples * seq_len}


def check_bytes(sample: DataFrame, whole: DataFrame) -> DataFrame:
    """One row: bytes that a sample of lines (``lines``, ``n_bytes``) leads to expect of the whole, what there are, and the difference, also in percent; null where nothing counts."""
    s = sample.agg(F.sum("lines").alias("_sl"), F.sum("n_bytes").alias("_sb"))
    w = whole.agg(F.sum("lines").alias("_wl"), F.sum("n_bytes").alias("_wb"))
    expected = F.nullif(F.col("_sb"), F.lit(0)) * (F.nullif(F.col("_wl"), F.lit(0)) / F.nullif(F.col("_sl"), F.lit(0)))
    out = s.crossJoin(w).select(expected.alias("expected_bytes"), F.nullif("_wb", F.lit(0)).cast("double").alias("actual_bytes"))  # two single rows
    return out.withColumn("difference", F.abs(F.col("expected_bytes") - F.col("actual_bytes"))).withColumn("difference_pct", 100 * F.col("difference") / F.col("actual_bytes"))


def special_token(ids: Mapping[str, int], named: int | None = None, fallbacks: Sequence[str | None] = ()) -> int | None:
    """A special token's id: the one named, else that of the first fallback text that the vocabulary has."""
    if named is not None:
        return int(named)
    return next((ids[t] for t in fallbacks if t and ids.get(t, -1) >= 0), None)


def separator(ids: Mapping[str, int], token: str = "<|endoftext|>") -> int:
    """The id that separates units and pads samples: one token for both, which must be there."""
    found = special_token(ids, fallbacks=(token,))
    if found is None:
        raise ValueError(f"the vocabulary has no {token}")
    return found


def sampled(values: Column, n: int, seed: int) -> Column:
    """At most ``n`` of an array's values, drawn by a seeded digest without replacement; the array itself if it is short enough, empty if ``n`` is 0 or less."""
    drawn = F.array_sort(F.transform(values, lambda x, i: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), i.cast("string"), x.cast("string"))).alias("k"), x.alias("x"))))
    return F.when(F.size(values) <= n, values).otherwise(F.transform(F.slice(drawn, 1, max(n, 0)), lambda s: s["x"]))


def sample_rows(df: DataFrame, key: str, value: str, n: int, seed: int) -> DataFrame:
    """At most ``n`` rows of each key, those whose values have the smallest seeded digests, with their ``place`` (from 1) by these.

    Each task sends on ``n`` rows a key at most, however many it has; equal values are told apart by nothing and share a chance."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(value).cast("string")))
    by = Window.partitionBy(key).orderBy("_digest", value)
    return df.withColumn("_digest", digest).withColumn("place", F.row_number().over(by)).filter(F.col("place") <= n).drop("_digest")


def vocabulary_tokens(units: DataFrame, path: str, pattern: str, text: str = "unit", out: str = "tokens") -> DataFrame:
    """The rows with ``out``: token ids of a text by a public rank file (lines of base64 bytes and rank) and its split pattern, special tokens aside; null for a null text.

    The file is read once in each worker; its path must lead there on all of them."""
    others = list(units.columns)
    kinds = dict(units.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path, pattern).encode_ordinary
        for batch in batches:
            ids = [None if t is None else encode(t) for t in batch.column(others.index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*others, out])

    return units.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in others), f"`{out}` array<int>"]))


@cache
def _encoding(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def combined_seed(*candidates: object) -> int:
    """One 64-bit seed of all candidates that are whole numbers (or say one): each multiplies what came before and is added."""
    seed = 0
    for value in candidates:
        try:
            seed = (seed * 6364136223846793005 + int(value)) % (1 << 64)
        except (TypeError, ValueError):
            continue
    return seed
