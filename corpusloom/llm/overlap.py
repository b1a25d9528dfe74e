"""SimHash near copies beyond its few bits: texts whose sets of five-word shingles have Jaccard similarity 0.8 or more.

SimHash fingerprints of the shingles, joined on the grid of segment bit counts, propose candidates within 3
bits. At similarity 0.8 two fingerprints differ in 10 of 64 bits on average and one pair in a hundred in more
than 16, which no grid can enumerate, so MinHash bands propose the rest; the sets themselves decide. With 32
bands of 5 values a pair at similarity 0.8 shares no band with probability 3e-6, a more similar pair with less.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, small_batches, staged
from .simhash import SEED, _bit_counts, _mark, _packed, _word_blocks, components
from .simhash import links as grid_links

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
#: Shingles that go through all hash functions at once.
AT_ONCE = 1024
#: Bytes of shingle sets that a task compares as one; larger buckets are dealt into cells.
SLICE_BYTES = 4 << 20
#: So many marks of candidates are broadcast at most (8 bytes each); beyond that the join shuffles the texts.
BROADCAST_MARKS = 250_000
_draw = np.random.Generator(np.random.PCG64(SEED))
_TIMES = _draw.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32) | np.uint32(1)
_PLUS = _draw.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32)


def shingles(text: bytes, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles in blocks, A-Z lower-cased; a shorter text is one shingle, also one without words."""
    digest, some, tail = xxhash.xxh64_intdigest, False, []
    for words in _word_blocks(text.lower()):
        words = tail + words
        if len(words) >= size:
            some = True
            yield np.array([digest(b" ".join(row), SEED) for row in zip(*(words[k:] for k in range(size)))], dtype=np.uint64)
        tail = words[-(size - 1) :] if size > 1 else []
    if not some:
        yield np.array([digest(b" ".join(tail), SEED)], dtype=np.uint64)


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    return np.unique(np.concatenate(list(shingles(text, size))))


def sketch(text: bytes, size: int = SHINGLE) -> tuple[int, np.ndarray]:
    """A text's SimHash fingerprint, and one hash for each band of its MinHash signature."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint32).max)
    ones, n = np.zeros(64, dtype=np.int64), 0
    for block in shingles(text, size):
        ones += _bit_counts(block)
        n += len(block)
        block = (block ^ (block >> np.uint64(32))).astype(np.uint32)
        for at in range(0, len(block), AT_ONCE):
            values = block[at : at + AT_ONCE] * _TIMES
            values += _PLUS
            low = np.minimum(low, values.min(axis=1))
    rows = low.reshape(BANDS, ROWS)
    return _packed(ones, n), np.array([xxhash.xxh64_intdigest(rows[b].tobytes(), b) for b in range(BANDS)], dtype=np.uint64).view(np.int64)


def prefix(size: int, similarity: float) -> tuple[int, int]:
    """Of a set's shingles, rarest first: how many must hold one that it shares with a similar set no larger than it, and with one no smaller."""
    return size - math.ceil(similarity * size - 1e-9) + 1, size - math.ceil(2 * similarity / (1 + similarity) * size - 1e-9) + 1


def _linked(marks: list[int], sets: list[np.ndarray], similarity: float) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among a cell's texts.

    Sets meet, the smaller first, where their rarest shingles do: a set's own shingles are its rarest, so that texts of one
    template don't meet by what they all share. Sets already in one group aren't compared."""
    flat, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(flat), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(flat))
    ends = np.cumsum([len(s) for s in sets])
    rows = [np.sort(x) for x in np.split(rank[inverse], ends[:-1])]
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    index: dict[int, dict[int, list[tuple[int, int, int]]]] = {}
    for i in sorted(range(len(sets)), key=lambda k: len(rows[k])):
        own, size, seen = rows[i], len(rows[i]), set()
        probe, kept = prefix(size, similarity)
        for at, h in enumerate(own[:probe].tolist()):
            for group, entries in index.get(h, {}).items():
                if find(group) == find(i):
                    continue
                for other_size, j, place in entries[bisect_left(entries, (similarity * size - 1e-9,)) :]:
                    if j in seen:
                        continue
                    seen.add(j)
                    if min(size - at, other_size - place) < similarity / (1 + similarity) * (size + other_size) - 1e-9:
                        continue  # not enough is left of either behind the first shingle that they share
                    other = rows[j]
                    both = int((own[np.minimum(np.searchsorted(own, other), size - 1)] == other).sum())
                    if both >= similarity * (size + other_size - both) - 1e-9:
                        yield marks[i], marks[j]
                        root[find(i)] = find(j)
                        break
        for place, h in enumerate(own[:kept].tolist()):
            index.setdefault(h, {}).setdefault(find(i), []).append((size, i, place))


def _hash_rows(members: DataFrame) -> DataFrame:
    """(bucket, mark, hash) of members with their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 64):
            sets = [np.frombuffer(x, dtype=np.int64) for x in as_bytes(batch.column(2))]
            again = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(again)), batch.column(1).take(pa.array(again)), pa.array(np.concatenate(sets) if sets else [], pa.int64())], ["bucket", "mark", "hash"])

    return members.select("bucket", "mark", "hashes").mapInArrow(run, "bucket long, mark long, hash long")


def _cells(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(cell, mark): large buckets (bucket, mark) in cells of sets that meet in one of their rarest shingles, smaller with larger."""
    rows = staged(_hash_rows(members.join(sets, "mark")), "hashes")
    often = staged(rows.groupBy("bucket", "hash").agg(F.count("*").alias("often")), "often")
    ordered = rows.join(often, ["bucket", "hash"]).groupBy("bucket", "mark").agg(F.sort_array(F.collect_list(F.struct("often", "hash"))).alias("h"))
    size = F.size("h")
    probe, kept = size - F.ceil(size * similarity - 1e-9) + 1, size - F.ceil(size * (2 * similarity / (1 + similarity)) - 1e-9) + 1
    some = ordered.select("bucket", "mark", kept.alias("kept"), F.posexplode(F.slice("h", F.lit(1), probe.cast("int")))).filter("col.often > 1")
    some = staged(some.select(F.xxhash64("bucket", "col.hash").alias("cell"), "mark", (F.col("pos") < F.col("kept")).alias("indexed")), "prefixes")
    return _different(some, F.max("indexed").alias("met")).select("cell", "mark")


def _different(rows: DataFrame, *more: Column) -> DataFrame:
    """Rows (cell, mark) of cells with two members or more; of cells with the same members one. ``met``, if asked for, must hold."""
    same = [F.bit_xor(F.xxhash64(F.lit(k), "mark")).alias(f"same{k}") for k in (1, 2)]
    cells = rows.groupBy("cell").agg(F.count("*").alias("n"), *same, *(more or [F.lit(True).alias("met")])).filter("n > 1 and met")
    cells = staged(cells.groupBy("n", "same1", "same2").agg(F.min("cell").alias("cell")).select("cell"), "cells")
    return staged(rows.join(cells, "cell", "left_semi"), "members")


def links(docs: DataFrame, nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (u, v) between the marks of similar texts, enough to span each component.

    Buckets with the same texts in them are compared once. A bucket with more than ``SLICE_BYTES`` of sets is dealt into
    cells by its sets' rarest shingles, as a task does within a smaller one. Cells that are still as large, mostly of
    copies, are dealt into slices by mark; every two slices meet in a task of their own."""

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = [shingle_set(text, shingle).tobytes() for text in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["mark", "hashes"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, marks, sets = None, [], []

        def found() -> Iterator[pa.RecordBatch]:
            out = list(_linked(marks, sets, similarity)) if len(marks) > 1 else []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["u", "v"])

        for batch in batches:
            for c, m, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))):
                if c != cell:
                    yield from found()
                    cell, marks, sets = c, [], []
                marks.append(m)
                sets.append(np.frombuffer(s, dtype=np.uint64))
        yield from found()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = _different(nodes.select("mark", F.explode("bands").alias("cell")))
    texts = docs.select(_mark("text").alias("mark"), "text")
    marks = staged(members.select("mark").distinct(), "candidates")
    marks = F.broadcast(marks) if marks.count() <= BROADCAST_MARKS else marks
    wanted = texts.join(marks, "mark", "left_semi")
    sets = staged(wanted.mapInArrow(to_sets, "mark long, hashes binary").dropDuplicates(["mark"]), "sets")
    sizes = sets.select("mark", F.length("hashes").cast("long").alias("bytes"))

    def large(cells: DataFrame) -> DataFrame:
        slices = F.least(F.ceil(F.sum("bytes") / SLICE_BYTES), F.count("*")).alias("slices")
        return staged(cells.join(sizes, "mark").groupBy("cell").agg(slices).filter("slices > 1"), "large-cells")

    buckets = large(members)
    if not buckets.isEmpty():
        dealt = _cells(members.join(buckets, "cell", "left_semi").select(F.col("cell").alias("bucket"), "mark"), sets, similarity)
        members = members.join(buckets, "cell", "left_anti").select("cell", "mark").unionByName(dealt)
        buckets = large(dealt)
    own = F.pmod(F.xxhash64("mark"), F.col("slices"))
    met = F.transform(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1), lambda other: F.xxhash64("cell", F.least(own, other), F.greatest(own, other)))
    cells = F.explode(F.when(F.col("slices").isNull(), F.array("cell")).otherwise(met)).alias("cell")
    cells = members.join(buckets, "cell", "left").select(cells, "mark").join(sets, "mark").select("cell", "mark", "hashes")
    dealt = cells.repartition(parts, "cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(compare, "u long, v long").distinct()


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The documents with one of each near-duplicate group left, that with the smallest doc_id. All columns stay.

    Groups are the components of links at ``similarity`` or more. Texts of fewer than ``shingle`` words are one
    shingle; null and wordless texts are one group. Shared and missing doc_ids are treated as in ``simhash.keep_one``."""
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("text"), _mark("text").alias("mark"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            fps, found = zip(*(sketch(text, shingle) for text in as_bytes(batch.column(1))))
            lists = pa.ListArray.from_arrays(pa.array(range(0, BANDS * len(found) + 1, BANDS), pa.int32()), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps, pa.int64()), lists], ["id", "mark", "fp", "bands"])

    signed = rows.mapInArrow(sign, f"id {dict(rows.dtypes)['id']}, mark long, fp long, bands array<long>")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "mark")).alias("first")
    nodes = staged(signed.groupBy("mark").agg(first, F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands")), "signatures")
    # fingerprints that the grid links, or that are equal, are one more bucket
    near = components(grid_links(nodes.select("fp").distinct())).withColumnRenamed("node", "fp")
    bucket = F.xxhash64(F.coalesce("root", "fp"), F.lit("simhash"))
    nodes = staged(nodes.join(near, "fp", "left").select("mark", "first", F.concat("bands", F.array(bucket)).alias("bands")), "candidates-of")
    roots = components(links(docs, nodes, shingle, similarity)).withColumnRenamed("node", "mark")
    classes = nodes.select("mark", "first").join(roots, "mark", "left").select("first", F.coalesce("root", "mark").alias("root"))
    kept = classes.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.id").alias("_kept_id"), F.col("first.mark").alias("_kept_mark"))
    marked = docs.withColumn("_keep_mark", _mark("text"))
    same = marked["doc_id"].eqNullSafe(kept["_kept_id"]) & (marked["_keep_mark"] == kept["_kept_mark"])
    return marked.join(kept, same, "left_semi").dropDuplicates(["doc_id", "_keep_mark"]).drop("_keep_mark")
