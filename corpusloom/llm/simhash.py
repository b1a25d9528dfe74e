"""SimHash near-duplicates: fingerprints, a grid range-join over segment bit counts, components.

A 64-bit fingerprint is embedded as the bit counts of its segments. Manhattan distance between two such
vectors never exceeds the Hamming distance of the fingerprints. Fingerprints within 3 bits therefore have
one 32-bit half whose vectors are at distance 1 or less; the join enumerates each half's grid cells, one
step around every even point, and compares exactly within a cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import as_bytes, small_batches, staged

MAX_BITS = 3
SEED = 42
#: Rows of a grid cell that are compared as one; larger cells are dealt into slices that meet in pairs.
CELL_ROWS = 1 << 16
#: Pairs compared at once in one task (bytes of scratch memory: about 24 times as many).
PAIRS_AT_ONCE = 2_000_000
#: Bytes of text hashed at once; longer texts are walked in such steps.
STEP = 1 << 20


def _word_blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in blocks, cut at white space, so that a very long text needs little memory."""
    at = 0
    while at < len(text):
        end = at + STEP
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield text[at:end].split()
        at = end


def _bit_counts(hashes: list[int] | np.ndarray) -> np.ndarray:
    return np.unpackbits(np.asarray(hashes, dtype=np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _packed(ones: np.ndarray, n: int) -> int:
    """The bits that over half of n hashes set, as a signed integer."""
    bits = np.packbits(2 * ones > n, bitorder="little") if n else np.zeros(8, dtype=np.uint8)
    return int(bits.view("<i8")[0])


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Fingerprint of one text as a signed 64-bit integer: A-Z lower-cased, a bit set if over half the shingles' hashes set it."""
    digest = xxhash.xxh64_intdigest
    ones, n, tail = np.zeros(64, dtype=np.int64), 0, []
    for words in _word_blocks(text.lower()):
        words = tail + words
        if len(words) >= shingle:
            rows = zip(*(words[k:] for k in range(shingle)))
            hashes = [digest(b" ".join(row), SEED) for row in rows]
            ones += _bit_counts(hashes)
            n += len(hashes)
        tail = words[-(shingle - 1) :] if shingle > 1 else []
    if not n and tail:
        ones, n = _bit_counts([digest(b" ".join(tail), SEED)]), 1
    return _packed(ones, n)


def _mark(text_col: str) -> Column:
    """A digest that tells apart the texts of rows that share an id, or have none."""
    return F.xxhash64(F.coalesce(text_col, F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp, mark) for each row; null and wordless texts get fingerprint 0. Other columns are not read."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _mark(text_col).alias("mark"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            fps = [fingerprint(text, shingle) for text in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), batch.column(2)], ["id", "fp", "mark"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, fp long, mark long")


def _cells(fps: np.ndarray, segment_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, cell and whether the cell is the row's own, for both halves of each fingerprint."""
    n_seg, width = 32 // segment_bits, int(segment_bits).bit_length()
    rows, cells, home = [], [], []
    index = np.arange(len(fps))
    for half in (0, 1):
        part = (fps >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        counts = [np.bitwise_count((part >> np.uint64(s * segment_bits)) & np.uint64((1 << segment_bits) - 1)).astype(np.int64) for s in range(n_seg)]
        own = np.full(len(fps), half, dtype=np.int64) << np.int64(62)
        for s, c in enumerate(counts):
            own |= c << np.int64(s * width)
        rows.append(index)
        cells.append(own)
        home.append(np.ones(len(fps), dtype=bool))
        even = np.bitwise_count(part) % 2 == 0  # cells one step apart differ in parity: the even point visits the odd one
        for s, c in enumerate(counts):
            for step in (-1, 1):
                goes = even & (c + step >= 0) & (c + step <= segment_bits)
                rows.append(index[goes])
                cells.append(own[goes] + np.int64(step * (1 << (s * width))))
                home.append(np.zeros(goes.sum(), dtype=bool))
    return np.concatenate(rows), np.concatenate(cells), np.concatenate(home)


def _contract(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest index of each of n nodes' component under the links a-b, starting from earlier labels."""
    label = np.arange(n) if label is None else label
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, label):
            return label
        label = new


def _links_in_cells(cell: np.ndarray, fp: np.ndarray, home: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links found within cells: pairs of fingerprints, at most one per row.

    Rows come sorted by cell. All pairs of a cell with a home row are compared, in blocks; only what a
    forest needs is kept, so a dense cell gives as many links as it has rows."""
    n = len(cell)
    nodes, node = np.unique(fp, return_inverse=True)
    label = np.arange(len(nodes))
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[starts, n])
    size_of = np.repeat(sizes, sizes)
    ends = np.repeat(starts + sizes, sizes)
    small = np.flatnonzero(size_of <= 128)
    distance = 1
    while len(small := small[small + distance < ends[small]]):
        for at in range(0, len(small), PAIRS_AT_ONCE):
            i = small[at : at + PAIRS_AT_ONCE]
            j = i + distance
            near = (np.bitwise_count(fp[i] ^ fp[j]) <= max_bits) & (home[i] | home[j]) & (label[node[i]] != label[node[j]])
            if near.any():
                label = _contract(len(nodes), node[i[near]], node[j[near]], label)
        distance += 1
    for s, size in zip(starts[sizes > 128], sizes[sizes > 128]):
        own = slice(s, s + size)
        x, h, v = fp[own], home[own], node[own]
        step = max(1, PAIRS_AT_ONCE // size)
        for at in range(0, size, step):
            block = slice(at, at + step)
            near = np.bitwise_count(x[block, None] ^ x[None, :]) <= max_bits
            near &= (h[block, None] | h[None, :]) & (label[v[block]][:, None] != label[v][None, :])
            i, j = np.nonzero(near)
            if len(i):
                label = _contract(len(nodes), v[block][i], v[j], label)
    out = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[out], nodes[label[out]]


def links(distinct: DataFrame, max_bits: int = MAX_BITS, segment_bits: int = 2) -> DataFrame:
    """Links (u, v) between the distinct fingerprints ``fp`` within ``max_bits``, enough to span each component.

    ``segment_bits`` (1, 2, 4 or 8) sets the grid's resolution: narrower segments give more, smaller cells.
    Any width gives the same components. A cell of more than ``CELL_ROWS`` rows is dealt into slices by
    fingerprint; every two slices meet in a task of their own, so no task holds a whole large cell."""
    if max_bits > MAX_BITS:
        raise ValueError("the half with distance 1 or less exists for 3 bits or fewer")

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 8192):
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            row, cell, home = _cells(fps.view(np.uint64), segment_bits)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fps[row]), pa.array(home)], ["cell", "fp", "home"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def found(parts: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            u, v = _links_in_cells(parts[0], parts[1].view(np.uint64), parts[2], max_bits)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)))
            rows += batch.num_rows
            if rows < 500_000 or held[0][0][0] == held[-1][0][-1]:
                continue  # a cell may go on in the next batch
            parts = tuple(np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(parts[0], parts[0][-1]))
            yield from found(tuple(x[:cut] for x in parts))
            held, rows = [tuple(x[cut:] for x in parts)], len(parts[0]) - cut
        if rows:
            yield from found(tuple(np.concatenate(x) for x in zip(*held)))

    spark = distinct.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    points = distinct.select("fp").mapInArrow(embed, "cell long, fp long, home boolean")
    large = staged(points.groupBy("cell").agg(F.ceil(F.count("*") / CELL_ROWS).alias("slices")).filter("slices > 1"), "large-cells")
    # a digest names each pair of slices; where two collide their rows are compared as well, which finds only true links
    own = F.pmod(F.xxhash64("fp"), F.col("slices"))
    met = F.transform(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1), lambda other: F.xxhash64("cell", F.least(own, other), F.greatest(own, other)))
    cells = F.explode(F.when(F.col("slices").isNull(), F.array("cell")).otherwise(met)).alias("cell")
    points = points.join(large, "cell", "left").select(cells, "fp", "home")
    dealt = points.repartition(parts, "cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(join, "u long, v long").distinct()


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int, segment_bits: int) -> tuple[DataFrame, DataFrame]:
    """Staged (id, fp, mark) of each row, and (fp, root, first) of each fingerprint: first is the row with the smallest id on it, nulls last."""
    fps = staged(fingerprints(docs, id_col, text_col, shingle), "simhash")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "mark")).alias("first")
    distinct = staged(fps.groupBy("fp").agg(first), "distinct")
    roots = components(links(distinct, max_bits, segment_bits)).withColumnRenamed("node", "fp")
    return fps, staged(distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = MAX_BITS, segment_bits: int = 2) -> DataFrame:
    """One row per document: (id, fp, component_id), component_id the smallest id reachable over links.

    Fingerprints link at ``max_bits`` differing bits or fewer. Nulls: a null or wordless text has
    fingerprint 0 and links like any other; a null id takes part, but never names a component unless all
    ids of it are null. Repeated rows come back as often as they came. Ties: none, the smallest id is unique."""
    fps, classes = _classes(docs, id_col, text_col, shingle, max_bits, segment_bits)
    named = staged(classes.groupBy("root").agg(F.min("first").alias("first")), "named")
    named = classes.select("fp", "root").join(named, "root").select("fp", F.col("first.id").alias("component_id"))
    return fps.join(named, "fp").select("id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = MAX_BITS, segment_bits: int = 2) -> DataFrame:
    """The documents with one of each near-duplicate group left, that with the smallest doc_id. All columns stay.

    Of rows that share that doc_id within a group one stays. A row without doc_id stays only if no row of its
    group has one, and then a single one for each such group."""
    _, classes = _classes(docs, "doc_id", "text", shingle, max_bits, segment_bits)
    kept = classes.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.id").alias("_kept_id"), F.col("first.mark").alias("_kept_mark")).distinct()
    marked = docs.withColumn("_keep_mark", _mark("text"))
    same = marked["doc_id"].eqNullSafe(kept["_kept_id"]) & (marked["_keep_mark"] == kept["_kept_mark"])
    return marked.join(kept, same, "left_semi").dropDuplicates(["doc_id", "_keep_mark"]).drop("_keep_mark")
