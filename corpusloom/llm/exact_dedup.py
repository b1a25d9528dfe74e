"""Exact dedup by composable polynomial fingerprints, confirmed chunk by chunk.

A text's bytes (A-Z lower-cased) are 32-bit limbs w_0 .. w_n-1, the last padded with zeros; its fingerprint
is sum(w_i * B^(n-1-i)) mod 2^61-1. Chunks hash on their own: H(ab) = H(a) * B^len(b) + H(b). Texts that
share fingerprint and length are compared byte for byte, chunk for chunk, before they count as equal.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import CHUNK_BYTES, split_huge, streamed_sha256
from .common import LISTED, as_bytes, listed, small_batches, staged

P = (1 << 61) - 1
BASE = 0x1B873593A5C3E1D7 % P
LIMBS = 1 << 14
#: Bytes compared at once when equal fingerprints are confirmed.
COMPARE_BYTES = 1 << 16
#: Chunks that are sent on at once for that.
COMPARE_ROWS = 256
#: So many ids of candidates are broadcast at most (8 bytes each); beyond that the join shuffles.
BROADCAST_IDS = 250_000
_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)


def _powers() -> tuple[np.ndarray, np.ndarray]:
    out = [1]
    for _ in range(LIMBS - 1):
        out.append(out[-1] * BASE % P)
    power = np.array(out[::-1], dtype=np.uint64)
    return power & _LOW, power >> _HALF


_POWERS: list = []


def _total(products: np.ndarray) -> int:
    return int((products & _LOW).sum()) + (int((products >> _HALF).sum()) << 32)


def chunk_hash(data: bytes, before: int = 0) -> int:
    """Fingerprint of ``before``'s text followed by ``data``; every part but the last must hold whole limbs."""
    if not _POWERS:
        _POWERS.append(_powers())
    low, high = _POWERS[0]
    if len(data) % 4:
        data += b"\0" * (-len(data) % 4)
    limbs = np.frombuffer(data, dtype="<u4")
    for at in range(0, len(limbs), LIMBS):
        w = limbs[at : at + LIMBS].astype(np.uint64)
        n = len(w)
        own = _total(w * low[LIMBS - n :]) + (_total(w * high[LIMBS - n :]) << 32)
        before = (before * pow(BASE, n, P) + own) % P
    return before


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, fp, n_bytes, sha256) for each row, of the text with A-Z lower-cased; null counts as empty. Also the staged fingerprints
    (rid, id, fp, n_bytes, sha256) of huge texts, and their staged chunks."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    short, chunks = split_huge(rows, chunk_bytes)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            fps, sizes, shas = [], [], []
            for text in as_bytes(batch.column(1)):
                text = text.lower()
                fps.append(chunk_hash(text))
                sizes.append(len(text))
                shas.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), pa.array(shas)], ["id", "fp", "n_bytes", "sha256"])

    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 4):
            out = []
            for k, n, chunk in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), as_bytes(batch.column(3))):
                after = -(-n // 4) - -(-min(n, (k + 1) * chunk_bytes) // 4)  # limbs that follow the chunk
                out.append(chunk_hash(chunk.lower()) * pow(BASE, after, P) % P)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], ["rid", "part"])

    if chunk_bytes % 4:
        raise ValueError("chunk_bytes must be a multiple of 4")
    done = short.mapInArrow(whole, f"id {kind}, fp long, n_bytes long, sha256 string")
    parts = chunks.select("rid", "k", "n_bytes", "chunk").repartition("rid", "k").mapInArrow(shifted, "rid long, part long")
    joined = parts.groupBy("rid").agg((F.sum(F.col("part").cast("decimal(38,0)")) % F.lit(P).cast("decimal(20,0)")).cast("long").alias("fp"))
    heads = chunks.filter("k = 0").select("rid", "id", "n_bytes")
    long = staged(heads.join(joined, "rid").join(streamed_sha256(chunks), "rid").select("rid", "id", "fp", "n_bytes", "sha256"), "long")
    return done.unionByName(long.drop("rid")), long, chunks


def _collisions(docs: DataFrame, slim: DataFrame, groups: DataFrame, long: DataFrame, chunks: DataFrame, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """(fp, n_bytes) of groups whose texts differ in some piece; huge texts are compared by their staged chunks."""
    several = groups.filter("group_size > 1").select("fp", "n_bytes")
    ids = staged(slim.filter(F.col("n_bytes") <= chunk_bytes).join(several, ["fp", "n_bytes"], "left_semi").select("id").distinct(), "candidates")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= chunk_bytes)
    rows = rows.join(ids, rows["id"].eqNullSafe(ids["id"]), "left_semi").select("text")
    pieces = max(-(-chunk_bytes // COMPARE_BYTES), 1)

    def send(found: Iterator[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["fp", "n_bytes", "k", "chunk"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        out: list[tuple[int, int, int, bytes]] = []
        for row in found:
            out.append(row)
            if len(out) >= COMPARE_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names)

    def cut(text: bytes) -> Iterator[tuple[int, bytes]]:
        for k in range(max(-(-len(text) // COMPARE_BYTES), 1)):
            yield k, text[k * COMPARE_BYTES : (k + 1) * COMPARE_BYTES]

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[int, int, int, bytes]]:
            for batch in small_batches(batches, 64):
                for text in map(bytes.lower, as_bytes(batch.column(0))):
                    fp = chunk_hash(text)
                    yield from ((fp, len(text), k, piece) for k, piece in cut(text))

        return send(found())

    def huge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[int, int, int, bytes]]:
            for batch in small_batches(batches, 4):
                for fp, n, at, chunk in zip(*(batch.column(i).to_pylist() for i in range(3)), as_bytes(batch.column(3))):
                    yield from ((fp, n, at * pieces + k, piece) for k, piece in cut(chunk.lower()))

        return send(found())

    schema = "fp long, n_bytes long, k long, chunk binary"
    common = staged(long.join(several, ["fp", "n_bytes"], "left_semi").select("rid", "fp", "n_bytes"), "common")
    own = chunks.select("rid", "k", "chunk").join(common, "rid").select("fp", "n_bytes", F.col("k").cast("long"), "chunk")
    chunks = rows.mapInArrow(short, schema).unionByName(own.mapInArrow(huge, schema))
    # equal chunks fold on the map side: a group of any size sends one row a task and chunk
    return chunks.groupBy("fp", "n_bytes", "k").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).filter("a <> b").select("fp", "n_bytes").distinct()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, stretch: int = LISTED) -> DataFrame:
    """One row per document: (id, keep_id, group_size, kept, sha256), sha256 that of the normalised text.

    Equal texts are those identical after lower-casing A-Z; the largest id of a group stays. Null texts are
    empty texts. A null id is smaller than any other. Where rows repeat with the id that stays, one of them
    is kept; rows that repeat more than ``stretch`` times are listed by several tasks. Very long texts are hashed and
    compared in chunks over many tasks."""
    prints, long, chunks = fingerprints(docs, id_col, text_col, chunk_bytes)
    slim = staged(prints.groupBy("id", "fp", "n_bytes", "sha256").agg(F.count("*").alias("n")), "fingerprints")

    def grouped(*key: str) -> DataFrame:
        # staged, so that a join reads it like any table and can split a large group
        return staged(slim.groupBy(*key).agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size")), "groups")

    key = ["fp", "n_bytes"]
    groups = grouped(*key)
    differ = staged(_collisions(docs, slim, groups, long, chunks, id_col, text_col, chunk_bytes), "collisions")
    if not differ.isEmpty():  # texts of one fingerprint that differ are told apart by their digests as well
        differ = differ.withColumn("hit", F.lit(True))
        slim = slim.join(differ, key, "left").withColumn("apart", F.when(F.col("hit"), F.col("sha256")).otherwise("")).drop("hit")
        key = [*key, "apart"]
        groups = grouped(*key)
    rows = listed(slim, "n", "i", "id", *key, stretch=stretch).join(groups, key)
    return rows.select("id", "keep_id", "group_size", ((F.col("i") == 0) & F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"), "sha256")


def drop_copies(docs: DataFrame, **how) -> DataFrame:
    """The documents that stay, with all their columns: one of each group of equal texts.

    Rows that share a doc_id, or have none, are told apart by their texts."""
    kept = exact_groups(docs, **how).filter("kept").select(F.col("id").alias("_kept_id"), F.col("sha256").alias("_kept_sha"))
    lower = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    marked = docs.withColumn("_sha", F.sha2(lower.cast("binary"), 256))
    same = marked["doc_id"].eqNullSafe(kept["_kept_id"]) & (marked["_sha"] == kept["_kept_sha"])
    return marked.join(kept, same, "left_semi").dropDuplicates(["doc_id", "_sha"]).drop("_sha")
