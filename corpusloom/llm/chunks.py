"""Whole texts in byte chunks: short documents stay one row, huge ones are spread over many tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, staged

#: Documents of more bytes than this are cut into chunks of so many bytes.
CHUNK_BYTES = 4 << 20


def split_huge(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(id, text) of short documents, and staged chunks (rid, id, k, n_bytes, chunk) of huge ones.

    ``rid`` tells rows apart even where ids repeat or are null; it is drawn once, as the chunks are staged."""
    n = F.coalesce(F.octet_length("text"), F.lit(0))
    short, huge = docs.filter(n <= chunk_bytes), docs.filter(n > chunk_bytes)
    size = F.octet_length("text")
    tagged = huge.select(F.monotonically_increasing_id().alias("rid"), "id", "text")  # before the explode, which other columns come after
    raw = tagged.select("rid", "id", size.cast("long").alias("n_bytes"), F.col("text").cast("binary").alias("raw"), F.explode(F.sequence(F.lit(0), F.expr(f"cast((octet_length(text) - 1) div {chunk_bytes} as int)"))).alias("k"))
    chunk = F.substring(F.col("raw"), F.col("k") * chunk_bytes + 1, F.lit(chunk_bytes))
    return short, staged(raw.select("rid", "id", "k", "n_bytes", chunk.alias("chunk")), "chunks")


def streamed_sha256(chunks: DataFrame, prepare=bytes.lower) -> DataFrame:
    """(rid, sha256) of the chunks (rid, k, chunk) in order, a chunk at a time in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            for rid, chunk in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                if rid != at:
                    if state:
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([state.hexdigest()])], ["rid", "sha256"])
                    at, state = rid, hashlib.sha256()
                state.update(prepare(chunk))
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([state.hexdigest()])], ["rid", "sha256"])

    dealt = chunks.repartition("rid").sortWithinPartitions("rid", "k").select("rid", "chunk")
    return dealt.mapInArrow(run, "rid long, sha256 string")
