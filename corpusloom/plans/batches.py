"""Queries that deal rows into chunks, batches and shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordering
from ..session import table
from .registry import query

_IDX = "o AS (SELECT doc_id, length(text) AS n, row_number() OVER (ORDER BY md5('7:0:' || doc_id)) - 1 AS idx FROM documents)"


def _indexed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"), ordering.shuffle_key(7, 0, F.col("doc_id")).alias("k"))
    return ordering.global_index(docs, "k", "doc_id")


@query(f"WITH {_IDX} SELECT doc_id, idx, CAST(floor(idx / 100) AS BIGINT) AS chunk FROM o")
def chunk_assign(spark, sf_dir):
    """Files of a hundred shuffled rows each."""
    return _indexed(spark, sf_dir).select("doc_id", "idx", ordering.chunk(F.col("idx"), 100).alias("chunk"))


@query("WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, CAST(greatest(1, least(count(*) OVER (), ceil(count(*) OVER () / 7.0))) AS BIGINT) AS len FROM documents) SELECT idx // len AS chunk, min(idx) AS first_idx, max(idx) + 1 AS stop_idx, count(*) AS n FROM o GROUP BY 1")
def chunk_ranges(spark, sf_dir):
    """Index ranges for seven workers."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    size = ordering.chunk_length(docs.count(), 7)
    idx = ordering.global_index(docs, "doc_id")
    return idx.groupBy(ordering.chunk(F.col("idx"), size).alias("chunk")).agg(F.min("idx").alias("first_idx"), (F.max("idx") + 1).alias("stop_idx"), F.count("*").alias("n"))


@query(f"WITH {_IDX}, b AS (SELECT *, idx // 16 AS batch, idx % 16 AS place FROM o), l AS (SELECT batch, max(n) > 5000 AS cut, count(*) AS size FROM b GROUP BY batch) SELECT doc_id, batch, CAST(CASE WHEN cut AND place >= size // 2 THEN 1 ELSE 0 END AS INT) AS half FROM b JOIN l USING (batch)")
def batch_split(spark, sf_dir):
    """Batches of 16; one that holds a long row is cut in two halves."""
    b = _indexed(spark, sf_dir).withColumn("batch", ordering.chunk(F.col("idx"), 16)).withColumn("place", F.col("idx") % 16)
    long_ = b.groupBy("batch").agg((F.max("n") > 5000).alias("cut"), F.count("*").alias("size"))
    return b.join(long_, "batch").select("doc_id", "batch", F.when(F.col("cut") & (F.col("place") >= F.expr("size div 2")), 1).otherwise(0).alias("half"))


@query(f"WITH {_IDX} SELECT doc_id, CAST(idx % 4 AS INT) AS rank, CAST((idx // 4) % 3 AS INT) AS worker FROM o")
def shard_assign(spark, sf_dir):
    rank, worker = ordering.shards(F.col("idx"), 4, 3)
    return _indexed(spark, sf_dir).select("doc_id", rank.alias("rank"), worker.alias("worker"))
