"""From raw documents to token digests: filter by quality, drop exact and near copies, mix the sources, encode.

``documents`` and ``labels`` are read from the same folder. A stage gets what the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import bpe, exact_dedup, mixing, overlap, quality
from corpusloom.llm.common import new_folder, remove, scope
from corpusloom.llm.queries import vocabulary
from corpusloom.session import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It is fitted on labelled documents among ``docs``."""
    ship(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model).select(*COLUMNS)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    ship(spark)
    return exact_dedup.drop_copies(docs).select(*COLUMNS)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays.

    SimHash fingerprints of five-word shingles propose pairs on the grid, bands those beyond its 3 bits; a
    similarity of 0.8 or more between the whole sets confirms them."""
    ship(spark)
    return overlap.keep_one(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    ship(spark)
    return mixing.remix(docs, weights=(3, 1, 2), share=1.5, cap=2.0).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens and digests of ids and decoded bytes of every document that is left."""
    ship(spark)
    return bpe.digests(docs, *vocabulary()).withColumnRenamed("id", "doc_id")


STAGES = [("quality", keep_quality), ("exact_dedup", drop_exact), ("near_dedup", drop_near), ("mixing", mix_sources), ("bpe", tokens)]

#: Fingerprints, seeded draws and merges aren't SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet to the shared folder and read again by the next.

    What a stage has staged, and what it has read, is removed once its result is written."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        read, path = path, new_folder(spark, f"pipeline-{name}")
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if read:
            remove(spark, read)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
