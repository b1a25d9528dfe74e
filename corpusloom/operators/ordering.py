"""Global order without a single task: positions, shards, chunks, seeded shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged


def global_index(df: DataFrame, *order: str, out: str = "idx") -> DataFrame:
    """Position of each row (from 0) in the order of the named columns, which must tell rows apart.

    Rows are range-partitioned and staged, so that the ranges stay what they are; a row's position is the
    number of rows in earlier ranges plus its place in its own."""
    spread = F.xxhash64(*order)
    dealt = staged(df.repartitionByRange(*order, spread).withColumn("_part", F.spark_partition_id()), "order")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each range
    offsets = dealt.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_offset") + within).drop("_part", "_offset")


def shuffle_key(seed: int, epoch: int, key: Column) -> Column:
    """A text by which rows are in random order, the same for a seed and epoch wherever they are computed."""
    return F.md5(F.concat(F.lit(f"{seed}:{epoch}:"), key.cast("string")))


def shards(idx: Column, world: int, workers: int) -> tuple[Column, Column]:
    """Rank and worker of a position: every world-th row, then every workers-th of those."""
    return F.pmod(idx, F.lit(world)).cast("int"), F.pmod(F.floor(idx / world), F.lit(workers)).cast("int")


def chunk(idx: Column, size: int) -> Column:
    return F.floor(idx / size)


def chunk_length(n: int, workers: int) -> int:
    """Length of the chunks that deal n rows to workers: at least 1, at most n."""
    return min(max(1, -(-n // max(workers, 1))), max(n, 1))
