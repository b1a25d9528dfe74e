"""Counters of a running job: observed on the pass that is made anyway, kept once a batch."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def observed(df: DataFrame, name: str, counters: Mapping[str, Column]) -> tuple[DataFrame, Observation]:
    """The same rows, and an observation whose ``get`` has the counters (aggregates) once an action has read all of them."""
    seen = Observation(name)
    return df.observe(seen, *(c.alias(k) for k, c in counters.items())), seen


def keep_metrics(spark: SparkSession, path: str, batch: int, values: Mapping[str, object]) -> None:
    """One row of a batch's counters in a folder of its own: a batch that is run again takes its own place."""
    row = spark.createDataFrame([tuple(float(v) if v is not None else None for v in values.values())], ", ".join(f"`{k}` double" for k in values))
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def counted(stream: DataFrame, work: Callable[[DataFrame, int], None], counters: Mapping[str, Column], path: str, checkpoint: str, every: int = 1, **trigger: object) -> StreamingQuery:
    """Start ``work(rows, batch)`` on every batch of a stream and keep the counters of every ``every``-th under ``path``.

    ``work`` must run one action over all of the rows, and give the same result when a batch comes again, as a write in
    the batch's name does. The counters come from that action: nothing is read twice."""
    spark = stream.sparkSession

    def step(rows: DataFrame, batch: int) -> None:
        rows, seen = observed(rows, f"batch-{batch}", counters)
        work(rows, batch)
        if batch % every == 0:
            keep_metrics(spark, path, batch, seen.get)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """(batch, counters) as kept, a row a batch."""
    return spark.read.parquet(path)


def totals(spark: SparkSession, path: str, counts: list[str]) -> DataFrame:
    """Sums of counters over all batches, and the number of these."""
    return metrics(spark, path).agg(F.count("*").alias("batches"), *(F.sum(c).alias(c) for c in counts))
