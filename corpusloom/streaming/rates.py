"""Windowed rates over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import new_folder


def windowed_rates(events: DataFrame, window: str = "1 day", late: str = "2 days", above: float = 50) -> DataFrame:
    """(day, event_type, n, rate) by tumbling window; rows later than the watermark allows are dropped by the stream."""
    hit = F.when(F.col("value") > above, 1.0).otherwise(0.0)
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))  # zone-less times count as the session's
    groups = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return groups.agg(F.count("*").alias("n"), F.round(F.avg(hit), 6).alias("rate")).select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "rate")


def daily_rates(spark: SparkSession, path: str) -> DataFrame:
    """Stream the file at ``path`` to its end in complete mode and return the last result of the sink."""
    schema = spark.read.parquet(path).schema
    # a path is watched as a folder: its one file is picked out by name
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    out, state = new_folder(spark, "rates"), new_folder(spark, "rates-state")

    def keep(df: DataFrame, _: int) -> None:
        df.write.mode("overwrite").parquet(out)

    windowed_rates(stream).writeStream.outputMode("complete").option("checkpointLocation", state).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)
