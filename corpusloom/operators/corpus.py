"""Filters, splits, look-ups and reports over corpus rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged


def first_per_group(df: DataFrame, group: list[str], order: list[Column | str], n: int | None) -> DataFrame:
    """The first ``n`` rows of each group; 0 and None mean all. The limit acts before the shuffle as well."""
    if not n:
        return df
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def first_wins(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value) of the row that comes first for each key; folds before the shuffle, by the key's digest where keys are texts."""
    if dict(df.dtypes)[key] != "string":
        return df.groupBy(key).agg(F.min(F.struct(order, value)).alias("_f")).select(key, F.col(f"_f.{value}").alias(value))
    first = df.groupBy(F.sha2(key, 256).alias("_d")).agg(F.min(F.struct(order, value)).alias("_f"), F.first(key).alias(key))
    return first.select(key, F.col(f"_f.{value}").alias(value))


def stable_mode(df: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    """Most frequent value of each group; ties go to the one seen first."""
    counts = df.groupBy(*group, value).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    return counts.groupBy(*group).agg(F.max(F.struct(F.col("n"), (-F.col("first_seen")).alias("_o"), F.col(value))).alias("_m")).select(*group, F.col(f"_m.{value}").alias(value), F.col("_m.n").alias("n"))


def fallback_lookup(keys: DataFrame, table: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """``value`` by exact name, else by the name with slashes as underscores; null if neither is known. One join: each key asks with both names."""
    asks = F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.col(key).alias("asked")), F.struct(F.lit(1).alias("turn"), F.translate(F.col(key), "/", "_").alias("asked"))))
    asked = keys.select(key, asks.alias("a")).select(key, "a.turn", "a.asked")
    met = asked.join(table.select(F.col(name).alias("asked"), value), "asked", "left")
    found = F.min(F.when(F.col(value).isNotNull(), F.struct("turn", value)))
    return met.groupBy(key).agg(found.alias("_f")).select(key, F.col(f"_f.{value}").alias(value))


def split_of(index: Column) -> Column:
    """train, valid or test by the last digit of an index: 0-7, 8, 9."""
    last = F.pmod(index, F.lit(10))
    return F.when(last <= 7, "train").when(last == 8, "valid").otherwise("test")


def split_rows(rows: DataFrame, place: str, index: DataFrame) -> DataFrame:
    """The rows that an index (split, idx) names, with their split: a place that two splits name comes twice. An entry without a row stops the job."""
    at = index.select("split", F.col("idx").alias("_idx"))
    met = at.join(rows, F.col("_idx") == F.col(place), "left")
    known = F.when(F.col(place).isNotNull(), F.col("split")).otherwise(F.raise_error(F.concat(F.lit("no row at index "), F.coalesce(F.col("_idx").cast("string"), F.lit("null")))))
    return met.withColumn("split", known).select("split", *rows.columns)


def split_report(df: DataFrame, by: list[str], total: bool = False) -> DataFrame:
    """Counts before and after filtering, averages, success rate and failures by split; with ``total`` also over all (split null).

    df: (split, geom, canonical, reason), reason null for rows that are kept. Rows of one split, group and text fold first, texts as
    digests: what the distinct counts, and the sums over all splits, then read is slim."""
    kept = F.col("reason").isNull()
    text = F.when(kept, F.md5("canonical")).alias("_text")
    slim = df.select(*by, "geom", "reason", text).groupBy(*by, "geom", "reason", "_text").agg(F.count("*").alias("_n"))
    if total:
        slim = staged(slim, "report")
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0))
    counts = [
        F.sum("_n").alias("rows_in"), n(kept).alias("rows_out"),
        F.countDistinct("geom").alias("groups_in"), F.countDistinct(F.when(kept, F.col("geom"))).alias("groups_out"),
        n(F.col("reason") == "dotted").alias("dotted"), n(F.col("reason") == "short").alias("short"),
        F.countDistinct("_text").alias("distinct_canonical"),
    ]
    out = slim.groupBy(*by).agg(*counts)
    if total:
        out = out.unionByName(slim.agg(*counts).select(*(F.lit(None).cast(t).alias(c) for c, t in slim.dtypes if c in by), "*"))
    return out.withColumn("success_rate", F.round(F.col("groups_out") / F.greatest(F.col("groups_in"), F.lit(1)), 6)).withColumn("average", F.round(F.col("rows_out") / F.greatest(F.col("groups_out"), F.lit(1)), 6))


def failure_report(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows and groups before and after filtering, groups whose kept rows say several graphs, and how often each reason drops a row, as a map, by split.

    df: (split, geom, graph, reason), reason null for rows that are kept, graph a key that equal graphs share."""
    kept = F.col("reason").isNull()
    slim = df.withColumn("_g", F.when(kept, F.md5("graph"))).groupBy(*by, "geom", "reason").agg(F.count("*").alias("_n"), F.min("_g").alias("_a"), F.max("_g").alias("_b"))
    slim = staged(slim, "failures")
    groups = slim.groupBy(*by, "geom").agg(F.sum("_n").alias("_in"), F.sum(F.when(kept, F.col("_n")).otherwise(0)).alias("_out"), F.coalesce(F.max(F.when(kept, F.col("_a") < F.col("_b"))), F.lit(False)).alias("_several"))
    out = groups.groupBy(*by).agg(F.sum("_in").alias("rows_in"), F.sum("_out").alias("rows_out"), F.count("*").alias("groups_in"), F.count_if(F.col("_out") > 0).alias("groups_out"), F.count_if("_several").alias("several_graphs"))
    reasons = slim.filter(~kept).groupBy(*by, "reason").agg(F.sum("_n").alias("_n")).groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "_n")))).alias("failures"))
    return out.join(reasons, by, "left").withColumn("failures", F.coalesce("failures", F.create_map().cast("map<string,bigint>")))
