"""Queries over run statistics, schedules and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs as op
from ..session import table
from .registry import query

_K = "CAST(json_extract(props, '$.k') AS BIGINT)"


@query(f"""WITH p AS (SELECT user_id % 8 AS pid, event_type, count(*) AS processed, count(*) FILTER (WHERE value >= 20) AS successful, count(*) FILTER (WHERE value < 20) AS failed, count(*) FILTER (WHERE value >= 20) AS rmsd_count, avg(value) FILTER (WHERE value >= 20) AS rmsd_mean, count({_K}) AS score_count, avg({_K}) AS score_mean FROM events GROUP BY 1, 2)
SELECT event_type, CAST(sum(processed) AS BIGINT) AS processed, CAST(sum(successful) AS BIGINT) AS successful, CAST(sum(failed) AS BIGINT) AS failed, CAST(sum(rmsd_count) AS BIGINT) AS rmsd_count, CAST(sum(score_count) AS BIGINT) AS score_count,
round(coalesce(sum(rmsd_mean * rmsd_count) / sum(rmsd_count), 0), 6) AS rmsd_mean, round(coalesce(sum(score_mean * score_count) / sum(score_count), 0), 6) AS score_mean, round(sum(successful) / sum(processed), 6) AS success_rate, round(sum(failed) / sum(processed), 6) AS failure_rate FROM p GROUP BY event_type""")
def stats_merge(spark, sf_dir):
    """Statistics of eight processes, merged by kind."""
    k = F.get_json_object("props", "$.k").cast("long")
    ok = F.col("value") >= 20
    e = table(spark, sf_dir, "events").withColumn("k", k)
    parts = e.groupBy(F.pmod("user_id", F.lit(8)).alias("pid"), "event_type").agg(F.count("*").alias("processed"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), F.count_if(ok).alias("rmsd_count"), F.avg(F.when(ok, F.col("value"))).alias("rmsd_mean"), F.count("k").alias("score_count"), F.avg("k").alias("score_mean"))
    return op.merge(parts, ["event_type"])


@query("""WITH s AS (SELECT event_id, event_id % 11000 AS step FROM events), t AS (SELECT unnest([1250, 2500, 5000, 10000]) AS t), n AS (SELECT event_id, step, min(t) AS t FROM s LEFT JOIN t ON t >= step GROUP BY event_id, step),
b AS (SELECT event_id, step, t, greatest(t - greatest(1, CAST(floor(t * 0.1) AS INT)), 100) AS b FROM n)
SELECT event_id, step, round(CASE WHEN step < 100 THEN step / 100.0::DOUBLE WHEN t IS NULL THEN 0.0::DOUBLE WHEN step > b THEN 1.0::DOUBLE - (step - b)::DOUBLE / (t - b) ELSE 1.0::DOUBLE END, 6) AS lr FROM b""")
def lr_schedule(spark, sf_dir):
    """The rate of each logged event, whose number stands for its step in a run of 11,000."""
    s = op.Schedule(100, (1250, 2500, 5000, 10000))
    steps = table(spark, sf_dir, "events").select("event_id", F.pmod("event_id", F.lit(11_000)).alias("step"))
    return steps.select("event_id", "step", F.round(s.rate(F.col("step")), 6).alias("lr"))


@query("SELECT event_type, CAST(event_id // 500 AS BIGINT) AS period, min(event_id) AS validated_at, count(*) AS events FROM events GROUP BY 1, 2")
def cadence(spark, sf_dir):
    """The first event of each kind in every 500 steps: when validation is due."""
    e = table(spark, sf_dir, "events").select("event_type", "event_id")
    return e.groupBy("event_type", F.floor(F.col("event_id") / 500).alias("period")).agg(F.min("event_id").alias("validated_at"), F.count("*").alias("events"))


@query("WITH r AS (SELECT DISTINCT l_discount AS rate FROM lineitem), b AS (SELECT DISTINCT l_linenumber * 24 AS batch FROM lineitem) SELECT rate, batch, CAST(150000 * 48 // batch AS BIGINT) AS steps FROM r, b WHERE rate IS NOT NULL AND batch IS NOT NULL")
def param_grid(spark, sf_dir):
    """Every rate that occurs with every batch size that does, and the steps that see as many samples."""
    axes = table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("rate"), (F.col("l_linenumber") * 24).alias("batch"))
    return op.grid_of(axes, ["rate", "batch"], F.expr("cast(150000 * 48 div batch as bigint)"))


@query("WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), p AS (SELECT n / sum(n) OVER () AS p FROM c) SELECT round(exp(-sum(p * ln(p + 1e-10))), 6) AS perplexity, round(100.0 * count(*) / 16, 6)::DOUBLE AS utilization FROM p")
def perplexity(spark, sf_dir):
    out = op.perplexity(table(spark, sf_dir, "embeddings"), "label", 16)
    return out.select(F.round("perplexity", 6).alias("perplexity"), F.round("utilization", 6).alias("utilization"))
