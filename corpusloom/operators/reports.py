"""Reports of an evaluation: a table for each key, and a text of numbered sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import format_float
from ..sources.staging import staged
from . import coverage

TITLES = ("SUMMARY", "RUN TIME", "COVERAGE AND MATCHING", "KEYS WITHOUT MEMBERS", "KEYS WITHOUT DISTANCES", "GENERATION", "CHECKS", "SETTINGS", "LOG")


def per_key(low: DataFrame, members: DataFrame, delta: float) -> DataFrame:
    """Twelve columns for each key, of what ``coverage.minima`` gives: distances, coverage, matching, counts, members (key, member) joined."""
    r = F.col("side") == "R"
    hit = F.when(F.col("m") < delta, 1.0).otherwise(0.0)
    of = lambda side, x: F.avg(F.when(F.col("side") == side, x))
    stats = low.groupBy("key").agg(F.min("m").alias("lo"), F.max("far").alias("hi"), F.sum(F.when(r, F.col("total"))).alias("total"), F.sum(F.when(r, F.col("n"))).alias("n_pairs"), of("R", hit).alias("cov_r"), of("P", hit).alias("cov_p"), of("R", F.col("m")).alias("mat_r"), of("P", F.col("m")).alias("mat_p"), F.count_if(r).alias("n_true"), F.count_if(~r).alias("n_gen"))
    listed = members.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("member")).cast("array<string>"), ";").alias("members"))
    text = lambda c, name: format_float(F.round(c, 6)).alias(name)
    mean = F.try_divide(F.col("total"), F.col("n_pairs"))
    numbers = [text(F.col("lo"), "rmsd_min"), text(F.col("hi"), "rmsd_max"), text(mean, "rmsd_mean"), *(text(F.col(c), c) for c in ("cov_r", "cov_p", "mat_r", "mat_p"))]
    return stats.join(listed, "key", "left").select("key", *numbers, "n_true", "n_gen", "n_pairs", F.coalesce("members", F.lit("")).alias("members"))


def write_csv(report: DataFrame, path: str, key: str = "key") -> None:
    """The table as CSV with a header, in order of its key."""
    report.orderBy(key).write.mode("overwrite").option("header", "true").csv(path)


def _numbered(keys: DataFrame, section: int) -> DataFrame:
    """One line a key, in order, or one that says there are none. Ranks come from a range partitioning's sort."""
    from .ordering import global_index

    rows = global_index(keys, "key", out="n").select(F.lit(section).alias("section"), (F.col("n") + 1).alias("n"), F.format_string("%3d. %s", F.col("n") + 1, F.col("key").cast("string")).alias("line"))
    none = keys.agg(F.count("*").alias("c")).filter("c = 0").select(F.lit(section).alias("section"), F.lit(1).cast("long").alias("n"), F.lit("None").alias("line"))
    return rows.unionByName(none)


def _listed(row: DataFrame, section: int, parts: list[tuple[str, Column]]) -> DataFrame:
    """The values of a single row as lines ``name: value``."""
    said = F.array(*(F.struct(F.lit(k).cast("long").alias("n"), F.concat(F.lit(f"{name}: "), value.cast("string")).alias("line")) for k, (name, value) in enumerate(parts, 1)))
    return row.select(F.lit(section).alias("section"), F.inline(said))


def lines(true: DataFrame, gen: DataFrame, low: DataFrame, durations: dict[str, float], delta: float, generation: str = "", checks: DataFrame | None = None, log: dict[str, str] | None = None) -> DataFrame:
    """(section, n, line) of a report; sections are numbered as ``TITLES``, and those without data have no lines.

    ``low`` as ``coverage.minima`` gives, ``durations`` in seconds, ``checks`` a single row of rates."""
    spark, low = true.sparkSession, staged(low, "minima")
    missing = true.select("key").distinct().join(gen.select("key").distinct(), "key", "left_anti")
    empty = low.groupBy("key").agg(F.sum("n").alias("n")).filter("n = 0").select("key")
    counts = lambda df, name: df.agg(F.countDistinct("key").alias(f"{name}_keys"), F.count("*").alias(f"{name}_rows"))
    single = counts(gen, "gen").crossJoin(counts(true, "true")).crossJoin(missing.agg(F.count("*").alias("missing"))).crossJoin(empty.agg(F.count("*").alias("empty")))  # single rows
    names = ("Generated keys", "gen_keys"), ("Generated members", "gen_rows"), ("True keys", "true_keys"), ("True members", "true_rows"), ("Keys without members", "missing"), ("Keys without distances", "empty")
    out = _listed(single, 1, [(name, F.col(c)) for name, c in names])
    fixed = lambda section, said: spark.createDataFrame([(section, k, line) for k, line in enumerate(said, 1)], "section int, n long, line string")
    minutes = spark.createDataFrame([(name, s / 60) for name, s in durations.items()], "name string, m double") if durations else None
    if minutes is not None:
        order = {name: k for k, name in enumerate(durations, 1)}
        place = F.element_at(F.create_map(*(F.lit(x) for pair in order.items() for x in pair)), F.col("name")).cast("long")
        out = out.unionByName(minutes.select(F.lit(2).alias("section"), place.alias("n"), F.concat("name", F.lit(": "), format_float(F.col("m")), F.lit(" min")).alias("line")))
    mats = coverage.covmat(low, delta)
    both = [(f"{c.upper().replace('_', '-')} {kind}", f(c)) for c in ("cov_r", "cov_p", "mat_r", "mat_p") for kind, f in (("mean", F.avg), ("median", F.median))]
    row = mats.agg(*(value.alias(f"v{k}") for k, (_, value) in enumerate(both)))
    out = out.unionByName(_listed(row, 3, [(name, format_float(F.round(f"v{k}", 6))) for k, (name, _) in enumerate(both)]))
    out = out.unionByName(_numbered(missing, 4)).unionByName(_numbered(empty, 5))
    if generation:
        out = out.unionByName(fixed(6, generation.splitlines()))
    if checks is not None:
        out = out.unionByName(_listed(checks, 7, [(c, format_float(F.col(c).cast("double"))) for c in checks.columns]))
    out = out.unionByName(fixed(8, [f"Threshold: {delta}"])) if generation or checks is not None or log else out
    return out.unionByName(fixed(9, [f"{k}: {v}" for k, v in log.items()])) if log else out


def write_text(report: DataFrame, path: str) -> None:
    """The report's sections under their titles, as one text file."""
    title = F.element_at(F.array(*map(F.lit, TITLES)), F.col("section"))
    first = F.row_number().over(Window.partitionBy("section").orderBy("n")) == 1
    head = F.concat(F.lit("\n"), title, F.lit("\n"), F.lit("-" * 40), F.lit("\n"))
    text = F.when(first, F.concat(head, F.col("line"))).otherwise(F.col("line"))
    report.select("section", "n", text.alias("value")).coalesce(1).sortWithinPartitions("section", "n").select("value").write.mode("overwrite").text(path)
