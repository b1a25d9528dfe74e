"""Check matrices: rows of boolean checks, pass fractions and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fraction(checks: list[str]) -> Column:
    """Share of a row's checks that pass; null checks count as failed."""
    if not checks:
        raise ValueError("a check matrix needs boolean columns")
    total = sum((F.coalesce(F.col(c), F.lit(False)).cast("int") for c in checks[1:]), F.coalesce(F.col(checks[0]), F.lit(False)).cast("int"))
    return total / F.lit(float(len(checks)))


def passed(checks: list[str]) -> Column:
    return fraction(checks) == 1.0


def pass_rates(df: DataFrame, key: str, checks: list[str]) -> DataFrame:
    """Mean of every check, pass percentage, count and distinct errors for each key and over all rows (key "ALL").

    The overall rates are means over rows, not over keys. One pass with grouping sets."""
    mean = [F.round(F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double")), 6).alias(c) for c in checks]
    out = df.groupingSets([[F.col(key)], []], F.col(key)).agg(*mean, F.round(100 * F.avg(passed(checks).cast("double")), 6).alias("pass_percentage"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("error")), ";").alias("errors"), F.grouping(key).alias("_all"))
    return out.withColumn(key, F.when(F.col("_all") == 1, "ALL").otherwise(F.col(key))).drop("_all")


def pass_rates_macro(df: DataFrame, key: str, checks: list[str]) -> DataFrame:
    """Means over keys of the keys' means, rows with errors left out, and the share of keys' rows that pass everything."""
    per_key = df.filter("error is null").groupBy(key).agg(*(F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double")).alias(c) for c in checks), F.avg(passed(checks).cast("double")).alias("_pass"))
    return per_key.agg(*(F.round(F.avg(c), 6).alias(c) for c in checks), F.round(100 * F.avg("_pass"), 6).alias("pass_percentage"), F.count("*").alias("n_keys"))


#: Modules of checks that a mode asks for; ``full`` asks for all of them.
STAGES = {"basic": 4, "geometry": 5}


def gate(modules: list[str] | list[list[str]], mode: str, stages: dict[str, int] = STAGES) -> tuple[Column, list[str]]:
    """Whether a row passes the checks of the first modules that a mode asks for, and these; unknown modes ask for none. A module is one check or a list."""
    first = modules[: len(modules) if mode == "full" else stages.get(mode, 0)]
    used = [c for m in first for c in ([m] if isinstance(m, str) else m)]
    return (passed(used) if used else F.lit(True)), used


def means(df: DataFrame, checks: list[str]) -> DataFrame:
    """One row: mean share of checks that pass (``avg``) and share of rows that pass all (``bool``) of a batch."""
    return df.agg(F.round(F.avg(fraction(checks)), 6).alias("avg"), F.round(F.avg(passed(checks).cast("double")), 6).alias("bool"))


def pass_vector(df: DataFrame, expected: DataFrame, key: str, pos: str, checks: list[str]) -> DataFrame:
    """(key, pos, passed) for positions 0 to n - 1 of every key in ``expected`` (key, n): rows beyond are cut off, missing ones have not passed."""
    places = expected.filter("n > 0").select(key, F.explode(F.expr("sequence(0L, n - 1)")).alias(pos))
    rows = df.select(key, F.col(pos).cast("long").alias(pos), passed(checks).alias("passed"))
    return places.join(rows, [key, pos], "left").select(key, pos, F.coalesce("passed", F.lit(False)).alias("passed"))
