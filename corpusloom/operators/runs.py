"""Run statistics that merge, schedules, cadences and grids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUMS = ("processed", "successful", "failed")
MEANS = ("rmsd", "score")


def merge(parts: DataFrame, by: list[str]) -> DataFrame:
    """Counters summed, means weighted by their counts (0 without any), rates of the sums. Partial results of partial results merge alike."""
    out = parts.groupBy(*by).agg(*(F.sum(c).alias(c) for c in SUMS), *(F.sum(f"{c}_count").alias(f"{c}_count") for c in MEANS), *(F.sum(F.col(f"{c}_mean") * F.col(f"{c}_count")).alias(f"_{c}") for c in MEANS))
    for c in MEANS:
        out = out.withColumn(f"{c}_mean", F.round(F.coalesce(F.try_divide(F.col(f"_{c}"), F.col(f"{c}_count")), F.lit(0.0)), 6)).drop(f"_{c}")
    return out.withColumn("success_rate", F.round(F.coalesce(F.try_divide("successful", "processed"), F.lit(0.0)), 6)).withColumn("failure_rate", F.round(F.coalesce(F.try_divide("failed", "processed"), F.lit(0.0)), 6))


@dataclass(frozen=True)
class Schedule:
    """Linear warm-up, hold, and before each target a linear decay, after which the rate starts anew."""

    warmup: int
    targets: tuple[int, ...]
    high: float = 1.0
    low: float = 0.0
    decay_fraction: float | None = 0.1
    decay_steps: int | None = None

    def __post_init__(self):
        """Targets rise and may repeat or lie within the warm-up; where both lengths of a decay are given the steps count."""
        if self.warmup < 0:
            raise ValueError("warmup must not be negative")
        if not self.targets:
            raise ValueError("a schedule needs targets")
        if list(self.targets) != sorted(self.targets) or self.targets[0] <= 0:
            raise ValueError("targets must be positive and rise")
        if self.high <= 0 or self.low < 0 or self.low > self.high:
            raise ValueError("rates must satisfy 0 <= low <= high, high > 0")
        if self.decay_fraction is None and self.decay_steps is None:
            raise ValueError("give decay_fraction or decay_steps")
        if self.decay_fraction is not None and not 0 <= self.decay_fraction <= 1:
            raise ValueError("decay_fraction must be in [0, 1]")
        if self.decay_steps is not None and self.decay_steps < 1:
            raise ValueError("decay_steps must be positive")

    def rate(self, step: Column) -> Column:
        """The rate at a step, as an expression: the next target's decay, found by a chain of comparisons."""
        span = self.high - self.low
        out = F.lit(self.low)
        for t in reversed(self.targets):
            length = max(1, min(t, self.decay_steps)) if self.decay_steps else max(1, int(t * self.decay_fraction))
            begin = max(t - length, self.warmup)
            decay = F.lit(self.high) - F.lit(span) * (step - begin) / max(t - begin, 1)
            out = F.when(step <= t, F.when(step > begin, decay).otherwise(F.lit(self.high))).otherwise(out)
        warm = F.lit(self.high) * step / max(self.warmup, 1)
        return F.when(step < 0, 0.0).when(step < self.warmup, warm).otherwise(out)


def perplexity(df: DataFrame, code: str, n_codes: int) -> DataFrame:
    """exp of the entropy of the codes' frequencies, and the percentage of codes in use."""
    counts = df.groupBy(code).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    return counts.crossJoin(F.broadcast(total)).agg(F.exp(-F.sum(p * F.log(p + 1e-10))).alias("perplexity"), (100.0 * F.count("*") / n_codes).alias("utilization"))  # the total is one row


def grid(spark: SparkSession, rates: list[float], batches: list[int], steps: dict[int, int]) -> DataFrame:
    """(lr, batch, steps): every rate with every batch size, and the steps of that size; a size without steps raises KeyError."""
    rows = [(rate, batch, steps[batch]) for rate in dict.fromkeys(rates) for batch in dict.fromkeys(batches)]
    return spark.createDataFrame(rows, "lr double, batch int, steps int")


def grid_of(values: DataFrame, axes: list[str], steps: Column) -> DataFrame:
    """(*axes, steps): every combination of the values that the columns ``axes`` have, nulls aside, each once, with the steps that ``steps`` says of it.

    The distinct values of an axis are few, as a grid's are; they meet as arrays of one row."""
    one = values.agg(*(F.array_sort(F.collect_set(a)).alias(a) for a in axes))
    for a in axes:
        one = one.withColumn(a, F.explode(a))
    return one.withColumn("steps", steps)


def flops_per_token(layers: int, hidden: int, vocabulary: int) -> int:
    return 24 * layers * hidden * hidden + 4 * hidden * vocabulary


def utilization(tokens_per_second: float, flops: int, peak: float) -> float:
    return tokens_per_second * flops / peak if peak > 0 else 0.0
