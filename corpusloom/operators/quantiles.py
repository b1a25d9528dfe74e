"""Exact quantiles of columns of any length, without a task that holds one of them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged

#: Values that a rank is looked up among, and ranges that the others are counted in.
AT_ONCE, RANGES = 50_000, 4_096


def quantiles(values: DataFrame, wanted: list[tuple[str, float]], at_once: int = AT_ONCE, ranges: int = RANGES) -> dict[tuple[str, float], float | None]:
    """The quantiles (name, share) of values (name, v), linear between neighbours; nulls and NaN don't count, None where nothing does.

    A rank's range is halved over and over by counting ``ranges`` parts of it in one pass for all ranks, until it holds
    ``at_once`` values or a single one; these few are sorted. The driver sees counts, and the values asked for."""
    rows = staged(values.select("name", F.col("v").cast("double").alias("v")).filter("v is not null and not isnan(v)"), "values")
    seen = {r["name"]: r for r in rows.groupBy("name").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    place = {(name, q): (seen[name]["n"] - 1) * q for name, q in wanted if name in seen}
    # of each rank its range: lowest and highest value, values below, values within
    at = {(name, k): (seen[name]["lo"], seen[name]["hi"], 0, seen[name]["n"]) for (name, _), h in place.items() for k in {math.floor(h), math.ceil(h)}}

    def each(found: dict) -> tuple[DataFrame, dict]:
        """(i, part, v) of the values within the ranks' ranges, and the ranges' numbers."""
        spans = sorted({(name, *span[:2]) for (name, _), span in found.items()})
        number = F.array(*(F.when((F.col("name") == name) & F.col("v").between(lo, hi), F.lit(i)) for i, (name, lo, hi) in enumerate(spans)))
        part = F.array(*(F.least(F.floor((F.col("v") - lo) / (hi - lo) * ranges), F.lit(ranges - 1)) if hi > lo else F.lit(0).cast("long") for _, lo, hi in spans))
        inside = rows.select("v", F.posexplode(F.arrays_zip(number.alias("i"), part.alias("part")))).filter("col.i is not null")
        return inside.select(F.col("col.i").alias("i"), F.col("col.part").alias("part"), "v"), {(name, lo, hi): i for i, (name, lo, hi) in enumerate(spans)}

    while large := {k: span for k, span in at.items() if span[3] > at_once and span[0] < span[1]}:
        inside, numbers = each(large)
        counts: dict[int, list] = {}
        for r in inside.groupBy("i", "part").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("i", "part").collect():
            counts.setdefault(r["i"], []).append(r)
        for (name, k), (lo, hi, below, _) in large.items():
            for r in counts[numbers[name, lo, hi]]:
                if k < below + r["n"]:
                    at[name, k] = (r["lo"], r["hi"], below, r["n"])
                    break
                below += r["n"]
    exact = {k: span[0] for k, span in at.items() if span[0] == span[1]}
    if rest := {k: span for k, span in at.items() if k not in exact}:
        inside, numbers = each(rest)
        # the few that are asked for are picked where they are sorted
        asked = F.array(*(F.lit(k - span[2]).cast("int") for (_, k), span in rest.items()))
        sorted_ = inside.groupBy("i").agg(F.sort_array(F.collect_list("v")).alias("v"))
        held = {r["i"]: r["v"] for r in sorted_.select("i", F.transform(asked, lambda p: F.try_element_at("v", p + 1)).alias("v")).collect()}
        for position, ((name, k), (lo, hi, _, _)) in enumerate(rest.items()):
            exact[name, k] = held[numbers[name, lo, hi]][position]
    out: dict[tuple[str, float], float | None] = {}
    for name, q in wanted:
        h = place.get((name, q))
        if h is None:
            out[name, q] = None
            continue
        low, high = exact[name, math.floor(h)], exact[name, math.ceil(h)]
        out[name, q] = low if low == high else (math.ceil(h) - h) * low + (h - math.floor(h)) * high
    return out
