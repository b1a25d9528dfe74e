"""Exact quantiles of the distances between the members of a key, of any number of them, without pairs as rows.

Distances that aren't negative are in the order of their bits. Pairs are counted by their leading bits, then those whose
bits lead as a rank's do by further ones, until a rank's value is known: each round works the distances out again. A key
that one group holds is sorted there at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged
from . import tiles

#: Trailing bits that the rounds leave out; the last one leaves none out, as does one that has few enough pairs to count.
STEPS, AT_ONCE = (40, 20, 0), 50_000
# Fixed value: the numbers of what isn't counted by its bits: pairs of a key, with or without a distance, and the quantile of a small key.
_ALL, _DONE = -1, -2


def _distances(a: tiles.Side, b: tiles.Side, same: bool, scale: float) -> Iterator[tuple[int, np.ndarray]]:
    """The number of pairs of a strip, each two members once, and the distances that aren't null."""
    for at, r in tiles.strips(a, b, scale):
        keep = np.ones(r.shape, dtype=bool) if not same else b.ids[None, :] > a.ids[at, None]
        n = int(keep.sum())
        none = tiles.without(a, b, at)
        yield n, r[keep if none is None else keep & ~none]


def _between(low: float, high: float, h: float) -> float:
    return low if low == high else (math.ceil(h) - h) * low + (h - math.floor(h)) * high


def _rounds(members: DataFrame, share: float, scale: float, pooled: bool) -> tuple[DataFrame, dict]:
    """Quantiles of keys that a single group held (key, n, q), and of others: key to (pairs, quantile); all pairs are None's if pooled, without NaN.

    The driver sees a few numbers for each key that was cut."""
    spark, kind = members.sparkSession, members.schema["key"].dataType.simpleString()
    columns = "span bigint, lead bigint, n bigint, q double"

    def counted(spans: dict | None) -> DataFrame:
        """How many pairs have which leading bits: of all pairs (span 0), or within the ``spans`` of each key (number, trailing bits left out before, leading bits, trailing bits left out now)."""
        asked = spark.sparkContext.broadcast(spans)

        def fold(a: tiles.Side, b: tiles.Side, same: bool, alone: bool, key: object) -> Iterator[dict]:
            total, held, parts = 0, [], []
            here = [(0, 63, 0, STEPS[0])] if asked.value is None else asked.value.get(None if pooled else key, [])
            if not here:
                return
            for n, r in _distances(a, b, same, scale):
                total += n
                if alone and not pooled:
                    held.append(r)
                    continue
                bits = np.abs(r[~np.isnan(r)] if pooled else r).view(np.int64)
                for number, before, lead, shift in here:
                    some = (bits if before == 63 else bits[bits >> before == lead]) >> shift
                    if len(some) and some.max() - some.min() < 1 << 16:
                        n_of = np.bincount(some - some.min())
                        found = np.flatnonzero(n_of)
                        parts.append((np.full(len(found), number), found + some.min(), n_of[found]))
                    else:
                        found, n_of = np.unique(some, return_counts=True)
                        parts.append((np.full(len(found), number), found, n_of))
            if alone and not pooled:
                r = np.sort(np.concatenate(held))
                h = (len(r) - 1) * share
                q = _between(r[math.floor(h)], r[math.ceil(h)], h) if len(r) else None
                if total:
                    yield {"span": np.array([0]), "lead": np.array([_DONE]), "n": np.array([total]), "q": pa.array([q], pa.float64())}
                return
            span, lead, n_of = (np.concatenate(x) for x in zip(*parts))
            each, at = np.unique(np.stack([span, lead]), axis=1, return_inverse=True)
            n_of = np.bincount(at.ravel(), n_of, each.shape[1]).astype(np.int64)
            yield {"span": np.append(each[0], 0), "lead": np.append(each[1], _ALL), "n": np.append(n_of, total), "q": pa.nulls(len(n_of) + 1, pa.float64())}

        return tiles.meet(members, None, fold, columns)

    met = staged(counted(None), "pairs-by-bits")
    small, counts = met.filter(F.col("lead") == _DONE).select("key", "n", "q"), met
    places: dict = {}  # of each key the place of its quantile among its distances
    found: dict = {}  # of each key the distances at whole places
    pairs, ranks, spans, first = {}, [], [(63, 0, STEPS[0])], True
    while first or ranks:
        counts = counts.filter(F.col("lead") != _DONE)
        counts = counts.withColumn("key", F.lit(None).cast(kind)) if pooled else counts
        counts = staged(counts.groupBy("key", "span", "lead").agg(F.sum("n").alias("n")), "bits")
        held = counts.filter(F.col("lead") >= 0)
        if first:
            pairs = {r["key"]: r["n"] for r in counts.filter(F.col("lead") == _ALL).collect()}
            places = {r["key"]: (r["n"] - 1) * share for r in held.groupBy("key").agg(F.sum("n").alias("n")).collect()}
            ranks = [(key, 0, k, k) for key, h in places.items() for k in {math.floor(h), math.ceil(h)}]
            first = False
            if not ranks:
                break
        up = Window.partitionBy("key", "span").orderBy("lead").rowsBetween(Window.unboundedPreceding, -1)
        held = held.withColumn("below", F.coalesce(F.sum("n").over(up), F.lit(0)))
        sought = F.broadcast(spark.createDataFrame(ranks, f"key {kind}, span bigint, k bigint, place bigint").withColumnsRenamed({"key": "_key", "span": "_span"}))
        hit = held.join(sought, F.col("key").eqNullSafe(F.col("_key")) & (F.col("span") == F.col("_span")) & (F.col("below") <= F.col("k")) & (F.col("below") + F.col("n") > F.col("k")))
        ranks, number, after, here = [], {}, [], {}
        for r in hit.select("key", "span", "lead", "n", "below", "k", "place").collect():
            before = spans[r["span"]][2]
            if before == 0:
                found.setdefault(r["key"], {})[r["place"]] = float(np.int64(r["lead"]).view(np.float64))
                continue
            span = (r["key"], before, r["lead"])
            if span not in number:
                number[span] = len(after)
                after.append((before, r["lead"], 0 if r["n"] <= AT_ONCE else STEPS[STEPS.index(before) + 1]))
                here.setdefault(r["key"], []).append((number[span], *after[-1]))
            ranks.append((r["key"], number[span], r["k"] - r["below"], r["place"]))
        if ranks:
            spans, counts = after, counted(here)
    out = {key: (n, _between(found[key][math.floor(places[key])], found[key][math.ceil(places[key])], places[key]) if key in places else None) for key, n in pairs.items()}
    return small, out


def by_key(members: DataFrame, share: float = 0.5, scale: float = 1.0) -> DataFrame:
    """(key, n, q): the number of pairs of members (key, conf_id, xyz) with different ids, and the quantile of their distances, linear between neighbours; nulls don't count, NaN is above all."""
    small, large = _rounds(members, share, scale, False)
    out = members.sparkSession.createDataFrame([(k, *v) for k, v in large.items()], small.schema)
    return small.unionByName(out)


def pooled(members: DataFrame, share: float = 0.5, scale: float = 1.0) -> float | None:
    """The quantile of the distances between members of one key, over all keys together, without nulls and NaN; None where there are none."""
    return _rounds(members, share, scale, True)[1].get(None, (0, None))[1]
