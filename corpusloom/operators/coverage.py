"""Set-against-set analytics: how well generated point sets cover the true ones, and match them."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import graphs
from ..functions.geometry import null_if_nan, rmsd
from . import tiles

#: 60 thresholds, 0.05 to 3.0.
N_THRESHOLDS = 60


def pair_distances(true: DataFrame, gen: DataFrame, scale: float = 1.0) -> DataFrame:
    """(key, i, j, r) for all pairs within a key. Only the key is shuffled on; a skewed key is split by adaptive execution."""
    a = true.select("key", F.col("conf_id").alias("i"), F.col("xyz").alias("a"))
    b = gen.select("key", F.col("conf_id").alias("j"), F.col("xyz").alias("b"))
    return a.join(b, "key").select("key", "i", "j", (F.lit(scale) * rmsd(F.col("a"), F.col("b"))).alias("r"))


def minima(pairs: DataFrame) -> DataFrame:
    """(key, side, id, m, far, total, n): nearest distance of every true (side R) and generated (side P) member; NaN counts as missing, and a member with no distance has null m.

    Furthest distance, sum and number of distances come along. One pass over the pairs: each goes to both of its members, and minima fold before the shuffle."""
    both = F.explode(F.array(F.struct(F.lit("R").alias("side"), F.col("i").alias("id")), F.struct(F.lit("P").alias("side"), F.col("j").alias("id"))))
    return pairs.select("key", null_if_nan(F.col("r")).alias("r"), both.alias("m")).groupBy("key", "m.side", "m.id").agg(F.min("r").alias("m"), F.max("r").alias("far"), F.sum("r").alias("total"), F.count("r").alias("n"))


#: Distances by inner products are good to more digits than this; those nearer the least one than it are compared as worked out in full.
_ALIKE = 1 + 1e-10


class Extremes:
    """Nearest, furthest, sum and number of the distances of both sides' members, gathered strip by strip."""

    def __init__(self, a: tiles.Side, b: tiles.Side, scale: float | None) -> None:
        self.a, self.b, self.scale = a, b, scale  # without a scale distances are taken as they come
        blank = lambda n: {"m": np.full(n, np.inf), "arg": np.full(n, -1), "far": np.full(n, -np.inf), "total": np.zeros(n), "n": np.zeros(n, dtype=np.int64)}
        self.of_a, self.of_b = blank(len(a)), blank(len(b))

    def _nearest(self, found: dict[str, np.ndarray], mine: np.ndarray, i: np.ndarray, j: np.ndarray, r: np.ndarray, by_a: bool) -> None:
        """Candidates (places ``i`` of a, ``j`` of b) for the members ``mine``: least distance, then least id."""
        r = r if self.scale is None else tiles.exact(self.a, self.b, i, j, self.scale)
        other = (self.b.ids[j] if by_a else self.a.ids[i]).astype(np.int64)
        order = np.lexsort((other, r, mine))
        first = order[np.concatenate([[True], np.diff(mine[order]) > 0])] if len(order) else order
        m, r, other = mine[first], r[first], other[first]
        better = (r < found["m"][m]) | ((r == found["m"][m]) & ((other < found["arg"][m]) | (found["arg"][m] < 0)))
        found["m"][m[better]], found["arg"][m[better]] = r[better], other[better]

    def add(self, at: slice, r: np.ndarray) -> None:
        none = np.isnan(r)
        low, high = r, r
        if none.any():
            low, high, r = np.where(none, np.inf, r), np.where(none, -np.inf, r), np.where(none, 0.0, r)
        for found, rows, axis in ((self.of_a, at, 1), (self.of_b, slice(None), 0)):
            found["far"][rows] = np.maximum(found["far"][rows], high.max(axis=axis))
            found["total"][rows] += r.sum(axis=axis)
            found["n"][rows] += r.shape[axis] - none.sum(axis=axis)
        least = low.min(axis=1)
        i, j = np.nonzero(low <= np.where(np.isfinite(least), least * _ALIKE, -1.0)[:, None])
        self._nearest(self.of_a, i + at.start, i + at.start, j, low[i, j], True)
        least = low.min(axis=0)
        some = np.flatnonzero(np.isfinite(least) & (least <= self.of_b["m"] * _ALIKE))
        i, j = np.nonzero(low[:, some] <= (least[some] * _ALIKE)[None, :])
        self._nearest(self.of_b, some[j], i + at.start, some[j], low[i, some[j]], False)

    def columns(self) -> Iterator[dict[str, np.ndarray | pa.Array]]:
        for side, own, found, n in (("R", self.a, self.of_a, len(self.b)), ("P", self.b, self.of_b, len(self.a))):
            some = found["n"] > 0
            null = lambda x: pa.array(x, mask=~some)  # noqa: E731, B023
            yield {"side": pa.repeat(side, len(own)), "id": own.ids, "m": null(found["m"]), "arg": null(found["arg"]), "far": null(found["far"]), "total": null(found["total"]), "n": found["n"], "pairs": np.full(len(own), n)}


EXTREMES = "side string, id bigint, m double, arg bigint, far double, total double, n bigint, pairs bigint"


def merged(parts: DataFrame, *more) -> DataFrame:
    """One row for each member of what ``extremes`` gives for each tile; ``more`` are further aggregates."""
    nearest = F.min(F.when(F.col("m").isNotNull(), F.struct("m", "arg")))
    out = parts.groupBy("key", "side", "id").agg(nearest.alias("_b"), F.max("far").alias("far"), F.sum("total").alias("total"), F.sum("n").alias("n"), F.sum("pairs").alias("pairs"), *more)
    return out.withColumns({"m": F.col("_b.m"), "arg": F.col("_b.arg")}).drop("_b")


def extremes(true: DataFrame, gen: DataFrame, scale: float = 1.0) -> DataFrame:
    """What ``minima`` gives for ``pair_distances``, without pairs as rows: (key, side, id, m, far, total, n), and ``arg``, the nearest member (of equal ones the smallest id), and the number of ``pairs`` with or without a distance.

    Members without a key or id take no part. Work grows with the pairs, memory and rows with the members."""

    def fold(a: tiles.Side, b: tiles.Side, same: bool, alone: bool, key: object) -> Iterator[dict[str, np.ndarray | pa.Array]]:
        found = Extremes(a, b, scale)
        for at, r in tiles.strips(a, b, scale):
            found.add(at, r)
        yield from found.columns()

    return merged(tiles.meet(true, gen, fold, EXTREMES))


def symmetric_extremes(true: DataFrame, gen: DataFrame) -> DataFrame:
    """``extremes`` by the symmetric distance (``graphs.symmetric_rmsd``) of structures (key, conf_id, atoms, bonds).

    Matches are looked for once for each two ways in which a group's structures are written, not for each pair."""
    written = F.concat_ws(" ", F.to_json(F.transform("atoms", lambda x: x["sym"])), F.to_json(F.struct(F.transform("bonds", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))).alias("bonds"))))
    places = F.flatten(F.transform("atoms", lambda x: F.array(*(F.coalesce(x[c].cast("double"), F.lit(float("nan"))) for c in "xyz"))))
    known = F.col("atoms").isNotNull() & F.col("bonds").isNotNull()
    flat = lambda df: df.select("key", "conf_id", F.when(known, places).alias("xyz"), F.when(known, written).alias("written"))

    def read(text: str) -> tuple[graphs.Graph, list[int]] | None:
        symbols, end = json.JSONDecoder().raw_decode(text)
        graph = graphs.of_structure([{"sym": x} for x in symbols], [{"a": x.get("a"), "b": x.get("b")} for x in json.loads(text[end:])["bonds"]])
        return graph and graph.without_hydrogens()

    def fold(a: tiles.Side, b: tiles.Side, same: bool, alone: bool, key: object) -> Iterator[dict[str, np.ndarray | pa.Array]]:
        found = Extremes(a, b, None)
        kinds = [{t: (np.flatnonzero(side.extra["written"] == t), read(t)) for t in set(side.extra["written"]) if t is not None} for side in (a, b)]
        ways: dict = {}
        for s, (_, x) in kinds[0].items():
            for t, (_, y) in kinds[1].items():
                if x and y and x[1] and y[1]:
                    some = list(islice(graphs.matches(x[0], y[0]), graphs.MOST_MATCHES + 1))
                    ways[s, t] = some if len(some) <= graphs.MOST_MATCHES else []
        step = max(1, (1 << 14) // len(b))
        for start in range(0, len(a), step):
            at = slice(start, min(len(a), start + step))
            r = np.full((at.stop - start, len(b)), np.nan)
            for (s, t), laid in ways.items():
                (mine, x), (others, y) = kinds[0][s], kinds[1][t]
                mine = mine[(mine >= at.start) & (mine < at.stop)]
                if not laid or not len(mine):
                    continue
                points = lambda side, rows, kept: side.x[rows][:, : 3 * (max(kept) + 1)].reshape(len(rows), -1, 3)[:, kept]
                of_a, of_b = points(a, mine, x[1]), points(b, others, y[1])
                least = np.full((len(mine), len(others)), np.nan)
                for way in laid:
                    least = np.fmin(least, tiles.superposed(of_a, of_b[:, way]))
                r[np.ix_(mine - start, others)] = least
            found.add(at, r)
        yield from found.columns()

    return merged(tiles.meet(flat(true), flat(gen), fold, EXTREMES, ("written",)))


def each_pair(true: DataFrame, gen: DataFrame, scale: float = 1.0, aligned: bool = False, digits: int = 6) -> DataFrame:
    """(key, i, j, r) of all pairs, r rounded half up; with ``aligned`` also the distance after superposition, points matched in order. Null where a vector is null or lengths differ; superposed also where a coordinate isn't finite or there are no points of three."""

    def fold(a: tiles.Side, b: tiles.Side, same: bool, alone: bool, key: object) -> Iterator[dict[str, np.ndarray | pa.Array]]:
        for at, r in tiles.strips(a, b, scale):
            none = tiles.without(a, b, at)
            out = {"i": np.repeat(a.ids[at], len(b)), "j": np.tile(b.ids, at.stop - at.start), "r": pa.array(tiles.rounded(r, digits).ravel(), mask=None if none is None else none.ravel())}
            if aligned:
                turned = np.full(r.shape, np.nan)
                for n in np.unique(a.sizes[at]):
                    x, y = np.flatnonzero(a.sizes[at] == n), np.flatnonzero(b.sizes == n)
                    if n and n % 3 == 0 and len(y):
                        others = b.x[y][:, :n].reshape(len(y), -1, 3)
                        for some in np.array_split(x, -(-len(x) * len(y) // (1 << 15))):
                            turned[np.ix_(some, y)] = tiles.superposed(a.x[at][some][:, :n].reshape(len(some), -1, 3), others)
                turned = tiles.rounded(turned, digits).ravel()
                out["aligned"] = pa.array(turned, mask=np.isnan(turned))
            yield out

    return tiles.meet(true, gen, fold, "i bigint, j bigint, r double" + (", aligned double" if aligned else ""))


def matching(low: DataFrame) -> DataFrame:
    """(key, mat_r, mat_p): mean nearest distance; missing minima are left out."""
    return low.groupBy("key").agg(F.avg(F.when(F.col("side") == "R", F.col("m"))).alias("mat_r"), F.avg(F.when(F.col("side") == "P", F.col("m"))).alias("mat_p"))


def coverage_curve(low: DataFrame, n: int = N_THRESHOLDS) -> DataFrame:
    """(key, t_idx, t, cov_r, cov_p): share of members nearer than each threshold; missing minima stay in the denominator."""
    hit = lambda t: F.when(F.col("m") < t, 1.0).otherwise(0.0)
    # the thresholds multiply the minima, never the pairs
    rows = low.select("key", "side", "m", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("t_idx")).withColumn("t", 0.05 + F.col("t_idx") * 0.05)
    by = rows.groupBy("key", "t_idx", "t")
    return by.agg(F.avg(F.when(F.col("side") == "R", hit(F.col("t")))).alias("cov_r"), F.avg(F.when(F.col("side") == "P", hit(F.col("t")))).alias("cov_p"))


def covmat(low: DataFrame, t: float) -> DataFrame:
    """Coverage at one threshold and matching for each key."""
    hit = F.when(F.col("m") < t, 1.0).otherwise(0.0)
    of = lambda side, x: F.avg(F.when(F.col("side") == side, x))
    return low.groupBy("key").agg(of("R", hit).alias("cov_r"), of("P", hit).alias("cov_p"), of("R", F.col("m")).alias("mat_r"), of("P", F.col("m")).alias("mat_p"))


def curve_over_keys(curve: DataFrame) -> DataFrame:
    """Mean and median over keys for every threshold."""
    return curve.groupBy("t_idx").agg(*(f(c).alias(f"{c}_{name}") for c in ("cov_r", "cov_p") for name, f in (("mean", F.avg), ("median", F.median))))


def summary(curve: DataFrame, mats: DataFrame) -> DataFrame:
    """Scalars over all keys and thresholds; a key without any distance makes the means of matching null."""
    a = curve.agg(F.avg("cov_r").alias("cov_r_mean"), F.avg("cov_p").alias("cov_p_mean"), F.median("cov_r").alias("cov_r_median"), F.median("cov_p").alias("cov_p_median"))
    strict = lambda f, c: F.when(F.count_if(F.col(c).isNull()) == 0, f(c))
    b = mats.agg(strict(F.avg, "mat_r").alias("mat_r_mean"), strict(F.avg, "mat_p").alias("mat_p_mean"), strict(F.median, "mat_r").alias("mat_r_median"), strict(F.median, "mat_p").alias("mat_p_median"))
    return a.crossJoin(b)  # two single rows


def nearest(pairs: DataFrame) -> DataFrame:
    """(key, j, best_i, d_min): nearest true member of each generated one, -1 if it has no distance; ties go to the smallest."""
    best = F.min(F.when(null_if_nan(F.col("r")).isNotNull(), F.struct("r", "i"))).alias("best")
    return pairs.groupBy("key", "j").agg(best).select("key", "j", F.coalesce("best.i", F.lit(-1)).alias("best_i"), F.col("best.r").alias("d_min"))


def unique_cover(pairs: DataFrame, delta: float) -> DataFrame:
    """(key, covered, uniquely_covered, n_true): covered: best distance below delta; uniquely: the second best is not."""
    w = Window.partitionBy("key", "i").orderBy(null_if_nan(F.col("r")).asc_nulls_last(), "j")
    two = pairs.withColumn("n", F.row_number().over(w)).filter("n <= 2")
    best = two.groupBy("key", "i").agg(F.min(F.when(F.col("n") == 1, F.col("r"))).alias("d1"), F.min(F.when(F.col("n") == 2, F.col("r"))).alias("d2"))
    hit = F.coalesce(F.col("d1") < delta, F.lit(False))
    alone = hit & F.coalesce(F.col("d2") >= delta, F.lit(True))
    return best.groupBy("key").agg(F.count_if(hit).alias("covered"), F.count_if(alone).alias("uniquely_covered"), F.count("*").alias("n_true"))
