"""Group-wise rewards: gates, quality, smooth coverage, matching, and their metrics.

Distances come in long form, (key, i, j, r): reference i, rollout j; null r for a pair without a distance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import null_if_nan, sigmoid
from ..sources.staging import staged
from . import coverage, matching, tiles
from .quantiles import quantiles


@dataclass(frozen=True)
class Params:
    delta: float = 0.75
    sigma: float = 0.25
    rho: float = 0.75
    w_quality: float = 1.0
    w_coverage: float = 1.0
    w_match: float = 1.0
    w_precision: float = 0.1
    w_depth: float = 0.2
    floor: float = -1.0
    #: a rollout without any distance is no longer valid (it gets the floor in any case)
    hard_distance: bool = False


def quality(d_min: Column, p: Params) -> Column:
    return F.when(d_min.isNotNull(), F.exp(-d_min / max(p.sigma, 1e-8))).otherwise(0.0)


def coverage_terms(pairs: DataFrame, p: Params) -> DataFrame:
    """(key, i, j, r, k, marginal): a rollout's own part in covering a reference: its kernel times the product of (1 - k) over the group's other rollouts.

    The product is exp of a window sum of logs; kernels of exactly 1 are counted apart."""
    d = pairs.withColumn("r", null_if_nan(F.col("r")))
    k = F.when(F.col("r").isNull(), 0.0).otherwise(sigmoid((p.delta - F.col("r")) / p.rho))
    d = d.withColumn("k", k).withColumn("_one", (F.col("k") >= 1.0).cast("int"))
    d = d.withColumn("_log", F.when(F.col("_one") == 1, 0.0).otherwise(F.log(1 - F.col("k"))))
    w = Window.partitionBy("key", "i")
    others = F.when(F.sum("_one").over(w) - F.col("_one") > 0, 0.0).otherwise(F.exp(F.sum("_log").over(w) - F.col("_log")))
    depth = 1 + p.w_depth * F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("r") / p.delta)), F.lit(0.0))
    return d.withColumn("marginal", F.col("k") * others * depth).drop("_one", "_log")


#: exp of a reference's sum of logs less any one of them (at least -36.8, the log of the least 1 - k above 0) is exactly 0 below this.
_NOTHING = -790.0


def _kernel(r: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k, whether it is exactly 1, and the log of 1 - k, 0 where it is."""
    with np.errstate(all="ignore"):
        k = np.where(np.isnan(r), 0.0, 1 / (1 + np.exp(-(p.delta - r) / p.rho)))
        one = k >= 1
        return k, one, np.where(one, 0.0, np.log(1 - k))


def nearness(true: DataFrame, gen: DataFrame, p: Params, scale: float = 1.0) -> DataFrame:
    """``coverage.extremes`` with, for references (side R), the sum of the logs of 1 - k over rollouts, the number of kernels that are exactly 1 and of distances below delta; staged. ``gen`` holds the valid rollouts."""

    def fold(a: tiles.Side, b: tiles.Side, same: bool, alone: bool, key: object) -> Iterator[dict]:
        found = coverage.Extremes(a, b, scale)
        log, ones, edges = np.zeros(len(a)), np.zeros(len(a), dtype=np.int64), np.zeros(len(a), dtype=np.int64)
        for at, r in tiles.strips(a, b, scale):
            found.add(at, r)
            _, one, of = _kernel(r, p)
            log[at], ones[at], edges[at] = of.sum(axis=1), one.sum(axis=1), (r < p.delta).sum(axis=1)
        for columns, more in zip(found.columns(), ((log, ones, edges), (np.zeros(len(b)), np.zeros(len(b), dtype=np.int64), np.zeros(len(b), dtype=np.int64)))):
            yield columns | dict(zip(("log", "one", "edges"), more))

    parts = tiles.meet(true, gen, fold, f"{coverage.EXTREMES}, log double, one bigint, edges bigint")
    return staged(coverage.merged(parts, *(F.sum(c).alias(c) for c in ("log", "one", "edges"))), "nearness")


def smoothed(true: DataFrame, gen: DataFrame, near: DataFrame, p: Params, scale: float = 1.0) -> DataFrame:
    """(key, j, d_min, best_i, cover) of valid rollouts, as from ``coverage_terms`` of all pairs: distances are worked out again, with the references' sums of ``nearness`` at hand.

    A reference whose product of (1 - k) is exactly 0 in double precision adds exactly 0 to every rollout and is not met again."""

    def fold(a: tiles.Side, b: tiles.Side, same: bool, alone: bool, key: object) -> Iterator[dict]:
        total = np.zeros(len(b))
        for at, r in tiles.strips(a, b, scale):
            k, one, log = _kernel(r, p)
            with np.errstate(all="ignore"):
                others = np.where(a.extra["one"][at, None] - one > 0, 0.0, np.exp(a.extra["log"][at, None] - log))
                depth = 1 + p.w_depth * np.where(np.isnan(r), 0.0, np.clip(1 - r / p.delta, 0.0, 1.0))
            total += (k * others * depth).sum(axis=0)
        yield {"j": b.ids, "cover": total}

    of = near.filter(f"side = 'R' and log >= {_NOTHING}").select("key", F.col("id").alias("conf_id"), "log", "one")
    some = tiles.meet(true.join(of, ["key", "conf_id"]), gen.withColumns({"log": F.lit(0.0), "one": F.lit(0).cast("long")}), fold, "j bigint, cover double", ("log", "one"))
    some = some.groupBy("key", "j").agg(F.sum("cover").alias("cover"))
    low = near.filter("side = 'P'").select("key", F.col("id").alias("j"), F.col("m").alias("d_min"), F.col("arg").alias("best_i"), "pairs")
    return low.join(some, ["key", "j"], "left").select("key", "j", "d_min", "best_i", (F.coalesce("cover", F.lit(0.0)) / F.col("pairs")).alias("cover"))


def mutual(near: DataFrame, delta: float) -> DataFrame:
    """``mutual_nearest`` of what ``coverage.extremes`` gives."""
    near = near.filter(F.col("m") < delta)
    of_i = near.filter("side = 'R'").select("key", F.col("id").alias("i"), F.col("arg").alias("j"), F.col("m").alias("d"))
    return of_i.join(near.filter("side = 'P'").select("key", F.col("arg").alias("i"), F.col("id").alias("j")), ["key", "i", "j"])


def gated(rollouts: DataFrame, check: Column | None = None) -> DataFrame:
    """Rollouts (key, j, graph, parsed) with ``base``, ``check`` and ``valid``: both gates passed, then the check gate.

    ``check`` is pass, fail or error for rollouts that pass both gates; other rollouts aren't checked, and without
    a check none is (null), which leaves validity to the gates. A check that failed to run counts as not passed."""
    base = rollouts.withColumn("base", F.col("graph") & F.col("parsed"))
    state = F.lit(None).cast("string") if check is None else F.when(F.col("base"), F.coalesce(check, F.lit("error")))
    return base.withColumn("check", state).withColumn("valid", F.col("base") & F.coalesce(F.col("check") == "pass", F.lit(True)))


def rollout_rewards(pairs: DataFrame, rollouts: DataFrame, p: Params, matched: DataFrame | None = None) -> DataFrame:
    """(key, j, graph, parsed, valid, d_min, best_i, r_qual, r_smcov, r_match, reward) of every rollout.

    Rollouts that fail a gate, and those without any distance, get the floor. ``matched``: (key, j, d) from ``matching.assign``."""
    terms = coverage_terms(pairs.join(rollouts.filter("valid").select("key", "j"), ["key", "j"]), p)
    each = terms.groupBy("key", "j").agg(F.min("r").alias("d_min"), F.min(F.when(F.col("r").isNotNull(), F.struct("r", "i"))).alias("_b"), F.avg("marginal").alias("cover"))
    return scored(each.withColumn("best_i", F.col("_b.i")).drop("_b"), rollouts, p, matched)


def scored(each: DataFrame, rollouts: DataFrame, p: Params, matched: DataFrame | None = None) -> DataFrame:
    """``rollout_rewards`` from (key, j, d_min, best_i, cover) of the valid rollouts, as ``smoothed`` gives."""
    out = rollouts.join(each, ["key", "j"], "left")
    match = F.lit(0.0)
    if matched is not None and p.w_match:
        out = out.join(matched.select("key", "j", "d"), ["key", "j"], "left")
        match = F.coalesce(F.greatest(F.lit(0.0), 1 - F.col("d") / p.delta), F.lit(0.0))
    ok = F.col("valid") & F.col("d_min").isNotNull()
    precision = F.lit(p.w_precision) * sigmoid((p.delta - F.col("d_min")) / p.rho) if p.w_precision else F.lit(0.0)
    out = out.withColumn("r_qual", quality(F.col("d_min"), p)).withColumn("r_smcov", F.when(ok, F.col("cover") + precision).otherwise(0.0)).withColumn("r_match", match)
    # a term without weight is not computed into the sum at all
    parts = [w * F.col(c) for w, c in ((p.w_quality, "r_qual"), (p.w_coverage, "r_smcov"), (p.w_match, "r_match")) if w]
    total = sum(parts[1:], parts[0]) if parts else F.lit(0.0)
    out = out.withColumn("reward", F.when(ok, total).otherwise(F.lit(p.floor))).drop("cover", "d")
    return out.withColumn("valid", ok) if p.hard_distance else out


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a cheapest assignment of a square matrix: shortest augmenting paths with potentials."""
    n = len(cost)
    u, v, owner = np.zeros(n + 1), np.zeros(n + 1), np.full(n + 1, -1)
    for row in range(n):
        owner[n] = row
        col, low, came, done = n, np.full(n, np.inf), np.full(n, -1), np.zeros(n + 1, dtype=bool)
        while owner[col] >= 0:
            done[col] = True
            r = owner[col]
            slack = cost[r] - u[r] - v[:n]
            better = ~done[:n] & (slack < low)
            low[better], came[better] = slack[better], col
            nxt = int(np.argmin(np.where(done[:n], np.inf, low)))
            step = low[nxt]
            u[owner[done]] += step
            v[done] -= step
            low[~done[:n]] -= step
            col = nxt
        while col != n:
            owner[col] = owner[came[col]]
            col = int(came[col])
    out = np.empty(n, dtype=int)
    out[owner[:n]] = np.arange(n)
    return out


def match_pairs(d: np.ndarray, delta: float) -> list[tuple[int, int]]:
    """(row, column) pairs below ``delta``: as many as possible, then the smallest total distance."""
    ok = np.isfinite(d) & (d < delta)
    n = max(d.shape)
    cost = np.full((n, n), 1e6)
    cost[: d.shape[0], : d.shape[1]] = np.where(ok, d, 1e6)
    return [(i, j) for i, j in enumerate(assignment(cost)) if i < d.shape[0] and j < d.shape[1] and ok[i, j]]


def mutual_nearest(pairs: DataFrame, delta: float) -> DataFrame:
    """(key, i, j, d): pairs below ``delta`` that are each other's nearest, ties to the smaller id: a matching for groups of any size."""
    near = pairs.filter(F.col("r") < delta)
    of_i = near.groupBy("key", "i").agg(F.min(F.struct("r", "j")).alias("n")).select("key", "i", F.col("n.j").alias("j"), F.col("n.r").alias("d"))
    of_j = near.groupBy("key", "j").agg(F.min(F.struct("r", "i")).alias("n")).select("key", F.col("n.i").alias("i"), "j")
    return of_i.join(of_j, ["key", "i", "j"])


def spearman(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation by group, ties at their average rank (values equal to 9 digits); null for fewer than two rows or no spread."""

    def rank(c: str) -> Column:
        value = F.round(c, 9)
        ties = F.count("*").over(Window.partitionBy(*group, value))
        return F.rank().over(Window.partitionBy(*group).orderBy(value)) + (ties - 1) / 2

    ranked = df.select(*group, rank(x).cast("double").alias("a"), rank(y).cast("double").alias("b"))
    r = F.try_divide(F.covar_pop("a", "b"), F.stddev_pop("a") * F.stddev_pop("b"))
    return ranked.groupBy(*group).agg(F.when(F.count("*") >= 2, r).alias("rho"))


def group_metrics(pairs: DataFrame, rewards: DataFrame, p: Params, matched: DataFrame | None = None) -> DataFrame:
    """One row for each group: counts of gates and checks, references hit, coverage, distinct nearest references, matches, spreads.

    ``rewards`` as from ``rollout_rewards`` over ``gated`` rollouts; ``pairs`` holds every reference of a group at least once."""
    valid = pairs.join(rewards.filter("valid").select("key", "j"), ["key", "j"]).withColumn("r", null_if_nan(F.col("r")))
    k = F.when(F.col("r").isNull(), 0.0).otherwise(sigmoid((p.delta - F.col("r")) / p.rho))
    # the two nearest rollouts of a reference, the second by id where distances are equal
    two = F.min(F.when(F.col("r").isNotNull(), F.struct("r", "j")))
    refs = valid.groupBy("key", "i").agg(two.alias("first"), (1 - F.exp(F.sum(F.log(1 - k)))).alias("soft"), F.count_if(F.col("r") < p.delta).alias("edges"))
    return grouped(refs.withColumn("d1", F.col("first.r")), pairs.groupBy("key").agg(F.countDistinct("i").alias("m")), rewards, p, matched)


def grouped(refs: DataFrame, m: DataFrame, rewards: DataFrame, p: Params, matched: DataFrame | None = None) -> DataFrame:
    """``group_metrics`` from the references that valid rollouts meet (key, i, d1, soft, edges) and the number of references of each group (key, m)."""
    hit = F.coalesce(F.col("d1") < p.delta, F.lit(False))
    alone = hit & (F.col("edges") == 1)
    share = lambda c: F.avg(c.cast("double"))
    per_ref = refs.groupBy("key").agg(F.count_if(hit).alias("refs_hit"), share(hit).alias("cov_ratio"), share(alone).alias("unique_cover_ratio"), F.avg("soft").alias("soft_cov"), share(F.col("soft") > 0.1).alias("soft_gt_01"), share(F.col("soft") > 0.5).alias("soft_gt_05"), F.sum("edges").alias("edges"))
    ok = F.col("valid") & F.col("d_min").isNotNull()
    on = lambda c: F.when(F.col("valid"), F.col(c))
    counts = [F.count("*").alias("k"), *(F.count_if(c).alias(f"n_{c}") for c in ("graph", "parsed", "base", "valid")), F.count("check").alias("n_checked"), F.count_if(F.col("check") == "pass").alias("n_passed"), F.count_if(F.col("check") == "error").alias("n_errors")]
    spreads = [F.stddev_pop(on(c)).alias(f"std_{c.removeprefix('r_')}") for c in ("r_qual", "r_smcov", "r_match", "reward")]
    per = rewards.groupBy("key").agg(*counts, F.countDistinct(F.when(ok, F.col("best_i"))).alias("unique_nearest"), F.count_if(ok).alias("n_near"), *spreads)
    rho = spearman(rewards.filter("valid").select("key", "r_smcov", "reward"), ["key"], "r_smcov", "reward")
    out = per.join(m, "key", "left").join(per_ref, "key", "left").join(rho, "key", "left")
    if matched is not None:
        out = out.join(matched.groupBy("key").agg(F.count("*").alias("n_matched")), "key", "left")
    else:
        out = out.withColumn("n_matched", F.lit(0).cast("long"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    collision = F.when(F.col("n_near") > 0, F.greatest(F.lit(0.0), 1 - F.col("unique_nearest") / F.col("n_near"))).otherwise(0.0)
    out = out.withColumn("collision", collision).withColumns({c: zero(c) for c in ("refs_hit", "n_matched", "edges")})
    out = out.withColumn("possible", F.least("n_valid", "refs_hit")).withColumn("efficiency", F.when(F.col("possible") == 0, 0.0).otherwise(F.col("n_matched") / F.col("possible")))
    # the same ratios twice: means over groups that have a ratio, and over all groups
    return out.withColumn("cover_ratio", F.col("cov_ratio")).withColumns({"cov_ratio": zero("cov_ratio"), "covered_ratio": zero("cov_ratio"), "unique_covered_ratio": zero("unique_cover_ratio")})


def batch_metrics(groups: DataFrame, rewards: DataFrame, p: Params, matched: DataFrame, between: DataFrame | float | None) -> DataFrame:
    """The batch's 47 metrics in one row: ratios over rollouts, means over groups, percentiles over pooled rollouts; 0 where nothing counts.

    ``matched`` (key, i, j, d) and ``between`` (r: distances between a group's valid rollouts, or their median)
    give percentiles that are NaN where there are none. The correlation is NaN where groups don't differ in one of its sides."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    of = lambda df, name, c: df.select(F.lit(name).alias("name"), F.col(c).cast("double").alias("v"))
    pooled = of(groups, "refs", "refs_hit").unionByName(of(rewards.filter("valid"), "near", "d_min")).unionByName(of(matched, "far", "d"))
    wanted = [("refs", 0.5), ("near", 0.5), ("near", 0.9), ("far", 0.5), ("far", 0.9)]
    if isinstance(between, DataFrame):
        found = quantiles(pooled.unionByName(of(between, "between", "r")), [*wanted, ("between", 0.5)])
    else:
        found = quantiles(pooled, wanted) | {("between", 0.5): between}
    known = lambda name, q, otherwise: F.lit(otherwise if found[name, q] is None else found[name, q])
    nan = float("nan")
    ratio = lambda a, b: z(F.try_divide(F.sum(a), F.sum(b)))
    corr = F.try_divide(F.covar_pop("refs_hit", "soft_cov"), F.stddev_pop(F.when(F.col("soft_cov").isNotNull(), F.col("refs_hit"))) * F.stddev_pop("soft_cov"))
    corr = F.when(F.count("soft_cov") > 0, F.coalesce(corr, F.lit(nan)))
    mean = lambda c, name: z(F.avg(c)).alias(name)
    g = groups.agg(
        ratio("n_graph", "k").alias("graph_match_rate"), ratio("n_parsed", "k").alias("parse_rate"), ratio("n_base", "k").alias("base_valid_rate"), ratio("n_valid", "k").alias("final_valid_rate"),
        ratio("n_checked", "n_base").alias("checked_rate"), ratio("n_passed", "n_checked").alias("check_pass_rate"), ratio("n_errors", "n_checked").alias("check_error_rate"),
        mean("refs_hit", "refs_hit_mean"), known("refs", 0.5, 0.0).alias("refs_hit_p50"), mean("cov_ratio", "cov_ratio_mean"), mean("unique_nearest", "unique_nearest_mean"), mean("collision", "collision_mean"), mean("n_valid", "valid_mean"),
        mean("cover_ratio", "cover_ratio_mean"), mean("unique_cover_ratio", "unique_cover_ratio_mean"), mean("covered_ratio", "covered_ratio_mean"), mean("unique_covered_ratio", "unique_covered_ratio_mean"),
        mean("n_matched", "num_matched_mean"), mean("possible", "max_possible_mean"), mean("efficiency", "efficiency_mean"),
        z(F.try_divide(F.sum("edges"), F.sum(F.col("k") * F.col("m")))).alias("edge_density"), mean("soft_cov", "soft_cov_mean"), mean("soft_gt_01", "soft_gt_01"), mean("soft_gt_05", "soft_gt_05"), z(corr).alias("soft_refs_corr"),
        mean("std_qual", "qual_group_std"), mean("std_smcov", "smcov_group_std"), mean("std_match", "match_group_std"), mean("std_reward", "group_std"), mean("rho", "rank_corr_mean"),
    )
    d, parts = F.col("d_min"), (("qual", p.w_quality), ("smcov", p.w_coverage), ("match", p.w_match))
    r = rewards.filter("valid").agg(
        z(F.avg(d)).alias("d_min_mean"), known("near", 0.5, 0.0).alias("d_min_p50"), known("near", 0.9, 0.0).alias("d_min_p90"),
        z(F.avg((d < p.delta).cast("double"))).alias("under_delta"), z(F.avg((d < 2 * p.delta).cast("double"))).alias("under_2delta"),
        z(F.avg("reward")).alias("total_mean"), z(F.stddev_pop("reward")).alias("total_std"),
        *(z(F.avg(w * F.col(f"r_{c}"))).alias(f"comp_{c}_mean") for c, w in parts), *(z(F.stddev_pop(w * F.col(f"r_{c}"))).alias(f"comp_{c}_std") for c, w in parts),
    )
    out = g.crossJoin(r).select("*", known("far", 0.5, nan).alias("dist_p50"), known("far", 0.9, nan).alias("dist_p90"), known("between", 0.5, nan).alias("pairwise_p50"))  # two single rows
    return out.withColumn("smcov_frac", F.when(F.col("total_mean") == 0, 0.0).otherwise(F.col("comp_smcov_mean") / (F.col("total_mean") + 1e-8)))


def counters(rewards: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rollouts and failures of a batch, in one row: no reference at all, another graph, unparsed, check not passed, no distance."""
    known = pairs.select("key").distinct().withColumn("truth", F.lit(True))
    r = rewards.join(known, "key", "left").withColumn("truth", F.coalesce("truth", F.lit(False)))
    failed = lambda c: F.count_if(F.col("truth") & c)
    return r.agg(F.count("*").alias("rollouts"), F.count_if(~F.col("truth")).alias("failed_ground_truth"), failed(~F.col("graph")).alias("failed_matching"), failed(F.col("graph") & ~F.col("parsed")).alias("failed_parsing"), failed(F.col("base") & ~F.col("valid")).alias("failed_checks"), failed(F.col("valid") & F.col("d_min").isNull()).alias("failed_distance"))


def met(near: DataFrame) -> DataFrame:
    """The references of ``nearness`` as ``grouped`` takes them."""
    return near.filter("side = 'R'").select("key", F.col("id").alias("i"), F.col("m").alias("d1"), (1 - F.exp("log")).alias("soft"), "edges")


def match_metrics(matched: DataFrame, groups: DataFrame) -> DataFrame:
    """Matched pairs: mean number, mean of the possible number, efficiency, percentiles of the distance (NaN if there are none)."""
    a = groups.agg(F.avg("n_matched").alias("num_matched_mean"), F.avg("possible").alias("max_possible_mean"), F.avg("efficiency").alias("efficiency_mean"))
    found = quantiles(matched.select(F.lit("far").alias("name"), F.col("d").alias("v")), [("far", 0.5), ("far", 0.9)])
    return a.select("*", *(F.lit(float("nan") if x is None else x).alias(f"dist_p{round(100 * q)}") for (_, q), x in found.items()))


def legacy_reward(d_min: Column, text_match: Column, truth: Column, generated: Column, same_graph: Column, scale: float = 1.25, w_rmsd: float = 0.5, w_match: float = 0.5) -> tuple[Column, Column]:
    """Weighted reward 1/(1 + d/scale) and text match, and the failure: ground truth before missing block before graph before distance."""
    total = w_rmsd + w_match
    reward = (w_rmsd * F.when(d_min.isNotNull(), 1 / (1 + d_min / scale)).otherwise(0.0) + w_match * text_match) / total
    failure = F.when(~truth, "ground_truth").when(~generated, "missing_conformer").when(~same_graph, "graph_mismatch").when(d_min.isNull(), "rmsd_nan")
    return F.when(failure.isin("ground_truth", "missing_conformer"), 0.0).otherwise(reward), failure


def _legacy(pairs: DataFrame, rollouts: DataFrame, p: Params) -> DataFrame:
    """(key, j, reward) by the legacy rule: same graph counts as the text match, unparsed rollouts as missing."""
    low = pairs.groupBy("key", "j").agg(F.min(null_if_nan(F.col("r"))).alias("d_min"))
    known = pairs.select("key").distinct().withColumn("truth", F.lit(True))
    r = rollouts.join(low, ["key", "j"], "left").join(known, "key", "left")
    reward, failure = legacy_reward(F.col("d_min"), F.col("graph").cast("double"), F.coalesce("truth", F.lit(False)), F.col("parsed"), F.col("graph"))
    return r.select("key", "j", reward.alias("reward"), failure.alias("failure"))


def _v3(pairs: DataFrame, rollouts: DataFrame, p: Params) -> DataFrame:
    matched = matching.assign(pairs.join(rollouts.filter("valid").select("key", "j"), ["key", "j"]), p.delta) if p.w_match else None
    return rollout_rewards(pairs, rollouts, p, matched)


#: Rewards of (pairs, gated rollouts, parameters) by the name of a strategy; more may be added.
STRATEGIES: dict[str, Callable[[DataFrame, DataFrame, Params], DataFrame]] = {"v3": _v3, "legacy": _legacy}


def strategy(name: str) -> Callable[[DataFrame, DataFrame, Params], DataFrame]:
    if name not in STRATEGIES:
        raise ValueError(f"no reward strategy {name!r}; there are {sorted(STRATEGIES)}")
    return STRATEGIES[name]
