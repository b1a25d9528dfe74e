"""Queries over rollouts and rewards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.geometry import null_if_nan
from ..operators import coverage, matching, pair_quantiles, rewards
from ..session import table
from ..sources.staging import staged
from .registry import query
from .views import PAIRS_SQL, RMSD_SQL, ROLLOUT_SQL, SCALE, rollouts, true_and_generated

P = rewards.Params(w_match=0.0)
PM = rewards.Params()


def _setup(spark, sf_dir):
    """Pairs (every 13th rollout's distances are NaN) and rollouts with their gates and check states."""
    true, gen = true_and_generated(spark, sf_dir)
    pairs = coverage.pair_distances(true, gen, SCALE)
    pairs = pairs.withColumn("r", null_if_nan(F.when(F.col("j") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("r"))))
    return pairs, _runs(gen)


def _runs(gen):
    j = F.col("conf_id")
    runs = gen.select("key", j.alias("j"), (j % 7 != 0).alias("graph"), (j % 11 != 0).alias("parsed"))
    j = F.col("j")
    return rewards.gated(runs, F.when(j % 17 == 0, "error").when(j % 5 == 0, "fail").otherwise("pass"))


def _sets(spark, sf_dir):
    """References, generated members (every 13th has no distances), and rollouts with their gates and check states: the same without pairs."""
    true, gen = true_and_generated(spark, sf_dir)
    return true, gen.withColumn("xyz", F.when(F.col("conf_id") % 13 != 0, F.col("xyz"))), _runs(gen)


def _valid(gen, runs):
    return gen.join(runs.filter("valid").select("key", F.col("j").alias("conf_id")), ["key", "conf_id"])


def _rewards(spark, sf_dir):
    true, gen, runs = _sets(spark, sf_dir)
    gen = _valid(gen, runs)
    return rewards.scored(rewards.smoothed(true, gen, rewards.nearness(true, gen, P, SCALE), P, SCALE), runs, P)


_SIG = lambda x: f"(1 / (1 + exp(-({x}))))"
_R = f"""{PAIRS_SQL}, d AS (SELECT key, i, j, CASE WHEN j % 13 = 0 THEN NULL ELSE r END AS r FROM pairs),
ra0 AS (SELECT key, conf_id AS j, conf_id % 7 <> 0 AS graph, conf_id % 11 <> 0 AS parsed FROM v_gen),
ro AS (SELECT *, graph AND parsed AS base, CASE WHEN graph AND parsed THEN CASE WHEN j % 17 = 0 THEN 'error' WHEN j % 5 = 0 THEN 'fail' ELSE 'pass' END END AS chk, graph AND parsed AND j % 17 <> 0 AND j % 5 <> 0 AS valid FROM ra0),
dv AS (SELECT d.* FROM d JOIN ro USING (key, j) WHERE valid),
kk AS (SELECT *, CASE WHEN r IS NULL THEN 0.0::DOUBLE ELSE {_SIG('(0.75 - r) / 0.75')} END AS k FROM dv),
mg AS (SELECT *, k * exp(sum(ln(1 - k)) OVER (PARTITION BY key, i) - ln(1 - k)) * (1 + 0.2 * coalesce(greatest(0.0, least(1.0, 1 - r / 0.75)), 0.0)) AS marginal FROM kk),
ea AS (SELECT key, j, min(r) AS d_min, arg_min(i, r) AS best_i, avg(marginal) AS cover FROM mg GROUP BY key, j),
rw AS (SELECT key, j, graph, parsed, base, chk, valid, d_min, best_i, CASE WHEN d_min IS NULL THEN 0.0::DOUBLE ELSE exp(-d_min / 0.25) END AS r_qual,
  CASE WHEN valid AND d_min IS NOT NULL THEN cover + 0.1 * {_SIG('(0.75 - d_min) / 0.75')} ELSE 0.0::DOUBLE END AS r_smcov FROM ro LEFT JOIN ea USING (key, j)),
"""
_MUTUAL = """bi AS (SELECT key, i, arg_min(j, struct_pack(r, j)) AS j, min(r) AS d FROM dv WHERE r < 0.75 GROUP BY key, i),
bj AS (SELECT key, j, arg_min(i, struct_pack(r, i)) AS i FROM dv WHERE r < 0.75 GROUP BY key, j),
mt AS (SELECT key, i, j, d FROM bi JOIN bj USING (key, i, j))"""
_RM = f"""{_R}{_MUTUAL},
rm AS (SELECT rw.*, coalesce(greatest(0.0, 1 - mt.d / 0.75), 0.0) AS r_match FROM rw LEFT JOIN mt USING (key, j)),
rr AS (SELECT *, CASE WHEN valid AND d_min IS NOT NULL THEN r_qual + r_smcov + r_match ELSE -1.0::DOUBLE END AS reward FROM rm)"""
_R = f"""{_R}rr AS (SELECT *, CASE WHEN valid AND d_min IS NOT NULL THEN r_qual + r_smcov ELSE -1.0::DOUBLE END AS reward FROM rw)"""


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query(f"WITH {_R} SELECT key, j, round(d_min, 6) AS d_min, round(r_qual, 6) AS r_qual FROM rr")
def quality_reward(spark, sf_dir):
    return _rounded(_rewards(spark, sf_dir).select("key", "j", "d_min", "r_qual"), "d_min", "r_qual")


@query(f"WITH {_R} SELECT key, j, round(r_smcov, 6) AS r_smcov FROM rr")
def smooth_coverage(spark, sf_dir):
    return _rounded(_rewards(spark, sf_dir).select("key", "j", "r_smcov"), "r_smcov")


@query(f"WITH {_R} SELECT key, j, valid, coalesce(best_i, -1) AS best_i, round(reward, 6) AS reward FROM rr")
def combine_reward(spark, sf_dir):
    return _rounded(_rewards(spark, sf_dir).select("key", "j", "valid", F.coalesce("best_i", F.lit(-1)).alias("best_i"), "reward"), "reward")


#: Consecutive numbers within which references and rollouts of a key are matched.
PART = 128


@query(f"""WITH RECURSIVE {_R}, el AS (SELECT key, i // {PART} AS part, i, j, r FROM dv WHERE r < 0.75 AND i // {PART} = j // {PART}),
li AS (SELECT key, part, i, row_number() OVER (PARTITION BY key, part ORDER BY i) AS n FROM (SELECT DISTINCT key, part, i FROM el)),
op AS (SELECT key, part, n, i, j, r FROM el JOIN li USING (key, part, i) UNION ALL SELECT key, part, n, i, NULL, 0 FROM li),
m AS (SELECT DISTINCT key, part, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS js, CAST([] AS STRUCT(i BIGINT, j BIGINT, r DOUBLE)[]) AS ps, CAST(0 AS DOUBLE) AS total FROM li
  UNION ALL SELECT key, part, op.n, CASE WHEN op.j IS NULL THEN js ELSE list_append(js, op.j) END, CASE WHEN op.j IS NULL THEN ps ELSE list_append(ps, {{'i': op.i, 'j': op.j, 'r': op.r}}) END, total + op.r FROM m JOIN op USING (key, part) WHERE op.n = m.n + 1 AND (op.j IS NULL OR NOT list_contains(js, op.j))),
b AS (SELECT key, part, ps, row_number() OVER (PARTITION BY key, part ORDER BY len(js) DESC, total) AS o FROM m JOIN (SELECT key, part, max(n) AS last FROM li GROUP BY key, part) USING (key, part) WHERE n = last)
SELECT key, part, p.i AS i, p.j AS j, round(p.r, 6) AS d FROM (SELECT key, part, unnest(ps) AS p FROM b WHERE o = 1)""")
def assignment(spark, sf_dir):
    """The matched pairs of each key's references and rollouts with numbers in one stretch: in SQL, the best of all matchings."""
    pairs, runs = _setup(spark, sf_dir)
    near = pairs.join(runs.filter("valid").select("key", "j"), ["key", "j"])
    part = lambda c: F.floor(F.col(c) / PART)
    near = near.filter(part("i") == part("j")).select(F.struct("key", part("i").alias("part")).alias("key"), "i", "j", "r")
    return matching.assign(near, PM.delta).select("key.key", "key.part", "i", "j", F.round("d", 6).alias("d"))


_RANK = lambda c: f"rank() OVER (PARTITION BY key ORDER BY round({c}, 9)) + (count(*) OVER (PARTITION BY key, round({c}, 9)) - 1) / 2.0"
_RHO = f"rk AS (SELECT key, CAST({_RANK('r_smcov')} AS DOUBLE) AS a, CAST({_RANK('reward')} AS DOUBLE) AS b FROM rr WHERE valid), rho AS (SELECT key, CASE WHEN count(*) >= 2 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) END AS rho FROM rk GROUP BY key)"


@query(f"WITH {_R}, {_RHO} SELECT key, round(rho, 6) AS rho FROM rho")
def spearman(spark, sf_dir):
    r = rewards.rollout_rewards(*_setup(spark, sf_dir), P).filter("valid")
    return _rounded(rewards.spearman(r.select("key", "r_smcov", "reward"), ["key"], "r_smcov", "reward"), "rho")


_G = f"""{_RM}, {_RHO},
rf AS (SELECT key, i, min(r) AS d1, 1 - exp(sum(ln(1 - k))) AS soft, count(*) FILTER (WHERE r < 0.75) AS edges FROM kk GROUP BY key, i),
pr AS (SELECT key, count(*) FILTER (WHERE d1 < 0.75) AS refs_hit, avg(CASE WHEN d1 < 0.75 THEN 1.0::DOUBLE ELSE 0.0 END) AS cov_ratio, avg(CASE WHEN edges = 1 THEN 1.0::DOUBLE ELSE 0.0 END) AS unique_cover_ratio,
 avg(soft) AS soft_cov, avg(CASE WHEN soft > 0.1 THEN 1.0::DOUBLE ELSE 0.0 END) AS soft_gt_01, avg(CASE WHEN soft > 0.5 THEN 1.0::DOUBLE ELSE 0.0 END) AS soft_gt_05, sum(edges) AS edges FROM rf GROUP BY key),
pg AS (SELECT key, count(*) AS k, count(*) FILTER (WHERE graph) AS n_graph, count(*) FILTER (WHERE parsed) AS n_parsed, count(*) FILTER (WHERE base) AS n_base, count(*) FILTER (WHERE valid) AS n_valid, count(chk) AS n_checked, count(*) FILTER (WHERE chk = 'pass') AS n_passed, count(*) FILTER (WHERE chk = 'error') AS n_errors,
 count(DISTINCT best_i) FILTER (WHERE valid AND d_min IS NOT NULL) AS unique_nearest, count(*) FILTER (WHERE valid AND d_min IS NOT NULL) AS n_near,
 stddev_pop(r_qual) FILTER (WHERE valid) AS std_qual, stddev_pop(r_smcov) FILTER (WHERE valid) AS std_smcov, stddev_pop(r_match) FILTER (WHERE valid) AS std_match, stddev_pop(reward) FILTER (WHERE valid) AS std_reward FROM rr GROUP BY key),
mm AS (SELECT key, count(DISTINCT i) AS m FROM d GROUP BY key),
mn AS (SELECT key, count(*) AS n_matched FROM mt GROUP BY key),
g AS (SELECT pg.*, m, coalesce(refs_hit, 0) AS refs_hit, coalesce(cov_ratio, 0) AS cov_ratio, cov_ratio AS cover_ratio, unique_cover_ratio, soft_cov, soft_gt_01, soft_gt_05, coalesce(edges, 0) AS edges, rho, coalesce(n_matched, 0) AS n_matched, least(n_valid, coalesce(refs_hit, 0)) AS possible,
 CASE WHEN n_near > 0 THEN greatest(0.0, 1 - unique_nearest / n_near) ELSE 0.0 END AS collision FROM pg LEFT JOIN mm USING (key) LEFT JOIN pr USING (key) LEFT JOIN rho USING (key) LEFT JOIN mn USING (key)),
ga AS (SELECT sum(n_graph) / sum(k) AS graph_match_rate, sum(n_parsed) / sum(k) AS parse_rate, sum(n_base) / sum(k) AS base_valid_rate, sum(n_valid) / sum(k) AS final_valid_rate, sum(n_checked) / sum(n_base) AS checked_rate, sum(n_passed) / sum(n_checked) AS check_pass_rate, sum(n_errors) / sum(n_checked) AS check_error_rate,
 avg(refs_hit) AS refs_hit_mean, median(refs_hit) AS refs_hit_p50, avg(cov_ratio) AS cov_ratio_mean, avg(unique_nearest) AS unique_nearest_mean, avg(collision) AS collision_mean, avg(n_valid) AS valid_mean, avg(cover_ratio) AS cover_ratio_mean, avg(unique_cover_ratio) AS unique_cover_ratio_mean, avg(coalesce(cover_ratio, 0)) AS covered_ratio_mean, avg(coalesce(unique_cover_ratio, 0)) AS unique_covered_ratio_mean,
 avg(n_matched) AS num_matched_mean, avg(possible) AS max_possible_mean, avg(CASE WHEN possible = 0 THEN 0.0::DOUBLE ELSE n_matched / possible END) AS efficiency_mean,
 sum(edges) / sum(k * m) AS edge_density, avg(soft_cov) AS soft_cov_mean, avg(soft_gt_01) AS soft_gt_01, avg(soft_gt_05) AS soft_gt_05, coalesce(corr(refs_hit, soft_cov), 0) AS soft_refs_corr, avg(std_qual) AS qual_group_std, avg(std_smcov) AS smcov_group_std, avg(std_match) AS match_group_std, avg(std_reward) AS group_std, avg(rho) AS rank_corr_mean FROM g),
ra AS (SELECT avg(d_min) AS d_min_mean, median(d_min) AS d_min_p50, quantile_cont(d_min, 0.9) AS d_min_p90, avg(CASE WHEN d_min < 0.75 THEN 1.0::DOUBLE WHEN d_min IS NULL THEN NULL ELSE 0.0 END) AS under_delta, avg(CASE WHEN d_min < 1.5 THEN 1.0::DOUBLE WHEN d_min IS NULL THEN NULL ELSE 0.0 END) AS under_2delta, avg(reward) AS total_mean, stddev_pop(reward) AS total_std,
 avg(r_qual) AS comp_qual_mean, avg(r_smcov) AS comp_smcov_mean, avg(r_match) AS comp_match_mean, stddev_pop(r_qual) AS comp_qual_std, stddev_pop(r_smcov) AS comp_smcov_std, stddev_pop(r_match) AS comp_match_std FROM rr WHERE valid),
md AS (SELECT coalesce(median(d), 'nan'::DOUBLE) AS dist_p50, coalesce(quantile_cont(d, 0.9), 'nan'::DOUBLE) AS dist_p90 FROM mt),
vg AS (SELECT v.* FROM v_gen v JOIN ro ON v.key = ro.key AND v.conf_id = ro.j WHERE ro.valid),
bt AS (SELECT median({SCALE} * {RMSD_SQL}) AS pairwise_p50 FROM vg a JOIN vg b ON a.key = b.key AND a.conf_id < b.conf_id)"""
_METRICS = "graph_match_rate parse_rate base_valid_rate final_valid_rate checked_rate check_pass_rate check_error_rate refs_hit_mean refs_hit_p50 cov_ratio_mean unique_nearest_mean collision_mean valid_mean cover_ratio_mean unique_cover_ratio_mean covered_ratio_mean unique_covered_ratio_mean num_matched_mean max_possible_mean efficiency_mean edge_density soft_cov_mean soft_gt_01 soft_gt_05 soft_refs_corr qual_group_std smcov_group_std match_group_std group_std rank_corr_mean d_min_mean d_min_p50 d_min_p90 under_delta under_2delta total_mean total_std comp_qual_mean comp_smcov_mean comp_match_mean comp_qual_std comp_smcov_std comp_match_std dist_p50 dist_p90 pairwise_p50".split()


def _scored(spark, sf_dir):
    """Groups, rollouts' rewards, matched pairs and the valid rollouts' members, each computed once. Mutual nearest pairs are the matching, which SQL can say."""
    true, gen, runs = _sets(spark, sf_dir)
    runs = staged(runs, "rollouts")
    valid = _valid(gen, runs)
    near = rewards.nearness(true, valid, PM, SCALE)
    matched = staged(rewards.mutual(near, PM.delta), "matched")
    r = staged(rewards.scored(rewards.smoothed(true, valid, near, PM, SCALE), runs, PM, matched), "rewards")
    m = true.join(gen.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.countDistinct("conf_id").alias("m"))
    return staged(rewards.grouped(rewards.met(near), m, r, PM, matched), "groups"), r, matched


@query(f"WITH {_G} SELECT {', '.join(f'round({c}, 6) AS {c}' for c in _METRICS)}, round(comp_smcov_mean / (total_mean + 1e-8), 6) AS smcov_frac FROM ga, ra, md, bt")
def batch_metrics(spark, sf_dir):
    """All 47 metrics; the distances between rollouts are those of all pairs of a group."""
    groups, r, matched = _scored(spark, sf_dir)
    valid = _valid(true_and_generated(spark, sf_dir)[1], r)
    out = rewards.batch_metrics(groups, r, PM, matched, pair_quantiles.pooled(valid, 0.5, SCALE))
    return _rounded(out, *out.columns)


@query(f"WITH {_G} SELECT round(num_matched_mean, 6) AS num_matched_mean, round(max_possible_mean, 6) AS max_possible_mean, round(efficiency_mean, 6) AS efficiency_mean, round(dist_p50, 6) AS dist_p50, round(dist_p90, 6) AS dist_p90 FROM ga, md")
def match_metrics(spark, sf_dir):
    groups, _, matched = _scored(spark, sf_dir)
    out = rewards.match_metrics(matched, groups)
    return _rounded(out, *out.columns)


@query(f"WITH {_R} SELECT count(*) AS rollouts, count(*) FILTER (WHERE NOT t) AS failed_ground_truth, count(*) FILTER (WHERE t AND NOT graph) AS failed_matching, count(*) FILTER (WHERE t AND graph AND NOT parsed) AS failed_parsing, count(*) FILTER (WHERE t AND base AND NOT valid) AS failed_checks, count(*) FILTER (WHERE t AND valid AND d_min IS NULL) AS failed_distance FROM (SELECT *, key IN (SELECT key FROM d) AS t FROM rr)")
def reward_counters(spark, sf_dir):
    pairs, runs = _setup(spark, sf_dir)
    return rewards.counters(rewards.rollout_rewards(pairs, runs, P), pairs)


_BLOCK = "regexp_extract(completion, '(?s)\\[CONFORMER\\](.*?)\\[/CONFORMER\\]', 1)"
_CANON = "regexp_extract(prompt, '(?s)\\[SMILES\\](.*?)\\[/SMILES\\]', 1)"
_GATES = f"{ROLLOUT_SQL}, gt AS (SELECT group_id, pos, {_CANON} AS canonical, {_BLOCK} AS block, completion FROM v_rollout)"


def _gates(spark, sf_dir):
    r = rollouts(spark, sf_dir)
    return r.select("group_id", "pos", text.extract_between(F.col("prompt"), *text.SMILES).alias("canonical"), text.extract_between(F.col("completion"), *text.CONFORMER).alias("block"), "completion")


@query(f"WITH {_GATES} SELECT group_id, pos, block <> '' AS parsed, block <> '' AND block = canonical AS graph FROM gt")
def gates(spark, sf_dir):
    parsed = F.col("block") != ""
    return _gates(spark, sf_dir).select("group_id", "pos", parsed.alias("parsed"), (parsed & (F.col("block") == F.col("canonical"))).alias("graph"))


@query(f"WITH {_GATES}, t AS (SELECT DISTINCT conv_id AS group_id FROM conversations WHERE role = 'assistant'), f AS (SELECT CASE WHEN t.group_id IS NULL THEN 'no_ground_truth' WHEN NOT contains(completion, '[/CONFORMER]') THEN 'no_closing_tag' WHEN trim(block) = '' THEN 'empty_conformer' WHEN length(block) < 20 THEN 'parsing_error' WHEN block <> canonical THEN 'smiles_mismatch' WHEN length(block) % 17 = 0 THEN 'rmsd_nan' ELSE 'ok' END AS failure FROM gt LEFT JOIN t USING (group_id)) SELECT failure, count(*) AS n FROM f GROUP BY failure")
def failure_taxonomy(spark, sf_dir):
    """The first failure that applies: nothing to compare with (a group without an answer), unclosed, empty, unparsable, another graph, no distance."""
    block = F.col("block")
    truth = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select(F.col("conv_id").alias("group_id"), F.lit(True).alias("known")).distinct()
    failure = F.when(F.col("known").isNull(), "no_ground_truth").when(~F.contains("completion", F.lit("[/CONFORMER]")), "no_closing_tag").when(F.trim(block) == "", "empty_conformer").when(F.length(block) < 20, "parsing_error").when(block != F.col("canonical"), "smiles_mismatch").when(F.length(block) % 17 == 0, "rmsd_nan").otherwise("ok")
    return _gates(spark, sf_dir).join(truth, "group_id", "left").groupBy(failure.alias("failure")).agg(F.count("*").alias("n"))


@query("WITH g AS (SELECT role, lower(text) AS canonical, conv_id * 1000 + turn AS pos FROM conversations) SELECT role, canonical, min(pos) AS first_pos, count(*) AS k, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS members FROM g GROUP BY role, canonical")
def rollout_group(spark, sf_dir):
    """Groups of a flat batch with their members' positions, by which rewards are written back."""
    g = table(spark, sf_dir, "conversations").select("role", F.lower("text").alias("canonical"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"))
    return g.groupBy("role", "canonical").agg(F.min("pos").alias("first_pos"), F.count("*").alias("k"), F.array_join(F.array_sort(F.collect_list("pos")).cast("array<string>"), ",").alias("members"))


_LEGACY = f"""{PAIRS_SQL}, n AS (SELECT key, j, min(CASE WHEN j % 13 = 0 THEN NULL ELSE r END) AS d_min FROM pairs GROUP BY key, j),
l AS (SELECT key, j, d_min, CASE WHEN j % 19 = 0 THEN 'ground_truth' WHEN j % 17 = 0 THEN 'missing_conformer' WHEN j % 7 = 0 THEN 'graph_mismatch' WHEN d_min IS NULL THEN 'rmsd_nan' END AS failure, CASE WHEN j % 7 = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS m FROM n)"""


@query(f"WITH {_LEGACY}, w AS (SELECT *, CASE WHEN failure IN ('ground_truth', 'missing_conformer') THEN 0.0::DOUBLE ELSE 0.5 * CASE WHEN d_min IS NULL THEN 0.0::DOUBLE ELSE 1 / (1 + d_min / 1.25) END + 0.5 * m END AS reward FROM l) SELECT coalesce(failure, 'none') AS failure, count(*) AS n, round(avg(reward), 6) AS mean, round(stddev_pop(reward), 6) AS std FROM w GROUP BY 1")
def legacy_reward(spark, sf_dir):
    true, gen, _ = _sets(spark, sf_dir)
    j = F.col("j")
    low = coverage.extremes(true, gen, SCALE).filter("side = 'P'").select("key", F.col("id").alias("j"), F.col("m").alias("d_min"))
    match = F.when(j % 7 == 0, 0.5).otherwise(1.0)
    reward, failure = rewards.legacy_reward(F.col("d_min"), match, j % 19 != 0, j % 17 != 0, j % 7 != 0)
    rows = low.select(reward.alias("reward"), F.coalesce(failure, F.lit("none")).alias("failure"))
    return rows.groupBy("failure").agg(F.count("*").alias("n"), F.round(F.avg("reward"), 6).alias("mean"), F.round(F.stddev_pop("reward"), 6).alias("std"))
