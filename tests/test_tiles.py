"""Pairs met in tiles: the same as pairs as rows and as SQL, also where keys are cut into blocks."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import geometry, graphs
from corpusloom.operators import coverage, pair_quantiles, rewards, tiles
from corpusloom.plans import coverage as coverage_plans
from corpusloom.plans import graphs as graph_plans
from corpusloom.plans import registry
from test_queries import SF, TABLES, plain

registry.load_all()
QUERIES = ["symmetric_coverage", "self_pairs", "batch_metrics", "kabsch_rmsd", "rmsd_stats", "covmat_summary", "combine_reward", "pairwise_distance", "nearest_ref", "legacy_reward", "covmat_curve", "smooth_coverage", "match_metrics", "quality_reward", "permol_report"]


@pytest.mark.parametrize("name", QUERIES)
def test_no_pair_is_a_row_of_a_join(spark, monkeypatch, name):
    """Keys of thousands of members took time and memory for each pair: no query builds them by a join, and blocks of cut keys give what SQL does."""

    def never(*_):
        raise AssertionError("pairs as rows")

    for module in (coverage, coverage_plans):
        monkeypatch.setattr(module, "rmsd", never, raising=False)
    monkeypatch.setattr(graph_plans.graphs, "symmetric_rmsd", never)
    monkeypatch.setattr(tiles, "ROWS", 16)
    monkeypatch.setattr(pair_quantiles, "AT_ONCE", 3)
    out = registry.QUERIES[name](spark, SF)
    cols = sorted(out.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    sql = con.sql(registry.ORACLES[name])
    at = [sql.columns.index(c) for c in cols]
    assert plain([tuple(r[c] for c in cols) for r in out.collect()]) == plain([tuple(r[i] for i in at) for r in sql.fetchall()])


def odd_members(spark, first, n=40):
    """Members with copies, offsets, null and short vectors, null and infinite components, in three keys, one of them without the other set."""
    rng = np.random.default_rng(first)
    rows = []
    for k in range(n):
        x = (rng.integers(0, 3, 6) + (1e5 if k % 4 == 0 else 0)).astype(float).tolist()
        x = {5: None, 11: x[:3], 17: [*x[:5], None], 23: [*x[:5], math.inf], 29: [*x[:5], math.nan]}.get(k, x)
        rows.append((("a", "b", f"only{first}")[min(k % 5, 2)], first + 2 * k, x))
    return spark.createDataFrame([*rows, (None, 1, [1.0, 2.0, 3.0])], "key string, conf_id long, xyz array<double>")


def near(got, want):
    assert set(got) == set(want)
    for k in want:
        assert len(got[k]) == len(want[k])
        for x, y in zip(got[k], want[k]):
            assert (x is None) == (y is None) and (x is None or x == y or x == pytest.approx(y, rel=1e-9, nan_ok=True)), (k, got[k], want[k])


@pytest.mark.parametrize("rows", [4, 4096])
def test_extremes_of_odd_members(spark, monkeypatch, rows):
    monkeypatch.setattr(tiles, "ROWS", rows)
    true, gen = odd_members(spark, 0), odd_members(spark, 1)
    pairs = coverage.pair_distances(true, gen, 2.8).cache()
    want = {(r["key"], r["side"], r["id"]): (r["m"], r["far"], r["total"], r["n"]) for r in coverage.minima(pairs).collect()}
    got = coverage.extremes(true, gen, 2.8).collect()
    near({(r["key"], r["side"], r["id"]): (r["m"], r["far"], r["total"], r["n"]) for r in got}, want)
    best = {(r["key"], r["j"]): (r["best_i"],) for r in coverage.nearest(pairs).collect()}
    near({(r["key"], r["id"]): (-1 if r["arg"] is None else r["arg"],) for r in got if r["side"] == "P"}, best)
    each = {(r["key"], r["i"], r["j"]): (r["r"],) for r in coverage.each_pair(true, gen, 2.8).collect()}
    near(each, {(r["key"], r["i"], r["j"]): (None if r["r"] is None else round(r["r"], 6),) for r in pairs.collect()})


@pytest.mark.parametrize("rows", [4, 4096])
def test_quantiles_of_odd_members(spark, monkeypatch, rows):
    monkeypatch.setattr(tiles, "ROWS", rows)
    monkeypatch.setattr(pair_quantiles, "AT_ONCE", 3)
    members = odd_members(spark, 0).filter("key is not null")
    a, b = members.select("key", F.col("conf_id").alias("i"), F.col("xyz").alias("a")), members.select("key", F.col("conf_id").alias("j"), F.col("xyz").alias("b"))
    d = a.join(b, "key").filter("i < j").select("key", geometry.rmsd(F.col("a"), F.col("b")).alias("r")).cache()
    want = {r["key"]: (r["n"], r["q"]) for r in d.groupBy("key").agg(F.count("*").alias("n"), F.median("r").alias("q")).collect()}
    near({r["key"]: (r["n"], r["q"]) for r in pair_quantiles.by_key(members).collect()}, want)
    all_ = d.filter("r is not null and not isnan(r)").agg(F.median("r")).first()[0]
    assert pair_quantiles.pooled(members) == pytest.approx(all_, rel=1e-9)
    assert pair_quantiles.pooled(members.limit(0)) is None


@pytest.mark.parametrize("points", [3, 5, 21])
def test_superposition_of_all_with_all(points):
    rng = np.random.default_rng(points)
    x = rng.normal(size=(12, points, 3))
    x[1, :, 2], x[2, :, 1:], x[3], x[4] = 0, 0, 1.5, x[0] @ np.array([[0, 1, 0], [-1, 0, 0], [0, 0, 1]]) + 4
    x[5], x[6], x[7, 0, 0] = x[0] * [1, 1, -1], x[0] + 1e-4 * x[8], np.inf
    want = geometry.best_superposition(np.repeat(x, 12, axis=0), np.tile(x, (12, 1, 1))).reshape(12, 12)
    np.testing.assert_allclose(tiles.superposed(x, x), want, atol=2e-7)


def test_symmetric_distances_by_tiles(spark, monkeypatch):
    monkeypatch.setattr(tiles, "ROWS", 3)
    rng = np.random.default_rng(4)
    kinds = [("CCO", [(1, 2), (2, 3)]), ("OCC", [(1, 2), (2, 3)]), ("CCCC", [(1, 2), (2, 3), (3, 4)]), ("CHCO", [(1, 2), (1, 3), (3, 4)]), ("CC", [(1, 5)]), (None, [])]
    rows = []
    for k in range(36):
        symbols, bonds = kinds[k % 6]
        atoms = None if symbols is None else [(s, *map(float, rng.normal(size=3))) for s in symbols]
        if k == 12:
            atoms[1] = ("C", None, 0.0, 0.0)
        rows.append(("ab"[k % 12 // 6], k, atoms, [(x, y, 1) for x, y in bonds]))
    all_ = spark.createDataFrame(rows, "key string, conf_id long, atoms array<struct<sym:string,x:double,y:double,z:double>>, bonds array<struct<a:int,b:int,order:int>>")
    true, gen = all_.filter("conf_id < 18"), all_.filter("conf_id >= 12")
    a, b = (x.select("key", F.col("conf_id").alias(i), F.col("atoms").alias(f"{i}a"), F.col("bonds").alias(f"{i}b")) for x, i in ((true, "i"), (gen, "j")))
    pairs = a.join(b, "key").select("key", "i", "j", graphs.symmetric_rmsd("ia", "ib", "ja", "jb").alias("r"))
    want = {(r["key"], r["side"], r["id"]): (r["m"], r["far"], r["n"]) for r in coverage.minima(pairs).collect()}
    got = {(r["key"], r["side"], r["id"]): (r["m"], r["far"], r["n"]) for r in coverage.symmetric_extremes(true, gen).collect()}
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-7)


@pytest.mark.parametrize("delta", [0.75, 60.0])
def test_rewards_by_tiles(spark, monkeypatch, delta):
    """The same as from pairs; with a wide kernel some are exactly 1, and products of the others vanish."""
    monkeypatch.setattr(tiles, "ROWS", 4)
    p = rewards.Params(delta=delta, w_match=0.5)
    true = odd_members(spark, 0).filter("key in ('a', 'b')")
    gen = odd_members(spark, 1).filter("key in ('a', 'b') or key = 'only1'")
    runs = rewards.gated(gen.select("key", F.col("conf_id").alias("j"), F.lit(True).alias("graph"), (F.col("conf_id") % 7 != 0).alias("parsed")))
    pairs = coverage.pair_distances(true, gen, 0.5).withColumn("r", geometry.null_if_nan(F.col("r"))).cache()
    valid = gen.join(runs.filter("valid").select("key", F.col("j").alias("conf_id")), ["key", "conf_id"])
    low = rewards.nearness(true, valid, p, 0.5)
    matched = rewards.mutual_nearest(pairs.join(runs.filter("valid").select("key", "j"), ["key", "j"]), delta).cache()
    assert sorted(map(tuple, matched.select("key", "i", "j").collect())) == sorted(map(tuple, rewards.mutual(low, delta).select("key", "i", "j").collect()))
    columns = ["valid", "d_min", "best_i", "r_qual", "r_smcov", "r_match", "reward"]
    rows = lambda df: {(r["key"], r["j"]): tuple(r[c] for c in columns) for r in df.collect()}
    want = rewards.rollout_rewards(pairs, runs, p, matched).cache()
    got = rewards.scored(rewards.smoothed(true, valid, low, p, 0.5), runs, p, matched).cache()
    near(rows(got), rows(want))
    columns = ["m", "d1", "soft", "edges"]
    m = true.join(gen.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.countDistinct("conf_id").alias("m"))
    groups = lambda df: {r["key"]: tuple(v for c, v in sorted(r.asDict().items()) if c != "key") for r in df.collect()}
    near(groups(rewards.grouped(rewards.met(low), m, got, p, matched)), groups(rewards.group_metrics(pairs, want, p, matched)))


def test_correlation_of_groups_that_do_not_differ(spark):
    """SQL's correlation is NaN where one side has no spread, and 0 only where no group counts."""
    for n, want in ((2, math.nan), (0, 0.0)):
        pairs = spark.createDataFrame([(f"k{g}", 0, j, 1e-9) for g in range(n) for j in range(80)], "key string, i long, j long, r double")
        runs = rewards.gated(pairs.select("key", "j", F.lit(True).alias("graph"), F.lit(True).alias("parsed")))
        p = rewards.Params()
        r = rewards.rollout_rewards(pairs, runs, p).cache()
        matched = rewards.mutual_nearest(pairs, p.delta)
        out = rewards.batch_metrics(rewards.group_metrics(pairs, r, p, matched), r, p, matched, pairs.select("r")).first()
        assert out["soft_refs_corr"] == pytest.approx(want, nan_ok=True)
