"""Golden values of text, codec, geometry and schedule functions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import codec, geometry, text
from corpusloom.operators import catalog, matching, packing, rewards, runs


def one(spark, column, **values):
    kind = {str: "string", float: "double", int: "int"}
    cols = [F.lit(v).cast(kind.get(type(v), "string")).alias(k) if v is not None else F.lit(None).cast("string").alias(k) for k, v in values.items()] or [F.lit(1).alias("_")]
    return spark.range(1).select(*cols).select(column).first()[0]


@pytest.mark.parametrize("raw, want", [("C<0,0,0>N<1.0,2.0,3.0>", "CN"), ("[NH2+]<0.1,0.2,0.3>[C]", "[NH2+]C"), ("[cH]<-0.1,0.0,0.1>C", "cC"), ("[C][N][C@H]<0.1,0.2,0.3>[c]", "CN[C@H]c"), ("[Cl] [Br]\n[13CH3]", "ClBr[13CH3]")])
def test_strip(spark, raw, want):
    assert one(spark, codec.strip_text(F.col("s")), s=raw) == want


def test_tokens(spark):
    got = one(spark, codec.tokenize_plain(F.col("s")), s="C1=CC(=O)O")
    assert [t["text"] for t in got] == list("C1=CC(=O)O")
    assert one(spark, codec.tokenize_plain(F.col("s")), s="C?C") is None
    assert one(spark, codec.tokenize_enriched(F.col("s")), s="[C]<1,2,3>C") is None
    assert one(spark, codec.tokenize_enriched(F.col("s")), s="[C]<1,2>") is None
    got = one(spark, codec.tokenize_enriched(F.col("s")), s="[C]<1.5,-2,3>%12=")
    assert [(t["type"], t["text"]) for t in got] == [("atom_with_coords", "[C]"), ("nonatom", "%12"), ("nonatom", "=")]
    assert got[0]["coords"] == [1.5, -2.0, 3.0]


@pytest.mark.parametrize("raw, want", [("[CH3]", "[C]"), ("[cH]", "[c]"), ("[13CH3]", "[13CH3]"), ("[NH2+]", "[NH2+]")])
def test_descriptors(spark, raw, want):
    assert one(spark, codec.normalize_descriptor(F.col("s")), s=raw) == want


@pytest.mark.parametrize("x, want", [(1.23456, "1.2345"), (-0.00001, "0.0000"), (-1.99999, "-1.9999"), (2.0, "2.0000")])
def test_truncate(spark, x, want):
    assert one(spark, text.truncate_fixed(F.col("x")), x=x) == want


def test_format_float(spark):
    assert one(spark, text.format_float(F.col("x"), 0), x=10.7) == "10"
    assert one(spark, text.format_float(F.col("x")), x=2.5) == "2.5"
    assert one(spark, text.format_float(F.col("x")), x=float("nan")) == "N/A"
    with pytest.raises(ValueError):
        text.truncate_fixed(F.lit(1.0), -1)


@pytest.mark.parametrize("x", [-21.0, 21.0, -21.1, 0.0, 0.043, 20.99, 30.0])
def test_bins_like_numpy(spark, x):
    edges = np.arange(-21, 21, 0.043)
    assert one(spark, codec.bin_index(F.col("x"), codec.bin_edges(-21, 21, 0.043)), x=x) == np.digitize(x, edges)


def test_binned_round_trip(spark):
    s = codec.encode_binned(F.array(F.lit(7), F.lit(840), F.lit(12)), 840)
    assert one(spark, s) == "<007,840,012>"
    assert one(spark, codec.decode_binned(s)) == [7, 840, 12]


def test_extract(spark):
    f = lambda s: one(spark, text.extract_between(F.col("s"), "[A]", "[/A]"), s=s)
    assert f("x[A]one\ntwo[/A][/A]") == "one\ntwo"
    assert f("x[A]one") == "" and f("one[/A]") == ""


def test_kabsch():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((4, 9, 3))
    q, _ = np.linalg.qr(rng.standard_normal((3, 3)))
    q *= np.sign(np.linalg.det(q))
    assert np.allclose(geometry.best_superposition(a, a @ q + 3), 0, atol=1e-6)
    mirrored = a * np.array([1, 1, -1])
    assert (geometry.best_superposition(a, mirrored) > 0.1).all()
    a[0, 0, 0] = np.nan
    assert math.isnan(geometry.best_superposition(a, a)[0])


@pytest.mark.parametrize("step, want", [(-5, 0.0), (50, 0.5), (1125, 1.0), (1250, 0.0), (1251, 1.0), (10001, 0.0)])
def test_schedule(spark, step, want):
    s = runs.Schedule(100, (1250, 2500, 5000, 10000))
    assert one(spark, s.rate(F.col("x")), x=step) == pytest.approx(want)


@pytest.mark.parametrize("bad", [dict(warmup=-1, targets=(5,)), dict(warmup=0, targets=()), dict(warmup=0, targets=(5, 3)), dict(warmup=0, targets=(0,)), dict(warmup=0, targets=(5,), low=2.0), dict(warmup=0, targets=(5,), decay_steps=0), dict(warmup=0, targets=(5,), decay_fraction=None), dict(warmup=0, targets=(5,), decay_fraction=1.5)])
def test_schedule_errors(bad):
    with pytest.raises(ValueError):
        runs.Schedule(**bad)


def test_schedules_that_are_taken(spark):
    """Repeated targets, a first one within the warm-up, no share to decay, both lengths (the steps count)."""
    rate = lambda s, x: one(spark, s.rate(F.col("x")), x=x)
    assert [rate(runs.Schedule(0, (5, 5), decay_steps=2), x) for x in (3, 4, 5, 6)] == [1.0, 0.5, 0.0, 0.0]
    assert rate(runs.Schedule(9, (5, 20), decay_steps=2), 4) == pytest.approx(4 / 9) and rate(runs.Schedule(9, (5, 20), decay_steps=2), 12) == 1.0
    assert [rate(runs.Schedule(0, (10,), decay_fraction=0.0), x) for x in (9, 10)] == [1.0, 0.0]
    assert rate(runs.Schedule(0, (100,), decay_fraction=0.5, decay_steps=10), 80) == 1.0


def test_matching_golden_and_brute_force():
    from itertools import permutations

    d = np.array([[0.10, 0.70, 0.95], [0.20, 0.60, 0.85], [0.55, 0.40, 0.30]])
    assert rewards.match_pairs(d, 0.8) == [(0, 0), (1, 1), (2, 2)]
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, m = rng.integers(1, 6, 2)
        d = rng.random((n, m))
        d[rng.random((n, m)) < 0.2] = np.nan
        got = rewards.match_pairs(d, 0.6)
        ok = np.isfinite(d) & (d < 0.6)
        a, b = (d, ok) if n <= m else (d.T, ok.T)
        best = min(((-sum(b[i, p[i]] for i in range(len(a))), sum(a[i, p[i]] for i in range(len(a)) if b[i, p[i]])) for p in permutations(range(a.shape[1]), len(a))))
        assert (-len(got), pytest.approx(sum(d[i, j] for i, j in got))) == best


def test_reward_golden(spark):
    d = [[0.2, 0.5], [0.6, 0.4], [0.95, 0.9]]
    pairs = spark.createDataFrame([("g", i, j, d[j][i]) for j in range(3) for i in range(2)], "key string, i long, j long, r double")
    runs_ = spark.createDataFrame([("g", j, True, True, True) for j in range(3)], "key string, j long, graph boolean, parsed boolean, valid boolean")
    out = rewards.rollout_rewards(pairs, runs_, rewards.Params(), matching.assign(pairs, 0.75)).orderBy("j").collect()
    assert [r["reward"] for r in out] == pytest.approx([1.41478837, 0.85966790, 0.14022715], abs=1e-6)


def test_reward_gates(spark):
    pairs = spark.createDataFrame([("g", 0, 0, 0.1), ("g", 0, 1, None), ("g", 0, 2, 0.1)], "key string, i long, j long, r double")
    flags = [(0, True), (1, True), (2, False)]
    runs_ = spark.createDataFrame([("g", j, v, v, v) for j, v in flags], "key string, j long, graph boolean, parsed boolean, valid boolean")
    out = {r["j"]: r["reward"] for r in rewards.rollout_rewards(pairs, runs_, rewards.Params(w_match=0)).collect()}
    assert out[0] > 0 and out[1] == out[2] == -1.0


def test_catalog():
    c = catalog.Catalog({"ckpt": {"a": {"500": "x", "1000": "y"}, "b": {"final": "z", "9": "w"}}, "data": {"d": "/abs", "e": "rel"}}, {"ckpt": "/base", "data": "/data"})
    assert c.resolve(" ckpt:a ") == "/base/x" and c.resolve("ckpt:a:1000") == "/base/y" and c.resolve("ckpt:b") == "/base/z"
    assert c.resolve("data:d") == "/abs" and c.resolve("data:e") == "/data/rel" and c.resolve("plain/path") == "plain/path"
    with pytest.raises(KeyError):
        c.resolve("none:x")


def test_labels(spark):
    s = packing.finalize(F.array(*map(F.lit, (5, 6, 7))), 6, 0)
    row = spark.range(1).select(s.alias("s"), packing.labels(s, F.lit(4)).alias("l"), packing.trailing(s, 0).alias("t")).first()
    assert row["s"] == [5, 6, 7, 0, 0, 0] and row["l"] == [6, 7, 0, -100, -100, -100] and row["t"] == 3
