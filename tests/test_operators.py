"""Readers, reports, checks, rewards and small helpers beyond the golden values."""

from dataclasses import dataclass, field

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import catalog, checks, components, coverage, matching, packing, quantiles, reports, rewards, runs
from corpusloom.sources import files


def test_paths_are_expanded(spark, tmp_path):
    (tmp_path / "d/e").mkdir(parents=True)
    for name in ("d/b.jsonl", "d/e/a.jsonl", "d/c.txt", "x1.jsonl", "x2.jsonl"):
        (tmp_path / name).write_text("{}\n")
    got = files.expand_paths(spark, str(tmp_path / "d"), str(tmp_path / "x*.jsonl"), str(tmp_path / "x1.jsonl"))
    assert [g.rpartition("/")[2] for g in got] == ["b.jsonl", "a.jsonl", "x1.jsonl", "x2.jsonl"]
    with pytest.raises(FileNotFoundError):
        files.expand_paths(spark, str(tmp_path / "none*"))


SDF = "{name}\n\n\n  3  2  0  0  0  0            999 V2000\n" + "".join(f"    {k}.0000    0.0000    0.0000 C   0  0\n" for k in range(3)) + "  1  2  1  0\n  2  3  2  0\nM  END\n>  <smi>\nCCC\n\n$$$$\n"


def test_records_are_numbered_over_splits(spark, tmp_path):
    (tmp_path / "a.sdf").write_text("".join(SDF.format(name=f"m{k}") for k in range(200)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        read = files.read_sdf(spark, str(tmp_path / "a.sdf"))
        rows = read.withColumn("degree", files.largest_degree(F.col("bonds"))).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["pos"], r["name"]) for r in rows) == [(k, f"m{k}") for k in range(200)]
    assert {tuple(map(tuple, r["bonds"])) for r in rows} == {((1, 2, 1), (2, 3, 2))} and {r["degree"] for r in rows} == {2}
    assert spark.range(1).select(files.largest_degree(F.array().cast("array<struct<a:int,b:int>>"))).first()[0] == 0


def test_enriched_and_reloaded(spark, tmp_path):
    (tmp_path / "a.sdf").write_text("".join(SDF.format(name=f"m{k}") for k in (2, 0, 1)))
    rows = files.with_index(files.read_sdf(spark, str(tmp_path / "a.sdf")), "pos").drop("mol_index")
    files.write_sdf(rows, str(tmp_path / "out"))
    again = files.read_sdf(spark, str(tmp_path / "out"))
    assert {r["name"]: (r["props"]["mol_index"], r["props"]["mol_id"], r["props"]["smi"]) for r in again.collect()} == {"m2": ("0", "m2", "CCC"), "m0": ("1", "m0", "CCC"), "m1": ("2", "m1", "CCC")}
    table = spark.createDataFrame([("a", "x"), ("b", None)], "k string, v string")
    assert files.checked_reload(table, table, "k", "v").count() == 2
    for other in ([("a", "y"), ("b", None)], [("a", "x")], [("a", "x"), ("b", None), ("c", "z")]):
        with pytest.raises(Exception, match="not as written"):
            files.checked_reload(table, spark.createDataFrame(other, "k string, v string"), "k", "v").collect()


def test_structures_after_one_another(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("1\nfirst\nO 0 0 1\n2\n\nH 1 2 3\nC x 0 0 0.1\n\n")
    got = [(r["frame"], r["n_atoms"], r["comment"], [tuple(a) for a in r["atoms"]]) for r in files.read_xyz(spark, str(tmp_path / "a.xyz")).orderBy("frame").collect()]
    assert got == [(0, 1, "first", [("O", 0.0, 0.0, 1.0)]), (1, 2, "", [("H", 1.0, 2.0, 3.0), ("C", None, 0.0, 0.0)])]
    (tmp_path / "bad.xyz").write_text("x\n")
    assert files.read_xyz(spark, str(tmp_path / "bad.xyz")).first()["atoms"] is None


def test_pass_vectors_have_the_expected_length(spark):
    df = spark.createDataFrame([("a", 0, True), ("a", 1, None), ("a", 2, True), ("b", 0, True)], "key string, pos int, ok boolean")
    expected = spark.createDataFrame([("a", 2), ("b", 3), ("c", 0)], "key string, n long")
    got = sorted(tuple(r) for r in checks.pass_vector(df, expected, "key", "pos", ["ok"]).collect())
    assert got == [("a", 0, True), ("a", 1, False), ("b", 0, True), ("b", 1, False), ("b", 2, False)]


def rollouts_of(spark):
    rows = [("g", 0, True, True), ("g", 1, True, False), ("g", 2, False, True), ("g", 3, True, True), ("h", 4, True, True)]
    runs_ = spark.createDataFrame(rows, "key string, j long, graph boolean, parsed boolean")
    pairs = spark.createDataFrame([("g", i, j, d) for i, j, d in ((0, 0, 0.1), (1, 0, 0.9), (0, 1, 0.2), (1, 1, 0.2), (0, 2, 0.1), (1, 2, 0.1), (0, 3, None), (1, 3, None))], "key string, i long, j long, r double")
    return pairs, runs_


def test_checks_gate_rollouts(spark):
    pairs, runs_ = rollouts_of(spark)
    state = F.when(F.col("j") == 0, "pass").when(F.col("j") == 3, "fail")
    got = {r["j"]: (r["base"], r["check"], r["valid"]) for r in rewards.gated(runs_, state).collect()}
    assert got == {0: (True, "pass", True), 1: (False, None, False), 2: (False, None, False), 3: (True, "fail", False), 4: (True, "error", False)}
    assert {r["j"] for r in rewards.gated(runs_).filter("valid").collect()} == {0, 3, 4}


def test_counters_and_hard_gate(spark):
    pairs, runs_ = rollouts_of(spark)
    for hard, valid in ((False, {0, 3, 4}), (True, {0})):
        p = rewards.Params(w_match=0.0, hard_distance=hard)
        r = rewards.rollout_rewards(pairs, rewards.gated(runs_), p)
        assert {x["j"] for x in r.filter("valid").collect()} == valid
    c = rewards.counters(rewards.rollout_rewards(pairs, rewards.gated(runs_), rewards.Params(w_match=0.0)), pairs).first()
    assert (c["rollouts"], c["failed_ground_truth"], c["failed_matching"], c["failed_parsing"], c["failed_checks"], c["failed_distance"]) == (5, 1, 1, 1, 0, 1)


def test_strategies(spark):
    pairs, runs_ = rollouts_of(spark)
    for name in ("v3", "legacy"):
        got = {r["j"]: r["reward"] for r in rewards.strategy(name)(pairs, rewards.gated(runs_), rewards.Params()).collect()}
        assert len(got) == 5 and got[0] > 0.5
    with pytest.raises(ValueError):
        rewards.strategy("none")


def test_matching_by_blocks(spark, monkeypatch):
    pairs = spark.createDataFrame([("g", i, j, 0.1 + 0.1 * abs(i - j)) for i in range(6) for j in range(6) if i // 3 == j // 3], "key string, i long, j long, r double")
    for few in (0, 1_000):
        assert sorted((r["i"], r["j"]) for r in matching.assign(pairs, 0.75, few).collect()) == [(k, k) for k in range(6)]
    assert sorted((r["i"], r["j"]) for r in rewards.mutual_nearest(pairs, 0.75).collect()) == [(k, k) for k in range(6)]
    assert matching.assign(pairs, 0.05).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_sparse_matching_like_the_dense_one(seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    d = rng.random((rng.integers(1, 12), rng.integers(1, 12)))
    delta = rng.choice([0.15, 0.4, 0.8, 2.0])
    rows, columns = np.nonzero(d < delta)
    found = [(int(rows[k]), int(columns[k])) for k in matching.match_links(rows.tolist(), columns.tolist(), d[rows, columns].tolist())]
    want = rewards.match_pairs(d, delta)
    assert len(found) == len(want) == len({r for r, _ in found}) == len({c for _, c in found})
    assert sum(d[x] for x in found) == pytest.approx(sum(d[x] for x in want))


def test_a_block_of_twenty_thousand(spark):
    """A chain of rollouts each near three references: one connected block; the cheapest way gives each its own."""
    n = 20_000
    j = spark.range(n).select(F.col("id").alias("j"), F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("d"))
    pairs = j.select(F.lit("k").alias("key"), (F.col("j") + F.col("d")).alias("i"), "j", F.when(F.col("d") == 0, 0.2).otherwise(0.3).alias("r")).filter(f"i between 0 and {n - 1}")
    got = matching.assign(pairs.unionByName(pairs.limit(5)), 0.75, few=1_000)
    assert got.count() == n and got.filter("i = j").count() == n
    none = spark.createDataFrame([("a", None, 1, 0.1), ("a", 1, 1, None)], "key string, i long, j long, r double")
    assert matching.assign(none, 0.75).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 30) if k % 10] + [(100, k) for k in range(101, 120)] + [(5, 5)], "u long, v long")
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert all(got[k] == k // 10 * 10 + 1 for k in range(2, 30) if k % 10 > 1) and all(got[k] == 100 for k in range(101, 120)) and 1 not in got


def test_reports_are_written(spark, tmp_path):
    pairs = spark.createDataFrame([("k", 0, 10, 0.5), ("k", 1, 10, 1.5), ("n", 0, 11, None)], "key string, i long, j long, r double")
    members = spark.createDataFrame([("k", 10), ("n", 11)], "key string, member long")
    table = reports.per_key(coverage.minima(pairs), members, 0.75)
    assert len(table.columns) == 12 and {r["key"]: (r["rmsd_min"], r["cov_r"], r["n_pairs"], r["members"]) for r in table.collect()} == {"k": ("0.5", "0.5", 2, "10"), "n": ("N/A", "0", 0, "11")}
    reports.write_csv(table, str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).columns == table.columns
    sets = lambda keys: spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "key string, conf_id long")
    rates = spark.createDataFrame([(0.5, 3)], "pass_rate double, n long")
    lines = reports.lines(sets(["k", "n", "m"]), sets(["k", "n"]), coverage.minima(pairs), {"all": 30.0}, 0.75, "made\nby hand", rates, {"note": "x"})
    reports.write_text(lines, str(tmp_path / "txt"))
    said = "\n".join(p.read_text() for p in (tmp_path / "txt").glob("part-*"))
    assert [t for t in reports.TITLES if t in said] == list(reports.TITLES)
    for line in ("Keys without members: 1", "all: 0.5 min", "  1. m", "  1. n", "by hand", "pass_rate: 0.5", "note: x", "COV-R mean: 0.25"):
        assert line in said.splitlines()


def test_bytes_expected_of_a_sample(spark):
    lines = spark.createDataFrame([(1, 10), (1, 30), (1, 20)], "lines int, n_bytes int")
    got = packing.check_bytes(lines.filter("n_bytes = 10"), lines).first()
    assert (got["expected_bytes"], got["actual_bytes"], got["difference"], got["difference_pct"]) == (30.0, 60.0, 30.0, 50.0)
    assert packing.check_bytes(lines.filter("lines = 0"), lines).first()["expected_bytes"] is None


def test_special_tokens_and_seeds(spark):
    ids = {"<|endoftext|>": 7, "</s>": 2}
    assert packing.special_token(ids, 5) == 5 and packing.special_token(ids, None, (None, "<s>", "</s>")) == 2 and packing.special_token(ids) is None
    assert packing.separator(ids) == 7
    with pytest.raises(ValueError):
        packing.separator({"a": 1})
    assert packing.combined_seed(None, "x") == 0 and packing.combined_seed(1, None, "2") == 6364136223846793005 + 2 and packing.combined_seed(1, 2) != packing.combined_seed(2, 1)
    a = F.array(*map(F.lit, range(10)))
    few, all_, none = spark.range(1).select(packing.sampled(a, 4, 1), packing.sampled(a, 10, 1), packing.sampled(a, 0, 1)).first()
    assert len(set(few)) == 4 and set(few) < set(range(10)) and all_ == list(range(10)) and none == []


def test_catalogue_rules_and_settings():
    rules = {"ckpt": ((frozenset({"special"}), ("s",)), ("base", ("missing", "b")), ("outputs...", ("o",)), ("none", ("missing",)))}
    c = catalog.Catalog({"ckpt": {"special": "base/x", "a": "base/y", "b": "my/outputs/z", "c": "none/w", "d": "/abs"}}, {"ckpt": "/default"}, rules, {"s": "/s", "b": "/b", "o": "/o"})
    assert [c.resolve(f"ckpt:{k}") for k in ("special", "a", "b", "c", "d")] == ["/s/base/x", "/b/base/y", "/o/my/outputs/z", "/default/none/w", "/abs"]

    @dataclass
    class Weights:
        quality: float = 1.0

    globals()["Weights"] = Weights

    @dataclass
    class Config:
        low: float
        lookahead: int = 0
        weights: Weights = field(default_factory=Weights)

    made = catalog.settings(Config, {"epsilon": 0.2, "lookahead": None, "weights": {"quality": 2.0}}, {"epsilon": "low"}, {"lookahead": 100})
    assert made == Config(0.2, 100, Weights(2.0))
    assert catalog.settings(Config, {"epsilon": 0.2, "low": 0.1, "weights": None}, {"epsilon": "low"}) == Config(0.1)
    with pytest.raises(TypeError):
        catalog.settings(Config, {"low": 1, "other": 2})


def test_text_helpers(spark):
    row = spark.range(1).select(
        text.without_prompt(F.lit("ab cd"), F.lit("ab")), text.without_prompt(F.lit("cd"), F.lit("ab")), text.preview(F.lit("abcdef"), 3), text.preview(F.lit("abc"), 3), text.run_name(F.lit("a b/c_é-1.2")),
        text.match_score(F.lit("abcd"), F.lit("abxdz")), text.match_score(F.lit(""), F.lit("a")), text.match_score(F.lit("é😀"), F.lit("é😀")),
    ).first()
    assert tuple(row) == (" cd", "cd", "abc…", "abc", "a-b-c_--1.2", 0.75, 0.0, 1.0)


def test_use_of_the_machine():
    flops = runs.flops_per_token(2, 8, 100)
    assert flops == 24 * 2 * 64 + 4 * 8 * 100 and runs.utilization(10.0, flops, 2.0 * flops) == 5.0 and runs.utilization(1.0, flops, 0.0) == 0.0


def test_grid(spark):
    got = [tuple(r) for r in runs.grid(spark, [0.1, 0.2, 0.1], [8, 4], {4: 20, 8: 10}).collect()]
    assert sorted(got) == [(0.1, 4, 20), (0.1, 8, 10), (0.2, 4, 20), (0.2, 8, 10)]
    with pytest.raises(KeyError):
        runs.grid(spark, [0.1], [3], {4: 20})


def test_splits_by_stored_indices(spark, tmp_path):
    import json

    import numpy as np

    from corpusloom.operators import corpus

    np.save(tmp_path / "train.npy", np.array([[0, 3], [4, 1]]))
    (tmp_path / "rest.json").write_text(json.dumps({"valid": [2], "test": [5, 2], "none": []}))
    index = files.read_split_indices(spark, str(tmp_path))
    rows = spark.range(6).select(F.col("id").alias("at"), F.col("id").cast("string").alias("x"))
    got = sorted((r["split"], r["at"]) for r in corpus.split_rows(rows, "at", index).collect())
    assert got == [("test", 2), ("test", 5), ("train", 0), ("train", 1), ("train", 3), ("train", 4), ("valid", 2)]
    with pytest.raises(Exception, match="no row at index 5"):
        corpus.split_rows(rows.filter("at < 5"), "at", index).collect()
    np.save(tmp_path / "bad.npy", np.array([[1], [2, 3]], dtype=object), allow_pickle=True)
    with pytest.raises(Exception, match="allow_pickle"):
        files.read_split_indices(spark, str(tmp_path)).collect()


def test_failures_by_reason(spark):
    from corpusloom.operators import corpus

    rows = [("a", "g", "x", None), ("a", "g", "y", None), ("a", "g", "x", "bad"), ("a", "h", "x", "bad"), ("a", "h", "y", "worse"), ("b", "g", "x", None), ("b", "g", "x", None), ("b", "g", "z", "bad")]
    got = {r["split"]: r for r in corpus.failure_report(spark.createDataFrame(rows, "split string, geom string, graph string, reason string"), ["split"]).collect()}
    a, b = got["a"], got["b"]
    assert (a["rows_in"], a["rows_out"], a["groups_in"], a["groups_out"], a["several_graphs"], a["failures"]) == (5, 2, 2, 1, 1, {"bad": 2, "worse": 1})
    assert (b["rows_in"], b["rows_out"], b["groups_in"], b["groups_out"], b["several_graphs"], b["failures"]) == (3, 2, 1, 1, 0, {"bad": 1})


def test_gates_of_modes(spark):
    modules = [["a"], ["b"], ["c"], ["d"], ["e", "f"], ["g"]]
    used = lambda mode: checks.gate(modules, mode)[1]
    assert used("off") == used("other") == [] and used("basic") == list("abcd") and used("geometry") == list("abcdef") and used("full") == list("abcdefg")


def test_units_by_a_public_vocabulary(spark):
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    texts = ["[SMILES]C[/SMILES]", "Größe 日本", "", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, unit string")
    got = {r["k"]: r["tokens"] for r in packing.vocabulary_tokens(df, path, pattern).collect()}
    enc = packing._encoding(path, pattern)
    assert got == {k: None if t is None else enc.encode_ordinary(t) for k, t in enumerate(texts)}


def test_rows_are_sampled(spark):
    df = spark.createDataFrame([(k % 3, k) for k in range(100)], "key int, v int")
    got = packing.sample_rows(df.repartition(7), "key", "v", 5, 1).collect()
    again = packing.sample_rows(df.repartition(2), "key", "v", 5, 1).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == 15 and sorted({r["place"] for r in got}) == [1, 2, 3, 4, 5]
    assert len(packing.sample_rows(df, "key", "v", 50, 1).collect()) == 100


@pytest.mark.parametrize("at_once,ranges", [(50_000, 4096), (3, 4), (1, 2)])
def test_quantiles(spark, at_once, ranges):
    import numpy as np

    rng = np.random.default_rng(0)
    columns = {"a": rng.normal(size=101), "ties": np.round(rng.normal(size=200)), "one": np.array([3.5]), "same": np.full(50, -2.0), "skew": np.concatenate([np.full(90, 1e-9), [1e9, -1e9]])}
    rows = [(n, float(v)) for n, values in columns.items() for v in values] + [("a", None), ("a", float("nan")), ("none", None)]
    wanted = [(n, q) for n in [*columns, "none", "unknown"] for q in (0.0, 0.1, 0.5, 0.9, 1.0)]
    got = quantiles.quantiles(spark.createDataFrame(rows, "name string, v double").repartition(5), wanted, at_once, ranges)
    for n, q in wanted:
        assert got[n, q] == (pytest.approx(np.quantile(columns[n], q)) if n in columns else None)
