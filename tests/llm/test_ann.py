import numpy as np
import pytest

from corpusloom.llm import ann


def brute(rows, every, k):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.setdefault((i, tuple(v)), np.array(v, np.float32).astype(float))
    out = []
    for (q, _), a in ok.items():
        if q % every == 0:
            best = {}
            for (i, _), b in ok.items():
                if i != q and len(a) == len(b):
                    s = float((a * b).sum() / (np.sqrt((a**2).sum()) * np.sqrt((b**2).sum())))
                    best[i] = max(s, best.get(i, -2))
            out += [(q, r + 1, i, s) for r, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", [1]) for i, v in rows], "vec_id long, embedding array<float>, label int, v string, ids array<int>")


def special():
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(6)]) for i in range(160)]
    same = rows[3][1]
    rows += [(200 + i, same) for i in range(30)] + [(5, rows[5][1])] * 2
    bad = [None, [], [0.0] * 6, [None] + [1.0] * 5, [float("nan")] * 6, [float("inf")] + [1.0] * 5, [1.0, 2.0]]
    return rows + [(400 + 10 * i, v) for i, v in enumerate(bad)] + [(None, same)]


def test_exact_on_a_small_table(spark):
    rows = special()
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(table(spark, rows), query_every=10, k=5, recall=1.0).collect())
    want = brute(rows, 10, 5)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want], abs=1e-12)


def test_few_and_none(spark):
    few = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.5])]
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(table(spark, few)).collect()]
    assert sorted(got) == [(0, 1, 1), (0, 2, 2)]
    assert ann.search(table(spark, few[:1])).count() == 0
    assert ann.search(table(spark, few).filter("vec_id < 0")).count() == 0
    assert ann.search(table(spark, [(0, None)])).count() == 0


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"])) for r in df.collect()]
    got = {(r["query_id"], r["vec_id"]) for r in ann.search(df).collect()}
    want = {(q, i) for q, _, i, _ in brute(rows, 50, 5)}
    assert len(got & want) / len(want) >= 0.9


def test_blocks_and_short_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 7)
    monkeypatch.setattr(ann, "ASK_ROWS", 3)
    rows = special()
    got = {(r["query_id"], r["vec_id"]) for r in ann.search(table(spark, rows), query_every=10, k=5, recall=1.0, shortlist=10).collect()}
    want = {(q, i) for q, _, i, _ in brute(rows, 10, 5)}
    assert len(got & want) / len(want) >= 0.9


def test_second_level(monkeypatch):
    """Many more rows than the sample can give centroids for: lists are as many as for a table of that size, and hold the neighbours."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((60, 16))[rng.integers(0, 60, 40_000)] + 0.4 * rng.standard_normal((40_000, 16))
    model = ann.fit_arrays(x[:1600], 40_000 * 400, 5)
    unit = ann.units(x)
    own = model.assign(unit)
    assert len(model.centroids) == 100 and len(model.second) == 20
    assert np.allclose(((unit - model.centres(own)) ** 2).sum(axis=1), [((u[None, :] - model.centroids[c // 20] - model.second) ** 2).sum(axis=1).min() for u, c in zip(unit, own)])
    sizes = np.bincount(own, minlength=2000)
    queries = unit[::400]
    probed = model.probed(queries, sizes, 12)
    near = np.argsort(-(queries @ unit.T), axis=1)[:, 1:6]
    held = [len(set(own[n]) & set(p)) and np.isin(own[n], p).mean() for n, p in zip(near, probed)]
    assert np.mean(held) >= 0.95 and np.mean([sizes[p].sum() for p in probed]) < 0.3 * len(x)


def test_second_level_search(spark, monkeypatch):
    fit = ann.fit_arrays
    monkeypatch.setattr(ann, "fit_arrays", lambda x, n, k, recall: fit(x, n * 5000, k, recall))
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"])) for r in df.collect()]
    got = {(r["query_id"], r["vec_id"]) for r in ann.search(df).collect()}
    want = {(q, i) for q, _, i, _ in brute(rows, 50, 5)}
    assert len(got & want) / len(want) >= 0.9


def test_outliers_and_ids_with_several_vectors(spark):
    """Queries alone in their lists go on to others; an id that comes with many vectors takes one place."""
    rng = np.random.default_rng(6)
    rows = [(100 + i, [1.0, 0.0, 0.001 * i]) for i in range(60)] + [(0, [-1.0, 0.1, 0.0]), (10, [0.0, -1.0, 0.3]), (7, [0.0, -1.0, 0.31])]
    rows += [(7, [0.0, -1.0, 0.3 + 0.0001 * i]) for i in range(9)] + [(8, [0.1, -1.0, float(x)]) for x in rng.random(3)]
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(table(spark, rows), query_every=10, k=5).collect())
    want = [x[:3] for x in brute(rows, 10, 5)]
    assert [g[:2] for g in got] == [w[:2] for w in want] and len(set(got) & set(want)) >= 0.9 * len(want)


def rows_of(kind):
    """6,000 rows: near copies beside strays; a common offset, so that cosines differ in their ninth digit; queries unlike all other rows."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((6000, 16))
    if kind == "near copies":
        x[rng.random(len(x)) < 0.95] = x[0]
        x += 1e-4 * rng.standard_normal(x.shape)
    elif kind == "offset":
        x += 1e4
    else:
        strays = x[::50].copy()
        x = x[rng.integers(0, 50, len(x))] + 0.05 * x
        x[::50] = strays
    return x.astype(np.float32)


@pytest.mark.parametrize("kind", ["near copies", "offset", "other queries"])
def test_recall_on_other_rows(spark, kind):
    x = rows_of(kind)
    got = {}
    for r in ann.search(table(spark, [(i, v.tolist()) for i, v in enumerate(x)])).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    unit, hit = ann.units(x.astype(float)), 0
    for q in range(0, len(x), 50):
        s = unit @ unit[q]
        s[q] = -2
        assert len(got[q]) == 5
        hit += int((s[got[q]] >= np.sort(s)[-5] - 1e-14).sum())
    assert hit / (5 * len(got)) >= 0.98


def test_ties_between_copies_and_multiples(spark):
    """Of equal scores the smaller ids count, though they come with several vectors of one direction."""
    rows = [(i, [1.0, 2.0]) for i in (1, 51, 52, 53, 54, 55)] + [(i, [4.0, 8.0]) for i in (2, 3, 4, 5, 6)] + [(0, [2.0, 4.0])]
    got = [(r["rank"], r["vec_id"]) for r in ann.search(table(spark, rows)).collect()]
    assert sorted(got) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]


def test_rerank_leaves_nothing_in_question():
    """Estimates that are all alike, with errors that say so: every row is looked at; none is beyond its error."""
    rng = np.random.default_rng(9)
    v = rng.standard_normal((500, 8))
    lengths = np.sqrt((v**2).sum(axis=1))
    true = v @ v[0] / lengths / lengths[0]
    found = ann.rerank(v[0], np.zeros(500), np.abs(true), v, lengths, [[i] for i in range(500)], 5, 10)
    assert set(np.argsort(-true)[:6]) <= set(found)
    unit = ann.units(v)
    model = ann.fit_arrays(v, 500, 5)
    lists = model.assign(unit)
    codes = model.encode(unit, lists)
    estimate = np.array([unit[0] @ model.centres(lists[i : i + 1])[0] + model.tables(unit[:1])[0, np.arange(4), codes[i]].sum() for i in range(500)])
    assert (np.abs(estimate - true) <= model.errors(unit, lists, codes) + ann.ROUNDING).all()


def test_each_length_apart(spark):
    """Vectors of every length find those of their own; an id with vectors of two lengths has one list of neighbours."""
    rng = np.random.default_rng(10)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(4 if i < 60 else 3)]) for i in range(90)]
    rows += [(95, [1.0, 2.0])]
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(table(spark, rows), query_every=10, k=5, recall=1.0).collect())
    assert got == [x[:3] for x in brute(rows, 10, 5)]
    both = [(0, [1.0, 0.0]), (0, [1.0, 0.0, 0.0]), (1, [1.0, 0.1]), (2, [1.0, 0.2, 0.0]), (3, [1.0, 0.3]), (3, [1.0, 0.05, 0.0])]
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(table(spark, both)).collect())
    assert got == [(0, 1, 3), (0, 2, 1), (0, 3, 2)]
