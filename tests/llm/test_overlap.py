import random
from itertools import combinations

import pytest

from corpusloom.llm import overlap


def brute_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_kept(rows, similarity=0.8):
    sets, root = [brute_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9:
            root[find(j)] = find(i)
    groups = {}
    for i, row in enumerate(rows):
        groups.setdefault(find(i), []).append(row)
    return sorted(min(g) for g in groups.values())


def corpus(seed):
    rng = random.Random(seed)
    words = lambda n: ["w%d" % rng.randrange(500) for _ in range(n)]
    rows = [None, "", " \t", "one", "ONE", "one two three four", "a b c d e", "A  b c d\te"]
    for _ in range(60):
        text = words(rng.randint(5, 300))
        rows.append(" ".join(text))
        for _ in range(rng.randint(0, 4)):
            copy = list(text)
            for _ in range(rng.randint(0, max(1, len(text) // 30))):
                copy[rng.randrange(len(copy))] = "x%d" % rng.randrange(99)
            rows.append("\n".join(copy))
    return list(enumerate(rows))


@pytest.mark.parametrize("slice_bytes", [4 << 20, 3000])
def test_like_brute_force(spark, docs_of, monkeypatch, slice_bytes):
    monkeypatch.setattr(overlap, "SLICE_BYTES", slice_bytes)
    rows = corpus(slice_bytes)
    kept = overlap.keep_one(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [d for d, _ in brute_kept(rows)]


def test_shared_and_missing_ids(spark, docs_of):
    rows = [(None, "one text of many words here"), (None, "quite another thing was said"), (None, "one text of many words here"), (5, "and a third kind of text"), (5, "no line like this stands elsewhere")]
    assert sorted(str((r["doc_id"], r["text"])) for r in overlap.keep_one(docs_of(rows)).collect()) == sorted(str(r) for r in set(rows))
    assert overlap.keep_one(docs_of(rows).filter("doc_id < 0")).count() == 0


def test_stage_drops_copies_beyond_three_bits(spark, docs_of):
    import corpus_pipeline

    text = ["v%d" % i for i in range(200)]
    copy = list(text)
    for at in (20, 90, 160):
        copy[at] = "changed"
    rows = [(1, " ".join(text)), (2, " ".join(copy)), (3, "something else that stands on its own")]
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near(spark, docs_of(rows), "").collect()) == [1, 3]


def templated(n, shared=74, own=40, seed=3):
    """Texts of one template: they share most words and no two are similar."""
    rng = random.Random(seed)
    common = ["t%d" % k for k in range(shared)]
    return [" ".join(common + ["o%d" % rng.randrange(10**9) for _ in range(own)]) for _ in range(n)]


@pytest.mark.parametrize("slice_bytes", [4 << 20, 20_000])
def test_a_bucket_of_templated_texts_without_links(spark, docs_of, monkeypatch, slice_bytes):
    monkeypatch.setattr(overlap, "SLICE_BYTES", slice_bytes)
    rows = list(enumerate(templated(150) + templated(40, 74, 2, 4)))
    assert sorted(r["doc_id"] for r in overlap.keep_one(docs_of(rows)).collect()) == [d for d, _ in brute_kept(rows)]


def test_templated_sets_are_not_all_compared(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(0)
    common = rng.integers(0, 1 << 60, 85).astype(np.uint64)
    for n in (500, 2000):
        sets = [np.unique(np.concatenate([common, rng.integers(0, 1 << 60, own).astype(np.uint64)])) for own in rng.integers(25, 40, n)]
        calls = []
        found = np.searchsorted
        monkeypatch.setattr(np, "searchsorted", lambda *a, **b: calls.append(1) or found(*a, **b))
        assert list(overlap._linked(list(range(n)), sets, 0.8)) == [] and len(calls) <= n
        monkeypatch.undo()


@pytest.mark.parametrize("seed", range(6))
def test_links_span_the_components_of_all_pairs(seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    base = [rng.integers(0, 3000, rng.integers(1, 80)) for _ in range(12)]
    sets = []
    for b in base:
        for _ in range(12):
            keep = rng.random(len(b)) > rng.choice([0, 0.05, 0.15])
            sets.append(np.unique(np.concatenate([b[keep], rng.integers(0, 3000, rng.integers(1, 4))])).astype(np.uint64))

    def components(pairs):
        root = list(range(len(sets)))
        for u, v in pairs:
            a, b = root[u], root[v]
            root = [a if x == b else x for x in root]
        return root

    similar = [(i, j) for i, j in combinations(range(len(sets)), 2) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-9]
    found = list(overlap._linked(list(range(len(sets))), sets, 0.8))
    assert set(map(tuple, map(sorted, found))) <= set(similar)
    same = lambda roots: {frozenset(k for k, r in enumerate(roots) if r == x) for x in roots}
    assert same(components(found)) == same(components(similar))
