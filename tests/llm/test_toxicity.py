import math
import random
import re
import zlib

import numpy as np
import pytest

from corpusloom.llm import toxicity as tox

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=600, seed=0):
    """Plain words, one in six texts with abuse; in some of those from invented words that no fixed lexicon has."""
    rng = random.Random(seed)
    vocab = ["word%s" % chr(97 + k % 26) * (1 + k // 26) for k in range(80)]
    docs, labels = [], []
    for d in range(n):
        bad = rng.random() < 0.17
        words = rng.choices(vocab, k=rng.randint(20, 120))
        for _ in range(rng.randint(2, 5) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scum", "trash", "brakkulon", "brakkulix", "brakkulom"]))
        docs.append((d, " ".join(words)))
        labels.append((d, 1, int(bad)))
    return docs, labels


def test_held_out_rows_are_told_apart(spark, docs_of):
    docs, labels = corpus()
    df = docs_of(docs + [(5000, None), (5001, ""), (None, "no id"), (7, docs[7][1])])
    model = tox.fit(df, spark.createDataFrame(labels + [(3, 1, None), (None, 1, 1)], LABELS))
    rows = tox.score(df, model).collect()
    assert len(rows) == len(docs) + 4 and all(0 <= r["score"] <= 1 for r in rows)
    score = {r["id"]: r["score"] for r in rows}
    held = [(d, y) for d, _, y in labels if zlib.crc32(str(d).encode()) % 5 == 0]
    assert len(held) > 80 and sum((score[d] >= 0.5) == bool(y) for d, y in held) / len(held) > 0.96
    assert score[5000] == score[5001] < 0.5


def test_held_out_labels_change_nothing(spark, docs_of):
    docs, labels = corpus(300)
    df = docs_of(docs)
    flipped = [(d, 0, 1 - y if zlib.crc32(str(d).encode()) % 5 == 0 else y) for d, _, y in labels]
    a, b = (tox.fit(df, spark.createDataFrame(x, LABELS)) for x in (labels, flipped))
    assert (a.trees.leaf == b.trees.leaf).all() and (a.trees.bound == b.trees.bound).all() and (a.values == b.values).all() and a.learned == b.learned


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)], [(1, 1, 1), (2, 1, 0), (3, 1, 0)]])
def test_few_labels(spark, docs_of, labels):
    df = docs_of([(k, "a") for k in range(1, 9)])
    model = tox.fit(df, spark.createDataFrame(labels, LABELS))
    scores = {r["score"] for r in tox.score(df, model).collect()}
    assert len(scores) == 1 and (labels or scores == {0.5})
    assert tox.score(df.filter("doc_id < 0"), model).count() == 0


def test_repeated_ids_count_once(spark, docs_of):
    docs, labels = corpus(200)
    df = spark.createDataFrame(labels, LABELS)
    once, often = tox.fit(docs_of(docs), df), tox.fit(docs_of(docs + [docs[0]] * 300), df)
    assert (once.trees.leaf == often.trees.leaf).all() and once.learned == often.learned


@pytest.mark.parametrize("word,kind,other", [("idiot", 0, False), ("IDIOT,".lower(), 0, False), ("1d10t", 0, True), ("id!ot", 0, True), ("iiidiot", 0, True), ("i.d.i.o.t", 0, True), ("id**t", 0, True), ("$hit", 1, True), ("shiiiit", 1, True), ("trash###", 0, False), ("word", -1, False), ("th**", -1, False), ("1234", -1, False), ("", -1, False), ("x" * 500, -1, False)])
def test_spellings(word, kind, other):
    assert tox.find(word) == (kind, other)


def plain(text, learned):
    """Features by their definitions, word by word over the whole text."""
    tokens = [t for t in re.split(r"[\x20\x09-\x0D]+", text) if t]
    bare = [t.strip(tox._EDGES) for t in tokens]
    found = [tox.find(t.lower()) for t in tokens]
    n, some, of = len(tokens), max(len(tokens), 1), max(len(text), 1)
    hits = [i for i, (k, _) in enumerate(found) if k >= 0]
    you = [i for i, b in enumerate(bare) if b.lower() in tox.SECOND_PERSON]
    spaced = [m.group() for m in tox._SPACED.finditer(text.lower())]
    laid = [tox.find("".join(c for c in m if c not in " ._-"))[0] for m in spaced]
    counts = [sum(found[i][0] == k for i in hits) + laid.count(k) for k in range(len(tox.KINDS))]
    different = {bare[i].lower() for i in hits} | {"".join(c for c in m if c not in " ._-") for m, k in zip(spaced, laid) if k >= 0}
    near = sum(any(abs(i - j) <= tox.NEAR for j in you) for i in hits)
    hidden = sum(found[i][1] for i in hits) + sum(k >= 0 for k in laid)
    letter = [c for c in text if c.isalpha()]
    digits, spaces = sum(c.isdigit() and not c.isalpha() for c in text), sum(c.isspace() for c in text)
    other = len(text) - len(letter) - digits - spaces
    has = lambda b, f: any(map(f, b))
    signs = [b for b in bare if b and not b.isalpha() and has(b, str.isalpha)]
    weights = [learned.weigh(b.lower()) for b in bare]
    each = [{b.lower(): w[k] for b, w in zip(bare, weights) if w[k]} for k in (0, 1)]
    run = re.compile(r"(.)\1\1")
    return [
        math.log1p(n), (len(text) - spaces) / some, *(100 * c / some for c in counts), *(math.log1p(c) for c in counts), math.log1p(len(different)), 100 * sum(counts) / some,
        max([sum(j - tox.STRETCH < i <= j for i in hits) for j in hits], default=0), near, near / max(sum(counts), 1), 100 * len(you) / some,
        sum(c.isupper() for c in letter) / max(len(letter), 1), sum(len(b) > 2 and b.isupper() for b in bare) / some, sum(len(bare[i]) > 2 and bare[i].isupper() for i in hits),
        100 * text.count("!") / of, 100 * text.count("?") / of, 100 * len(re.findall(r"[!?]{2,}", text)) / some, 100 * other / of, 100 * digits / of,
        100 * sum(has(b, str.isdigit) for b in signs) / some, 100 * sum(not b.isalnum() for b in signs) / some, 100 * sum(bool(run.search(b)) and b[0].isalpha() for b in bare if b) / some,
        100 * len(spaced) / some, 100 * sum("*" in b[1:-1] for b in signs) / some, hidden, 100 * hidden / some,
        100 * sum(w for w, _ in weights) / some, sum(each[0].values()), math.log1p(len(each[0])), 100 * sum(w for _, w in weights) / some, sum(each[1].values()), math.log1p(len(each[1])),
    ]


def test_features_by_their_definitions():
    rng = random.Random(4)
    words = ["you", "YOU!", "idiot", "1d10t", "i d i o t", "SCUM", "trash!!", "plain", "Été", "12%", "a1b", "wooord", "id**t", "du", "\n", "brakkulon", "brak", "kill", "so??", "x-y", "😀"]
    learned = tox.Learned({"brakkulon": 2.0, "plain": 0.5}, {"brak": 1.5, "brakku": 3.0})
    for k in range(60):
        text = " ".join(rng.choices(words, k=rng.randint(0, 150)))
        got = tox.features(text, tox.Reader(learned))
        assert len(got) == len(tox.NAMES) and got.tolist() == pytest.approx(plain(text, learned)), k


def test_blocks_do_not_matter():
    text = " ".join(random.Random(1).choices(["you", "idiot", "plain", "SCUM!", "a1"], k=4000))
    assert tox.features(text, block=300).tolist() == pytest.approx(tox.features(text).tolist())


def test_very_long_texts(spark, docs_of):
    docs, labels = corpus(300)
    model = tox.fit(docs_of(docs), spark.createDataFrame(labels, LABELS))
    clean = "worda wordb wordc " * 300_000
    got = {r["id"]: r["score"] for r in tox.score(docs_of([(1, clean), (2, clean + "you idiot, scum and trash " * 40_000), (3, "x" * 3_000_000)]), model).collect()}
    assert got[1] < 0.5 < got[2] and 0 <= got[3] <= 1


def best_split(x, g, h, weight, least):
    """A node's split by trying all values of all features."""
    best = (1e-9, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for bound in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= bound
            if h[left].sum() < least / 4 or h[~left].sum() < least / 4:
                continue
            gain = g[left].sum() ** 2 / (h[left].sum() + weight) + g[~left].sum() ** 2 / (h[~left].sum() + weight) - g.sum() ** 2 / (h.sum() + weight)
            if gain > best[0] + 1e-9:
                best = (gain, f, bound)
    return best


def test_splits_by_brute_force():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 12, (200, 5)).astype(float)
    y = ((x[:, 1] > 6) ^ (x[:, 3] > 3)).astype(float)
    trees = tox.boost(x, y, trees=1, depth=2)
    p = np.full(200, (y.sum() + 1) / 202)
    _, f, bound = best_split(x, y - p, p * (1 - p), 1.0, 2.0)
    assert (trees.split[0, 0], trees.bound[0, 0]) == (f, bound)
    for node, rows in ((1, x[:, f] <= bound), (2, x[:, f] > bound)):
        _, a, b = best_split(x[rows], (y - p)[rows], (p * (1 - p))[rows], 1.0, 2.0)
        assert (trees.split[0, node], trees.bound[0, node]) == (a, b)
    full = tox.boost(x, y)
    assert (((full.logits(x) > 0) == (y == 1)).mean()) > 0.99


def test_isotonic_rises_and_fits_best():
    rng = np.random.default_rng(1)
    z = rng.standard_normal(80)
    y = (rng.random(80) < 1 / (1 + np.exp(-2 * z))).astype(float)
    places, values = tox.isotonic(z, y)
    assert (np.diff(values) > 0).all() and (np.diff(places) > 0).all()
    order = np.argsort(z)
    want = [max(min(y[order][a : b + 1].mean() for b in range(i, 80)) for a in range(i + 1)) for i in range(80)]  # the max-min formula
    steps = np.searchsorted(places, [z[order][k] for k in range(80)])
    assert sorted(set(np.round(want, 9))) == sorted(set(np.round(values, 9))) and len(steps) == 80
