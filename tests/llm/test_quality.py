import math
import random
import zlib
from collections import Counter

import pytest

from corpusloom.llm import quality


def corpus(n=900):
    rng = random.Random(0)
    vocab = ["word%d" % i for i in range(200)]
    docs, labels = [], []
    for d in range(n):
        good = rng.random() < 0.8
        words = rng.choices(vocab, k=rng.randint(20, 120))
        docs.append((d, " ".join(words) if good else " ".join(w.upper() + rng.choice(["!!", "$$$", "###"]) for w in words)))
        labels.append((d, int(good), 0))
    return docs, labels


def test_held_out_rows_are_told_apart(spark, docs_of):
    docs, labels = corpus()
    df = docs_of(docs + [(5000, None), (5001, ""), (None, "no id"), (7, docs[7][1])])
    model = quality.fit(df, spark.createDataFrame(labels + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int"))
    got = {(r["id"], r["score"]) for r in quality.score(df, model).collect()}
    assert len({i for i, _ in got}) == len(docs) + 3 and all(0 <= s <= 1 for _, s in got)
    score = {i: s for i, s in got}
    held = [(d, y) for d, y, _ in labels if zlib.crc32(str(d).encode()) % 4 == 2]
    assert len(held) > 100 and sum((score[d] >= quality.THRESHOLD) == bool(y) for d, y in held) / len(held) > 0.97
    kept = quality.keep_good(df, model)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i in [r["id"] for r in quality.score(df, model).filter(f"score >= {quality.THRESHOLD}").collect()])


def test_held_out_flag(spark, docs_of):
    df = docs_of([(d, "x") for d in range(50)] + [(None, "x")])
    for r in df.select("doc_id", quality.held_out().alias("h")).collect():
        assert r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_held_out_labels_change_nothing(spark, docs_of):
    docs, labels = corpus(300)
    df = docs_of(docs)
    schema = "doc_id long, quality int, toxic int"
    flipped = [(d, 1 - y if zlib.crc32(str(d).encode()) % 4 == 2 else y, 1) for d, y, _ in labels]
    a, b = (quality.fit(df, spark.createDataFrame(x, schema)) for x in (labels, flipped))
    assert a.bias == b.bias and (a.w == b.w).all() and (a.v == b.v).all()


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)]])
def test_without_two_labels(spark, docs_of, labels):
    df = docs_of([(1, "a"), (2, "b")])
    model = quality.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert len({r["score"] for r in quality.score(df, model).collect()}) == 1
    assert quality.score(df.filter("doc_id < 0"), model).count() == 0


def test_pairs_by_the_sum_of_squares():
    import numpy as np

    rng = np.random.default_rng(0)
    m = quality.Model(0.3, rng.standard_normal(30), rng.standard_normal((30, 4)), 10)
    index, value = np.array([1, 5, 9, 20]), rng.standard_normal(4)
    want = 0.3 + sum(m.w[i] * x for i, x in zip(index, value)) + sum(m.v[index[a]] @ m.v[index[b]] * value[a] * value[b] for a in range(4) for b in range(a))
    assert m.logits(index, value, np.array([0]))[0][0] == pytest.approx(want)


def test_repeated_ids_count_once(spark, docs_of):
    docs, labels = corpus(300)
    df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    once, often = quality.fit(docs_of(docs), df), quality.fit(docs_of(docs + [docs[0]] * 500), df)
    assert once.bias == often.bias and (once.w == often.w).all() and (once.v == often.v).all()


def plain_score(text, n_chars, model):
    """A text's score from the definitions of its features, pair by pair."""
    data = (text or "").encode()
    words = Counter(data.lower().split())
    x = {}
    for word, n in words.items():
        h = zlib.crc32(word)
        x[h % model.buckets] = x.get(h % model.buckets, 0) + (1 + math.log(n)) * (1 if h >= 1 << 31 else -1)
    norm = max(math.sqrt(sum(v * v for v in x.values())), 1e-6)
    x = {i: v / norm for i, v in x.items()}
    n, n_words = len(data), sum(words.values())
    kind = lambda low, high: sum(low <= b <= high for b in data)
    upper, letters = kind(65, 90), kind(65, 90) + kind(97, 122) + kind(128, 255)
    space, digits, lines, some = sum(b in b" \t\n\v\f\r" for b in data), kind(48, 57), data.count(b"\n") + 1, max(n, 1)
    length = sum(len(w) * c for w, c in words.items()) / max(n_words, 1)
    stats = [1, math.log1p(n) / 10, math.log1p(n_words) / 8, min(length, 30) / 10, upper / max(letters, 1), 4 * digits / some, 4 * (n - letters - space - digits) / some, 2 * kind(128, 255) / some, 2 * space / some]
    stats += [len(words) / max(n_words, 1), 2 * max(words.values(), default=0) / max(n_words, 1), math.log1p(lines) / 5, min(n_words / lines, 100) / 50]
    stats += [min(20 * data.count(c.encode()) / some, 3) for c in "!|#$."] + [math.log1p(max(n_chars or 0, 0)) / 10, float(n == 0)]
    x.update({model.buckets + k: v for k, v in enumerate(stats)})
    items = list(x.items())
    z = model.bias + sum(float(model.w[i]) * v for i, v in items)
    z += sum(float(model.v[a] @ model.v[b]) * u * v for k, (a, u) in enumerate(items) for b, v in items[:k])
    return 1 / (1 + math.exp(-z))


def test_scores_by_the_definition(spark, docs_of):
    docs, labels = corpus(200)
    model = quality.fit(docs_of(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    texts = [None, "", " \n", "One", "Été 12% | $5.\n# the the The", *(t for _, t in docs[:15])]
    rows = list(enumerate(texts))
    got = {r["id"]: r["score"] for r in quality.score(docs_of(rows), model).collect()}
    for d, t in rows:
        assert got[d] == pytest.approx(plain_score(t, len(t or ""), model), abs=1e-4)


def test_very_long_text(spark, docs_of):
    docs, labels = corpus(200)
    model = quality.fit(docs_of(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    good = " ".join("word%d" % (k % 200) for k in range(600_000))
    got = {r["id"]: r["score"] for r in quality.score(docs_of([(1, good), (2, good.upper().replace(" ", "!! "))]), model).collect()}
    assert got[1] > got[2]
