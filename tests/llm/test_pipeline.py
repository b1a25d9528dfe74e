"""The pipeline's stages on the smallest tables, each against brute force over its own input."""

import hashlib
import re
from collections import Counter

import pytest

import corpus_pipeline
from corpusloom.llm import bpe, queries
from test_overlap import brute_kept

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    top, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(top / str(k)))
        docs = spark.read.parquet(str(top / str(k)))
        out.append(docs)
    return [spark.read.parquet(f"{SF}/documents.parquet"), *out]


def rows(df):
    return [tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in df.collect()]


def test_columns(stages):
    assert all(tuple(s.columns) == corpus_pipeline.COLUMNS for s in stages[1:-1])


def test_quality(spark, stages):
    scores = {r["doc_id"]: r["predicted"] for r in queries.op7_quality(spark, SF).collect()}
    assert sorted(rows(stages[1])) == sorted(r for r in rows(stages[0]) if scores[r[0]])
    bad = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 0").collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    left = {r[0] for r in rows(stages[1])}
    assert len(good - left) <= 0.02 * len(good) and len(bad & left) <= 0.2 * len(bad)


def test_exact(stages):
    keep = {}
    for r in rows(stages[1]):
        t = re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")
        keep[t] = max(keep.get(t, r), r, key=lambda x: x[0])
    assert sorted(rows(stages[2])) == sorted(keep.values())


def test_near(stages):
    """Five words and a similarity of 0.8, over all pairs."""
    before = rows(stages[2])
    kept = {d for d, _ in brute_kept([(r[0], r[1]) for r in before])}
    assert sorted(rows(stages[3])) == sorted(r for r in before if r[0] in kept) and len(kept) < len(before)


def test_mix(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert set(after) <= set(before) and max(Counter(after).values()) <= 2
    size = lambda r: len((r[1] or "").encode().split())
    assert sum(map(size, after)) == pytest.approx(1.5 * sum(map(size, before)), rel=0.1)


def test_tokens(stages):
    enc = bpe.tokenizer(*queries.vocabulary())
    want = Counter()
    for r in rows(stages[4]):
        ids = enc.encode_ordinary(r[1] or "")
        want[r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in stages[5].collect()) == want


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[5].count()


def test_entry_lists_all():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert "covmat" in names
