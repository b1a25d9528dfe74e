import random
import re

import pytest
import xxhash

from corpusloom.llm import simhash


def brute_fingerprint(text, shingle=3):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    rows = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in rows]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(items, bits=3):
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if (items[i][1] ^ items[j][1]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(items):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(items))]


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)] + ["Ünïcode", "ÉTÉ", " x", "A b"]
    rows = [(None, None), (3, None), (4, ""), (5, " \t\n"), (6, "one"), (7, "One"), (8, "one two"), (8, "one two"), (None, "same words here now")]
    for d in range(20, 20 + n):
        words = rng.choices(vocab, k=rng.randint(1, 300))
        rows.append((d, " ".join(words)))
        for c in range(rng.randint(0, 3)):
            copy = list(words)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((1000 + d * 10 + c, "  ".join(copy).upper() if c == 2 else "\x0b".join(copy)))
    return rows


@pytest.mark.parametrize("segment_bits", [1, 2, 4, 8])
def test_like_brute_force(spark, docs_of, segment_bits):
    rows = corpus(segment_bits)
    want_fp = [brute_fingerprint(t) for _, t in rows]
    want = sorted(map(str, zip([d for d, _ in rows], want_fp, brute_components([(d, f) for (d, _), f in zip(rows, want_fp)]))))
    got = simhash.near_duplicates(docs_of(rows), segment_bits=segment_bits).collect()
    assert sorted(str((r["id"], r["fp"] % (1 << 64), r["component_id"])) for r in got) == want


@pytest.mark.parametrize("cell_rows", [1 << 16, 7])
def test_links_span_dense_and_chained_fingerprints(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(simhash, "CELL_ROWS", cell_rows)
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = {base} | {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(400)}
    at = rng.getrandbits(64)
    for _ in range(40):  # a chain, each 3 bits from the last
        fps.add(at)
        for b in rng.sample(range(64), 3):
            at ^= 1 << b
    fps |= {rng.getrandbits(64) for _ in range(200)}
    items = [(f, f) for f in sorted(fps)]
    want = brute_components(items)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    edges = simhash.links(df, segment_bits=4 if cell_rows == 7 else 2)
    assert edges.count() <= 60 * len(fps)
    roots = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in simhash.components(edges).collect()}
    groups = {}
    for (f, _), c in zip(items, want):
        groups.setdefault(c, set()).add(roots.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_long_text_in_steps(monkeypatch):
    rng = random.Random(2)
    text = " ".join("v%d" % rng.randrange(50) for _ in range(5000))
    want = brute_fingerprint(text)
    monkeypatch.setattr(simhash, "STEP", 97)
    assert simhash.fingerprint(text.encode()) % (1 << 64) == want


def test_keep_one(spark, docs_of):
    rows = [(5, "a b c d e"), (2, "A b c d e"), (9, "other words entirely here"), (2, "A b c d e"), (7, None)]
    kept = simhash.keep_one(docs_of(rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 7, 9] and kept.columns == docs_of(rows).columns

    rows = [(None, "one text of many words here"), (None, "quite another thing was said"), (None, "one text of many words here"), (5, "and a third kind of text"), (5, "no line like this stands elsewhere")]
    assert sorted(str((r["doc_id"], r["text"])) for r in simhash.keep_one(docs_of(rows)).collect()) == sorted(str(r) for r in set(rows))


def test_empty(spark, docs_of):
    none = docs_of([(1, "x")]).filter("doc_id < 0")
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0
    with pytest.raises(ValueError):
        simhash.links(none, max_bits=4)


def test_a_centre_of_many_links_is_split_between_tasks(spark):
    """Under lowered thresholds a join of links with what is staged of them, as in a component's rounds, is a skew join."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        star = spark.range(1, 60_001).selectExpr("id as u", "cast(0 as long) as v")
        roots = simhash.components(star)
        assert roots.count() == 60_000 and roots.filter("root <> 0").count() == 0
        both = simhash.staged(star.unionByName(star.selectExpr("v as u", "u as v")), "test-both")
        low = simhash.staged(both.groupBy("u").agg({"v": "min"}).withColumnRenamed("min(v)", "m"), "test-low")
        joined = both.filter("v > u").join(low, "u")
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
