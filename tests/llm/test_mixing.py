import heapq
import random
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    total, capped, target = share * sum(sizes.values()), set(), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(cap * sizes[s] for s in capped)
        w = sum(weight[s] for s in free)
        target = {s: cap * sizes[s] if s in capped else left * weight[s] / w for s in names}
        over = {s for s in free if target[s] > cap * sizes[s] or not sizes[s]}
        if not over:
            return target
        capped |= over


def corpus(seed, n=400):
    rng = random.Random(seed)
    rows = [(d, " ".join("w%d" % rng.randrange(9) for _ in range(rng.randint(0, 80))), rng.choice(["big"] * 9 + ["a", "é", "Z", "", None, "😀", "￿"])) for d in range(n)]
    return rows + [(None, "some words", "a"), (3, "twice here", "a"), (3, "twice here", "a"), (n + 1, None, "nothing"), (n + 2, " \t ", "nothing"), (n + 3, "w " * 3000, "a")]


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_contract(spark, docs_of, seed):
    rows = corpus(seed)
    docs = docs_of(rows)
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").encode().split())
    want, taken = brute_targets(sizes), defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(3, 0.01 * t), (s, taken[s], t)


@pytest.mark.parametrize("seats", [0, 1, 7, 50, 1001])
def test_highest_quotients(spark, seats):
    rng = random.Random(seats)
    votes = {k: rng.choice([0, 1, 1, 2, 5, 5, 100, 1000]) for k in range(12)}
    heap, won = [(-Fraction(v), k, 1) for k, v in votes.items() if v], dict.fromkeys(votes, 0)
    heapq.heapify(heap)
    for _ in range(seats):
        _, k, d = heapq.heappop(heap)
        won[k] += 1
        heapq.heappush(heap, (-Fraction(votes[k], d + 2), k, d + 2))
    df = spark.createDataFrame(list(votes.items()), "name int, votes long")
    got = {r["name"]: r["seats"] for r in mixing.highest_quotients(df, [], "votes", F.lit(seats).cast("long"), ["name"], "seats").collect()}
    assert got == won


@pytest.mark.parametrize("tray", [1, 3, 1024])
def test_large_blocks_split_over_shards(spark, docs_of, monkeypatch, tray):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 64)
    monkeypatch.setattr(mixing, "TRAY", tray)
    rows = corpus(9)
    got = mixing.mix(docs_of(rows), block=16).collect()
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    t = {r["source"]: r["target"] for r in got}
    assert abs(taken["big"] - t["big"]) <= 0.02 * t["big"] + 16


def test_taken_blocks_are_the_quotas(spark, docs_of, monkeypatch):
    """By the words that documents give: a shard gives quota blocks, its last one short; a source's quota is what highest quotients give it."""
    monkeypatch.setattr(mixing, "SHARD_WORDS", 256)
    rows, block = corpus(5), 16
    docs = docs_of(rows)
    _, wanted, shards = (x.collect() for x in mixing.plan(docs, block=block))
    quotas, blocks = defaultdict(int), defaultdict(int)
    for r in shards:
        quotas[r["sid"]] += r["quota"]
        blocks[r["sid"]] += r["n"]
        assert 0 <= r["quota"] <= 2 * r["n"] and r["n"] == -(-r["words"] // block)
    words = {r["sid"]: r["source_size"] for r in wanted}
    votes = {r["sid"]: Fraction(r["target"]) * blocks[r["sid"]] / r["source_size"] for r in wanted if r["source_size"]}
    won = dict.fromkeys(votes, 0)
    for _ in range(round(sum(votes.values()))):
        top = max((k for k in votes if won[k] < 2 * blocks[k]), key=lambda k: (votes[k] / (2 * won[k] + 1), -k))
        won[top] += 1
    assert quotas == won
    taken = defaultdict(int)
    for r in mixing.mix(docs, block=block).collect():
        taken[r["source"]] += r["taken"]
    for r in wanted:
        short = sum(2 * (s["n"] * block - s["words"]) for s in shards if s["sid"] == r["sid"])
        assert quotas[r["sid"]] * block - short <= taken[r["source"]] <= quotas[r["sid"]] * block and words[r["sid"]] * 2 >= taken[r["source"]]


def test_equal_rows_are_listed_in_stretches(spark, docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "LISTED", 3)
    rows = [(None, "one two three", "a")] * 20 + [(1, "", "a")] * 10 + [(2, "four five", "b")]
    got = mixing.mix(docs_of(rows)).collect()
    assert len(got) == len(rows) and sum(r["size"] for r in got) == 62 and {r["taken"] for r in got if not r["size"]} == {0}
    t = {r["source"]: r["target"] for r in got}
    assert abs(sum(r["taken"] for r in got if r["source"] == "a") - t["a"]) <= 4


def test_remix(spark, docs_of):
    docs = docs_of([(d, "w " * (d % 40), "abc"[d % 3]) for d in range(300)])
    out = mixing.remix(docs)
    assert out.columns == docs.columns
    counts = defaultdict(int)
    for r in out.collect():
        counts[r["doc_id"]] += 1
    assert set(counts.values()) <= {1, 2} and mixing.remix(docs).count() == sum(counts.values())


def test_remix_meets_targets_with_shared_and_null_ids(spark, docs_of):
    rng = random.Random(4)
    texts = [" ".join("w%d" % rng.randrange(99) for _ in range(rng.randint(1, 40))) for _ in range(900)]
    rows = [(rng.choice([None, 7, d]), t, rng.choice(["a", "a", "a", "b", "c", None])) for d, t in enumerate(texts)]
    rows += [(None, "the same row again and again", "b")] * 30 + [(8, "one more row", "c")] * 9
    sizes, got = defaultdict(int), defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(text.split())
    counts = defaultdict(int)
    for r in mixing.remix(docs_of(rows)).collect():
        got[r["source"]] += len(r["text"].split())
        counts[r["doc_id"], r["text"], r["source"]] += 1
    for s, t in brute_targets(sizes).items():
        assert abs(got[s] - t) <= 0.08 * t, (s, got[s], t)
    assert set(counts) <= set(rows) and all(n <= 2 * rows.count(k) for k, n in counts.items())


def test_empty(spark, docs_of):
    docs = docs_of([(1, "x")])
    assert mixing.mix(docs.filter("doc_id < 0")).count() == 0
    assert [r["taken"] for r in mixing.mix(docs_of([(1, None), (2, "")])).collect()] == [0, 0]
    assert mixing.remix(docs.filter("doc_id < 0")).count() == 0
