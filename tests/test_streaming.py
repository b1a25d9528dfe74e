"""Streams that are stopped and go on: nothing lost, nothing twice."""

import random
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import packing
from corpusloom.streaming import epochs, pack


def batches_of(spark, tmp_path, parts):
    source = str(tmp_path / "source")
    for part in parts:
        spark.createDataFrame(part, "unit long, n_tokens long").coalesce(1).write.mode("append").parquet(source)
    return source


def run(spark, tmp_path, source, name="a", **how):
    stream = spark.readStream.schema("unit long, n_tokens long").option("maxFilesPerTrigger", 1).parquet(source)
    with pack.state_store(spark):
        q = pack.packed(stream, 128, 3, lookahead=7, by=F.col("unit") % 3, **how).writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def bins_of(spark, path):
    return sorted((r["shard"], r["bin"], tuple(r["units"]), r["used"]) for r in spark.read.schema(pack.OUT).parquet(str(path)).collect())


def test_stopped_between_batches_gives_the_same_bins(spark, tmp_path):
    rng = random.Random(0)
    sizes = [(i, rng.randint(1, 127)) for i in range(240)] + [(500, 4000)]
    parts = [sizes[k : k + 60] for k in range(0, 241, 60)]
    ends = [(pack.END, s) for s in range(3)]
    whole = batches_of(spark, tmp_path / "w", [*parts, ends])
    run(spark, tmp_path, whole, "whole")
    for k, part in enumerate([*parts, ends]):  # a new query for each batch
        run(spark, tmp_path, batches_of(spark, tmp_path / "s", [part]), "steps")
    want = []
    for s in range(3):
        p = packing.BestFit(128, 7)
        want += [(s, *b) for u, n in sizes if u % 3 == s for b in p.add(u, n + 1)]
        want += [(s, *b) for b in p.finish()]
    want = sorted((s, k, tuple(units), used) for s, k, units, used in want)
    assert bins_of(spark, tmp_path / "whole-out") == bins_of(spark, tmp_path / "steps-out") == want


def test_an_idle_shard_is_closed_by_its_timer(spark, tmp_path):
    source = batches_of(spark, tmp_path, [[(3, 10), (6, 20), (4, 30)]])
    stream = spark.readStream.schema("unit long, n_tokens long").parquet(source)
    with pack.state_store(spark):
        q = pack.packed(stream, 128, 3, by=F.col("unit") % 3, idle_ms=500).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="200 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and not q.exception():
            found = bins_of(spark, tmp_path / "out") if (tmp_path / "out").exists() else []
            if len(found) == 2:
                break
            time.sleep(1)
    finally:
        q.stop()
    assert found == [(0, 0, (6, 3), 32), (1, 0, (4,), 31)]


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "shards")
    epochs.store_shards(spark.range(40).select(F.col("id").alias("unit")), path, "unit", 5)
    return path


def drain(spark, tmp_path, stored, until, **how):
    """Rows in the order that batches and ``order`` give, from a query that is stopped once ``until`` rows are there."""
    q = epochs.epochs(spark, stored, "unit", 5, seed=3, **how).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
    read = lambda: spark.read.schema("epoch long, turn long, unit long, `order` string").parquet(str(tmp_path / "out"))
    try:
        end = time.time() + 90
        while time.time() < end and not q.exception():
            if (tmp_path / "out" / "_spark_metadata").exists() and read().count() >= until:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert not q.exception()
    return [(r["epoch"], r["unit"]) for r in read().orderBy("epoch", "turn", "order").collect()]


def test_epochs_go_on_after_a_restart(spark, tmp_path, stored):
    before = drain(spark, tmp_path, stored, 55)
    rows = drain(spark, tmp_path, stored, len(before) + 30)
    assert len(rows) >= len(before) + 30 and len(set(rows)) == len(rows) and set(before) <= set(rows)
    first, second = ([u for e, u in rows if e == k] for k in (0, 1))
    assert sorted(first) == sorted(second) == list(range(40)) and first != second and first != sorted(first)
    last = max(e for e, _ in rows)
    assert all(sorted(u for e, u in rows if e == k) == list(range(40)) for k in range(last))


def test_a_number_of_epochs_ends(spark, tmp_path, stored):
    q = epochs.epochs(spark, stored, "unit", 5, at_once=4, stop_after=2).writeStream.format("memory").queryName("two_epochs").start()
    q.processAllAvailable()
    q.stop()
    got = [tuple(r) for r in spark.sql("SELECT epoch, unit FROM two_epochs").collect()]
    assert sorted(got) == [(e, u) for e in (0, 1) for u in range(40)]


def test_offsets():
    t = epochs._Turns(1, 3, 2, None)
    at, rows = t.initialOffset(), []
    for _ in range(5):
        some, after = t.read(at)
        some = list(some)
        assert list(t.readBetweenOffsets(at, after)) == some
        rows, at = rows + some, after
    assert [(e, k) for e, k, _ in rows] == [(n // 3, n % 3) for n in range(10)] and sorted(s for e, _, s in rows if e == 1) == [0, 1, 2]
