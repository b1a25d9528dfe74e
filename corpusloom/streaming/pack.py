"""Best-fit packing as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.packing import LOOKAHEAD, BestFit
from ..sources.staging import new_folder, staged

OUT = "shard int, bin long, units array<long>, used long"
#: Unit id of the row that ends a shard's stream.
END = -1
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Within it, queries that are started keep their state in RocksDB, which lists and maps of state need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class _Packer(StatefulProcessor):
    """A shard's packer: waiting units by their place in line, the open bin's units, and four numbers.

    A batch writes what it changes: a unit that comes or goes, one that is put into the bin, and the numbers once."""

    def __init__(self, seq_len: int, lookahead: int, idle_ms: int | None):
        self.seq_len, self.lookahead, self.idle_ms = seq_len, lookahead, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "place long", "unit long, size long")
        self.bin = handle.getListState("bin", "unit long")
        self.numbers = handle.getValueState("numbers", "used long, number long, next long, timer long")

    def _load(self) -> tuple[BestFit, list[int], int, int]:
        p, places = BestFit(self.seq_len, self.lookahead), []
        p.used, p.number, following, timer = map(int, self.numbers.get() or (0, 0, 0, 0)) if self.numbers.exists() else (0, 0, 0, 0)
        for place, value in sorted((int(k[0]), v) for k, v in self.waiting.iterator()):
            places.append(place)
            p.waiting.append((int(value[0]), int(value[1])))
        p.bin = [int(u[0]) for u in self.bin.get()]
        return p, places, following, timer

    def _save(self, p: BestFit, places: dict[int, int], held: list[int], bin_before: tuple[int, list[int]], following: int, timer: int) -> None:
        """``places``: the place in line of each unit that waits or has waited in this batch; ``held``: places that the state has."""
        still = {places[unit]: (unit, size) for unit, size in p.waiting}
        for place in held:
            if place not in still:
                self.waiting.removeKey((place,))
        for place, value in still.items():
            if place not in held:
                self.waiting.updateValue((place,), value)
        number, units = bin_before
        if p.number == number:
            for unit in p.bin[len(units) :]:
                self.bin.appendValue((unit,))
        elif p.bin:
            self.bin.put([(unit,) for unit in p.bin])
        else:
            self.bin.clear()
        self.numbers.update((p.used, p.number, following, timer))

    def _out(self, key: tuple, bins: list) -> Iterator[pd.DataFrame]:
        if bins:
            yield pd.DataFrame({"shard": [key[0]] * len(bins), "bin": [b[0] for b in bins], "units": [b[1] for b in bins], "used": [b[2] for b in bins]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        p, held, following, timer = self._load()
        before, bins, ended = (p.number, list(p.bin)), [], False
        places = dict(zip((unit for unit, _ in p.waiting), held))
        batch = pd.concat(list(rows)).sort_values("unit")  # one order, however the batch's rows come
        for unit, n in zip(batch["unit"].tolist(), batch["n_tokens"].tolist()):
            if unit == END:
                ended = True
                continue
            places[unit], following = following, following + 1
            bins.extend(p.add(unit, n + 1))
        if ended:
            bins.extend(p.finish())
        if self.idle_ms is not None:
            if timer:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(timer)
        self._save(p, places, held, before, following, timer)
        yield from self._out(key, bins)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Nothing has come for a while: what waits is packed and the open bin given out."""
        p, held, following, _ = self._load()
        before, places = (p.number, list(p.bin)), dict(zip((unit for unit, _ in p.waiting), held))
        bins = list(p.finish())
        self._save(p, places, held, before, following, 0)
        yield from self._out(key, bins)

    def close(self) -> None:
        pass


def packed(units: DataFrame, seq_len: int, shards: int, lookahead: int = LOOKAHEAD, by: Column | None = None, idle_ms: int | None = None) -> DataFrame:
    """Bins of a stream of (unit, n_tokens), to be started within ``state_store``; a restart goes on exactly where it stopped.

    A batch's units come in the order of their ids, batches one after the other; an id comes once. Rows with unit ``END`` close the
    shard that n_tokens names; with ``idle_ms`` a shard is closed too when nothing has come for so long. ``by`` says
    the shard of a unit, otherwise a hash does."""
    own = F.pmod(F.xxhash64("unit"), F.lit(shards)) if by is None else by
    shard = F.when(F.col("unit") == END, F.col("n_tokens")).otherwise(own).cast("int")
    rows = units.select(F.col("unit").cast("long"), F.col("n_tokens").cast("long"), shard.alias("shard"))
    mode = "None" if idle_ms is None else "ProcessingTime"
    return rows.groupBy("shard").transformWithStateInPandas(_Packer(seq_len, lookahead, idle_ms), OUT, "Append", mode)


def pack_stream(units: DataFrame, seq_len: int, shards: int, files: int = 4, by: Column | None = None) -> DataFrame:
    """Write units as files, ascending ids one after the other, stream them a file at a time, then the rows that end the shards; returns what the sink holds."""
    spark = units.sparkSession
    source, sink, checkpoint = (new_folder(spark, name) for name in ("units", "packed-units", "packing-state"))
    slim = staged(units.select("unit", "n_tokens"), "stream-units")
    low, high = slim.agg(F.min("unit"), F.max("unit")).first()
    part = F.floor((F.col("unit") - F.lit(low or 0)) * files / F.lit((high or 0) - (low or 0) + 1))
    for k in range(files):  # in order: the source reads them as they were written
        slim.filter(part == k).coalesce(1).write.mode("append").parquet(source)

    def drain() -> None:
        stream = spark.readStream.schema(slim.schema).option("maxFilesPerTrigger", 1).parquet(source)
        with state_store(spark):
            query = packed(stream, seq_len, shards, by=by).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()

    drain()
    ends = spark.range(shards).select(F.lit(END).cast("long").alias("unit"), F.col("id").alias("n_tokens"))
    ends.coalesce(1).write.mode("append").parquet(source)
    drain()  # a new query on the same checkpoint: state and read files carry on
    return staged(spark.read.schema(OUT).parquet(sink), "packed")
