"""An endless stream of a stored table: epoch after epoch, each in an order of its own, going on where it stopped."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


NAME = "corpusloom_epochs"
SCHEMA = "epoch long, turn long, shard long"


def shard_order(seed: int, epoch: int, shards: int) -> list[int]:
    """The shards in an epoch's order."""
    digest = lambda k: hashlib.md5(f"{seed}:{epoch}:{k}".encode()).hexdigest()
    return sorted(range(shards), key=digest)


class _Turns(SimpleDataSourceStreamReader):
    """The shards' turns; an offset is the epoch and the number of turns taken in it."""

    def __init__(self, seed: int, shards: int, at_once: int, epochs: int | None):
        self.seed, self.shards, self.at_once, self.epochs = seed, shards, at_once, epochs

    def initialOffset(self) -> dict:
        return {"epoch": 0, "turn": 0}

    def _from(self, start: dict) -> Iterator[tuple[int, int, int]]:
        epoch, turn = start["epoch"], start["turn"]
        while self.epochs is None or epoch < self.epochs:
            order = shard_order(self.seed, epoch, self.shards)
            for k in range(turn, self.shards):
                yield epoch, k, order[k]
            epoch, turn = epoch + 1, 0

    def _after(self, row: tuple[int, int, int]) -> dict:
        epoch, turn, _ = row
        return {"epoch": epoch, "turn": turn + 1} if turn + 1 < self.shards else {"epoch": epoch + 1, "turn": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = [row for row, _ in zip(self._from(start), range(self.at_once))]
        return iter(rows), self._after(rows[-1]) if rows else start

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for row in self._from(start):
            if (row[0], row[1]) >= (end["epoch"], end["turn"]):
                return
            yield row

    def commit(self, end: dict) -> None:
        pass


class EpochSource(DataSource):
    """Options: seed, shards, at_once (shards of a batch), epochs (none: endless)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> _Turns:
        o = self.options
        return _Turns(int(o.get("seed", 0)), int(o["shards"]), int(o.get("at_once", 1)), int(o["epochs"]) if "epochs" in o else None)


def store_shards(rows: DataFrame, path: str, key: str, shards: int, seed: int = 0) -> None:
    """Write rows dealt out to shards by their key's digest: a folder each, so that a batch reads its own only."""
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(shards)))
    dealt.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def epochs(spark: SparkSession, path: str, key: str, shards: int, seed: int = 0, at_once: int = 1, stop_after: int | None = None) -> DataFrame:
    """The rows that ``store_shards`` wrote, as a stream with ``epoch``, ``turn`` and ``order``, endless or ``stop_after`` epochs long.

    Each batch has ``at_once`` shards, each epoch them in another order; rows of a shard are in order of ``order``, another text in each epoch.
    Offsets are in the query's checkpoint: after a restart no row comes again. An epoch's last batch may hold the next one's first shards."""
    spark.dataSource.register(EpochSource)
    source = spark.readStream.format(NAME).option("seed", seed).option("shards", shards).option("at_once", at_once)
    turns = (source if stop_after is None else source.option("epochs", stop_after)).load()
    stored = spark.read.parquet(path).withColumn("shard", F.col("shard").cast("long"))
    # a few rows of turns; the join prunes the folders of other shards
    rows = stored.join(F.broadcast(turns), "shard")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("epoch").cast("string"), F.lit(":"), F.col(key).cast("string")))
    return rows.withColumn("order", digest)
