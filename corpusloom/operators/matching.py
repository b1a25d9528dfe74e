"""One-to-one matching of references and rollouts: as many near pairs as possible, then the smallest total distance."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from .components import components

# Fixed value: what a pair that isn't near costs.
APART = 1e6
#: Near pairs of one connected block at most: a task holds them.
MOST_LINKS = 8_000_000
#: Near pairs up to which a group is dealt out whole: fewer than a block may have, they need no rounds to part them.
FEW_LINKS = 100_000


def match_links(rows: list[int], columns: list[int], cost: list[float]) -> list[int]:
    """The links chosen, by number, of (row, column, cost) ones, rows and columns counted from 0.

    Row after row gets a column by the shortest augmenting path over the links that there are, found with potentials
    that keep what is left of every cost from falling below 0; a row may also stay alone, or leave its column to another, at the cost of a pair that isn't near."""
    links: list[list[tuple[int, int, float]]] = [[] for _ in range(max(rows, default=-1) + 1)]
    for k, (r, c, x) in enumerate(zip(rows, columns, cost)):
        links[r].append((c, k, x))
    m = max(columns, default=-1) + 1
    of_row, of_column, owner, chosen = [0.0] * len(links), [0.0] * m, [-1] * m, [-1] * m
    for start in range(len(links)):
        far = {start: 0.0}
        near: dict[int, float] = {}
        came: dict[int, tuple[int, int]] = {}
        done: set[int] = set()
        heap: list[tuple[float, int]] = []
        alone, last = APART - of_row[start], start
        row, end = start, -1
        while True:
            base = far[row] - of_row[row]
            for c, k, x in links[row]:
                d = base + x - of_column[c]
                if c not in done and d < near.get(c, np.inf):
                    near[c], came[c] = d, (row, k)
                    heappush(heap, (d, c))
            while heap and heap[0][1] in done:
                heappop(heap)
            if not heap or heap[0][0] >= alone:
                total = alone
                break
            total, end = heappop(heap)
            if owner[end] < 0:
                break
            done.add(end)
            row, end = owner[end], -1
            far[row] = total
            if total + APART - of_row[row] < alone:
                alone, last = total + APART - of_row[row], row
        held = {owner[c]: c for c in done}
        for r, d in far.items():
            of_row[r] += total - d
        for c in done:
            of_column[c] -= total - near[c]
        if end < 0:  # ``last`` stays alone; what it had goes to the row that reached it
            end = held.get(last, -1)
        while end >= 0:
            row, k = came[end]
            before = held.get(row, -1)
            owner[end], chosen[end] = row, k
            end = before if row != start else -1
    return sorted(k for k in chosen if k >= 0)


def assign(pairs: DataFrame, delta: float, few: int = FEW_LINKS) -> DataFrame:
    """(key, i, j, d) of each group's matched pairs, of pairs (key, i, j, r) below ``delta``; a repeated pair counts by its least r, null ids and distances don't.

    Connected blocks of near pairs are found first, by rounds of joins, and each is solved apart in the task that it
    is dealt to: a group is never in one task as such, unless all groups together have no more than ``few`` near pairs. The pairs are the same either way. A block of more than ``MOST_LINKS`` pairs stops the job (``mutual_nearest`` has no limit)."""
    kinds = dict(pairs.dtypes)
    near = staged(pairs.filter(F.col("r") < delta).dropna(subset=["i", "j", "r"]).groupBy("key", "i", "j").agg(F.min("r").cast("double").alias("r")), "near")
    if near.count() <= few:
        blocks = near.select(F.xxhash64("key").alias("block"), "key", "i", "j", "r")
    else:
        named = near.withColumn("u", F.xxhash64(F.lit("i"), "key", "i")).withColumn("v", F.xxhash64(F.lit("j"), "key", "j"))
        roots = components(named.select("u", "v")).withColumnRenamed("node", "u")
        # the smallest node of a block has no row of its own among the roots
        blocks = named.join(roots, "u", "left").select(F.coalesce("root", "u").alias("block"), "key", "i", "j", "r")
    dealt = blocks.repartition("block").sortWithinPartitions("block", "key", "j", "i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at, size = None, 0

        def solved() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            _, i = np.unique(table["i"].to_numpy(), return_inverse=True)
            _, j = np.unique(table["j"].to_numpy(), return_inverse=True)
            found = match_links(j.tolist(), i.tolist(), table["r"].to_pylist())
            return table.select(["key", "i", "j", "r"]).take(pa.array(found, pa.int64())).combine_chunks().to_batches()

        for batch in batches:
            blocks = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and blocks[a] != at:
                    yield from solved()
                    held, size = [], 0
                at, size = blocks[a], size + b - a
                if size > MOST_LINKS:
                    raise ValueError(f"a connected block has more than {MOST_LINKS} near pairs")
                held.append(batch.slice(a, b - a))
        if held:
            yield from solved()

    out = dealt.mapInArrow(run, f"key {kinds['key']}, i {kinds['i']}, j {kinds['j']}, r double")
    return out.withColumnRenamed("r", "d")
