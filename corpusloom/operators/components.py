"""Connected components of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import drop, staged


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (u, v), root being the component's smallest node.

    Large-star and small-star rounds: each node's neighbours are hung under the smallest of them, until
    nothing changes. All state is in staged tables; the driver sees a count and a checksum a round."""
    now = staged(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(pmod(xxhash64(u, v), 1000003) as bigint))")).first())

    before = mark(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # what is joined back to the rows it is made from is staged, so that a centre with many links is split between tasks
        low = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # every link now points down (u > v): the small-star step hangs u and its lower neighbours under the lowest
        large = staged(large, "large-star")
        floor = staged(large.groupBy("u").agg(F.min("v").alias("m")), "floor")
        hung = large.join(floor, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = hung.unionByName(floor.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        used, now = (now, low, large, floor), staged(small, "links")
        drop(*used)
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
