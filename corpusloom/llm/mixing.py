"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets come from weights by filling up to a cap. Each source's documents are dealt into shards, and each
shard's words, laid end to end in seeded order, are cut into blocks of ``BLOCK`` words. The mix's blocks go to
sources by highest quotients target/(2k+1), a source's quota to its shards the same way, and a shard takes
exactly its quota of blocks: every block quota div n times, and quota mod n of them, evenly spaced from a
seeded phase, once more. What a document gives is then the difference of two running counts, so no block is
ever a row. DataFrame functions only. Documents and shards are never grouped by source alone, so that a source
may hold any share of them; quotas go to trays of ``TRAY`` sources or shards first, then within each tray.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, word_count

#: Words of a block, in tables of any size.
BLOCK = 4
#: Words of a shard, about.
SHARD_WORDS = 1 << 16
#: Shards or sources that one window apportions; a window over trays has one row for every so many.
TRAY = 1024
#: Equal rows that are listed by one task at once.
LISTED = 1 << 16


def source_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """``sid`` (rank) and ``weight`` for each row of (source, ...): by code point, nulls last, the weights repeating.

    The rank is a range partitioning's: rows before in earlier partitions plus the rank within the own one."""
    dealt = staged(sources.withColumn("last", F.col("source").isNull()).repartitionByRange("last", "source").withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("part").agg(F.count("*").alias("rows")).withColumn("offset", F.coalesce(F.sum("rows").over(before), F.lit(0))).select("part", "offset")
    within = Window.partitionBy("part").orderBy("last", "source")
    rank = (F.col("offset") + F.row_number().over(within) - 1).cast("long")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("sid", F.lit(len(weights))) + 1).cast("int"))
    return dealt.join(F.broadcast(parts), "part").withColumn("sid", rank).withColumn("weight", weight).drop("part", "offset", "last")


def targets(sources: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, sid, weight, target): ``share`` of all words by weight, no target above ``cap`` times its source.

    What a capped source can't take goes to the others by weight, until none is above."""
    rows = staged(source_weights(sources, weights), "sources")
    limit = F.col("source_size") * F.lit(cap)
    total, level = None, 0.0
    while True:  # sources only ever move to the capped side
        full = limit <= F.lit(level) * F.col("weight")
        words, held, open_weight, least = rows.agg(F.sum("source_size"), F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight"))), F.min(F.when(~full, limit / F.col("weight")))).first()
        total = float(words or 0) * share
        if not open_weight:
            level = None
            break
        new = max((total - (held or 0.0)) / open_weight, level)
        if new < least or new <= level:
            level = new
            break
        level = new
    target = limit if level is None else F.least(limit, F.lit(level) * F.col("weight"))
    return rows.withColumn("target", target)


def highest_quotients(rows: DataFrame, group: list[str], votes: str, seats: Column, order: list[str], out: str, most: Column | None = None) -> DataFrame:
    """Sainte-Lague: ``seats`` of each group go to the rows with the highest quotients votes/(2k+1), ``most`` to a row at most.

    Only the last few seats of a row are in question: with divisor d = votes of the group / seats, a row has
    surely round(votes/d) - 2 seats if others are near theirs. The rest compete by quotient, ties by ``order``."""
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    sum_votes, n_rows = F.sum(votes).over(w), F.count("*").over(w)
    rows = rows.withColumn("_seats", seats).withColumn("_max", seats if most is None else most).withColumn("_sum", sum_votes).withColumn("_rows", n_rows)
    # at d_hi the rounded seats can't exceed the seats to give, at d_lo they can't fall short
    d_hi = F.col("_sum") / (F.col("_seats") - F.col("_rows") / 2)
    d_lo = F.col("_sum") / (F.col("_seats") + F.col("_rows") / 2)
    sure = F.when((F.col("_seats") > F.col("_rows")) & (F.col("_sum") > 0), F.floor(F.col(votes) / d_hi + 0.5 - 1e-9)).otherwise(F.lit(0))
    could = F.when((F.col("_seats") > 0) & (F.col("_sum") > 0) & (F.col(votes) > 0), F.ceil(F.col(votes) / d_lo + 0.5 + 1e-9)).otherwise(F.lit(0))
    # a seat or two more than that are tried, for those that rows at their most leave to others
    rows = rows.withColumn("_sure", F.least(F.greatest(sure, F.lit(0)).cast("long"), F.col("_max")))
    rows = rows.withColumn("_most", F.least(F.when(could > 0, could + 2).otherwise(0).cast("long"), F.col("_max")))
    rows = rows.withColumn("_left", F.col("_seats") - F.sum("_sure").over(w))
    tried = rows.withColumn("_k", F.explode(F.when(F.col("_most") > F.col("_sure"), F.sequence(F.col("_sure"), F.col("_most") - 1)).otherwise(F.array(F.lit(-1).cast("long")))))
    quotient = F.when(F.col("_k") >= 0, F.col(votes) / (2 * F.col("_k") + 1)).otherwise(F.lit(-1.0))
    by = w.orderBy(F.desc("_q"), *order, "_k")
    won = tried.withColumn("_q", quotient).withColumn("_won", (F.row_number().over(by) <= F.col("_left")) & (F.col("_k") >= 0))
    keep = [c for c in rows.columns if not c.startswith("_")]
    return won.groupBy(*keep, "_sure").agg(F.sum(F.col("_won").cast("long")).alias("_more")).withColumn(out, F.col("_sure") + F.col("_more")).select(*keep, out)


def by_trays(rows: DataFrame, group: list[str], name: str, votes: str, seats: str, most: str, out: str) -> DataFrame:
    """``highest_quotients`` in two steps: to trays of ``TRAY`` rows (by the number ``name``), then within each tray."""
    rows = rows.withColumn("tray", F.floor(F.col(name) / TRAY))
    trays = rows.groupBy(*group, "tray").agg(F.sum(votes).alias("tray_votes"), F.sum(most).alias("tray_most"), F.first(seats).alias("tray_seats"))
    trays = highest_quotients(trays, group, "tray_votes", F.col("tray_seats"), ["tray"], "tray_quota", F.col("tray_most"))
    both = rows.join(trays.select(*group, "tray", "tray_quota"), [*group, "tray"])
    return highest_quotients(both, [*group, "tray"], votes, F.col("tray_quota"), [name], out, F.col(most)).drop("tray", "tray_quota")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 11, block: int = BLOCK, mark: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Staged documents (equal ones once, ``times`` often) with their place in a shard, targets and shards with their quotas.

    Documents: (id, source, mark, size, times, sid, shard, start), mark telling apart texts of one id; those
    without words have no place. Targets: (sid, source, source_size, weight, target). Shards: (sid, shard,
    words, n, source_blocks, source_quota, quota); the shards' blocks n add up to source_blocks, their quotas
    to source_quota."""
    mark = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) if mark is None else mark
    slim = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), mark.alias("mark"), word_count(F.col(text_col)).alias("size"))
    slim = staged(slim.groupBy("id", "source", "mark", "size").agg(F.count("*").alias("times")), "sizes")
    sources = slim.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"))
    wanted = staged(targets(sources, weights, share, cap), "targets")

    of_source = wanted.select(F.col("source").alias("s"), "sid", F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS)).alias("shards"))
    dealt = slim.join(of_source, slim["source"].eqNullSafe(of_source["s"])).drop("s")
    shard = F.pmod(F.xxhash64(F.lit(seed + 1), "id", "mark", "size"), F.col("shards"))
    order = F.xxhash64(F.lit(seed), "id", "mark", "size")
    place = Window.partitionBy("sid", "shard").orderBy("order", "id", "mark", "size")
    stop = F.sum(F.col("size") * F.col("times")).over(place.rowsBetween(Window.unboundedPreceding, 0))
    full = dealt.filter("size > 0").withColumn("order", order).withColumn("shard", shard).withColumn("start", stop - F.col("size") * F.col("times"))
    columns = ["id", "source", "mark", "size", "times", "sid", "shard", "start"]
    bare = dealt.filter("size = 0").withColumn("shard", F.lit(None).cast("long")).withColumn("start", F.lit(None).cast("long"))
    placed = staged(full.select(*columns).unionByName(bare.select(*columns)), "placed")

    shards = placed.filter("size > 0").groupBy("sid", "shard").agg(F.sum(F.col("size") * F.col("times")).alias("words"))
    shards = staged(shards.withColumn("n", F.ceil(F.col("words") / block)).withColumn("most", F.col("n") * int(cap)), "shards")
    # a source's target in its own blocks, some of which are short
    blocks = shards.groupBy("sid").agg(F.sum("n").alias("source_blocks"), F.sum("words").alias("words"), F.sum("most").alias("source_most"))
    blocks = blocks.join(wanted.select("sid", "target"), "sid").withColumn("votes", F.col("target") * F.col("source_blocks") / F.col("words"))
    blocks = staged(blocks.select("sid", "source_blocks", "source_most", "votes"), "blocks")
    seats = int(round(blocks.agg(F.coalesce(F.sum("votes"), F.lit(0.0))).first()[0]))
    quotas = by_trays(blocks.withColumn("seats", F.lit(seats).cast("long")), [], "sid", "votes", "seats", "source_most", "source_quota")
    shards = shards.join(quotas.select("sid", "source_blocks", "source_quota"), "sid")
    shards = staged(by_trays(shards, ["sid"], "shard", "n", "source_quota", "most", "quota").drop("most"), "quotas")
    return placed, wanted, shards


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 11, block: int = BLOCK) -> DataFrame:
    """One row per document: (id, source, size, source_size, target, taken).

    ``taken`` counts the words that the mix takes of the document, repeats included; it never exceeds ``cap``
    (a whole number) times its size. A source's taken words miss its target by a few blocks at most (half a
    block by its own quota, as much by each shard's). Null texts have size 0 and give nothing; null sources are
    a source of their own, last in order; a null id takes part like any other. Repeated rows are documents of
    their own. Ties in quotients go to the first source or shard. An empty table gives an empty result."""
    return _mixed(docs, id_col, text_col, source_col, weights, share, cap, seed, block, None).drop("mark")


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], share: float, cap: float, seed: int, block: int, mark: Column | None) -> DataFrame:
    """The rows of ``mix`` with ``mark``, a value of each document that is carried along."""
    placed, wanted, shards = plan(docs, id_col, text_col, source_col, weights, share, cap, seed, block, mark)
    rows = placed.join(shards.select("sid", "shard", "n", "quota"), ["sid", "shard"], "left").join(wanted.select("sid", "source_size", "target"), "sid")
    rows = rows.withColumn("phase", F.pmod(F.xxhash64(F.lit(seed + 2), "sid", "shard"), F.coalesce("n", F.lit(1).cast("long"))))
    # equal rows are listed in stretches, so that many of them are not one task's
    stretch = F.explode(F.expr(f"sequence(0L, (times - 1) div {LISTED})"))
    often = rows.filter(f"times > {LISTED}").withColumn("part", stretch)
    dealt = often.repartition("id", "mark", "part")
    listed = dealt.withColumn("copy", F.explode(F.expr(f"sequence(part * {LISTED}, least(times, (part + 1) * {LISTED}) - 1)"))).drop("part")
    few = rows.filter(f"times <= {LISTED}").withColumn("copy", F.explode(F.expr("sequence(0L, times - 1)")))
    each = few.unionByName(listed)

    def before(at: str) -> str:
        """Words taken before position ``at`` of a shard: whole blocks, then a part of one."""
        count = lambda b: f"((({b}) * quota + phase) div n)"
        b = f"(({at}) div {block})"
        return f"({block} * {count(b)} + ({count(b + ' + 1')} - {count(b)}) * (({at}) % {block}))"

    taken = F.coalesce(F.expr(f"{before('start + (copy + 1) * size')} - {before('start + copy * size')}"), F.lit(0).cast("long"))
    return each.withColumn("taken", taken).select("id", "source", "mark", "size", "source_size", "target", "taken")


def remix(docs: DataFrame, seed: int = 11, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mixed documents, all columns kept: each stays taken/size times, the fraction drawn by a seeded hash.

    A document taken twice comes twice; one of which nothing is taken goes. Rows that share a doc_id, or have
    none, are told apart by all their columns; rows equal in all get what is taken of them together, dealt
    out evenly, which of them is the same."""
    key = ["_mix_id", "_mix_source", "_mix_mark"]
    mark = F.xxhash64(*docs.columns)
    taken = _mixed(docs, "doc_id", "text", "source", weights, share, cap, seed, BLOCK, mark)
    named = taken.select(F.col("id").alias("_mix_id"), F.col("source").alias("_mix_source"), F.col("mark").alias("_mix_mark"), "size", "taken")
    u = F.pmod(F.xxhash64(F.lit(seed + 3), *key), F.lit(1 << 20)) / F.lit(float(1 << 20))
    rows = named.groupBy(*key).agg(F.count("*").alias("_mix_rows"), F.sum("taken").alias("taken"), F.max("size").alias("size")).filter("taken > 0")
    copies = staged(rows.select(*key, "_mix_rows", F.floor(F.col("taken") / F.col("size") + u).alias("_mix_n")).filter("_mix_n > 0"), "copies")
    marked = docs.withColumn("_mix_mark_of", mark)

    def joined(some: DataFrame) -> DataFrame:
        same = marked["doc_id"].eqNullSafe(some["_mix_id"]) & marked["source"].eqNullSafe(some["_mix_source"]) & (marked["_mix_mark_of"] == some["_mix_mark"])
        return marked.join(some, same)

    def listed(rows: DataFrame) -> DataFrame:
        return rows.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_n"))).alias("_mix_i")).select(*docs.columns)

    once, equal = joined(copies.filter("_mix_rows = 1")), copies.filter("_mix_rows > 1")
    if equal.isEmpty():
        return listed(once)
    # equal rows are numbered within the parts of a staged table, then over them: no window holds them all
    more = staged(joined(equal).withColumn("_mix_part", F.spark_partition_id()), "equal-rows")
    parts = more.groupBy(*key, "_mix_part").agg(F.count("*").alias("_mix_part_rows"))
    earlier = F.coalesce(F.sum("_mix_part_rows").over(Window.partitionBy(*key).orderBy("_mix_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*(F.col(c).alias(f"{c}_p") for c in [*key, "_mix_part"]), earlier.alias("_mix_earlier"))
    on = F.lit(True)
    for c in [*key, "_mix_part"]:
        on = on & more[c].eqNullSafe(parts[f"{c}_p"])
    place = F.row_number().over(Window.partitionBy(*key, "_mix_part").orderBy("_mix_mark_of")) + F.col("_mix_earlier")
    share_of = F.expr("_mix_n div _mix_rows + if(_mix_place <= _mix_n % _mix_rows, 1, 0)")
    more = more.join(parts, on).withColumn("_mix_place", place).withColumn("_mix_n", share_of).filter("_mix_n > 0")
    return listed(once.select(*docs.columns, "_mix_n").unionByName(more.select(*docs.columns, "_mix_n")))
