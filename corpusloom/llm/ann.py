"""Approximate nearest neighbours by cosine: inverted lists, product-quantised residuals, exact reranking.

The model (coarse centroids, codebooks) is fitted on a bounded sample and broadcast; every row is indexed. A
list belongs to a centroid and, in tables with more rows than the sample can give centroids for, to one of the
second level as well, which is shared by all centroids: the number of lists grows with the root of the rows.
Equal vectors are indexed once with their smallest ids, all that a top-k with ties to smaller ids can
return. How many lists a query asks is set by queries of the table itself, a bounded number of which meets
every row. Lists are dealt in blocks of bounded size and the queries that probe a list in slices of bounded
size; each block scores each slice by table look-ups, reranks its shortlist with the original vectors and
then whatever else the quantisation errors, kept with the codes, leave in question: a block loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, staged

#: Rows that centroids and codebooks are fitted on at most, those with the smallest hashes of their ids.
TRAIN_ROWS = 20_000
#: Share of the trial queries' true neighbours that the probed lists must hold when the number of probes is set.
PROBE_RECALL = 0.997
#: Queries that meet every row to set the number of probes at most, those with the smallest hashes of their vectors.
TRIAL_QUERIES = 512
#: Rows of a list's block, and queries that meet it in one task, about.
BLOCK_ROWS = 1 << 15
ASK_ROWS = 1 << 15
SHORTLIST = 128
CODES = 256
#: More than what rounding does to a cosine or to its estimate.
ROUNDING = 1e-12


@dataclass
class Model:
    dim: int
    centroids: np.ndarray
    second: np.ndarray  # centroids of what is left of a vector after the first; list = first * len(second) + second
    books: np.ndarray  # subspace x code x 2
    probes: int  # first-level centroids
    lists: int  # lists of those

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, 2 * len(self.books) - x.shape[1])))

    def centres(self, lists: np.ndarray) -> np.ndarray:
        return self.centroids[lists // len(self.second)] + self.second[lists % len(self.second)]

    def assign(self, unit: np.ndarray) -> np.ndarray:
        first = np.argmax(unit @ self.centroids.T - 0.5 * (self.centroids**2).sum(axis=1), axis=1)
        left = unit - self.centroids[first]
        return first * len(self.second) + np.argmax(left @ self.second.T - 0.5 * (self.second**2).sum(axis=1), axis=1)

    def encode(self, unit: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = self.padded(unit - self.centres(lists)).reshape(len(unit), -1, 2)
        codes = np.empty(rest.shape[:2], dtype=np.uint8)
        for j, book in enumerate(self.books):
            codes[:, j] = np.argmin((book**2).sum(axis=1) - 2 * rest[:, j] @ book.T, axis=1)
        return codes

    def errors(self, unit: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """How far what the codes stand for is from each row: no query's estimate is off by more."""
        rest = self.padded(unit - self.centres(lists)).reshape(len(unit), -1, 2)
        return np.sqrt(((rest - self.books[np.arange(len(self.books)), codes]) ** 2).sum(axis=(1, 2)))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """query x subspace x code: inner products of the query with the codes; a query stays exact, only rows are quantised."""
        return np.einsum("qjd,jcd->qjc", self.padded(queries).reshape(len(queries), -1, 2), self.books)

    def nearness(self, query: np.ndarray, first: np.ndarray) -> np.ndarray:
        """How near a query is to each list of some first-level centroids: first x second."""
        c = self.centroids[first]
        of_first = c @ query - 0.5 * (c**2).sum(axis=1)
        return of_first[:, None] + (self.second @ query - 0.5 * (self.second**2).sum(axis=1))[None, :] - c @ self.second.T

    def probed(self, queries: np.ndarray, sizes: np.ndarray, least: int) -> list[np.ndarray]:
        """The lists that each query asks, nearest first; further ones too as long as they hold fewer than ``least`` ids together."""
        near = queries @ self.centroids.T - 0.5 * (self.centroids**2).sum(axis=1)
        order = np.argsort(-near, axis=1, kind="stable")
        out = []
        for query, first in zip(queries, order):
            for some, n in ((first[: self.probes], self.lists), (first, None)):
                found = self.nearness(query, some).ravel()
                ranked = np.argsort(-found, kind="stable")
                lists = (some[:, None] * len(self.second) + np.arange(len(self.second))[None, :]).ravel()[ranked]
                held = np.cumsum(sizes[lists])
                if n is not None and held[min(n, len(held)) - 1] >= least:
                    break
                n = int(np.searchsorted(held, least)) + 1
            out.append(lists[:n])
        return out


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    centres = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)
        n = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, x[:, d], k) for d in range(x.shape[1])], axis=1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; the largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def fit_arrays(x: np.ndarray, n_rows: int, k: int, recall: float = PROBE_RECALL, seed: int = 3) -> Model:
    """A model for ``n_rows`` rows from sampled ones; probes are set so that the lists hold ``recall`` of the sample's neighbours in it."""
    rng = np.random.default_rng(seed)
    unit = units(x)
    n_lists = int(np.clip(np.sqrt(n_rows) / 2, 1, max(1, len(unit) // 16)))
    centroids = _kmeans(unit, n_lists, 8, rng)
    first = np.argmax(unit @ centroids.T - 0.5 * (centroids**2).sum(axis=1), axis=1)
    n_second = int(np.clip(np.sqrt(n_rows) / 2 / len(centroids), 1, max(1, len(unit) // 16)))
    second = _kmeans(unit - centroids[first], n_second, 8, rng) if n_second > 1 else np.zeros((1, x.shape[1]))
    model = Model(x.shape[1], centroids, second, np.zeros((-(-x.shape[1] // 2), 1, 2)), len(centroids), len(centroids) * len(second))
    own = model.assign(unit)
    rest = model.padded(unit - model.centres(own)).reshape(len(unit), -1, 2)
    books = []
    for j in range(rest.shape[1]):
        book = _kmeans(rest[:, j], CODES, 5, rng)
        books.append(np.concatenate([book, np.repeat(book[:1], CODES - len(book), axis=0)]))
    model.books = np.stack(books)
    trial = unit[rng.choice(len(unit), min(len(unit), 400), replace=False)]
    near = np.argsort(-(trial @ unit.T), axis=1)[:, 1 : k + 1]
    return set_probes(model, trial, own[near], recall)


def set_probes(model: Model, trial: np.ndarray, near: np.ndarray, recall: float) -> Model:
    """The model with as many centroids and lists asked as hold ``recall`` of trial queries' neighbours, whose lists are ``near`` (-1: none)."""
    n_second = len(model.second)
    order = np.argsort(-(trial @ model.centroids.T - 0.5 * (model.centroids**2).sum(axis=1)), axis=1, kind="stable")
    place = np.argsort(order, axis=1)

    def enough(ranks: np.ndarray) -> int:
        """How many of the nearest hold ``recall`` of the neighbours whose ranks these are."""
        ranks = np.sort(ranks)
        return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1

    if not (near >= 0).any():
        return model
    probes = enough(np.take_along_axis(place, np.maximum(near, 0) // n_second, axis=1)[near >= 0])
    ranks = []
    for query, some, at, lists in zip(trial, order[:, :probes], place, near):
        found = model.nearness(query, some)
        held = lists[(lists >= 0) & (at[lists // n_second] < probes)]
        ranks += [int((found > found[at[i // n_second], i % n_second]).sum()) for i in held]
    return replace(model, probes=probes, lists=enough(np.array(ranks)) if ranks else probes * n_second)


def _first(exact: np.ndarray, rows: np.ndarray, ids: list[list[int]], k: int) -> tuple[dict[int, float], float]:
    """The ids of the best rows with their scores, more than ``k`` if there are, and the least score that counts. Rows are in the order of their ids: of equal scores, more than ``k`` rows with ids of their own hold the smallest."""
    found: dict[int, float] = {}
    last, heads = np.inf, set()
    for i in np.lexsort((rows, -exact)):
        if exact[i] < last:
            if len(found) > k:
                return found, last
            last, heads = exact[i], set()
        heads.add(ids[rows[i]][0])
        for x in ids[rows[i]]:
            found.setdefault(x, float(exact[i]))
        if len(heads) > k:
            return found, last
    return found, -np.inf


def rerank(query: np.ndarray, scores: np.ndarray, errors: np.ndarray, v: np.ndarray, lengths: np.ndarray, ids: list[list[int]], k: int, shortlist: int) -> dict[int, float]:
    """The ids with the ``k`` + 1 largest cosines of a block and some more: the shortlist by scores first, then every row whose error could lift it among them."""

    def exact(rows: np.ndarray) -> np.ndarray:
        return (v[rows] * query).sum(axis=1) / (lengths[rows] * np.sqrt((query**2).sum()))

    if len(ids) <= shortlist:
        return _first(exact(np.arange(len(ids))), np.arange(len(ids)), ids, k)[0]
    rows = np.argpartition(-scores, shortlist)[:shortlist]
    found, least = _first(exact(rows), rows, ids, k)
    listed = np.zeros(len(ids), dtype=bool)
    listed[rows] = True
    further = (scores + errors >= least - ROUNDING) & ~listed
    if not further.any():
        return found
    rows = np.flatnonzero(further | listed)
    return _first(exact(rows), rows, ids, k)[0]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Distinct (vec_id, v) that take part: ids and vectors that aren't null, no null or non-finite component, not all zero."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.filter(F.coalesce(finite, F.lit(False))).filter(F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id", "v").agg(F.count("*").alias("_n")).drop("_n")


def search(vectors: DataFrame, query_every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", train_rows: int = TRAIN_ROWS, recall: float = PROBE_RECALL, shortlist: int = SHORTLIST) -> DataFrame:
    """The ``k`` nearest rows found for each row whose id ``query_every`` divides: (query_id, rank, vec_id, score).

    Nearest first by cosine of the original vectors in double precision, ties to the smaller id; the query's
    own row is no candidate. ``usable`` tells what takes part; vectors of each length are searched apart.
    Repeated rows count once. With few candidates all are returned; an empty table gives an empty result.
    The sample for the model holds at most
    ``train_rows`` distinct vectors; every row is indexed. Lists asked hold ``recall`` of the neighbours that
    trial queries have in the whole table; within them no row is missed, whatever the ``shortlist``."""
    spark = vectors.sparkSession
    rows = staged(usable(vectors, id_col, vector_col), "vectors")
    lengths = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("v")).alias("distinct"), F.max((F.col("vec_id") % query_every == 0).cast("int")).alias("asked"))
    lengths = lengths.filter("n > 1 AND asked = 1").orderBy("dim").collect()  # a row a length: few
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = [_of_length(rows.filter(F.size("v") == x["dim"]), x["dim"], x["n"], x["distinct"], query_every, k, train_rows, recall, shortlist) for x in lengths]
    mine = reduce(DataFrame.unionByName, found).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return mine.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _of_length(rows: DataFrame, dim: int, n_rows: int, distinct: int, query_every: int, k: int, train_rows: int, recall: float, shortlist: int) -> DataFrame:
    """(query_id, vec_id, score) of vectors of one length, the ``k`` best of each query's vector among them. Some row is a query."""
    spark = rows.sparkSession
    vector = dict(rows.dtypes)["v"]
    # copies count once in the sample; hashes that aren't among the smallest don't travel
    most = min(1.0, (2 * train_rows + 100) / max(1, distinct))
    some = rows.withColumn("h", F.xxhash64("v")).filter(F.col("h") <= int(min(2**63 - 1, -(2**63) + most * 2**64)))
    sample = some.groupBy("v", "h").agg(F.count("*").alias("_n")).orderBy("h", "v").limit(train_rows).select("v").toArrow()["v"].combine_chunks()
    model = fit_arrays(_matrix(sample, dim), n_rows, k, recall)
    shared = spark.sparkContext.broadcast(model)

    # equal vectors once, with the k + 1 smallest ids; the limit acts before the shuffle too
    least = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("_r", F.row_number().over(least)).filter(F.col("_r") <= k + 1)
    classes = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            if batch.num_rows:
                unit = units(_matrix(batch.column(0), dim))
                lists = own.assign(unit)
                codes = own.encode(unit, lists)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(own.errors(unit, lists, codes))], ["v", "ids", "list", "code", "error"])

    indexed = staged(classes.mapInArrow(index, f"v {vector}, ids array<long>, list int, code binary, error double"), "index")
    queries = rows.filter(F.col("vec_id") % query_every == 0)
    asked = staged(queries.groupBy("v").agg(F.count("*").alias("_n")).select("v", F.monotonically_increasing_id().alias("q")), "queries")

    held = indexed.groupBy("list").agg(F.sum(F.size("ids")).alias("n_ids"), F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    # ids that come with several vectors could count more than once: they don't count at all
    several = staged(rows.groupBy("vec_id").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("vec_id").alias("id")), "several")
    over = indexed.select("list", F.explode("ids").alias("id")).join(several, "id").groupBy("list").agg(F.count("*").alias("n_over"))
    held = held.join(over, "list", "left").withColumn("n_ids", F.col("n_ids") - F.coalesce("n_over", F.lit(0))).drop("n_over")
    held = staged(held, "lists")
    # a row for each of the model's lists: half the root of the table's rows, and never more than (train_rows / 16) squared
    counts = held.select("list", "n_ids").toArrow()
    sizes = np.zeros(len(model.centroids) * len(model.second), dtype=np.int64)
    sizes[counts["list"].to_numpy()] = counts["n_ids"].to_numpy()
    sizes_of = spark.sparkContext.broadcast(sizes)

    trial_rows = asked.orderBy(F.xxhash64("v"), "q").limit(TRIAL_QUERIES).select("v").toArrow()["v"].combine_chunks()
    trial = units(_matrix(trial_rows, dim))
    trial_of = spark.sparkContext.broadcast(trial)

    def meet_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking = trial_of.value
        best, lists = np.full((len(asking), k + 1), -np.inf), np.full((len(asking), k + 1), -1, dtype=np.int32)
        for batch in small_batches(batches, 2048):
            of = np.broadcast_to(batch.column(1).to_numpy(), (len(asking), batch.num_rows))
            best, lists = np.hstack([best, asking @ units(_matrix(batch.column(0), dim)).T]), np.hstack([lists, of])
            top = np.argpartition(-best, k, axis=1)[:, : k + 1]
            best, lists = np.take_along_axis(best, top, axis=1), np.take_along_axis(lists, top, axis=1)
        t, c = np.nonzero(lists >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(best[t, c]), pa.array(lists[t, c])], ["t", "score", "list"])

    # the true neighbours of the trial queries: the nearest row of all is the query itself
    nearest = Window.partitionBy("t").orderBy(F.desc("score"), "list")
    met = indexed.select("v", "list").mapInArrow(meet_all, "t int, score double, list int").withColumn("r", F.row_number().over(nearest))
    met = met.filter((F.col("r") > 1) & (F.col("r") <= k + 1)).select("t", "r", "list").toArrow()  # k a trial query
    near = np.full((len(trial), k), -1, dtype=np.int64)
    near[met["t"].to_numpy(), met["r"].to_numpy() - 2] = met["list"].to_numpy()
    tuned = spark.sparkContext.broadcast(set_probes(model, trial, near, recall))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tuned.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                lists = own.probed(units(_matrix(some.column(0), dim)), sizes_of.value, k + 1)
                again = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
                yield pa.RecordBatch.from_arrays([some.column(0).take(again), some.column(1).take(again), pa.array(np.concatenate(lists).astype(np.int32))], ["v", "q", "list"])

    probes = asked.select("v", "q").mapInArrow(probe, f"v {vector}, q long, list int")
    slices = probes.groupBy("list").agg(F.ceil(F.count("*") / ASK_ROWS).cast("int").alias("slices"))
    grid = F.broadcast(staged(held.select("list", "blocks").join(slices, "list"), "grid"))  # a row for each of the model's lists
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    members = indexed.join(grid, "list").withColumn("block", dealt(F.element_at("ids", 1), "blocks")).withColumn("slice", each("slices")).select("list", "block", "slice", "v", "ids", "code", "error")
    probes = probes.join(grid, "list").withColumn("slice", dealt(F.col("q"), "slices")).withColumn("block", each("blocks")).select("list", "block", "slice", "q", F.col("v").alias("qv"))

    def meet(held: pa.Table, asking: pa.Table) -> pa.Table:
        empty = pa.table({"q": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not held.num_rows or not asking.num_rows:
            return empty
        own = shared.value
        ids = held["ids"].to_pylist()
        order = sorted(range(len(ids)), key=ids.__getitem__)
        ids = [ids[i] for i in order]
        v = _matrix(held["v"].combine_chunks(), dim)[order]
        codes = np.frombuffer(b"".join(held["code"].to_pylist()), dtype=np.uint8).reshape(len(ids), -1)[order]
        errors = held["error"].to_numpy()[order]
        lengths_of = np.sqrt((v**2).sum(axis=1))
        centre = own.centres(np.array([held["list"][0].as_py()]))[0]
        qs, qv = asking["q"].to_pylist(), _matrix(asking["qv"].combine_chunks(), dim)
        out: list[tuple[int, int, float]] = []
        step = max(1, min(256, (1 << 21) // len(ids)))
        for at in range(0, len(qs), step):
            part = qv[at : at + step]
            unit = units(part)
            tables = own.tables(unit)
            near = np.repeat((unit @ centre)[:, None], len(ids), axis=1)
            for j in range(codes.shape[1]):
                near += tables[:, j].take(codes[:, j], axis=1)
            for q, query, scores in zip(qs[at : at + step], part, near):
                out += [(q, x, score) for x, score in rerank(query, scores, errors, v, lengths_of, ids, k, shortlist).items()]
        if not out:
            return empty
        q, x, s = zip(*out)
        return pa.table({"q": pa.array(q, pa.int64()), "vec_id": pa.array(x, pa.int64()), "score": pa.array(s, pa.float64())})

    found = members.groupBy("list", "block", "slice").cogroup(probes.groupBy("list", "block", "slice")).applyInArrow(meet, "q long, vec_id long, score double")
    found = found.groupBy("q", "vec_id").agg(F.max("score").alias("score"))  # an id with several vectors takes one place
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k + 1).drop("_r")
    ids_of = queries.join(asked, "v").select(F.col("vec_id").alias("query_id"), "q")
    return top.join(ids_of, "q").filter("vec_id <> query_id").select("query_id", "vec_id", "score")
