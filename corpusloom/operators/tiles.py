"""Two sets of vectors, or one with itself, key by key: every pair meets once, in tiles of bounded size.

Keys with more members than a block holds are cut into blocks, each two of which meet in a task's group of their own;
smaller keys share groups. What leaves a group is what a fold makes of its pairs, worked out by strips of a few rows, so
that neither the pairs of a key nor those of a tile are ever held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import best_superposition
from ..sources.staging import staged

#: Members of a key that a block holds, about.
ROWS = 4_096
#: Pairs of a strip, and rows of an outgoing batch.
STRIP, BATCH = 1 << 17, 1 << 16


@dataclass
class Side:
    """Members of one key in order of their ids."""

    ids: np.ndarray
    x: np.ndarray  # members x components, shorter vectors padded with zeros
    sizes: np.ndarray  # components of each vector; 0 where it is null, empty or has a null component
    extra: dict[str, np.ndarray]

    def __len__(self) -> int:
        return len(self.ids)


#: (members of one set, members of the other, whether these are the same ones, whether the key is met in this group alone, the key) to columns.
Fold = Callable[[Side, Side, bool, bool, object], Iterator[dict[str, np.ndarray | pa.Array]]]


def without(a: Side, b: Side, at: slice) -> np.ndarray | None:
    """Which pairs have no distance, as a vector is null or lengths differ; None if all have."""
    if len(a) and len(b) and a.sizes[0] and (a.sizes == a.sizes[0]).all() and (b.sizes == a.sizes[0]).all():
        return None
    return (a.sizes[at, None] != b.sizes[None, :]) | (a.sizes[at, None] == 0)


def exact(a: Side, b: Side, i: np.ndarray, j: np.ndarray, scale: float) -> np.ndarray:
    """Distances of the pairs of places ``i`` and ``j``, of one length: differences squared and summed in order, as ``geometry.rmsd``."""
    out = np.empty(len(i))
    with np.errstate(all="ignore"):
        for start in range(0, len(i), 4_096):
            at = slice(start, start + 4_096)
            d = a.x[i[at]] - b.x[j[at]]
            d *= d
            out[at] = np.sqrt(np.add.reduce(np.ascontiguousarray(d.T), axis=0) / (a.sizes[i[at]] / 3))
    return scale * out


def strips(a: Side, b: Side, scale: float = 1.0) -> Iterator[tuple[slice, np.ndarray]]:
    """Rows of ``a`` and their distances to all of ``b``, NaN where there is none.

    Lengths and an inner product give a distance to eleven digits where it is not much less than the vectors' own lengths; all other pairs are worked out from their differences."""
    if not len(a) or not len(b):
        return
    step = max(1, STRIP // len(b))
    with np.errstate(all="ignore"):
        of_a, of_b = (a.x**2).sum(axis=1), (b.x**2).sum(axis=1)
        finite, other = np.isfinite(of_a).all() and np.isfinite(of_b).all(), np.ascontiguousarray(b.x.T)
        every = np.arange(len(b))
        for start in range(0, len(a), step):
            at = slice(start, min(len(a), start + step))
            size = of_a[at, None] + of_b[None, :]
            r = a.x[at] @ other
            r *= -2
            r += size
            size *= 1e-3
            near = r < size if finite else np.ones(r.shape, dtype=bool)
            none = without(a, b, at)
            if none is not None:
                near &= ~none
            r /= (a.sizes[at] / 3)[:, None]
            np.sqrt(r, out=r)
            r *= scale
            if near.all():
                for i in range(at.start, at.stop):
                    r[i - at.start] = exact(a, b, np.full(len(b), i), every, scale)
            elif near.any():
                i, j = np.nonzero(near)
                r[i, j] = exact(a, b, i + at.start, j, scale)
            if none is not None:
                r[none] = np.nan
            yield at, r


def superposed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """RMSD of each of ``x`` and each of ``y`` (sets x points x 3) after the best rotation and shift, as ``best_superposition``.

    The largest root of the quaternion matrix's characteristic polynomial, by Newton's steps from above; where they don't settle, or the root is close to another one, by singular values."""
    n, m, points = len(x), len(y), x.shape[1]
    with np.errstate(all="ignore"):
        a, b = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
        g = (a**2).sum(axis=(1, 2))[:, None] + (b**2).sum(axis=(1, 2))[None, :]
        c = [[np.ascontiguousarray(a[:, :, i]) @ np.ascontiguousarray(b[:, :, j].T) for j in range(3)] for i in range(3)]
        squares = sum(c[i][j] ** 2 for i in range(3) for j in range(3))
        gram = 0.0
        for i in range(3):
            for j in range(i, 3):
                dot = c[i][0] * c[j][0] + c[i][1] * c[j][1] + c[i][2] * c[j][2]
                gram = gram + (dot * dot if i == j else 2 * dot * dot)
        det = c[0][0] * (c[1][1] * c[2][2] - c[1][2] * c[2][1]) - c[0][1] * (c[1][0] * c[2][2] - c[1][2] * c[2][0]) + c[0][2] * (c[1][0] * c[2][1] - c[1][1] * c[2][0])
        c2, c1, c0 = -2 * squares, -8 * det, 2 * gram - squares**2
        root = np.minimum(g / 2, np.sqrt(3 * squares))  # neither is below the root
        for _ in range(16):
            square = root * root
            slope = 4 * square * root + 2 * c2 * root + c1
            step = (square * square + c2 * square + c1 * root + c0) / slope
            root = root - step
            settled = np.abs(step) <= 1e-8 * root  # a step's error is the square of that of the one before
            if settled.all():
                break
        out = np.sqrt(np.maximum(g - 2 * root, 0) / points)
        unsure = ~(settled & (slope > 1e-2 * root**3) & np.isfinite(out))
        i, j = np.nonzero(unsure)
        for start in range(0, len(i), 1 << 14):
            at = slice(start, start + (1 << 14))
            out[i[at], j[at]] = best_superposition(x[i[at]], y[j[at]])
    return out


def rounded(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """Distances rounded half up."""
    with np.errstate(all="ignore"):
        return np.where(x < 1e9, np.floor(x * 10.0**digits + 0.5) / 10.0**digits, x)


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        x = values.reshape(len(sizes), width)
    else:
        x = np.zeros((len(sizes), width))
        x[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    if flat.null_count:
        sizes = sizes.copy()
        sizes[row[flat.is_null().to_numpy(zero_copy_only=False)]] = 0
    return x, sizes


def _keys(table: pa.Table, extra: list[str]) -> Iterator[tuple[pa.Scalar, bool, list[tuple[bool, Side]]]]:
    key = table["key"].combine_chunks().dictionary_encode()
    codes, ids = key.indices.to_numpy(zero_copy_only=False), table["id"].to_numpy()
    first, alone = table["first"].to_numpy(), table["alone"].to_numpy()
    x, sizes = _vectors(table["x"].combine_chunks())
    more = {c: table[c].to_numpy() for c in extra}
    order = np.lexsort((ids, ~first, codes))
    cuts = np.flatnonzero(np.diff(codes[order] * 2 + ~first[order])) + 1
    of: dict[int, list[tuple[bool, Side]]] = {}
    single: dict[int, bool] = {}
    for at in np.split(order, cuts):
        of.setdefault(int(codes[at[0]]), []).append((bool(first[at[0]]), Side(ids[at], x[at], sizes[at], {c: v[at] for c, v in more.items()})))
        single[int(codes[at[0]])] = bool(alone[at[0]])
    for code, sides in of.items():
        yield key.dictionary[code], single[code], sides


def meet(a: DataFrame, b: DataFrame | None, fold: Fold, schema: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """What ``fold`` makes of the pairs of members (key, conf_id, xyz, *extra) of ``a`` and ``b`` with one key, with the key before the columns of ``schema``.

    Without ``b`` the members of ``a`` meet each other: in a group of one block with itself both sides are the same.
    Members without key or id take no part. A key that is cut gives rows for each two of its blocks."""
    spark, same, rows = a.sparkSession, b is None, ROWS
    kind = a.schema["key"].dataType.simpleString()
    names = [("key", kind), *((c.split()[0], c.split()[1]) for c in schema.split(", "))]
    pick = lambda df: df.select("key", F.col("conf_id").cast("long").alias("id"), F.col("xyz").cast("array<double>").alias("x"), *extra).filter("key is not null and id is not null")
    a, b = pick(a), None if same else pick(b)
    one = lambda df, n, m: df.select("key", F.lit(n).alias("na"), F.lit(m).alias("nb"))
    each = one(a, 1, 1) if same else one(a, 1, 0).unionByName(one(b, 0, 1))
    counts = staged(each.groupBy("key").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb")), "members").filter("na > 0 and nb > 0")
    large = (F.col("na") > rows) | (F.col("nb") > rows)
    blocks = lambda c: F.ceil(F.col(c) / rows).cast("int")
    held, cut = counts.agg(F.sum(F.when(~large, F.col("na") + F.col("nb"))), F.sum(F.when(large, blocks("na") * blocks("nb")))).first()
    bins, n_tiles = max(1, -(-(held or 0) // (2 * rows))), cut or 0
    # at most one row for each block's worth of members
    grid = F.broadcast(counts.filter(large).select("key", blocks("na").alias("na"), blocks("nb").alias("nb")))

    def dealt(df: DataFrame, own: str, other: str, first: bool) -> DataFrame:
        df = df.join(grid, "key", "left").withColumn("alone", F.col("na").isNull())
        number = lambda c, n: F.pmod(F.xxhash64(c), n)
        df = df.withColumn("part", F.when(F.col("alone"), number("key", F.lit(bins))).otherwise(F.xxhash64("key")))
        df = df.withColumn("_own", F.when(F.col("alone"), 0).otherwise(number("id", F.col(own)).cast("int")))
        df = df.withColumn("_other", F.explode(F.when(F.col("alone"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col(other) - 1))))
        if same:
            df = df.withColumn("ab", F.least("_own", "_other")).withColumn("bb", F.greatest("_own", "_other")).withColumn("first", F.col("_own") <= F.col("_other"))
        else:
            at = ("_own", "_other") if first else ("_other", "_own")
            df = df.withColumn("ab", F.col(at[0])).withColumn("bb", F.col(at[1])).withColumn("first", F.lit(first))
        return df.select("part", "ab", "bb", "first", "alone", "key", "id", "x", *extra)

    laid = dealt(a, "na", "nb", True) if same else dealt(a, "na", "nb", True).unionByName(dealt(b, "nb", "na", False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        itself = same and table["ab"][0].as_py() == table["bb"][0].as_py()
        waiting, n = [], 0
        for key, alone, sides in _keys(table, list(extra)):
            if len(sides) < 2 and not itself:
                continue
            for out in fold(sides[0][1], sides[-1][1], itself, alone, key.as_py()):
                columns = [pa.array(v) if isinstance(v, np.ndarray) else v for v in out.values()]
                waiting.append(pa.RecordBatch.from_arrays([pa.repeat(key, len(columns[0])), *columns], [c for c, _ in names]))
                n += len(columns[0])
                if n >= BATCH:
                    yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                    waiting, n = [], 0
        if n:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(2 * (bins + n_tiles), 4_096))
    laid = laid.repartition(parts, "part", "ab", "bb")  # by number: work is not told by the bytes that adaptive execution would put together
    return laid.groupBy("part", "ab", "bb").applyInArrow(run, ", ".join(f"`{c}` {t}" for c, t in names))
