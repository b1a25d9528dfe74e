"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import drop, new_folder, remove, scope, staged  # noqa: F401

#: A word is a run of characters other than ASCII white space (what ``bytes.split()`` splits on).
WORD = r"[^\x20\x09-\x0D]+"

#: So many repetitions of a row are listed in one stretch.
LISTED = 1 << 16


def word_count(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hex64(value: Column) -> Column:
    """16 lower-case hex digits of a long read as unsigned."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def as_bytes(column: pa.Array) -> Iterator[bytes]:
    """The values of a string or binary Arrow column as bytes; null as the empty text."""
    if not (pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    for value in column:
        yield value.as_py() or b""


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches short enough that what is made for one stays small beside the texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def listed(rows: DataFrame, times: str, out: str, *keys: str, stretch: int = LISTED) -> DataFrame:
    """Each row as often as ``times`` says, numbered from 0 in ``out``. Rows are read twice: staged ones, best.

    Those that repeat more than ``stretch`` times are dealt out by their keys and stretches, so that no array and no task holds them all."""
    few = rows.filter(F.col(times) <= stretch).withColumn(out, F.explode(F.expr(f"sequence(0L, {times} - 1)")))
    often = rows.filter(F.col(times) > stretch).withColumn("_part", F.explode(F.expr(f"sequence(0L, ({times} - 1) div {stretch})")))
    dealt = often.repartition(*keys, "_part")
    return few.unionByName(dealt.withColumn(out, F.explode(F.expr(f"sequence(_part * {stretch}, least({times}, (_part + 1) * {stretch}) - 1)"))).drop("_part"))
