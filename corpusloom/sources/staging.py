"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
_made: ContextVar[list[str] | None] = ContextVar("staged tables of the innermost scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a temporary one of this process, but only if all of Spark is this process."""
    global _own_dir
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that driver and executors share (master {master})")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    return _own_dir


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is written there goes when its scope ends, or else when the driver does."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    system, where = _file_system(spark, path)
    system.deleteOnExit(where)
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it from there: cuts the lineage, survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    system, where = _file_system(spark, path)
    system.delete(where, True)


def drop(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for table in tables:
        remove(table.sparkSession, table._staged_path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[str], None]]:
    """What is staged within goes at the end, but for paths that the function given was called with."""
    outer, own, kept = _made.get(), [], set()
    token = _made.set(own)
    try:
        yield kept.add
    finally:
        _made.reset(token)
        for path in own:
            if path not in kept:
                remove(spark, path)
        if outer is not None:
            outer.extend(kept)
