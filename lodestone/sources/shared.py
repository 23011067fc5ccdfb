"""The folder that the whole cluster shares, and tables in it: intermediate ones, which go when they are no longer read, and results.

``written`` makes a table; inside ``scratch`` all tables made are removed at the end, but for the result that is kept. Results go when Python ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_made: ContextVar[list[str] | None] = ContextVar("made", default=None)
_local: dict[str, str] = {}
_kept: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a local session has a temporary one, which goes when Python ends; a cluster has none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        session = spark.sparkContext.applicationId
        if session not in _local:
            where = tempfile.mkdtemp(prefix="lodestone-")
            atexit.register(shutil.rmtree, where, ignore_errors=True)
            _local[session] = f"file://{where}"
        found = _local[session]
    return found.rstrip("/")


def located(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    where, files = located(spark, path)
    files.delete(where, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path, removed with the ``scratch`` block it is made in, else when Python ends."""
    path = f"{folder(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    if _made.get() is not None:
        _made.get().append(path)
    else:
        _kept.append((spark, path))
    return path


@atexit.register
def _remove_kept() -> None:
    for spark, path in _kept:
        with suppress(Exception):  # the session may be gone
            remove(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage is cut, and losing an executor loses nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Gives ``keep(df, name)``, which writes a result that outlives the block; every other table made in it goes."""
    outer, mine = _made.get(), []
    token = _made.set(mine)

    def keep(df: DataFrame, name: str) -> DataFrame:
        inner = _made.set(outer)
        try:
            return written(df, name)
        finally:
            _made.reset(inner)

    try:
        yield keep
    finally:
        _made.reset(token)
        for path in mine:
            remove(spark, path)
