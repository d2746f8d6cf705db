"""Iteration: each round joins only what the last one found, and its rows are written to the shared folder."""

from __future__ import annotations

import atexit
import inspect
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rounds whose rows are gathered into one table.
MERGED = 16

#: (folder of a written table, weak reference to the file index of the frame that reads it)
_WRITTEN: list[tuple] = []


def _shared(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="arggraph-"))
    return sc._jsc.sc().getCheckpointDir().get()


def _drop(spark: SparkSession, unused_only: bool) -> None:
    if spark.sparkContext._jsc is None:
        _WRITTEN.clear()
        return
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for entry in list(_WRITTEN):
        if not unused_only or entry[1].get() is None:
            _WRITTEN.remove(entry)
            p = path_of(entry[0])
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _drop_all() -> None:
    try:
        spark = SparkSession.getActiveSession()
        if spark is not None and _WRITTEN:
            _drop(spark, unused_only=False)
    except Exception:  # the JVM may be gone at exit
        pass


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder of spark.checkpoint.dir and reads it again, so that lost executors cost no recomputation.

    A checkpoint would run the plan twice. The files go when nothing on the JVM's side refers to them any more.
    """
    spark = df.sparkSession
    _drop(spark, unused_only=True)
    path = f"{_shared(spark)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    index = out._jdf.queryExecution().analyzed().relation().location()
    _WRITTEN.append((path, spark.sparkContext._jvm.java.lang.ref.WeakReference(index)))
    return out


def is_cut(df: DataFrame) -> bool:
    """Whether ``df`` is a frame that ``cut`` gave, so that writing it once more gains nothing."""
    plan = df._jdf.queryExecution().analyzed()
    return plan.getClass().getSimpleName() == "LogicalRelation" and any(ref.get() is not None and ref.get().equals(plan.relation().location()) for _, ref in _WRITTEN)


@contextmanager
def shared_folder(spark: SparkSession) -> Iterator[str]:
    """A new folder in the shared one, deleted at the end; what reads it must have been written elsewhere by then."""
    path = f"{_shared(spark)}/folder-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def some(df: DataFrame) -> bool:
    return not df.isEmpty()


def fixpoint(start: DataFrame, step: Callable[..., DataFrame], keys: list[str], rounds: int | None = None, number: str | None = None) -> DataFrame:
    """All rows that ``start`` and repeated ``step`` give, distinct by ``keys``.

    ``step`` gets the rows of the last round, and all rows so far if it takes two arguments. ``number`` names a column
    for the round, from 1, in which a row was first met; ``rounds`` is the most of them.
    """
    wide = len(inspect.signature(step).parameters) > 1
    new = start.select(*keys).distinct()
    new = cut(new.withColumn(number, F.lit(1)) if number else new)
    parts, all_, n = [new], new, 1
    while (rounds is None or n < rounds) and some(new):
        n += 1
        found = (step(new, all_) if wide else step(new)).select(*keys).distinct().join(all_.select(*keys), keys, "left_anti")
        new = cut(found.withColumn(number, F.lit(n)) if number else found)
        parts.append(new)
        all_ = all_.unionByName(new)
        if len(parts) == MERGED:  # so that the plan of all rows stays small over many rounds
            all_ = cut(all_)
            parts = [all_]
    return all_
