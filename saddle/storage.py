"""Lineage cuts: tables written to the shared folder named by ``spark.checkpoint.dir``.

A written parquet table survives the loss of any executor, can be pruned by column
when it is read back, and gives every later job the same rows, which the ordering
helpers rely on.
"""
from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting under which a job's shuffle files go when the job ends, not when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_passing: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder for lineage cuts; set here only when the session names none and runs locally, and then it ends with the process."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            configured = tempfile.mkdtemp(prefix="saddle-")
            atexit.register(shutil.rmtree, configured, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(configured)
    return jsc.getCheckpointDir().get()


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Writes inside leave no shuffle files: what they wrote is read from the shared folder and never made again from shuffles."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What ``materialise`` writes inside, to folders of its own choice, goes at the end: nothing that is used later may read it."""
    _passing.append([])
    try:
        yield
    finally:
        for target in _passing.pop():
            _delete(spark, target)


def _delete(spark: SparkSession, target: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` once and return the written table."""
    spark = df.sparkSession
    target = path or f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    if path is None and _passing:
        _passing[-1].append(target)
    schema = df.schema
    with shuffles_go(spark):
        df.write.mode("error").parquet(target)
    return spark.read.schema(schema).parquet(target)


def new_name() -> str:
    """A name for a table that ``drop`` can take away again."""
    return f"saddle_{uuid.uuid4().hex}"


def drop(spark: SparkSession, name: str) -> None:
    """Take away what was written under ``new_name``: the table and its files in the shared folder. Files written to another path stay.

    Call it only when nothing that reads the table is still to run.
    """
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    _delete(spark, f"{shared_folder(spark)}/{name}")


def bucketed(df: DataFrame, *keys: str, parts: str | None = None, path: str | None = None, name: str | None = None) -> DataFrame:
    """As ``materialise``, but the table remembers that it is hash partitioned by ``keys``.

    Joins and sums on the keys then move only the other side. ``parts`` names a column whose values
    get folders of their own.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = name or new_name()
    writer = df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).format("parquet")
    if parts:
        writer = writer.partitionBy(parts)
    with shuffles_go(spark):
        writer.option("path", path or f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)
