"""Where jobs keep what must outlive an executor: tables in the folder that the cluster shares."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where that is unset, a fresh folder on one machine, an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A place of its own in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: A session setting: shuffle files go when the query that made them ends, not when the driver next collects its garbage.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries inside go as soon as their query ends."""
    before = spark.conf.get(_FREED, "false")
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREED, before)


def saved(df: DataFrame) -> DataFrame:
    """Writes a DataFrame to the shared folder and reads it back: lineage is cut and the rows survive executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        df.write.parquet(path)
    if (made := _passing.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables saved inside are deleted at its end; what is to stay is saved by `outlasting`."""
    made: list[str] = []
    token = _passing.set(made)
    try:
        yield
    finally:
        _passing.reset(token)
        context = spark.sparkContext
        for path in made:
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def outlasting(df: DataFrame) -> DataFrame:
    """`saved`, for what `passing_tables` around it must not delete."""
    token = _passing.set(None)
    try:
        return saved(df)
    finally:
        _passing.reset(token)
