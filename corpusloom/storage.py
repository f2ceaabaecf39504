"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_recording: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("recording", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset: one of our own on a local master, an error on a cluster."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="corpusloom-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and survives the loss of executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (paths := _recording.get()) is not None:
        paths.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what stored() has written for these tables. For steps that are done: nothing may read the tables later."""
    for df in tables:
        delete(df.sparkSession, df._stored_path)
    if tables:
        released(tables[0].sparkSession)


def released(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps that are done: Spark's cleaner deletes them when it finds that no plan refers to them, which otherwise may take half an hour."""
    spark._jvm.System.gc()


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def recorded(paths: list[str]) -> Iterator[None]:
    """Within it, stored() notes in paths where it has written."""
    token = _recording.set(paths)
    try:
        yield
    finally:
        _recording.reset(token)
