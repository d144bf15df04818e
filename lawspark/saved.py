"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def _jvm_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, else (tests on one machine) a
    folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lawspark-")
        spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
    return spark.conf.get("spark.checkpoint.dir", None) or folder


#: Saved tables by path: of the blocks of temporary() open in this thread, innermost last; and those of no block.
_blocks = threading.local()
_left: dict[str, SparkSession] = {}


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back. This cuts the lineage: a lost executor costs only the
    tasks it was running, and later readers scan columns instead of computing df again. The table goes at the end of the
    innermost block of temporary(), else when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _owner()[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_path = path
    return out


def _owner() -> dict[str, SparkSession]:
    stack = getattr(_blocks, "stack", None)
    return stack[-1] if stack else _left


def _delete(path: str, spark: SparkSession) -> None:
    p = _jvm_path(spark, path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_saved(df: DataFrame) -> None:
    """Deletes the files of a table from saved() that no later plan reads."""
    for tables in (*getattr(_blocks, "stack", ()), _left):
        tables.pop(df._saved_path, None)
    _delete(df._saved_path, df.sparkSession)


@contextmanager
def temporary():
    """Tables saved inside are deleted at the end, but for those given to kept()."""
    stack = _blocks.stack = getattr(_blocks, "stack", [])
    stack.append(tables := {})
    try:
        yield
    finally:
        stack.remove(tables)
        for path, spark in tables.items():
            _delete(path, spark)


def kept(df: DataFrame) -> DataFrame:
    """A saved table that stays for the block outside, as a result reads it."""
    spark = _blocks.stack[-1].pop(df._saved_path)
    (_blocks.stack[-2] if len(_blocks.stack) > 1 else _left)[df._saved_path] = spark
    return df


@atexit.register
def _clean() -> None:
    """Deletes what results still read, unless Spark has ended before."""
    for path, spark in _left.items():
        if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
            return
        _delete(path, spark)
