"""Where intermediate tables go: the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables stored in each open `scratch`, the innermost last.
_open: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a session on one machine, as in tests, may leave it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (folder or _local()).rstrip("/")


@cache
def _local() -> str:
    return tempfile.mkdtemp(prefix="quillveil-")


def stored(df: DataFrame, codec: str = "zstd", outer: bool = False) -> DataFrame:
    """df, written as a table in the shared folder and read from there: it survives lost executors and has no lineage.

    The innermost open `scratch` removes it at its end; with `outer`, the one round that.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    scopes = _open[:-1] if outer else _open
    if scopes:
        scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored within are removed at the end; what is computed from them must be stored further out before."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            remove(spark, path)
