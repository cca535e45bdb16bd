"""Redaction of a stream of rows: the batch transforms as they are, for they keep no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillveil.operators.detect import redact
from quillveil.policy import Policy


def _is_folder(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(place).isDirectory()


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table's Parquet files as a stream, the table being a file or a folder of files; the schema is that of the files now there."""
    path = f"{folder}/{table}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    if _is_folder(spark, path):
        return stream.parquet(path)
    return stream.option("pathGlobFilter", f"{table}.parquet").parquet(folder)  # a stream reads folders only


def start(stream: DataFrame, output: str, checkpoint: str, policy: Policy = Policy(), text: str = "text"):  # noqa: B008
    """Redact all that is there now, append it to Parquet files exactly once, and stop."""
    rows = redact(stream, text, policy=policy).drop("detections")
    return rows.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
