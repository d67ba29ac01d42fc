"""Streams of record files: every file of a folder that is not read yet, through a query, to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files at ``path``, a folder or a single file."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())


def run_to_files(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream until nothing is left to read, with exactly one copy of each row under ``path``; returns what it holds.

    Back-pressure is Spark's: a batch is taken when the one before is written. A run that is broken off goes on from its checkpoint.
    """
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")
