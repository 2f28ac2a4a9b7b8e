"""Incremental input: new match files update the match table as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MATCHES = "i int, j int, a int, b int"


def append_matches(spark: SparkSession, folder: str, target: str, checkpoint: str):
    """A finite stream over the Parquet files of matches in a folder: each batch drops what the target has and appends the rest.
    Returns the query, which ends when it has read all files that are there."""

    def add(batch: DataFrame, _: int) -> None:
        new = batch.distinct()
        try:
            new = new.join(spark.read.schema(MATCHES).parquet(target), ["i", "j", "a", "b"], "left_anti")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
        new.write.mode("append").parquet(target)

    stream = spark.readStream.schema(MATCHES).parquet(folder)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
