"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from manyview.session import cut, scratch

__all__ = ["ascii_lower", "cut", "in_modest_batches", "scratch", "table", "text_or_empty"]

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(column: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.when(column.rlike("[A-Z]"), F.translate(column, ASCII_UPPER, ASCII_UPPER.lower())).otherwise(column)


ROWS_PER_BATCH = 500


def in_modest_batches(df: DataFrame) -> DataFrame:
    """df, in a session that hands Python at most ROWS_PER_BATCH rows at a time: texts are long, and a batch is held in memory by
    both sides. A smaller setting stays. Spark reads the setting when a plan runs, which is after its operator has returned,
    so it can't be put back here."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= ROWS_PER_BATCH:
        df.sparkSession.conf.set(key, ROWS_PER_BATCH)
    return df
