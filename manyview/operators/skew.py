"""Joins whose keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with at least one in HOT_SHARE of all rows is hot; so there are at most HOT_SHARE hot keys, which may be sent to all tasks.
HOT_SHARE = 1_000


def hot_keys(counts: DataFrame, keys: list[str], whole: int) -> DataFrame:
    """(keys, salts) of the hot keys as a local table; counts: (keys, n), how many rows there are of each; whole: of how many."""
    salts = F.ceil(F.col("n") * HOT_SHARE / F.lit(max(1, whole))).cast("int")
    hot = counts.where(F.col("n") * HOT_SHARE >= whole).select(*keys, salts.alias("salts"))
    return counts.sparkSession.createDataFrame(hot.toArrow(), hot.schema)


def joined_by_hot_key(many: DataFrame, other: DataFrame, hot: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """many joined with other by keys; hot: what hot_keys gives for `many`.

    Rows of a hot key are dealt over as many salts as it has times the share of rows that makes a key hot, and the rows of
    `other` go to each; so no task gets more than about that share by one key. Other keys have one salt.
    """
    dealt = F.pmod(F.xxhash64(*[F.col(c) for c in many.columns if c not in keys]), F.coalesce("salts", F.lit(1))).cast("int")
    spread = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
    left = many.join(F.broadcast(hot), keys, "left").withColumn("salt", dealt).drop("salts")
    right = other.join(F.broadcast(hot), keys, "left").withColumn("salt", spread).drop("salts")
    return left.join(right, [*keys, "salt"], how).drop("salt")
