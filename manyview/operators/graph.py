"""Connected components of links between rows, by alternating large-star and small-star rounds.

Each round is two grouped minima with map-side combine; no component is gathered anywhere. The links shrink towards
stars around the smallest id of each component, in a number of rounds that grows with the logarithm of its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from manyview.session import cut

MOST_ROUNDS = 60
#: Of a partition, about.
LINKS = 200_000


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (a > b) after one operation."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("u", "m").alias("m"))
    moved = both.join(least, F.col("u") == F.col("of"))
    if large:
        out = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("of").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, label) of each node that has a link (a, b); label: the smallest id of its component.

    Links get fewer from round to round, and so do the partitions that they lie in. Where many links share a node, the joins
    of a round are left to Spark's splitting of skewed partitions.
    """
    now = cut(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    for _ in range(MOST_ROUNDS):
        parts = max(1, -(-state[0] // LINKS))
        now = cut(_star(_star(now, True).coalesce(parts), False).coalesce(parts))
        before, state = state, _state(now)
        if before == state:
            break
    else:
        raise RuntimeError(f"components have not settled in {MOST_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(now.select("b", F.col("b").alias("label")).distinct())


def _sorted_star(links: DataFrame, large: bool) -> DataFrame:
    """As _star, by one shuffle; links may be there twice, as the next sort drops them."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    order = Window.partitionBy("u").orderBy("v")
    one = both.select("u", "v", F.first("v").over(order).alias("m"), F.lag("v").over(order).alias("last")).where("last is null or last <> v")
    if large:
        return one.where("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b"))
    return one.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"), F.col("m").alias("b"))


def sorted_components(links: DataFrame) -> DataFrame:
    """As components, for graphs of many small components: each operation sorts the links by their nodes once, instead of grouping, joining and
    making them distinct. The links of one node are sorted in one task, which spills them if they are many."""
    now = cut(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    state = None
    for _ in range(MOST_ROUNDS):
        now = cut(_sorted_star(_sorted_star(now, True), False))
        before, state = state, _state(now)
        if before == state:
            break
    else:
        raise RuntimeError(f"components have not settled in {MOST_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(now.select("b", F.col("b").alias("label")).distinct())
