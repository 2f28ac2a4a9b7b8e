"""Tracks: connected components of the match graph, one keypoint for each image."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from manyview.operators.graph import components

#: A node is image * 2^32 + keypoint, so nodes sort by image, then keypoint.
SHIFT = 2**32


def _node(image: str, keypoint: str):
    return F.col(image).cast("long") * SHIFT + F.col(keypoint).cast("long")


def degrees(matches: DataFrame) -> DataFrame:
    """(img_id, kp_id, degree): a match counts for both its ends."""
    ends = matches.select(F.explode(F.array(F.struct(F.col("i").alias("img_id"), F.col("a").alias("kp_id")), F.struct(F.col("j").alias("img_id"), F.col("b").alias("kp_id")))).alias("e"))
    return ends.groupBy("e.img_id", "e.kp_id").agg(F.count(F.lit(1)).alias("degree"))


def labelled(matches: DataFrame, components: Callable[[DataFrame], DataFrame] = components) -> DataFrame:
    """(img_id, kp_id, degree, label) of each matched keypoint; label: the smallest node of its component."""
    label = components(matches.select(_node("j", "b").alias("a"), _node("i", "a").alias("b")))
    return degrees(matches).withColumn("node", _node("img_id", "kp_id")).join(label, "node").drop("node")


def build(nodes: DataFrame, policy: str = "degree", least: int = 2) -> DataFrame:
    """(track_id, img_id, kp_id) from `labelled`. Of several keypoints of an image in a component one stays: that of the highest
    degree, then the smallest id ("degree"), or the smallest id ("first"). Components of fewer than `least` images go. Ids
    are dense in the order of the components' smallest nodes, numbered within blocks of labels."""
    order = [F.desc("degree"), F.col("kp_id")] if policy == "degree" else [F.col("kp_id")]
    one = nodes.withColumn("nth", F.row_number().over(Window.partitionBy("label", "img_id").orderBy(*order))).where("nth = 1")
    long = one.groupBy("label").agg(F.count(F.lit(1)).alias("images")).where(F.col("images") >= least).select("label", F.pmod(F.floor(F.col("label") / 65536), F.lit(2**40)).alias("block"))
    sizes = long.groupBy("block").agg(F.count(F.lit(1)).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("block", before.alias("start"))
    numbered = long.withColumn("nth", F.row_number().over(Window.partitionBy("block").orderBy("label")) - 1).join(starts, "block")
    ids = numbered.select("label", (F.col("start") + F.col("nth")).cast("long").alias("track_id"))
    return one.join(ids, "label").select("track_id", "img_id", "kp_id")


def statistics(nodes: DataFrame, least: int = 2) -> DataFrame:
    """One row: components, those of `least` images, those with conflicts, keypoints dropped for a conflict."""
    each = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("img_id").alias("images"))
    return each.agg(
        F.count(F.lit(1)).alias("components"),
        F.count_if(F.col("images") >= least).alias("multi_view"),
        F.count_if(F.col("n") > F.col("images")).alias("conflicts"),
        F.sum(F.col("n") - F.col("images")).alias("dropped"),
    )


def correspondences(track_obs: DataFrame, points: DataFrame) -> DataFrame:
    """(img_id, n): how many observations of each image belong to a track that has a point."""
    return track_obs.join(points.select("track_id"), "track_id", "left_semi").groupBy("img_id").agg(F.count(F.lit(1)).alias("n"))
