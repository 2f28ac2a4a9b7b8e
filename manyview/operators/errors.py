"""Reprojection: the star join of points, observations and cameras, and what is computed from its errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from manyview.functions.linalg import once
from manyview.functions.projection import DEPTH_MEDIAN, DEPTH_PROJECT, distance, pixel
from manyview.operators.quantiles import exact_percentiles
from manyview.session import cut

XYZ = ("x", "y", "z")


def _point() -> tuple[Column, Column, Column]:
    return tuple(F.col(c) for c in XYZ)


def projected(points: DataFrame, cameras: DataFrame, least_depth: float = DEPTH_PROJECT) -> DataFrame:
    """Every point in every camera: (track_id, img_id, u, v, depth). Meant for small sets of cameras."""
    u, v, z = pixel(_point(), least_depth=least_depth)
    return points.crossJoin(cameras).select("track_id", "img_id", u.alias("u"), v.alias("v"), z.alias("depth"))


def observed(points: DataFrame, obs: DataFrame, cameras: DataFrame, least_depth: float = DEPTH_PROJECT) -> DataFrame:
    """Each observation with the projection of its point: (track_id, img_id, u, v, pu, pv, depth, err); err is NULL if invalid."""
    u, v, z = pixel(_point(), least_depth=least_depth)
    star = obs.select("track_id", "img_id", "u", "v").join(points.select("track_id", *XYZ), "track_id").join(cameras, "img_id")
    put = once(star, ["track_id", "img_id", "u", "v", *XYZ], {"pu": u, "pv": v, "depth": z})  # filters on err don't get the whole projection
    return put.withColumn("err", distance(F.col("pu"), F.col("pv"), F.col("u"), F.col("v")))


def errors_or_infinite(star: DataFrame) -> DataFrame:
    return star.withColumn("err", F.coalesce("err", F.lit(float("inf"))))


def point_summary(star: DataFrame) -> DataFrame:
    """(track_id, n_views, median_err, max_err) over views in front of the camera; NULL where there are none."""
    fine = F.when(F.col("depth") > DEPTH_MEDIAN, F.col("err"))
    return star.groupBy("track_id").agg(F.count(fine).alias("n_views"), F.median(fine).alias("median_err"), F.max(fine).alias("max_err"))


def statistics(star: DataFrame, most: int | None = None) -> DataFrame:
    """One row: count, mean, median, p90, p95 of the errors; of the first `most` by (track_id, img_id), if given."""
    rows = star.where("err is not null")
    if most is not None:
        rows = rows.orderBy("track_id", "img_id").limit(most)
    rows = cut(rows.select("err"))
    found = exact_percentiles(rows, {"median": ("err", 0.5), "p90": ("err", 0.9), "p95": ("err", 0.95)})
    return rows.agg(F.count("err").alias("n"), F.avg("err").alias("mean"), *[F.lit(found[k]).cast("double").alias(k) for k in ("median", "p90", "p95")])


def worst(star: DataFrame, most: int) -> DataFrame:
    """The `most` largest errors of each image, with their place (from 1)."""
    order = Window.partitionBy("img_id").orderBy(F.desc("err"), "track_id")
    return star.where("err is not null").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("img_id", "place", "track_id", "err")
