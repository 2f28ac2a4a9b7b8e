"""Diagnostics as relations: what an overlay would draw, and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from manyview.operators.errors import observed, projected
from manyview.session import cut

#: Lines of masks that go to all tasks, some fifty bytes each; more are joined by shuffling.
MOST_SENT = 1_000_000


def _in_image(width: int, height: int):
    return F.col("u").between(0, width - 1) & F.col("v").between(0, height - 1)


def projection_counts(points: DataFrame, cameras: DataFrame, obs: DataFrame, width: int, height: int) -> DataFrame:
    """(img_id, n_valid, n_inside, n_outside, n_observed, n_unobserved) of all points in each image."""
    put = projected(points, cameras).join(obs.select("track_id", "img_id", F.lit(1).alias("seen")), ["track_id", "img_id"], "left")
    valid, inside = F.col("u").isNotNull(), F.coalesce(_in_image(width, height), F.lit(False))
    return put.groupBy("img_id").agg(
        F.count_if(valid).alias("n_valid"),
        F.count_if(inside).alias("n_inside"),
        F.count_if(valid & ~inside).alias("n_outside"),
        F.count_if(inside & F.col("seen").isNotNull()).alias("n_observed"),
        F.count_if(inside & F.col("seen").isNull()).alias("n_unobserved"),
    )


def _shuffled(key: str):
    """A number below 2^32 by which rows are drawn without regard to the order of the key."""
    return F.pmod(F.pmod(F.col(key), F.lit(2**31)) * F.lit(2654435761), F.lit(2**32))


def draw_list(points: DataFrame, cameras: DataFrame, obs: DataFrame, width: int, height: int, most: int) -> DataFrame:
    """(img_id, track_id, u, v, seen): up to `most` points of each image, observed ones first, then mixed."""
    put = projected(points, cameras).where(_in_image(width, height)).join(obs.select("track_id", "img_id", F.lit(True).alias("seen")), ["track_id", "img_id"], "left")
    order = Window.partitionBy("img_id").orderBy(F.col("seen").isNull(), _shuffled("track_id"), "track_id")
    return put.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).select("img_id", "track_id", "u", "v", F.coalesce("seen", F.lit(False)).alias("seen"))


def outside_masks(points: DataFrame, cameras: DataFrame, runs: DataFrame, width: int, height: int, margin: int = 0, least: float = 0.5) -> DataFrame:
    """(track_id, n_views, ratio): points that fall outside the masks in at least that share of the images that show them.

    A point's images are one after another in a task, so only its counts are shuffled."""
    put = projected(points, F.broadcast(cameras)).where(_in_image(width, height)).select("track_id", "img_id", F.rint("u").cast("int").alias("pu"), F.rint("v").cast("int").alias("v"))
    rows = cut(runs.where("v is not null").groupBy("img_id", "v").agg(F.collect_list(F.struct(F.col("u0") - margin, F.col("u1") + margin)).alias("in_row")))  # a row for each line of a mask
    rows = F.broadcast(rows) if rows.count() <= MOST_SENT else rows
    hit = F.exists("in_row", lambda r: F.col("pu").between(r["col1"], r["col2"]))
    out = F.when(F.coalesce(hit, F.lit(False)), 0.0).otherwise(1.0)
    judged = put.join(rows, ["img_id", "v"], "left").select("track_id", out.alias("out")).groupBy("track_id").agg(F.count(F.lit(1)).alias("n_views"), F.avg("out").alias("ratio"))
    return judged.where(F.col("ratio") >= least)


def heat_cells(kps: DataFrame, width: int, height: int) -> DataFrame:
    """(img_id, cx, cy, n): keypoints on each pixel, half-even rounding, inside the image."""
    cells = kps.select("img_id", F.rint("x").cast("int").alias("cx"), F.rint("y").cast("int").alias("cy"))
    return cells.where((F.col("cx") >= 0) & (F.col("cx") < width) & (F.col("cy") >= 0) & (F.col("cy") < height)).groupBy("img_id", "cx", "cy").agg(F.count(F.lit(1)).alias("n"))


def heat_map(cells: DataFrame, sigma: float = 3.0) -> DataFrame:
    """(img_id, cx, cy, heat): cells spread by a Gaussian cut at 3 sigma, scaled by the 99.5th percentile of each image and cut at 1."""
    reach = int(3 * sigma)
    near = cells.withColumn("dx", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn("dy", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    weight = F.exp(-(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) / (2 * sigma * sigma))
    spread = near.groupBy("img_id", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy")).agg(F.sum(F.col("n") * weight).alias("raw"))
    top = spread.groupBy("img_id").agg(F.percentile("raw", F.lit(0.995)).alias("top"))
    return spread.join(top, "img_id").select("img_id", "cx", "cy", F.least(F.col("raw") / F.col("top"), F.lit(1.0)).alias("heat"))


def long_tracks(track_obs: DataFrame, kps: DataFrame, least: int) -> DataFrame:
    """(img_id, track_id, x, y): keypoints of tracks with at least `least` views."""
    long = track_obs.groupBy("track_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("track_id")
    return track_obs.join(long, "track_id", "left_semi").join(kps, ["img_id", "kp_id"]).select("img_id", "track_id", "x", "y")


def removed(judged: DataFrame, obs: DataFrame) -> DataFrame:
    """(track_id, img_id, u, v, reason): observations of points that a filter removed."""
    return judged.where("reason is not null").select("track_id", "reason").join(obs, "track_id").select("track_id", "img_id", "u", "v", "reason")


def drawn_keypoints(kps: DataFrame, most: int) -> DataFrame:
    """(img_id, kp_id, x, y): up to `most` keypoints of each image, mixed."""
    order = Window.partitionBy("img_id").orderBy(_shuffled("kp_id"), "kp_id")
    return kps.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).select("img_id", "kp_id", "x", "y")


def drawn_matches(pixels: DataFrame, most: int) -> DataFrame:
    """(i, j, a, b, xi, yi, xj, yj): up to `most` matches of each pair, mixed."""
    order = Window.partitionBy("i", "j").orderBy(_shuffled("a"), "a", "b")
    return pixels.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).select("i", "j", "a", "b", "xi", "yi", "xj", "yj")


def residuals(star: DataFrame, least: float = 0.0) -> DataFrame:
    """(img_id, track_id, u, v, pu, pv, err): where points fall against where they were seen, from `least` pixels on."""
    return star.where(F.col("err") >= least).select("img_id", "track_id", "u", "v", "pu", "pv", "err")


def residual_summary(star: DataFrame) -> DataFrame:
    """(img_id, n, mean, median, p95, worst) of the errors of each image's observations."""
    parts = [F.count("err").alias("n"), F.avg("err").alias("mean"), F.percentile("err", F.lit(0.5)).alias("median"), F.percentile("err", F.lit(0.95)).alias("p95"), F.max("err").alias("worst")]
    return star.where(F.col("err").isNotNull()).groupBy("img_id").agg(*parts)


def foreground(runs: DataFrame, width: int, height: int) -> DataFrame:
    """(img_id, ratio): the share of an image's pixels that its mask covers."""
    return runs.groupBy("img_id").agg((F.sum(F.col("u1") - F.col("u0") + 1) / F.lit(width * height)).alias("ratio"))


def resized_runs(runs: DataFrame, old: tuple[int, int], new: tuple[int, int]) -> DataFrame:
    """Mask runs (img_id, v, u0, u1) for images of (width, height) new instead of old, by the nearest pixel."""

    def first(x, k: int):
        """The first new pixel whose old one is x or later."""
        return F.ceil(x * new[k] / old[k])

    rows = F.sequence(first(F.col("v"), 1), first(F.col("v") + 1, 1) - 1)
    some = runs.where((first(F.col("v") + 1, 1) > first(F.col("v"), 1)) & (first(F.col("u1") + 1, 0) > first(F.col("u0"), 0)))
    made = some.select("img_id", F.explode(rows).alias("v"), first(F.col("u0"), 0).alias("u0"), (first(F.col("u1") + 1, 0) - 1).alias("u1"))
    return made.select("img_id", *[F.col(c).cast("int").alias(c) for c in ("v", "u0", "u1")])


def export(folder: str, tables: dict[str, DataFrame]) -> None:
    """Writes each relation as Parquet under its name."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def report(points: DataFrame, kps: DataFrame, track_obs: DataFrame, cameras: DataFrame, judged: DataFrame, width: int, height: int, most: int = 3000) -> dict[str, DataFrame]:
    """The relations of a reconstruction's diagnostics, ready for `export`: keypoint and long-track heat cells, counts of
    projections, points to draw, residuals, and what the cleanup removed."""
    kps, track_obs = kps.select("img_id", "kp_id", "x", "y"), track_obs.select("track_id", "img_id", "kp_id")
    obs = track_obs.join(kps.select("img_id", "kp_id", F.col("x").alias("u"), F.col("y").alias("v")), ["img_id", "kp_id"]).select("track_id", "img_id", "u", "v")
    return {
        "keypoint_cells": heat_cells(kps, width, height),
        "track_cells": heat_cells(long_tracks(track_obs, kps, 3), width, height),
        "projection_counts": projection_counts(points, cameras, obs, width, height),
        "draw_list": draw_list(points, cameras, obs, width, height, most),
        "residuals": residuals(observed(points, obs, cameras)),
        "removed": removed(judged, obs),
    }
