"""Registration of images: scores, next image, and the two ways to grow a reconstruction with known poses."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyview.functions.projection import DEPTH_MULTIVIEW
from manyview.operators import growing
from manyview.operators.errors import observed
from manyview.operators.matching import initial_pair, pair_scores, with_pixels
from manyview.operators.tracks import correspondences
from manyview.operators.triangulate import triangulate_checked, two_view_reasons
from manyview.session import cut


def visible(points: DataFrame, obs: DataFrame, cameras: DataFrame, most_error: float = 1.5, least: int = 3) -> DataFrame:
    """(img_id, n_visible): images in which at least `least` points lie before the camera and near their observation."""
    star = observed(points, obs, cameras, DEPTH_MULTIVIEW).where(F.col("err") < most_error)
    return star.groupBy("img_id").agg(F.count(F.lit(1)).alias("n_visible")).where(F.col("n_visible") >= least)


def small(spark: SparkSession, **columns: pa.Array) -> DataFrame:
    """A few rows as a table. What changes from round to round comes in this way and not as literals, so that the code that
    Spark generates for a round serves all rounds."""
    return spark.createDataFrame(pa.table(columns))


def images_table(spark: SparkSession, images: list[int]) -> DataFrame:
    return F.broadcast(small(spark, img_id=pa.array(images, pa.int32())))


def scores(obs: DataFrame, points: DataFrame, cameras: DataFrame, registered: list[int]) -> DataFrame:
    """(img_id, n, baseline, score) of the images not yet registered: correspondences and a tenth of the largest baseline."""
    there = images_table(cameras.sparkSession, registered)
    known = cameras.join(there, "img_id", "left_semi").select(*[F.col(f"c{k}_w").alias(f"k{k}") for k in "xyz"])
    gap = [F.col(f"c{k}_w") - F.col(f"k{k}") for k in "xyz"]
    open_ = cameras.join(there, "img_id", "left_anti")
    far = open_.crossJoin(known).groupBy("img_id").agg(F.max(F.sqrt(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2])).alias("baseline"))
    counted = far.join(correspondences(obs, points), "img_id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return counted.withColumn("score", F.round(F.col("n") + 0.1 * F.col("baseline"), 9)).select("img_id", "n", "baseline", "score")


def next_image(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.desc("score"), "img_id").limit(1)


def seeds(matches: DataFrame, kps: DataFrame, track_obs: DataFrame, cameras: DataFrame, i: int, j: int, most_error: float = 1.5, least_angle: float = 3.0) -> DataFrame:
    """(track_id, x, y, z) from the matches of the first pair whose two keypoints are in one track."""
    pair = matches.where((F.col("i") == i) & (F.col("j") == j))
    fine = two_view_reasons(with_pixels(pair, kps).select("i", "j", "a", "b", "xi", "yi", "xj", "yj"), cameras, most_error, least_angle).where("reason = 0")
    at_i = track_obs.select("track_id", F.col("img_id").alias("i"), F.col("kp_id").alias("a"))
    at_j = track_obs.select("track_id", F.col("img_id").alias("j"), F.col("kp_id").alias("b"))
    return fine.join(at_i, ["i", "a"]).join(at_j, ["j", "b", "track_id"]).select("track_id", "x", "y", "z")


def _score(n: int, baseline: float) -> Decimal:
    """The score of `scores`, as Spark rounds it."""
    return Decimal(repr(n + 0.1 * baseline)).quantize(Decimal("1e-9"), ROUND_HALF_UP)


@dataclass
class Reconstruction:
    """points: (track_id, x, y, z, step); order: the images as they were registered."""

    points: DataFrame
    order: list[int]
    counts: list[int] = field(default_factory=list)


def incremental(matches: DataFrame, kps: DataFrame, track_obs: DataFrame, cameras: DataFrame, most_error: float = 1.5, least_views: int = 3, most_images: int | None = None) -> Reconstruction:
    """Images one by one with known poses. A point is made in the first step in which it passes, from the views registered then,
    and stays as it is. The loop has as many rounds as images; each is a map over the tracks that are still open, without a
    shuffle, and counts of views by image, which tell the next image."""
    spark = matches.sparkSession
    first = initial_pair(pair_scores(matches)).first()
    if first is None:
        raise ValueError("no pair of images has enough matches")
    order = [first["i"], first["j"]]
    all_tracks = cut(growing.listed(track_obs.join(kps.select("img_id", "kp_id", F.col("x").alias("u"), F.col("y").alias("v")), ["img_id", "kp_id"]).select("track_id", "img_id", "u", "v")))
    made = cut(seeds(matches, kps, track_obs, cameras, *order, most_error).withColumn("step", F.lit(0)))
    rig, showing = growing.rig_of(cameras), growing.views_by_image(all_tracks)
    counts = [made.count()]
    found = growing.views_by_image(all_tracks.join(made.select("track_id"), "track_id", "left_semi"))
    open_ = cut(all_tracks.join(made.select("track_id"), "track_id", "left_anti"))
    images = len(rig.images) if most_images is None else most_images
    baseline = np.full(len(rig.images), -np.inf)
    for img in order:
        baseline = np.maximum(baseline, rig.distances(img))
    while len(order) < images:
        left = [k for k, img in enumerate(rig.images.tolist()) if img not in set(order)]
        if not left:
            break
        chosen = int(rig.images[min(left, key=lambda k: (-_score(found.get(int(rig.images[k]), 0), float(baseline[k])), rig.images[k]))])
        order.append(chosen)
        baseline = np.maximum(baseline, rig.distances(chosen))
        if chosen not in showing:
            counts.append(0)
            continue
        known = rig.known(order)

        def passing(views: growing.Views, known: np.ndarray = known) -> np.ndarray:
            x = growing.checked(views.only(known[views.camera]), rig, most_error, least_views)
            return np.where(growing.valid(x, views, rig, most_error, least_views)[:, None], x, np.nan)

        new, open_, n, seen = growing.tried(open_, rig, chosen, passing)
        counts.append(n)
        found = {img: found.get(img, 0) + seen.get(img, 0) for img in {*found, *seen}}
        made = made.unionByName(new.select("track_id", "x", "y", "z", F.lit(len(order) - 2).alias("step")))
    return Reconstruction(made, order, counts)


def fixpoint(obs: DataFrame, cameras: DataFrame, first: tuple[int, int], most_error: float = 1.5, least_views: int = 2, least_visible: int = 3) -> Reconstruction:
    """Rounds that don't depend on an order: triangulate all open tracks by the registered images, then register every image
    that sees enough of the points; until no image comes in, which is after as many rounds as there are images at most."""
    order, made, counts = list(first), None, []
    for step in itertools.count():
        known = obs.join(images_table(obs.sparkSession, order), "img_id", "left_semi")
        open_ = known if made is None else known.join(made, "track_id", "left_anti")
        new = triangulate_checked(open_, cameras, most_error, least_views, 1.0).withColumn("step", F.lit(step))
        made = cut(new if made is None else made.unionByName(new))
        counts.append(made.count())
        found = visible(made, obs, cameras, most_error, least_visible).select("img_id").collect()  # a row for each image
        fresh = sorted({r["img_id"] for r in found} - set(order))
        if not fresh:
            break
        order += fresh
    return Reconstruction(made, order, counts)
