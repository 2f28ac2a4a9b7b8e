"""A whole reconstruction with known cameras: matches to tracks to points to a clean cloud, each step a DataFrame."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyview.operators import cleanup, errors, growing, matching, register, tracks, triangulate, twoview
from manyview.operators.graph import sorted_components
from manyview.operators.growth import Growth, New
from manyview.plans.config import PRESETS, Config
from manyview.session import cut


def match_rig(desc: DataFrame, kps: DataFrame, cameras: DataFrame, config: Config | None = None, least: int = 4) -> DataFrame:
    """(i, j, a, b) for all pairs of images with known cameras: descriptors matched once, pairs with `least` raw matches, those of them
    near their epipolar lines, and again pairs with `least`."""
    m = (config or PRESETS["multicam"]).matching
    raw = matching.match_descriptors(desc, matching.image_pairs(desc.select("img_id").distinct()), m.ratio or 0.8, m.mutual)
    raw = cut(matching.enough(raw.select("i", "j", "a", "b"), least))
    fine = matching.epipolar_filter(raw, kps, cameras, m.most_epipolar).select("i", "j", "a", "b")
    return matching.enough(cut(fine), least)


def match_window(desc: DataFrame, kps: DataFrame, k: tuple[float, float, float, float], config: Config | None = None) -> DataFrame:
    """(i, j, a, b) for the pairs of a window over images of one camera: inliers of each pair's essential matrix."""
    images = desc.select("img_id").distinct()
    m = (config or PRESETS["singlecam"]).adapted(images.count(), int(2 * k[2]), int(2 * k[3])).matching
    raw = matching.match_descriptors(desc, matching.window_pairs(images, m.pair_window), m.ratio, m.mutual)
    pixels = matching.with_pixels(raw.select("i", "j", "a", "b"), kps).select("i", "j", "a", "b", "xi", "yi", "xj", "yj")
    return twoview.verify_pairs(pixels, k, m.ransac_px, m.least_inliers)


def known_cameras(cameras: DataFrame, kps: DataFrame, matches: DataFrame, config: Config | None = None, images: int | None = None) -> dict[str, DataFrame]:
    """{"track_obs", "points" (pid, track_id, x, y, z), "judged", "meta", "order"} from keypoints and raw matches."""
    config = config or PRESETS["multicam"]
    fine = cut(matching.epipolar_filter(matches, kps, cameras, config.matching.most_epipolar).select("i", "j", "a", "b"))
    fine = matching.enough(fine, 4)
    track_obs = cut(tracks.build(cut(tracks.labelled(fine))))
    made = register.incremental(fine, kps, track_obs, cameras, config.triangulation.most_error, config.triangulation.least_views, images)
    pixels = track_obs.join(kps.select("img_id", "kp_id", F.col("x").alias("u"), F.col("y").alias("v")), ["img_id", "kp_id"])
    judged = cut(cleanup.strict(made.points, pixels, cameras, config.cleanup.any_view, config.cleanup.median, config.cleanup.good_views))
    stay = cleanup.spatial(judged.where("reason is null").select("track_id", "x", "y", "z"), config.cleanup.percentile, config.cleanup.multiplier).where("keep")
    points = cut(cleanup.kept(stay))
    spark = cameras.sparkSession
    order = spark.createDataFrame([(img, k) for k, img in enumerate(made.order)], "img_id int, ordinal int")
    star = errors.observed(points, pixels, cameras)
    return {"track_obs": track_obs, "points": points, "judged": judged, "meta": triangulate.point_meta(points, pixels, cameras), "errors": errors.point_summary(star), "order": order}


def _camera(k: tuple[float, ...], r: list[float] | np.ndarray, t: list[float] | np.ndarray) -> tuple[float, ...]:
    turned = np.array(r).reshape(3, 3)
    return tuple(map(float, (*k, *turned.ravel(), *t, *(-turned.T @ np.array(t)))))


def single_camera(kps: DataFrame, matches: DataFrame, k: tuple[float, float, float, float], config: Config | None = None, images: int | None = None) -> dict[str, DataFrame]:
    """{"track_obs", "points" (track_id, x, y, z), "cameras"} from pixels of one camera, up to scale and place.

    The first pair is the one with the most two-view points that pass all tests. Each next image is the one that sees the most
    points; its pose comes from them, and tracks that it shows get points with the view farthest away. The loop ends
    with the first image that can't be placed. Every few images the last ones are adjusted, at the end all of them, as the
    configuration says, with all points that two of them show, unless it names a cap; known poses, as in known_cameras, are never
    adjusted. Then the adaptive cleanup judges the points.
    """
    spark = kps.sparkSession
    config = (config or PRESETS["singlecam"]).adapted(kps.select("img_id").distinct().count(), int(2 * k[2]), int(2 * k[3]))
    t = config.triangulation
    unit = _camera(k, [1.0, 0, 0, 0, 1, 0, 0, 0, 1], [0.0, 0, 0])

    def score(i: int, j: int, r: np.ndarray, way: np.ndarray, at_i: np.ndarray, at_j: np.ndarray) -> int:
        """How many of a pair's matches give a point that passes all tests."""
        rig, n = growing.Rig({i: unit, j: _camera(k, r, way)}), len(at_i)
        pixels, number = np.concatenate([at_i, at_j]), np.arange(n)
        views = growing.Views(n, np.concatenate([number, number]), np.repeat([rig.at(i), rig.at(j)], n), *pixels.T)
        return int((~np.isnan(growing.of_two_views(views, rig, j, rig.known([i]), t.most_error, t.least_angle)[:, 0])).sum())

    pixels = matching.with_pixels(matches, kps).select("i", "j", "a", "b", "xi", "yi", "xj", "yj")
    posed = cut(twoview.posed_pairs(pixels, k, config.matching.ransac_px, config.matching.least_inliers, score))
    fine = posed.where("a is not null").select("i", "j", "a", "b")
    poses = [(r["i"], r["j"], np.frombuffer(r["pose"])) for r in posed.where("a is null").select("i", "j", "pose").collect()]  # a row for each pair of images
    first = max(poses, key=lambda p: (p[2][12], -p[0], -p[1]), default=None)
    if first is None or first[2][12] < 30:
        raise ValueError("no pair of images gives enough points")
    known = {first[0]: unit, first[1]: _camera(k, first[2][:9], first[2][9:12])}
    track_obs = cut(tracks.build(cut(tracks.labelled(fine, sorted_components))))
    spots = track_obs.join(kps.select("img_id", "kp_id", F.col("x").alias("u"), F.col("y").alias("v")), ["img_id", "kp_id"])
    growth = Growth(spots.select("track_id", "img_id", "u", "v"))
    growth.then(New(growing.Rig(known), first[1], t.most_error, t.least_angle))
    a = config.adjustment
    everyone = kps.select("img_id").distinct().count() if images is None else images
    while len(known) < everyone:
        n_made, found = growth.counts()
        most, image = max(((n, -img) for img, n in found.items() if img not in known), default=(0, 0))
        image = -image
        if most < max(4, n_made // 100):
            break
        placed = twoview.pnp(growth.shown(image), k, config.matching.ransac_px).first()
        if placed is None:
            break
        known[image] = _camera(k, placed["r"], placed["t"])
        least_views, least_angle = 2 if len(known) < 5 else 3, max(1.0, 3.0 - 0.3 * len(known))
        growth.then(New(growing.Rig(known), image, t.most_error, least_angle, least_views))
        if a.has("local") and len(known) >= 3 and len(known) % a.local_every == 0:
            known = growth.adjust(known, list(known)[-a.local_window :], a.local_cap, 50, 200, a.scale, a.loss)
    if a.has("global_end") and len(known) >= 3:
        known = growth.adjust(known, list(known), a.global_cap, a.global_points, a.global_obs, a.scale, a.loss)
    growth.write()
    made = growth.points()
    judged = cut(cleanup.adaptive_of(made, growth.errors(growing.Rig(known))))
    points = judged.where("keep").select("track_id", "x", "y", "z")
    schema = "img_id int, " + ", ".join(f"{n} double" for n in growing.NAMES)
    return {"track_obs": track_obs, "points": points, "judged": judged, "cameras": spark.createDataFrame([(img, *c) for img, c in sorted(known.items())], schema)}  # a row for each image


def run(matches: DataFrame, kps: DataFrame, cameras: DataFrame | None = None, k: tuple[float, float, float, float] | None = None, config: Config | None = None) -> dict[str, DataFrame]:
    """A reconstruction by what is known: the cameras' poses, else the intrinsics of the one camera."""
    if cameras is not None:
        return known_cameras(cameras, kps, matches, config)
    if k is None:
        raise ValueError("either cameras or the intrinsics of one camera have to be given")
    return single_camera(kps, matches, k, config)
