"""Triangulation without a UDF, and the tests a new point has to pass.

The homogeneous least-squares point is the null vector of A'A, ten sums over a track's views. It comes from inverse
iteration with the adjugate of that 4x4 matrix, which is plain arithmetic and stays in generated code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from manyview.functions.linalg import UPPER, adjugate4, dot, finite, norm, once
from manyview.functions.projection import DEPTH_MULTIVIEW, DEPTH_PROJECT, angle, centre, distance, in_camera, pixel, projection_matrix
from manyview.operators.errors import observed, point_summary
from manyview.session import cut

STEPS = 4
#: Reasons of `two_view_reasons`, in the order of the tests; fixed values.
REASONS = ["ok", "not_finite", "too_far", "behind_i", "behind_j", "too_deep", "error_i", "error_j", "angle"]


def design_rows(u: Column, v: Column, camera: str = "") -> list[list[Column]]:
    """The two rows u P3 - P1 and v P3 - P2 of one view."""
    p = projection_matrix(camera)
    return [[u * c - a for a, c in zip(p[0], p[2])], [v * c - b for b, c in zip(p[1], p[2])]]


def normal_entries(rows: list[list[Column]]) -> dict[str, Column]:
    """The ten different entries of the sum of a'a over rows a."""
    return {f"m{i}{j}": reduce(lambda x, y: x + y, [row[i] * row[j] for row in rows]) for i, j in UPPER}


def null_vector(df: DataFrame, keep: list[str]) -> DataFrame:
    """keep and (n0..n3), a multiple of the null vector of the matrix in m00..m23."""
    trace = F.col("m00") + F.col("m11") + F.col("m22") + F.col("m33")
    scaled = once(df, keep, {f"m{i}{j}": F.col(f"m{i}{j}") / trace for i, j in UPPER})
    adjugate = adjugate4([[F.col(f"m{min(i, j)}{max(i, j)}") for j in range(4)] for i in range(4)])
    entries = [f"a{i}{j}" for i in range(4) for j in range(4)]
    now = once(scaled, keep, {f"a{i}{j}": adjugate[i][j] for i in range(4) for j in range(4)} | {f"n{k}": F.lit(float(k == 3)) for k in range(4)})
    for _ in range(STEPS):
        now = once(now, [*keep, *entries], {f"w{i}": dot([F.col(f"a{i}{k}") for k in range(4)], [F.col(f"n{k}") for k in range(4)]) for i in range(4)})
        size = norm([F.col(f"w{k}") for k in range(4)])
        now = once(now, [*keep, *entries], {f"n{k}": F.try_divide(F.col(f"w{k}"), size) for k in range(4)})
    return now.select(*keep, *[f"n{k}" for k in range(4)])


def euclidean(df: DataFrame, keep: list[str], least_w: float = 1e-12) -> DataFrame:
    """keep and (x, y, z); rows whose point is at infinity go."""
    w = F.col("n3")
    return df.where(F.abs(w) > least_w).select(*keep, *[(F.col(f"n{k}") / w).alias(c) for k, c in enumerate("xyz")])


def triangulate(obs: DataFrame, cameras: DataFrame, least_views: int = 2) -> DataFrame:
    """(track_id, n_views, x, y, z) of the tracks with least_views views, from (track_id, img_id, u, v); no further test."""
    rows = design_rows(F.col("u"), F.col("v"))
    entries = obs.join(cameras, "img_id").select("track_id", *[e.alias(n) for n, e in normal_entries(rows).items()])
    sums = entries.groupBy("track_id").agg(F.count(F.lit(1)).alias("n_views"), *[F.sum(f"m{i}{j}").alias(f"m{i}{j}") for i, j in UPPER])
    return euclidean(null_vector(sums.where(F.col("n_views") >= least_views), ["track_id", "n_views"]), ["track_id", "n_views"])


def triangulate_checked(obs: DataFrame, cameras: DataFrame, most_error: float = 1.5, least_views: int = 2, slack: float = 2.0) -> DataFrame:
    """(track_id, x, y, z): only points before all their cameras with a median error of up to slack x most_error."""
    made = cut(triangulate(obs, cameras, least_views))
    star = observed(made, obs, cameras, DEPTH_MULTIVIEW)
    per = star.groupBy("track_id").agg(F.min("depth").alias("least"), F.median("err").alias("median"))
    good = per.where((F.col("least") > DEPTH_MULTIVIEW) & (F.col("median") <= slack * most_error)).select("track_id")
    return made.join(good, "track_id", "left_semi").select("track_id", "x", "y", "z")


def with_cameras(pairs: DataFrame, cameras: DataFrame) -> DataFrame:
    """pairs (i, j, ...) with the columns of both cameras as i_* and j_*."""
    for side in "ij":
        pairs = pairs.join(cameras.select(F.col("img_id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in cameras.columns if c != "img_id"]), side)
    return pairs


def triangulate_pairs(pairs: DataFrame) -> DataFrame:
    """pairs (xi, yi, xj, yj, i_*, j_*, ...) with x, y, z of the two-view point."""
    rows = design_rows(F.col("xi"), F.col("yi"), "i_") + design_rows(F.col("xj"), F.col("yj"), "j_")
    return euclidean(null_vector(once(pairs, pairs.columns, normal_entries(rows)), pairs.columns), pairs.columns)


def near_both(pairs: DataFrame, cameras: DataFrame, most_error: float = 3.0) -> DataFrame:
    """The pairs (i, j, xi, yi, xj, yj, ...) whose two-view point lies within most_error of both pixels, on either side of the
    cameras."""
    keep = list(pairs.columns)
    put = triangulate_pairs(with_cameras(pairs, cameras))
    point, far = (F.col("x"), F.col("y"), F.col("z")), {}
    for side in "ij":
        x, y, z = in_camera(point, f"{side}_")
        u, v = (F.try_divide(a, z) * F.col(f"{side}_f{n}") + F.col(f"{side}_c{n}") for a, n in ((x, "x"), (y, "y")))
        far[f"e{side}"] = distance(u, v, F.col(f"x{side}"), F.col(f"y{side}"))
    return once(put, keep, far).where((F.col("ei") <= most_error) & (F.col("ej") <= most_error)).select(*keep)


def two_view_reasons(pairs: DataFrame, cameras: DataFrame, most_error: float = 1.5, least_angle: float = 3.0, most_depth: float = 1e6, most_abs: float = 1e6) -> DataFrame:
    """The first test that each two-view point fails: pairs with x, y, z, angle, reason (0 is none; names in REASONS)."""
    return reasons(with_cameras(pairs, cameras), list(pairs.columns), most_error, least_angle, most_depth, most_abs)


def reasons(pairs: DataFrame, keep: list[str], most_error: float = 1.5, least_angle: float = 3.0, most_depth: float = 1e6, most_abs: float = 1e6) -> DataFrame:
    """As two_view_reasons, for pairs that have the columns of their own two cameras."""
    put = triangulate_pairs(pairs)
    point = (F.col("x"), F.col("y"), F.col("z"))
    ui, vi, zi = pixel(point, "i_")
    uj, vj, zj = pixel(point, "j_")
    measured = {"zi": zi, "zj": zj, "ei": distance(ui, vi, F.col("xi"), F.col("yi")), "ej": distance(uj, vj, F.col("xj"), F.col("yj")), "angle": angle(point, centre("i_"), centre("j_"))}
    put = once(put, [*keep, "x", "y", "z"], measured)
    far = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    tests = [~finite(*point), far > most_abs, F.col("zi") <= DEPTH_PROJECT, F.col("zj") <= DEPTH_PROJECT, F.greatest("zi", "zj") >= most_depth, F.col("ei") > most_error, F.col("ej") > most_error, F.col("angle") < least_angle]
    reason = reduce(lambda case, t: case.when(t[1], t[0]), list(enumerate(tests, 1))[1:], F.when(tests[0], 1)).otherwise(0)
    return put.withColumn("reason", reason)


def validate(points: DataFrame, obs: DataFrame, cameras: DataFrame, most_error: float = 1.5, least_views: int = 3, good_ratio: float = 0.6, adaptive: bool = True, mad_k: float = 3.5, cap: float = 4.0, depth_cov: float = 1.0) -> DataFrame:
    """(track_id, n_views, threshold, n_good, valid) over all views that a point lies before."""
    star = observed(points, obs, cameras, DEPTH_MULTIVIEW).where((F.col("depth") > DEPTH_MULTIVIEW) & F.col("err").isNotNull())
    star = cut(star.select("track_id", "depth", "err"))  # read three times
    middle = star.groupBy("track_id").agg(F.count(F.lit(1)).alias("n_views"), F.median("err").alias("median"))
    with_middle = star.join(middle, "track_id")
    mad = with_middle.groupBy("track_id").agg(F.median(F.abs(F.col("err") - F.col("median"))).alias("mad"))
    loose = F.col("median") + mad_k * 1.4826 * F.col("mad")
    follows = F.greatest(F.lit(0.75 * most_error), F.least(loose, F.lit(cap * most_error)))
    limit = middle.join(mad, "track_id").withColumn("threshold", F.when(F.lit(adaptive) & (F.col("n_views") >= 3), follows).otherwise(F.lit(most_error)))
    good = F.col("err") <= F.col("threshold")
    depth = F.when(good, F.col("depth"))
    judged = star.join(limit.select("track_id", "n_views", "threshold"), "track_id").groupBy("track_id", "n_views", "threshold").agg(F.count_if(good).alias("n_good"), (F.stddev_pop(depth) / F.avg(depth)).alias("cov"))
    needed = F.greatest(F.ceil(good_ratio * F.col("n_views")), F.lit(least_views).cast("long"))
    valid = (F.col("n_views") >= least_views) & (F.col("n_good") >= needed) & ((F.col("n_good") < 3) | (F.col("cov") <= depth_cov))
    return judged.select("track_id", "n_views", "threshold", "n_good", valid.alias("valid"))


def angles(points: DataFrame, obs: DataFrame, cameras: DataFrame) -> DataFrame:
    """(track_id, img_a, img_b, angle) between the rays of each two views of a point; a track has few views."""
    seen = obs.select("track_id", "img_id").join(cameras.select("img_id", "cx_w", "cy_w", "cz_w"), "img_id")
    a = seen.select("track_id", F.col("img_id").alias("img_a"), *[F.col(f"c{k}_w").alias(f"a{k}") for k in "xyz"])
    b = seen.select("track_id", F.col("img_id").alias("img_b"), *[F.col(f"c{k}_w").alias(f"b{k}") for k in "xyz"])
    both = a.join(b, "track_id").where("img_a < img_b").join(points.select("track_id", "x", "y", "z"), "track_id")
    between = angle(tuple(F.col(k) for k in "xyz"), tuple(F.col(f"a{k}") for k in "xyz"), tuple(F.col(f"b{k}") for k in "xyz"))
    return both.select("track_id", "img_a", "img_b", between.alias("angle"))


def point_meta(points: DataFrame, obs: DataFrame, cameras: DataFrame) -> DataFrame:
    """(track_id, views, track_len, max_angle, median_angle, median_err) of each point."""
    wide = angles(points, obs, cameras).groupBy("track_id").agg(F.max("angle").alias("max_angle"), F.median("angle").alias("median_angle"))
    star = observed(points, obs, cameras)
    lists = star.groupBy("track_id").agg(F.sort_array(F.collect_list("img_id")).alias("views"), F.count(F.lit(1)).alias("track_len"))
    joined = points.select("track_id").join(lists, "track_id", "left").join(wide, "track_id", "left").join(point_summary(star).select("track_id", "median_err"), "track_id", "left")
    none = F.array().cast("array<int>")
    return joined.select("track_id", F.coalesce("views", none).alias("views"), F.coalesce("track_len", F.lit(0).cast("long")).alias("track_len"), F.coalesce("max_angle", F.lit(0.0)).alias("max_angle"), F.coalesce("median_angle", F.lit(0.0)).alias("median_angle"), "median_err")


def best_baseline(obs: DataFrame, cameras: DataFrame, new_image: int, registered: list[int]) -> DataFrame:
    """(track_id, partner, baseline): of each track in the new image, the registered view farthest from it, first of equals."""
    centres = cameras.select("img_id", "cx_w", "cy_w", "cz_w")
    mine = obs.where(F.col("img_id") == new_image).select("track_id").join(centres.where(F.col("img_id") == new_image).select(*[F.col(f"c{k}_w").alias(f"n{k}") for k in "xyz"]))
    other = obs.where(F.col("img_id").isin(registered) & (F.col("img_id") != new_image)).select("track_id", "img_id").join(centres, "img_id")
    gap = [F.col(f"c{k}_w") - F.col(f"n{k}") for k in "xyz"]
    far = F.round(F.sqrt(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]), 9)
    both = other.join(mine, "track_id").select("track_id", "img_id", far.alias("baseline"))
    nth = F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("baseline"), "img_id"))
    return both.withColumn("nth", nth).where("nth = 1").select("track_id", F.col("img_id").alias("partner"), "baseline")
