"""More of the query catalogue: camera files, masks, what overlays draw, and how near reconstructions come to the scene."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from manyview.functions import text
from manyview.functions.projection import angle_plain, projection_matrix, quaternion, rotation_of
from manyview.operators import adjust, binary, descindex, diagnostics, errors, matching, register, tracks, triangulate, twoview
from manyview.plans import queries, reconstruct, scene
from manyview.plans.config import PRESETS
from manyview.plans.queries import ALL, FUND, KNN, RUNS, K, R, Scene, query, rounded
from manyview.plans.scene import HEIGHT, SQL, WIDTH
from manyview.session import cut, scratch
from manyview.sources import calibration
from manyview.streaming.tracks import TrackState, keep_tracks

QUERIES, ORACLES = queries.QUERIES, queries.ORACLES

# --- camera files -------------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey, CAST(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey % 5 ELSE 3 END AS INTEGER) AS n, round(CASE WHEN n_nationkey % 2 = 0 THEN (n_nationkey % 5) * (n_nationkey % 5 + 1) / 2.0 ELSE n_nationkey + 0.75 END, 6) + 0.0 AS total FROM nation WHERE n_nationkey % 2 = 1 OR n_nationkey % 5 > 0")
def distortion_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows the ninth number of a text, or stands at `dist` in JSON."""
    n = F.col("n_nationkey")
    more = F.when(n % 5 == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), (n % 5).cast("int")))
    plain = F.array_join(F.concat(F.split(F.lit("700 0 512 0 700 384 0 0 1"), " "), more.cast("array<string>")), " ")
    nested = F.concat(F.lit('{"camera": {"K": [[7,0,5],[0,7,3],[0,0,1]], "dist": [0.5, '), n.cast("string"), F.lit(", 0.25]}}"))
    made = scene.read(spark, sf_dir, "nation").select("n_nationkey", text.distortion(F.when(n % 2 == 0, plain).otherwise(nested)).alias("d")).where("d is not null")
    return rounded(made.select("n_nationkey", F.size("d").alias("n"), F.aggregate("d", F.lit(0.0), lambda a, x: a + x).alias("total")))


@query(f"{SQL} SELECT img_id, {R('fx * 0.5', 'fx')}, {R('fy * 0.25', 'fy')}, {R('cx * 0.5', 'cx')}, {R('cy * 0.25', 'cy')} FROM cameras")
def scaled_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibration.scaled(Scene(spark, sf_dir).cameras, (WIDTH, HEIGHT), (WIDTH // 2, HEIGHT // 4)).select("img_id", "fx", "fy", "cx", "cy"))


_PARTS = ["fx", "fy", "cx", "cy", "r00", "r01", "r02", "r10", "r11", "r12", "r20", "r21", "r22", "tx", "ty", "tz", "cx_w", "cy_w", "cz_w"]


@query(f"{SQL} SELECT img_id, 0.0::DOUBLE AS skew, {', '.join(R(c, c) for c in _PARTS)} FROM cameras")
def decomposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projection matrices taken apart again, scaled by minus two before."""
    p = F.array(*[x * -2.0 for row in projection_matrix() for x in row])
    made = calibration.decompose(Scene(spark, sf_dir).cameras.select(F.col("img_id").cast("string").alias("stem"), p.alias("p")))
    return rounded(made.select(F.col("stem").cast("int").alias("img_id"), "skew", *_PARTS))


@query(f"{SQL} SELECT img_id, {', '.join(R(c, c) for c in _PARTS[4:13])} FROM cameras")
def quaternion_rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotations to quaternions of another length and back."""
    q = Scene(spark, sf_dir).cameras.select("img_id", *[(3.0 * x).alias(f"q{k}") for k, x in enumerate(quaternion())])
    r = rotation_of([F.col(f"q{k}") for k in range(4)])
    return rounded(q.select("img_id", *[r[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)]))


@query("SELECT 'img_' || (n_nationkey % 7) AS stem, max('/d' || (n_nationkey % 3) || '/img_' || (n_nationkey % 7) || '.p' || n_nationkey) AS path FROM nation GROUP BY 1")
def stem_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    s = lambda e: e.cast("string")
    path = F.concat(F.lit("/d"), s(n % 3), F.lit("/img_"), s(n % 7), F.lit(".p"), s(n))
    return calibration.stem_index(scene.read(spark, sf_dir, "nation").select(path.alias("path")))


# --- masks and overlays -------------------------------------------------------------------------------------------------


@query(f"{SQL}, {RUNS} SELECT img_id, {R('sum(u1 - u0 + 1) / (1024.0 * 768)', 'ratio')} FROM runs GROUP BY 1")
def mask_foreground(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.foreground(Scene(spark, sf_dir).runs, WIDTH, HEIGHT))


@query(
    f"""{SQL}, {RUNS}, px AS (SELECT img_id, CAST(y AS INTEGER) AS v, CAST(x AS INTEGER) AS u FROM cameras, range(576) a(y), range(512) b(x)),
    hit AS (SELECT px.img_id, px.v, px.u FROM px JOIN runs r ON r.img_id = px.img_id AND r.v = CAST(floor(px.v * 768 / 576) AS INTEGER) AND CAST(floor(px.u * 1024 / 512) AS INTEGER) BETWEEN r.u0 AND r.u1)
    SELECT img_id, v, min(u) AS u0, max(u) AS u1 FROM hit GROUP BY ALL"""
)
def resized_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.resized_runs(Scene(spark, sf_dir).runs, (WIDTH, HEIGHT), (512, 576))


_MIXED = "((({0} % 2147483648) * 2654435761) % 4294967296)"


@query(f"{SQL}, {ALL} SELECT img_id, track_id, {R('u', 'u')}, {R('v', 'v')}, seen FROM ins WHERE inside QUALIFY row_number() OVER (PARTITION BY img_id ORDER BY NOT seen, {_MIXED.format('track_id')}, track_id) <= 700")
def overlay_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 700 points to draw on each image; the limit is the feature."""
    s = Scene(spark, sf_dir)
    return rounded(diagnostics.draw_list(s.points, s.cameras, s.obs, WIDTH, HEIGHT, 700))


@query(f"{SQL} SELECT img_id, kp_id, {R('u', 'x')}, {R('v', 'y')} FROM kps QUALIFY row_number() OVER (PARTITION BY img_id ORDER BY {_MIXED.format('kp_id::BIGINT')}, kp_id) <= 300")
def overlay_keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 300 keypoints to draw on each image; the limit is the feature."""
    return rounded(diagnostics.drawn_keypoints(Scene(spark, sf_dir).kps, 300))


@query(
    f"""{SQL} SELECT i, j, m.a, m.b, {R('p.u', 'xi')}, {R('p.v', 'yi')}, {R('q.u', 'xj')}, {R('q.v', 'yj')}
    FROM matches m JOIN kps p ON p.img_id = i AND p.kp_id = m.a JOIN kps q ON q.img_id = j AND q.kp_id = m.b
    QUALIFY row_number() OVER (PARTITION BY i, j ORDER BY {_MIXED.format('m.a::BIGINT')}, m.a, m.b) <= 40"""
)
def overlay_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 40 matches to draw for each pair; the limit is the feature."""
    return rounded(diagnostics.drawn_matches(Scene(spark, sf_dir).pixels, 40))


@query(f"{SQL} SELECT img_id, track_id, {R('u', 'u')}, {R('v', 'v')}, {R('pu', 'pu')}, {R('pv', 'pv')}, {R('sqrt((pu-u)*(pu-u) + (pv-v)*(pv-v))', 'err')} FROM obs WHERE sqrt((pu-u)*(pu-u) + (pv-v)*(pv-v)) >= 1.2")
def overlay_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.residuals(Scene(spark, sf_dir).star, 1.2))


@query(
    f"""{SQL}, cell AS (SELECT img_id, CAST(round_even(u, 0) AS INTEGER) AS cx, CAST(round_even(v, 0) AS INTEGER) AS cy, count(*) AS n FROM kps WHERE round_even(u, 0) BETWEEN 0 AND 1023 AND round_even(v, 0) BETWEEN 0 AND 767 GROUP BY ALL),
    spread AS (SELECT img_id, CAST(cx + dx AS INTEGER) AS cx, CAST(cy + dy AS INTEGER) AS cy, sum(n * exp(-(dx*dx + dy*dy) / 2.0::DOUBLE)) AS raw FROM cell, range(-3, 4) a(dx), range(-3, 4) b(dy) GROUP BY ALL),
    tops AS (SELECT img_id, quantile_cont(raw, 0.995) AS top FROM spread GROUP BY 1)
    SELECT img_id, cx, cy, {R('least(raw / top, 1)', 'heat')} FROM spread JOIN tops USING (img_id)"""
)
def keypoint_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.heat_map(diagnostics.heat_cells(Scene(spark, sf_dir).kps, WIDTH, HEIGHT), 1.0))


@query(f"{SQL}, mv AS (SELECT DISTINCT track_id FROM obs WHERE img_id = 3) SELECT track_id, {R('x + CASE WHEN mv.track_id IS NULL THEN 0 ELSE 0.5 END', 'x')}, {R('y', 'y')}, {R('z', 'z')} FROM points LEFT JOIN mv USING (track_id)")
def updated_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points seen in one image moved, as after a local adjustment, the others as they were."""
    s = Scene(spark, sf_dir)
    some = s.points.join(s.obs.where("img_id = 3").select("track_id"), "track_id", "left_semi").withColumn("x", F.col("x") + 0.5)
    return rounded(adjust.updated(s.points, some))


@query(
    f"""{SQL}, pa AS (SELECT track_id, img_id, x, y, z, cx_w, cy_w, cz_w FROM obs JOIN cameras USING (img_id)),
    two AS (SELECT p.track_id, p.img_id AS i, q.img_id AS j, p.x, p.y, p.z, p.cx_w AS ix, p.cy_w AS iy, p.cz_w AS iz, q.cx_w AS jx, q.cy_w AS jy, q.cz_w AS jz
      FROM pa p JOIN pa q ON p.track_id = q.track_id AND p.img_id + 1 = q.img_id)
    SELECT track_id, i, j, round(CASE WHEN i = 4 THEN 0 ELSE degrees(acos(((x-ix)*(x-jx)+(y-iy)*(y-jy)+(z-iz)*(z-jz))
      / (sqrt((x-ix)*(x-ix)+(y-iy)*(y-iy)+(z-iz)*(z-iz)) * sqrt((x-jx)*(x-jx)+(y-jy)*(y-jy)+(z-jz)*(z-jz))))) END, 6) + 0.0 AS angle FROM two"""
)
def angles_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles of neighbouring views; for image 4, of a point that lies on its centre."""
    s = Scene(spark, sf_dir)
    seen = s.obs.select("track_id", "img_id").join(s.points, "track_id").join(s.cameras.select("img_id", "cx_w", "cy_w", "cz_w"), "img_id")
    one = seen.select("track_id", F.col("img_id").alias("i"), "x", "y", "z", *[F.col(f"c{c}_w").alias(f"i{c}") for c in "xyz"])
    other = seen.select("track_id", F.col("img_id").alias("j"), *[F.col(f"c{c}_w").alias(f"j{c}") for c in "xyz"])
    both = one.join(other, "track_id").where("i + 1 = j")
    point = tuple(F.when(F.col("i") == 4, F.col(f"i{c}")).otherwise(F.col(c)) for c in "xyz")
    made = angle_plain(point, tuple(F.col(f"i{c}") for c in "xyz"), tuple(F.col(f"j{c}") for c in "xyz"))
    return rounded(both.select("track_id", "i", "j", made.alias("angle")))


@query(
    f"""{SQL}, {KNN.strip()[5:]}, {FUND}, raw AS (SELECT f.i, f.j, f.a, f.b FROM uniq f JOIN uniq r ON f.i = r.j AND f.j = r.i AND f.a = r.b AND f.b = r.a WHERE f.i < f.j),
    gate AS (SELECT * FROM raw QUALIFY count(*) OVER (PARTITION BY i, j) >= 4),
    pix AS (SELECT *, (a * 7919 % 1024)::DOUBLE AS xi, (a * 10473 % 768)::DOUBLE AS yi, (b * 7919 % 1024)::DOUBLE AS xj, (b * 10473 % 768)::DOUBLE AS yj FROM gate),
    lns AS (SELECT pix.*, f00*xi+f01*yi+f02 AS a0, f10*xi+f11*yi+f12 AS a1, f20*xi+f21*yi+f22 AS a2, f00*xj+f10*yj+f20 AS b0, f01*xj+f11*yj+f21 AS b1, f02*xj+f12*yj+f22 AS b2 FROM pix JOIN fm USING (i, j)),
    fine AS (SELECT i, j, a, b FROM lns WHERE (abs(a0*xj+a1*yj+a2)/(sqrt(a0*a0+a1*a1)+1e-12) + abs(b0*xi+b1*yi+b2)/(sqrt(b0*b0+b1*b1)+1e-12)) / 2 < 250)
    SELECT * FROM fine QUALIFY count(*) OVER (PARTITION BY i, j) >= 4"""
)
def rig_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptors to matches for a rig, with keypoints at places that their ids give and a wide epipolar band."""
    s = Scene(spark, sf_dir)
    at = [(F.col("kp_id") * k % n).cast("double").alias(c) for k, n, c in ((7919, WIDTH, "x"), (10473, HEIGHT, "y"))]
    config = PRESETS["multicam"].with_values(ratio=0.95, most_epipolar=250.0)
    return reconstruct.match_rig(s.desc, s.desc.select("img_id", "kp_id", *at), s.cameras, config)


# --- reconstructions against the scene ----------------------------------------------------------------------------------


def _near(made: DataFrame, s: Scene, reach: float) -> DataFrame:
    """(track_id, views, near) of every track that has four views or more and none that is off by nine pixels: whether it has a
    point within `reach` of the scene's. Such tracks have to have one."""
    true = s.points.select("track_id", *[F.col(c).alias(f"true_{c}") for c in "xyz"])
    wanted = s.obs.groupBy("track_id").agg(F.count(F.lit(1)).alias("views"), F.min(F.col("h") % 53).alias("least")).where("views >= 4 and least > 0").drop("least")
    gap = [F.col(c) - F.col(f"true_{c}") for c in "xyz"]
    far = F.sqrt(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2])
    return wanted.join(true, "track_id").join(made.select("track_id", "x", "y", "z"), "track_id", "left").select("track_id", "views", F.coalesce(far <= reach, F.lit(False)).alias("near"))


TRUE = f"{SQL} SELECT track_id, count(*) AS views, true AS near FROM obs GROUP BY 1 HAVING count(*) >= 4 AND min(h % 53) > 0"


@query(TRUE)
def adjusted_points_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjustment of the points under the scene's cameras, against the scene's points."""
    s = Scene(spark, sf_dir)
    seen = cut(s.obs)
    return _near(adjust.points_only(triangulate.triangulate(seen, s.cameras, 3), seen, s.cameras), s, 0.1)


@query(TRUE)
def fixpoint_points_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of triangulation and registration, against the scene's points."""
    s = Scene(spark, sf_dir)
    return _near(register.fixpoint(cut(s.obs), s.cameras, (0, 1)).points, s, 0.2)


@query(TRUE)
def incremental_points_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image by image with known poses over the scene's tracks, against the scene's points."""
    s = Scene(spark, sf_dir)
    kps = cut(s.kps)
    matches = cut(scene.matches(kps))
    made = register.incremental(matches.select("i", "j", "a", "b"), kps, kps.select("track_id", "img_id", "kp_id"), cut(s.cameras)).points
    return _near(made, s, 0.2)


@query(f"{SQL} SELECT img_id, true AS near, count(*) >= 6 AS enough FROM obs GROUP BY 1 HAVING count(*) >= 30")
def pnp_poses_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses of images with thirty points or more, against the scene's cameras."""
    s = Scene(spark, sf_dir)
    poses = twoview.pnp(s.obs.join(s.points, "track_id").select("img_id", "track_id", "u", "v", "x", "y", "z"), K)
    counts = s.obs.groupBy("img_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 30")
    both = counts.join(poses, "img_id", "left").join(s.cameras, "img_id")
    centre = [-(F.col("r")[c] * F.col("t")[0] + F.col("r")[3 + c] * F.col("t")[1] + F.col("r")[6 + c] * F.col("t")[2]) for c in range(3)]
    far = F.sqrt(sum(((x - F.col(f"c{c}_w")) * (x - F.col(f"c{c}_w")) for x, c in zip(centre[1:], "yz")), (centre[0] - F.col("cx_w")) * (centre[0] - F.col("cx_w"))))
    return both.select("img_id", F.coalesce(far < 0.05, F.lit(False)).alias("near"), F.coalesce(F.col("n_inliers") >= 6, F.lit(False)).alias("enough"))


@query(TRUE.replace("true AS near", "true AS near, true AS lower, (SELECT CAST(count(*) AS INTEGER) FROM cameras) AS n_cameras"))
def full_adjustment_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cameras but the first two and all points free, from points that were pushed off by more than they may be off at the end."""
    s = Scene(spark, sf_dir)
    seen = cut(s.obs)
    pushed = triangulate.triangulate(seen, s.cameras, 3).withColumn("x", F.col("x") + 0.2)
    points, cameras, costs = adjust.full(pushed, seen, s.cameras, rounds=8, fixed=2)
    return _near(points, s, 0.1).withColumn("lower", F.lit(costs[-1] < 0.1 * costs[0])).withColumn("n_cameras", F.lit(cameras.count()))


@query(f"{SQL}, {queries.BY_DEGREE} SELECT * FROM tr")
def streamed_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scene's tracks out of a stream of its matches that comes in several batches."""
    folder = scratch(spark, "stream")
    cut(Scene(spark, sf_dir).matches).repartition(3, "i").write.parquet(f"{folder}/matches")
    keep_tracks(spark, f"{folder}/matches", f"{folder}/state", f"{folder}/log", 1).awaitTermination()
    return TrackState(spark, f"{folder}/state").tracks()


@query(f"{SQL} SELECT img_id, count(*) AS n, {R('avg(err)', 'mean')}, {R('median(err)', 'median')}, {R('quantile_cont(err, 0.95)', 'p95')}, {R('max(err)', 'worst')} FROM errs WHERE err IS NOT NULL GROUP BY img_id")
def overlay_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of each image's observations, as an overlay of them is titled."""
    return rounded(diagnostics.residual_summary(Scene(spark, sf_dir).star))


@query(f"{SQL}, sc AS (SELECT i, j, least(count(*), 40) AS score FROM matches GROUP BY 1, 2) SELECT i, j, score FROM sc WHERE score >= 8 ORDER BY score DESC, (i % 2 = 0)::INTEGER, i, j LIMIT 1")
def init_pair_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pair where scores tie and pairs of even images have matches of contours alone."""
    scores = matching.pair_scores(Scene(spark, sf_dir).matches).withColumn("score", F.least("score", F.lit(40)))
    return matching.initial_pair(scores, contour_only=scores.where("i % 2 = 0"))


# --- poses against the scene's cameras ----------------------------------------------------------------------------------


def _common(seen: DataFrame) -> DataFrame:
    """(i, j, a, b, xi, yi, xj, yj) of all tracks that two images see; the track is the keypoint."""
    one, other = (seen.select("track_id", F.col("img_id").alias(i), F.col("track_id").alias(a), F.col("u").alias(f"x{i}"), F.col("v").alias(f"y{i}")) for i, a in (("i", "a"), ("j", "b")))
    return one.join(other, "track_id").where("i < j").select("i", "j", "a", "b", "xi", "yi", "xj", "yj")


def _relative_near(pixels: DataFrame, cameras: DataFrame, reach: float) -> DataFrame:
    """(i, j, n, near) of each pair with thirty common tracks: whether rotation and direction lie within `reach` of the cameras'."""
    r = F.array(*[F.col(f"r{a}{b}") for a in range(3) for b in range(3)])
    t = F.array("tx", "ty", "tz")
    one, other = (cut(cameras).select(F.col("img_id").alias(i), r.alias(f"r_{i}"), t.alias(f"t_{i}")) for i in "ij")
    turn = [sum((F.col("r_j")[3 * a + k] * F.col("r_i")[3 * b + k] for k in (1, 2)), F.col("r_j")[3 * a] * F.col("r_i")[3 * b]) for a in range(3) for b in range(3)]
    move = [F.col("t_j")[a] - sum((turn[3 * a + k] * F.col("t_i")[k] for k in (1, 2)), turn[3 * a] * F.col("t_i")[0]) for a in range(3)]
    length = F.sqrt(move[0] * move[0] + move[1] * move[1] + move[2] * move[2])
    gaps = [F.abs(F.col("r")[k] - turn[k]) for k in range(9)] + [F.abs(F.col("t")[k] - move[k] / length) for k in range(3)]
    counts = pixels.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")).where("n >= 30")
    judged = counts.join(twoview.two_view_poses(pixels, K), ["i", "j"], "left").join(one, "i").join(other, "j")
    return judged.select("i", "j", "n", F.coalesce(F.greatest(*gaps) < reach, F.lit(False)).alias("near"))


PAIRS = f"{SQL} SELECT p.img_id AS i, q.img_id AS j, count(*) AS n, true AS near FROM obs p JOIN obs q ON p.track_id = q.track_id AND p.img_id < q.img_id GROUP BY ALL HAVING count(*) >= 30"


@query(PAIRS)
def two_view_poses_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative poses of all pairs with thirty common tracks, against the scene's cameras."""
    s = Scene(spark, sf_dir)
    return _relative_near(_common(cut(s.obs.select("track_id", "img_id", "u", "v"))), s.cameras, 0.1)


@query(PAIRS.replace("p.img_id < q.img_id", "p.img_id < q.img_id AND q.img_id - p.img_id BETWEEN 2 AND 23"))
def wall_poses_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where all points lie on a plane, which leaves linear fits of eight points undetermined. Pairs of neighbours on the ring
    are left out: the second pose that fits a plane may have all points before both cameras there, and nothing tells the two apart."""
    _, seen = scene.wall(spark, sf_dir)
    return _relative_near(_common(cut(seen)).where("j - i between 2 and 23"), Scene(spark, sf_dir).cameras, 0.05)


def _absolute_near(poses: DataFrame, seen: DataFrame, cameras: DataFrame) -> DataFrame:
    counts = seen.groupBy("img_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 30")
    both = counts.join(poses, "img_id", "left").join(cameras, "img_id")
    centre = [-(F.col("r")[c] * F.col("t")[0] + F.col("r")[3 + c] * F.col("t")[1] + F.col("r")[6 + c] * F.col("t")[2]) for c in range(3)]
    far = F.sqrt(sum(((x - F.col(f"c{c}_w")) * (x - F.col(f"c{c}_w")) for x, c in zip(centre[1:], "yz")), (centre[0] - F.col("cx_w")) * (centre[0] - F.col("cx_w"))))
    return both.select("img_id", F.coalesce(far < 0.05, F.lit(False)).alias("near"), F.coalesce(F.col("n_inliers") >= 0.9 * F.col("n"), F.lit(False)).alias("enough"))


@query(f"{SQL} SELECT img_id, true AS near, count(*) >= 30 AS enough FROM obs GROUP BY 1 HAVING count(*) >= 30")
def wall_cameras_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera poses from points of a plane, which leave linear fits of six points undetermined."""
    flat, seen = scene.wall(spark, sf_dir)
    seen = cut(seen)
    links = seen.join(flat, "track_id").select("img_id", "track_id", "u", "v", "x", "y", "z")
    return _absolute_near(twoview.pnp(links, K), seen, Scene(spark, sf_dir).cameras)


# --- neighbours by indexes, and one-to-one matches ----------------------------------------------------------------------

NEAR = f"{KNN.strip()[5:]}"


@query(f"WITH {NEAR} SELECT i, count(*) FILTER (WHERE place = 1) AS n, true AS enough FROM near WHERE i < j GROUP BY i")
def indexed_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nearest neighbours in later images an image's descriptors have, and whether the index shows nine of ten."""
    desc = cut(Scene(spark, sf_dir).desc)
    pairs = matching.image_pairs(desc.select("img_id").distinct())
    best = matching.two_nearest(desc, pairs).where("place = 1").select("i", "j", "a", "b")
    made = descindex.two_nearest_indexed(desc, pairs, leaf=64).select("i", "j", "a", "b", F.lit(1).alias("shown")).distinct()
    joined = best.join(made, ["i", "j", "a", "b"], "left").groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.sum("shown").alias("shown"))
    return joined.select("i", "n", (F.coalesce("shown", F.lit(0)) >= 0.9 * F.col("n")).alias("enough"))


def _signs(desc: DataFrame) -> DataFrame:
    """(img_id, kp_id, bits): a bit for each component over zero."""
    bits = [F.when(F.get("desc", F.lit(k)) > 0, F.lit((1 << k) - (1 << 64 if k == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")) for k in range(64)]
    return desc.select("img_id", "kp_id", F.array(reduce(lambda x, y: x.bitwiseOR(y), bits)).alias("bits"))


@query(
    """WITH d AS (SELECT CAST(label AS INTEGER) AS img_id, CAST(vec_id AS INTEGER) AS kp_id, list_sum(list_transform(range(64), lambda k: CASE WHEN embedding[k + 1] > 0 THEN 1::HUGEINT << k::INTEGER ELSE 0::HUGEINT END))::HUGEINT AS bits FROM embeddings WHERE embedding IS NOT NULL),
    met AS (SELECT l.img_id AS i, r.img_id AS j, l.kp_id AS a, r.kp_id AS b, CAST(bit_count(xor(l.bits, r.bits)) AS INTEGER) AS dist FROM d l JOIN d r ON l.img_id < r.img_id)
    SELECT i, j, a, b, CAST(row_number() OVER (PARTITION BY i, j, a ORDER BY dist, b) AS INTEGER) AS place, dist FROM met QUALIFY place <= 2"""
)
def hamming_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two nearest of each later image, by the signs of descriptors."""
    desc = cut(_signs(Scene(spark, sf_dir).desc))
    return binary.two_nearest_binary(desc, matching.image_pairs(desc.select("img_id").distinct()), 1)


@query(
    f"""WITH RECURSIVE {NEAR}, e AS (SELECT i, j, a, b, dist, row_number() OVER (PARTITION BY i, j ORDER BY dist, a, b) AS k FROM near WHERE i < j),
    g(i, j, k, ua, ub, kept) AS (
      SELECT DISTINCT i, j, 0::BIGINT, []::INTEGER[], []::INTEGER[], false FROM e
      UNION ALL SELECT g.i, g.j, e.k, CASE WHEN list_contains(ua, e.a) OR list_contains(ub, e.b) THEN ua ELSE list_append(ua, e.a) END,
        CASE WHEN list_contains(ua, e.a) OR list_contains(ub, e.b) THEN ub ELSE list_append(ub, e.b) END, NOT (list_contains(ua, e.a) OR list_contains(ub, e.b))
      FROM g JOIN e ON e.i = g.i AND e.j = g.j AND e.k = g.k + 1)
    SELECT e.i, e.j, e.a, e.b, {R('e.dist', 'dist')} FROM g JOIN e USING (i, j, k) WHERE g.kept"""
)
def greedy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one matches out of both neighbours of each descriptor, the nearest first."""
    desc = Scene(spark, sf_dir).desc
    near = matching.two_nearest(desc, matching.image_pairs(desc.select("img_id").distinct()))
    return rounded(matching.unique_greedy(near.select("i", "j", "a", "b", "dist"), few=1_000))
