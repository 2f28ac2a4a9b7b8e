"""The query catalogue: each operator on the scene of plans.scene, by the DataFrame API, and the same by hand-written SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyview.functions import projection, text
from manyview.functions.linalg import clean
from manyview.functions.projection import centre, projection_matrix, quaternion
from manyview.operators import adjust, cleanup, diagnostics, errors, matching, register, tracks, triangulate, twoview
from manyview.plans import reconstruct, scene
from manyview.plans.scene import HEIGHT, SQL, WIDTH
from manyview.session import cut
from manyview.sources import calibration, clouds, exports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
K = (800.0, 800.0, 512.0, 384.0)


def query(sql: str | None = None):
    def keep(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double rounded, without -0.0."""
    return df.select([clean(F.col(c), digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


class Scene:
    """The tables of a scene, made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.cameras, self.points, self.obs = scene.cameras(spark, sf_dir), scene.points(spark, sf_dir), scene.obs(spark, sf_dir)
        self.desc = scene.descriptors(spark, sf_dir)

    @property
    def kps(self) -> DataFrame:
        return scene.keypoints(self.obs)

    @property
    def matches(self) -> DataFrame:
        return scene.matches(self.kps)

    @property
    def star(self) -> DataFrame:
        return errors.observed(self.points, self.obs, self.cameras)

    @property
    def runs(self) -> DataFrame:
        rows = self.spark.range(184, 585).select(F.col("id").cast("int").alias("v"))
        half = F.sqrt(F.lit(40000.0) - (F.col("v") - 384) * (F.col("v") - 384))
        return self.cameras.select("img_id").crossJoin(rows.select("v", F.ceil(512 - half).cast("int").alias("u0"), F.floor(512 + half).cast("int").alias("u1")))

    @property
    def contours(self) -> DataFrame:
        turn = 2 * F.pi() * F.col("id") / 150
        disc = self.spark.range(150).select(F.col("id").cast("int").alias("idx"), F.floor(512.5 + 200 * F.cos(turn)).cast("double").alias("x"), F.floor(384.5 + 200 * F.sin(turn)).cast("double").alias("y"))
        return self.cameras.select("img_id").crossJoin(disc)

    @property
    def pixels(self) -> DataFrame:
        return matching.with_pixels(self.matches, self.kps)


R = lambda e, n: f"round({e}, 6) + 0.0 AS {n}"

# --- projection and errors ----------------------------------------------------------------------------------------------


@query(f"{SQL} SELECT track_id, img_id, {R('pu', 'u')}, {R('pv', 'v')} FROM obs")
def project_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Scene(spark, sf_dir).star.select("track_id", "img_id", F.col("pu").alias("u"), F.col("pv").alias("v")))


@query(f"{SQL} SELECT track_id, img_id, {R('err', 'err')} FROM errs")
def reprojection_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(errors.errors_or_infinite(Scene(spark, sf_dir).star).select("track_id", "img_id", "err"))


SUMMARY = "per AS (SELECT track_id, count(*) AS n_views, median(err) AS median_err, max(err) AS max_err FROM errs WHERE zc > 1e-9 GROUP BY track_id)"


@query(f"{SQL}, {SUMMARY} SELECT track_id, n_views, {R('median_err', 'median_err')}, {R('max_err', 'max_err')} FROM per")
def point_error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(errors.point_summary(Scene(spark, sf_dir).star))


@query(f"{SQL} SELECT count(err) AS n, {R('avg(err)', 'mean')}, {R('median(err)', 'median')}, {R('quantile_cont(err, 0.9)', 'p90')}, {R('quantile_cont(err, 0.95)', 'p95')} FROM errs")
def reproj_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(errors.statistics(Scene(spark, sf_dir).star))


@query(f"{SQL}, few AS (SELECT err FROM errs ORDER BY track_id, img_id LIMIT 1000) SELECT count(err) AS n, {R('avg(err)', 'mean')}, {R('median(err)', 'median')}, {R('quantile_cont(err, 0.9)', 'p90')}, {R('quantile_cont(err, 0.95)', 'p95')} FROM few")
def reproj_stats_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(errors.statistics(Scene(spark, sf_dir).star, 1000))


@query(f"{SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY err DESC, track_id) AS place FROM errs) SELECT img_id, CAST(place AS INTEGER) AS place, track_id, {R('err', 'err')} FROM o WHERE place <= 10")
def worst_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(errors.worst(Scene(spark, sf_dir).star, 10))


@query(f"{SQL} SELECT img_id, {R('-(r00*tx + r10*ty + r20*tz)', 'x')}, {R('-(r01*tx + r11*ty + r21*tz)', 'y')}, {R('-(r02*tx + r12*ty + r22*tz)', 'z')} FROM cameras")
def camera_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = centre()
    return rounded(Scene(spark, sf_dir).cameras.select("img_id", *[x.alias(n) for x, n in zip(c, "xyz")]))


_P = [[f"fx*{a} + cx*{c}" for a, c in zip(("r00", "r01", "r02", "tx"), ("r20", "r21", "r22", "tz"))], [f"fy*{a} + cy*{c}" for a, c in zip(("r10", "r11", "r12", "ty"), ("r20", "r21", "r22", "tz"))], ["r20", "r21", "r22", "tz"]]


@query(f"{SQL} SELECT img_id, {', '.join(R(_P[i][j], f'p{i}{j}') for i in range(3) for j in range(4))} FROM cameras")
def projection_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = projection_matrix()
    return rounded(Scene(spark, sf_dir).cameras.select("img_id", *[p[i][j].alias(f"p{i}{j}") for i in range(3) for j in range(4)]))


@query(f"{SQL} SELECT img_id, {', '.join(R(f'{s}r{j}{i}', f'm{i}{j}') for i in range(3) for j, s in enumerate(('', '-', '-')))}, {R('cx_w', 'm03')}, {R('cy_w', 'm13')}, {R('cz_w', 'm23')} FROM cameras")
def c2w(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(exports.camera_to_world(Scene(spark, sf_dir).cameras))


@query(
    f"""{SQL}, q AS (SELECT *, 1 + r00 + r11 + r22 AS a, 1 + r00 - r11 - r22 AS b, 1 - r00 + r11 - r22 AS c, 1 - r00 - r11 + r22 AS d FROM cameras),
    m AS (SELECT *, greatest(a, b, c, d) AS g FROM q),
    w AS (SELECT img_id,
      CASE WHEN a >= g THEN a WHEN b >= g THEN r21 - r12 WHEN c >= g THEN r02 - r20 ELSE r10 - r01 END / (2 * sqrt(g)) AS w,
      CASE WHEN a >= g THEN r21 - r12 WHEN b >= g THEN b WHEN c >= g THEN r01 + r10 ELSE r02 + r20 END / (2 * sqrt(g)) AS x,
      CASE WHEN a >= g THEN r02 - r20 WHEN b >= g THEN r01 + r10 WHEN c >= g THEN c ELSE r12 + r21 END / (2 * sqrt(g)) AS y,
      CASE WHEN a >= g THEN r10 - r01 WHEN b >= g THEN r02 + r20 WHEN c >= g THEN r12 + r21 ELSE d END / (2 * sqrt(g)) AS z FROM m)
    SELECT img_id, {', '.join(R(f'CASE WHEN w < 0 THEN -{k} ELSE {k} END', f'q{k}') for k in 'wxyz')} FROM w"""
)
def quaternions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Scene(spark, sf_dir).cameras.select("img_id", *[q.alias(f"q{k}") for q, k in zip(quaternion(), "wxyz")]))


DISTORTION = (0.05, -0.01, 0.001, -0.0005, 0.002)


def _undistort_sql() -> str:
    k1, k2, p1, p2, k3 = (f"{x!r}::DOUBLE" for x in DISTORTION)
    parts, before = ["u0 AS (SELECT img_id, kp_id, (u - 512) / 800 AS x0, (v - 384) / 800 AS y0, (u - 512) / 800 AS x, (v - 384) / 800 AS y FROM kps)"], "u0"
    for step in range(1, 11):
        parts.append(f"r{step} AS (SELECT *, x*x + y*y AS r FROM {before})")
        parts.append(f"u{step} AS (SELECT img_id, kp_id, x0, y0, (x0 - (2*{p1}*x*y + {p2}*(r + 2*x*x))) / (1 + r*({k1} + r*({k2} + r*{k3}))) AS x, (y0 - ({p1}*(r + 2*y*y) + 2*{p2}*x*y)) / (1 + r*({k1} + r*({k2} + r*{k3}))) AS y FROM r{step})")
        before = f"u{step}"
    return ", ".join(parts)


@query(f"{SQL}, {_undistort_sql()} SELECT img_id, kp_id, {R('x * 800 + 512', 'x')}, {R('y * 800 + 384', 'y')} FROM u10")
def undistorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scene(spark, sf_dir)
    with_lens = s.kps.select("img_id", "kp_id", "x", "y").join(s.cameras.select("img_id", "fx", "fy", "cx", "cy"), "img_id")
    return rounded(projection.undistorted(with_lens, ["img_id", "kp_id"], DISTORTION))


@query(f"{SQL} SELECT img_id, {R('1024 / (2 * tan(radians(60) / 2))', 'fx')} FROM cameras")
def estimated_focal(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = Scene(spark, sf_dir).cameras.select("img_id", F.lit(HEIGHT).alias("height"), F.lit(WIDTH).alias("width"))
    return rounded(calibration.guessed(images).select("img_id", "fx"))


# --- cleanup ------------------------------------------------------------------------------------------------------------

STRICT = """
vs AS (SELECT track_id, count(*) AS n_obs, max(CASE WHEN zc > 1e-6 THEN err END) AS max_err,
         median(CASE WHEN zc > 1e-6 THEN err ELSE 1000 END) AS median_err, count(*) FILTER (WHERE zc > 1e-6 AND err <= 5) AS n_good
       FROM errs GROUP BY track_id),
judged AS (SELECT p.track_id, x, y, z, n_obs, max_err, median_err, n_good,
         CASE WHEN n_obs IS NULL THEN 'few_good' WHEN max_err > 5 THEN 'any_view' WHEN median_err > 1 THEN 'median' WHEN coalesce(n_good, 0) < 3 THEN 'few_good' END AS reason
       FROM points p LEFT JOIN vs USING (track_id)),
stay AS (SELECT track_id, x, y, z FROM judged WHERE reason IS NULL),
mid AS (SELECT median(x) AS mx, median(y) AS my, median(z) AS mz, count(*) AS n FROM stay),
far AS (SELECT stay.*, n, sqrt((x-mx)*(x-mx) + (y-my)*(y-my) + (z-mz)*(z-mz)) AS distance FROM stay, mid),
gate AS (SELECT far.*, (n < 10 OR distance <= 2 * (SELECT quantile_cont(distance, 0.95) FROM far)) AS keep FROM far)
"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scene(spark, sf_dir)
    return cleanup.strict(s.points, s.obs, s.cameras)


@query(f"{SQL}, {STRICT} SELECT track_id, n_obs, {R('max_err', 'max_err')}, {R('median_err', 'median_err')}, n_good, reason FROM judged")
def strict_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_judged(spark, sf_dir).select("track_id", "n_obs", "max_err", "median_err", "n_good", "reason"))


@query(f"{SQL}, {STRICT} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM judged GROUP BY 1")
def strict_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{SQL}, {STRICT} SELECT track_id, {R('distance', 'distance')}, keep FROM gate")
def spatial_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    stay = _judged(spark, sf_dir).where("reason is null").select("track_id", "x", "y", "z")
    return rounded(cleanup.spatial(stay).select("track_id", "distance", "keep"))


@query(f"{SQL}, {STRICT} SELECT row_number() OVER (ORDER BY track_id) - 1 AS pid, track_id, {R('x', 'x')}, {R('y', 'y')}, {R('z', 'z')} FROM gate WHERE keep")
def flagship_clean_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which points survive the strict multi-view filter and the spatial gate, numbered anew."""
    stay = _judged(spark, sf_dir).where("reason is null").select("track_id", "x", "y", "z")
    return rounded(cleanup.kept(cleanup.spatial(stay).where("keep")))


@query(f"{SQL}, {STRICT} SELECT o.track_id, o.img_id, {R('o.u', 'u')}, {R('o.v', 'v')}, reason FROM judged JOIN obs o USING (track_id) WHERE reason IS NOT NULL")
def removed_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.removed(_judged(spark, sf_dir), Scene(spark, sf_dir).obs))


ADAPTIVE = """
fine AS (SELECT *, count(*) OVER (PARTITION BY track_id) AS views FROM errs WHERE zc > 1e-9),
used AS (SELECT err FROM fine WHERE views >= 2 OR NOT (SELECT coalesce(max(views) >= 2, false) FROM fine)),
mid AS (SELECT median(err) AS m, count(*) AS n FROM used),
mad AS (SELECT any_value(n) AS n, any_value(m) AS m, median(abs(err - m)) AS mad FROM used, mid),
lim AS (SELECT n, m, mad, least(greatest(m + 3.5 * 1.4826 * (mad + 1e-9), 0.75), greatest(2.0, 4.0 * greatest(m, 1e-6))) AS threshold FROM mad),
per AS (SELECT track_id, count(*) AS n_views, count(*) FILTER (WHERE err < threshold) AS n_good,
          stddev_pop(CASE WHEN err < threshold THEN zc END) / avg(CASE WHEN err < threshold THEN zc END) AS cov FROM fine, lim GROUP BY track_id),
pass AS (SELECT p.track_id, x, y, z, n_views, n_good, coalesce(n_views >= 2 AND n_good / n_views::DOUBLE >= CASE n_views WHEN 2 THEN 1.0 WHEN 3 THEN 2.0::DOUBLE / 3.0::DOUBLE ELSE 0.6 END AND coalesce(cov, 0) <= 1, false) AS ok
         FROM points p LEFT JOIN per USING (track_id)),
c AS (SELECT median(x) AS mx, median(y) AS my, median(z) AS mz, count(*) AS n FROM pass WHERE ok),
aw AS (SELECT track_id, n, sqrt((x-mx)*(x-mx) + (y-my)*(y-my) + (z-mz)*(z-mz)) AS away FROM pass, c WHERE ok),
am AS (SELECT median(away) AS am FROM aw),
sp AS (SELECT any_value(am) AS am, median(abs(away - am)) AS amad FROM aw, am),
near AS (SELECT track_id, (n <= 20 OR away <= am + 4.0 * 1.4826 * amad) AS near FROM aw, sp)
"""


@query(f"{SQL}, {ADAPTIVE} SELECT n, {R('m', 'median')}, {R('mad', 'mad')}, {R('threshold', 'threshold')} FROM lim")
def mad_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scene(spark, sf_dir)
    return rounded(cleanup.adaptive_threshold(errors.observed(s.points, s.obs, s.cameras, 1e-9)))


@query(f"{SQL}, {ADAPTIVE} SELECT track_id, coalesce(n_views, 0) AS n_views, coalesce(n_good, 0) AS n_good, ok AND coalesce(near, false) AS keep FROM pass LEFT JOIN near USING (track_id)")
def adaptive_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scene(spark, sf_dir)
    return cleanup.adaptive(s.points, s.obs, s.cameras).select("track_id", F.col("n_views").cast("long").alias("n_views"), F.col("n_good").cast("long").alias("n_good"), "keep")


_AGG = ", ".join([R(f"any_value(m{c})", f"median_{c}") for c in "xyz"] + [R(f"avg({c})", f"mean_{c}") for c in "xyz"] + [R(f"{f}({c})", f"{f}_{c}") for c in "xyz" for f in ("min", "max")])


@query(
    f"""{SQL}, m AS (SELECT median(x) AS mx, median(y) AS my, median(z) AS mz FROM points), a AS (SELECT points.*, m.*, sqrt((x-mx)*(x-mx) + (y-my)*(y-my) + (z-mz)*(z-mz)) AS away FROM points, m),
    l AS (SELECT quantile_cont(away, 0.95) AS p95 FROM a)
    SELECT count(*) AS n, {_AGG}, {R('avg(away)', 'away_mean')}, {R('median(away)', 'away_median')}, {R('stddev_pop(away)', 'away_std')}, {R('min(away)', 'away_min')}, {R('max(away)', 'away_max')},
    {R('quantile_cont(away, 0.9)', 'away_p90')}, {R('any_value(p95)', 'away_p95')}, {R('quantile_cont(away, 0.99)', 'away_p99')}, count(*) FILTER (WHERE away > p95) AS n_outliers FROM a, l"""
)
def cloud_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cleanup.statistics(Scene(spark, sf_dir).points))


@query(f"{SQL}, s AS (SELECT track_id, count(*) AS n FROM obs GROUP BY 1 HAVING count(*) >= 2) SELECT CAST(least(n, 8) AS INTEGER) AS length, count(*) AS n_tracks FROM s GROUP BY 1")
def track_length_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanup.length_histogram(Scene(spark, sf_dir).obs)


# --- pairing and matching -----------------------------------------------------------------------------------------------

_STEMS = "im AS (SELECT printf('img_%03d', n_nationkey) AS stem, n_nationkey AS ord FROM nation WHERE n_nationkey % 7 <> 3), ca AS (SELECT printf('img_%03d', n_nationkey) AS stem, n_nationkey AS k FROM nation WHERE n_nationkey % 5 <> 1)"


def _stems(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nation = scene.read(spark, sf_dir, "nation")
    path = F.format_string("/rig/img_%03d.%s", "n_nationkey", F.lit("ppm"))
    images = nation.where("n_nationkey % 7 <> 3").select(text.stem(path).alias("stem"), F.col("n_nationkey").alias("ord"))
    cams = nation.where("n_nationkey % 5 <> 1").select(text.stem(F.format_string("/calib/img_%03d.txt", "n_nationkey")).alias("stem"), F.col("n_nationkey").alias("k"))
    return calibration.pair_with_images(images, cams)


@query(f"WITH {_STEMS} SELECT stem, ord, k, CAST(row_number() OVER (ORDER BY stem) - 1 AS INTEGER) AS img_id FROM im JOIN ca USING (stem)")
def stem_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stems(spark, sf_dir)[0]


@query(f"WITH {_STEMS} SELECT stem, 'no camera' AS side FROM im WHERE stem NOT IN (SELECT stem FROM ca) UNION ALL SELECT stem, 'no image' FROM ca WHERE stem NOT IN (SELECT stem FROM im)")
def stem_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, images, cams = _stems(spark, sf_dir)
    return images.select("stem", F.lit("no camera").alias("side")).unionAll(cams.select("stem", F.lit("no image").alias("side")))


@query(f"{SQL} SELECT a.img_id AS i, b.img_id AS j FROM cameras a JOIN cameras b ON a.img_id < b.img_id")
def image_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.image_pairs(Scene(spark, sf_dir).cameras)


@query(f"{SQL} SELECT a.img_id AS i, b.img_id AS j FROM cameras a JOIN cameras b ON a.img_id < b.img_id AND b.img_id <= a.img_id + 6")
def pair_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.window_pairs(Scene(spark, sf_dir).cameras, 6)


KNN = """
WITH d AS (SELECT CAST(label AS INTEGER) AS img_id, CAST(vec_id AS INTEGER) AS kp_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL),
met AS (SELECT l.img_id AS i, r.img_id AS j, l.kp_id AS a, r.kp_id AS b,
          round(sqrt(list_sum(list_transform(list_zip(l.v, r.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 9) AS dist
        FROM d l JOIN d r ON l.img_id <> r.img_id),
near AS (SELECT *, row_number() OVER (PARTITION BY i, j, a ORDER BY dist, b) AS place FROM met QUALIFY place <= 2),
ratio AS (SELECT i, j, a, min(b) FILTER (WHERE place = 1) AS b, min(dist) FILTER (WHERE place = 1) AS dist FROM near GROUP BY i, j, a
          HAVING count(*) = 2 AND min(dist) FILTER (WHERE place = 1) < 0.95 * min(dist) FILTER (WHERE place = 2)),
uniq AS (SELECT * FROM ratio QUALIFY row_number() OVER (PARTITION BY i, j, b ORDER BY dist, a) = 1)
"""


def _desc_pairs(desc: DataFrame) -> DataFrame:
    return matching.image_pairs(desc.select("img_id").distinct())


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    desc = Scene(spark, sf_dir).desc
    return matching.two_nearest(desc, _desc_pairs(desc))


@query(f"{KNN} SELECT i, j, a, b, CAST(place AS INTEGER) AS place, {R('dist', 'dist')} FROM near WHERE i < j")
def knn2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_near(spark, sf_dir).select("i", "j", "a", "b", "place", "dist"))


@query(f"{KNN} SELECT i, j, a, b, {R('dist', 'dist')} FROM ratio WHERE i < j")
def ratio_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(matching.ratio_test(_near(spark, sf_dir), 0.95))


@query(f"{KNN} SELECT i, j, a, b, {R('dist', 'dist')} FROM uniq WHERE i < j")
def unique_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(matching.unique_by_distance(matching.ratio_test(_near(spark, sf_dir), 0.95)))


@query(f"{KNN} SELECT f.i, f.j, f.a, f.b, {R('f.dist', 'dist')} FROM uniq f JOIN uniq r ON f.i = r.j AND f.j = r.i AND f.a = r.b AND f.b = r.a WHERE f.i < f.j")
def mutual_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    desc = Scene(spark, sf_dir).desc
    return rounded(matching.match_descriptors(desc, _desc_pairs(desc), 0.95))


_SKEW = [["0", "-tz", "ty"], ["tz", "0", "-tx"], ["-ty", "tx", "0"]]
FUND = f"""
rel AS (SELECT a.img_id AS i, b.img_id AS j, a.fx, a.fy, a.cx, a.cy, {', '.join(f'b.r{r}0*a.r{c}0 + b.r{r}1*a.r{c}1 + b.r{r}2*a.r{c}2 AS q{r}{c}' for r in range(3) for c in range(3))},
   a.tx AS ax, a.ty AS ay, a.tz AS az, b.tx AS bx, b.ty AS by_, b.tz AS bz FROM cameras a JOIN cameras b ON a.img_id < b.img_id),
rt AS (SELECT *, bx - (q00*ax + q01*ay + q02*az) AS tx, by_ - (q10*ax + q11*ay + q12*az) AS ty, bz - (q20*ax + q21*ay + q22*az) AS tz FROM rel),
es AS (SELECT *, {', '.join(' + '.join(f'({_SKEW[r][k]})*q{k}{c}' for k in range(3)) + f' AS e{r}{c}' for r in range(3) for c in range(3))} FROM rt),
kj AS (SELECT *, {', '.join(f'e0{c}/fx AS h0{c}, e1{c}/fy AS h1{c}, e2{c} - cx/fx*e0{c} - cy/fy*e1{c} AS h2{c}' for c in range(3))} FROM es),
ki AS (SELECT i, j, {', '.join(f'h{r}0/fx AS g{r}0, h{r}1/fy AS g{r}1, h{r}2 - cx/fx*h{r}0 - cy/fy*h{r}1 AS g{r}2' for r in range(3))} FROM kj),
fm AS (SELECT i, j, {', '.join(f'g{r}{c} / (sqrt({" + ".join(f"g{a}{b}*g{a}{b}" for a in range(3) for b in range(3))}) + 1e-12) AS f{r}{c}' for r in range(3) for c in range(3))} FROM ki),
mp AS (SELECT m.*, k.u AS xi, k.v AS yi, l.u AS xj, l.v AS yj FROM matches m JOIN kps k ON k.img_id = m.i AND k.kp_id = m.a JOIN kps l ON l.img_id = m.j AND l.kp_id = m.b),
ln AS (SELECT mp.*, f00*xi+f01*yi+f02 AS a0, f10*xi+f11*yi+f12 AS a1, f20*xi+f21*yi+f22 AS a2, f00*xj+f10*yj+f20 AS b0, f01*xj+f11*yj+f21 AS b1, f02*xj+f12*yj+f22 AS b2 FROM mp JOIN fm USING (i, j)),
ep AS (SELECT i, j, a, b, (abs(a0*xj+a1*yj+a2)/(sqrt(a0*a0+a1*a1)+1e-12) + abs(b0*xi+b1*yi+b2)/(sqrt(b0*b0+b1*b1)+1e-12)) / 2 AS epipolar FROM ln)
"""


@query(f"{SQL}, {FUND} SELECT i, j, {', '.join(R(f'f{r}{c}', f'f{r}{c}') for r in range(3) for c in range(3))} FROM fm")
def fundamental(spark: SparkSession, sf_dir: str) -> DataFrame:
    cameras = Scene(spark, sf_dir).cameras
    return rounded(matching.fundamental(cameras, matching.image_pairs(cameras)))


@query(f"{SQL}, {FUND} SELECT i, j, a, b, {R('epipolar', 'epipolar')} FROM ep WHERE epipolar < 3")
def epipolar_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scene(spark, sf_dir)
    return rounded(matching.epipolar_filter(s.matches, s.kps, s.cameras))


@query(f"{SQL}, {FUND} SELECT i, j, count(*) AS n FROM ep WHERE epipolar < 3 GROUP BY 1, 2 HAVING count(*) >= 4")
def valid_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scene(spark, sf_dir)
    return matching.pair_scores(matching.epipolar_filter(s.matches, s.kps, s.cameras)).where("score >= 4").withColumnRenamed("score", "n")


@query(f"{SQL} SELECT i, j, count(*) AS score FROM matches GROUP BY 1, 2")
def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.pair_scores(Scene(spark, sf_dir).matches)


@query(f"{SQL} SELECT i, j, count(*) AS score FROM matches GROUP BY 1, 2 HAVING count(*) >= 8 ORDER BY score DESC, i, j LIMIT 1")
def init_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.initial_pair(matching.pair_scores(Scene(spark, sf_dir).matches))


@query(f"{SQL} SELECT i, j, a, b FROM (SELECT *, max(b) OVER (PARTITION BY i, j ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM (SELECT i, j, a, min(b) AS b FROM matches GROUP BY ALL)) WHERE most IS NULL OR b >= most - 5")
def monotonic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = Scene(spark, sf_dir).matches.groupBy("i", "j", "a").agg(F.min("b").alias("b"))
    return matching.monotonic(one)


CONT = """
cont AS (SELECT img_id, CAST(k AS INTEGER) AS idx, floor(512.5::DOUBLE + 200 * cos(2 * pi() * k / 150)) AS x, floor(384.5::DOUBLE + 200 * sin(2 * pi() * k / 150)) AS y FROM cameras, range(150) t(k)),
cl AS (SELECT i, j, idx AS a, f00*x+f01*y+f02 AS l0, f10*x+f11*y+f12 AS l1, f20*x+f21*y+f22 AS l2 FROM fm JOIN cont ON img_id = i),
cd AS (SELECT i, j, a, idx AS b, round(abs(l0*x+l1*y+l2)/(sqrt(l0*l0+l1*l1)+1e-12), 9) AS dist FROM cl JOIN cont ON img_id = j),
cb AS (SELECT * FROM cd WHERE dist < 5 QUALIFY row_number() OVER (PARTITION BY i, j, a ORDER BY dist, b) = 1),
cm AS (SELECT * FROM cb QUALIFY row_number() OVER (PARTITION BY i, j, b ORDER BY a) = 1)
"""


def _contour(s: Scene) -> DataFrame:
    return matching.contour_matches(s.contours, s.cameras, matching.image_pairs(s.cameras.select("img_id")))


@query(f"{SQL}, {FUND}, {CONT} SELECT i, j, a, b, {R('dist', 'dist')} FROM cm")
def contour_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_contour(Scene(spark, sf_dir)))


@query(
    f"""{SQL}, {FUND}, {CONT}, offs AS (SELECT img_id, max(kp_id) + 1 AS o FROM kps GROUP BY 1),
    fresh AS (SELECT cm.* FROM cm JOIN cont c ON c.img_id = cm.i AND c.idx = cm.a WHERE NOT EXISTS (
      SELECT 1 FROM matches m JOIN kps k ON k.img_id = m.i AND k.kp_id = m.a WHERE m.i = cm.i AND m.j = cm.j AND sqrt((c.x - k.u)*(c.x - k.u) + (c.y - k.v)*(c.y - k.v)) < 5))
    SELECT i, j, a, b FROM matches UNION ALL
    SELECT i, j, CAST(a + coalesce(p.o, 0) AS INTEGER), CAST(b + coalesce(q.o, 0) AS INTEGER) FROM fresh LEFT JOIN offs p ON p.img_id = i LEFT JOIN offs q ON q.img_id = j"""
)
def merge_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scene(spark, sf_dir)
    return matching.merge_contours(s.matches, s.kps, s.contours, _contour(s))[1]


@query(f"{SQL}, {FUND}, {CONT} SELECT i, j, a, b FROM cm WHERE EXISTS (SELECT 1 FROM cm q WHERE q.i = cm.i AND q.j = cm.j AND q.b = cm.b AND abs(q.a - cm.a) <= 1)")
def contour_mutual_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contour matches against themselves turned round, within one step along the contour."""
    found = _contour(Scene(spark, sf_dir)).select("i", "j", "a", "b")
    turned = found.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("b").alias("a"), F.col("a").alias("b"))
    return matching.mutual_within(found, turned, 1)


@query()
def contour_matches_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contour matches both ways, ordered, near their two-view points."""
    s = Scene(spark, sf_dir)
    return matching.match_contours(s.contours, s.cameras, matching.image_pairs(s.cameras.select("img_id")))


RUNS = "runs AS (SELECT img_id, CAST(v AS INTEGER) AS v, CAST(ceil(512 - sqrt(40000.0::DOUBLE - (v-384)*(v-384))) AS INTEGER) AS u0, CAST(floor(512 + sqrt(40000.0::DOUBLE - (v-384)*(v-384))) AS INTEGER) AS u1 FROM cameras, range(184, 585) t(v))"


@query(
    f"""{SQL}, {RUNS}, px AS (SELECT img_id, kp_id, u AS x, v AS y, greatest(0, least(1023, CAST(round_even(u, 0) AS INTEGER))) AS pu, greatest(0, least(767, CAST(round_even(v, 0) AS INTEGER))) AS pv FROM kps)
    SELECT img_id, kp_id, CAST(row_number() OVER (PARTITION BY img_id ORDER BY kp_id) - 1 AS INTEGER) AS new_id FROM px WHERE EXISTS (SELECT 1 FROM runs r WHERE r.img_id = px.img_id AND r.v = px.pv AND px.pu BETWEEN r.u0 AND r.u1)"""
)
def mask_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scene(spark, sf_dir)
    return matching.in_mask(s.kps, s.runs, WIDTH, HEIGHT).select("img_id", "kp_id", "new_id")


# --- tracks -------------------------------------------------------------------------------------------------------------

TRACKS = """
ends AS (SELECT i AS img_id, a AS kp_id FROM matches UNION ALL SELECT j, b FROM matches),
deg AS (SELECT img_id, kp_id, count(*) AS degree, img_id * 4294967296 + kp_id AS node FROM ends GROUP BY ALL),
edge AS (SELECT i::BIGINT * 4294967296 + a AS s, j::BIGINT * 4294967296 + b AS t FROM matches UNION SELECT j::BIGINT * 4294967296 + b, i::BIGINT * 4294967296 + a FROM matches),
reach AS (SELECT node AS s, node AS t FROM deg UNION SELECT r.s, e.t FROM reach r JOIN edge e ON e.s = r.t),
lab AS (SELECT s AS node, min(t) AS label FROM reach GROUP BY s),
nodes AS (SELECT deg.*, label FROM deg JOIN lab USING (node)),
one AS (SELECT * FROM nodes QUALIFY row_number() OVER (PARTITION BY label, img_id ORDER BY {order}) = 1),
ids AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS track_id FROM one GROUP BY label HAVING count(*) >= 2),
tr AS (SELECT track_id, img_id, kp_id FROM one JOIN ids USING (label))
"""
BY_DEGREE, FIRST = TRACKS.format(order="degree DESC, kp_id"), TRACKS.format(order="kp_id")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(tracks.labelled(Scene(spark, sf_dir).matches))


@query(f"{SQL}, {BY_DEGREE} SELECT img_id, kp_id, degree FROM deg")
def node_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.degrees(Scene(spark, sf_dir).matches)


@query(f"{SQL}, {BY_DEGREE} SELECT * FROM tr")
def track_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.build(_labelled(spark, sf_dir))


@query(f"{SQL}, {FIRST} SELECT * FROM tr")
def tracks_first_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.build(_labelled(spark, sf_dir), "first")


@query(f"{SQL}, {BY_DEGREE}, st AS (SELECT label, count(*) AS n, count(DISTINCT img_id) AS images FROM nodes GROUP BY 1) SELECT count(*) AS components, count(*) FILTER (WHERE images >= 2) AS multi_view, count(*) FILTER (WHERE n > images) AS conflicts, CAST(sum(n - images) AS BIGINT) AS dropped FROM st")
def track_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.statistics(_labelled(spark, sf_dir))


@query(f"{SQL} SELECT img_id, count(*) AS n FROM obs GROUP BY 1")
def corr_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scene(spark, sf_dir)
    return tracks.correspondences(s.obs, s.points)


@query(f"{SQL}, long AS (SELECT track_id FROM kps GROUP BY 1 HAVING count(*) >= 5) SELECT img_id, track_id, {R('u', 'x')}, {R('v', 'y')} FROM kps WHERE track_id IN (SELECT track_id FROM long)")
def long_track_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    kps = Scene(spark, sf_dir).kps
    return rounded(diagnostics.long_tracks(kps.select("track_id", "img_id", "kp_id"), kps.select("img_id", "kp_id", "x", "y"), 5))


# --- triangulation ------------------------------------------------------------------------------------------------------


def _minor(i: int, j: int) -> str:
    m = [[f"m{min(r, c)}{max(r, c)}" for c in range(4) if c != j] for r in range(4) if r != i]
    (a, b, c), (d, e, f), (g, h, k) = m
    return f"{'-' if (i + j) % 2 else ''}({a}*({e}*{k} - {f}*{h}) - {b}*({d}*{k} - {f}*{g}) + {c}*({d}*{h} - {e}*{g}))"


_UP = [(i, j) for i in range(4) for j in range(i, 4)]


def null_sql(source: str, keep: str) -> str:
    """CTEs that end in `nul`: the null vector n0..n3 of the matrix m00..m33 of `source`."""
    parts = [f"nrm AS (SELECT {keep}, {', '.join(f'm{i}{j} / (m00 + m11 + m22 + m33) AS m{i}{j}' for i, j in _UP)} FROM {source})"]
    parts.append(f"adj AS (SELECT {keep}, {', '.join(f'{_minor(j, i)} AS a{i}{j}' for i in range(4) for j in range(4))}, 0.0::DOUBLE AS n0, 0.0::DOUBLE AS n1, 0.0::DOUBLE AS n2, 1.0::DOUBLE AS n3 FROM nrm)")
    before = "adj"
    every = ", ".join(f"a{i}{j}" for i in range(4) for j in range(4))
    for step in range(triangulate.STEPS):
        parts.append(f"w{step} AS (SELECT {keep}, {every}, {', '.join(' + '.join(f'a{i}{k}*n{k}' for k in range(4)) + f' AS w{i}' for i in range(4))} FROM {before})")
        parts.append(f"s{step} AS (SELECT {keep}, {every}, {', '.join(f'w{k} / sqrt(w0*w0 + w1*w1 + w2*w2 + w3*w3) AS n{k}' for k in range(4))} FROM w{step})")
        before = f"s{step}"
    return ", ".join(parts) + f", nul AS (SELECT {keep}, n0, n1, n2, n3 FROM {before})"


def _rows_sql(cam: str, u: str, v: str) -> list[list[str]]:
    c = lambda k: f"{cam}.{k}"
    p = [[f"({c('fx')}*{c(a)} + {c('cx')}*{c(b)})" for a, b in zip(("r00", "r01", "r02", "tx"), ("r20", "r21", "r22", "tz"))], [f"({c('fy')}*{c(a)} + {c('cy')}*{c(b)})" for a, b in zip(("r10", "r11", "r12", "ty"), ("r20", "r21", "r22", "tz"))], [c(k) for k in ("r20", "r21", "r22", "tz")]]
    return [[f"({u}*{z} - {x})" for x, z in zip(p[0], p[2])], [f"({v}*{z} - {y})" for y, z in zip(p[1], p[2])]]


_ONE = _rows_sql("c", "o.u", "o.v")
DLT = f"""
dl AS (SELECT track_id, count(*) AS n_views, {', '.join(f"sum({' + '.join(f'{r[i]}*{r[j]}' for r in _ONE)}) AS m{i}{j}" for i, j in _UP)} FROM obs o JOIN cameras c USING (img_id) GROUP BY track_id HAVING count(*) >= 3),
{null_sql('dl', 'track_id, n_views')},
tri AS (SELECT track_id, n_views, n0/n3 AS x, n1/n3 AS y, n2/n3 AS z FROM nul WHERE abs(n3) > 1e-12),
tst AS (SELECT t.track_id, r20*t.x + r21*t.y + r22*t.z + c.tz AS d, o.u, o.v, r00*t.x + r01*t.y + r02*t.z + c.tx AS a, r10*t.x + r11*t.y + r12*t.z + c.ty AS b, c.fx, c.fy, c.cx, c.cy FROM tri t JOIN obs o USING (track_id) JOIN cameras c USING (img_id)),
te AS (SELECT track_id, d, CASE WHEN d > 1e-6 THEN sqrt((a/d*fx+cx-u)*(a/d*fx+cx-u) + (b/d*fy+cy-v)*(b/d*fy+cy-v)) END AS err FROM tst),
tg AS (SELECT track_id FROM te GROUP BY 1 HAVING min(d) > 1e-6 AND median(err) <= 3)
"""


@query(f"{SQL}, {DLT} SELECT track_id, n_views, {R('x', 'x')}, {R('y', 'y')}, {R('z', 'z')} FROM tri")
def triangulate_dlt(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scene(spark, sf_dir)
    return rounded(triangulate.triangulate(s.obs, s.cameras, 3))


@query(f"{SQL}, {DLT} SELECT track_id, {R('x', 'x')}, {R('y', 'y')}, {R('z', 'z')} FROM tri WHERE track_id IN (SELECT track_id FROM tg)")
def triangulate_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scene(spark, sf_dir)
    return rounded(triangulate.triangulate_checked(s.obs, s.cameras, 1.5, 3))


_TWO = _rows_sql("ci", "m.xi", "m.yi") + _rows_sql("cj", "m.xj", "m.yj")
_NRM = lambda s: f"sqrt((x-{s}x)*(x-{s}x) + (y-{s}y)*(y-{s}y) + (z-{s}z)*(z-{s}z))"
TWO = f"""
pr AS (SELECT m.i, m.j, m.a, m.b, {', '.join(f"{' + '.join(f'{r[p]}*{r[q]}' for r in _TWO)} AS m{p}{q}" for p, q in _UP)} FROM mp m JOIN cameras ci ON ci.img_id = m.i JOIN cameras cj ON cj.img_id = m.j),
{null_sql('pr', 'i, j, a, b')},
tv AS (SELECT i, j, a, b, n0/n3 AS x, n1/n3 AS y, n2/n3 AS z FROM nul WHERE abs(n3) > 1e-12),
td AS (SELECT tv.*, mp.xi, mp.yi, mp.xj, mp.yj, c.fx, c.fy, c.cx, c.cy, c.cx_w AS ix, c.cy_w AS iy, c.cz_w AS iz, d.cx_w AS jx, d.cy_w AS jy, d.cz_w AS jz,
   c.r00*x+c.r01*y+c.r02*z+c.tx AS ai, c.r10*x+c.r11*y+c.r12*z+c.ty AS bi, c.r20*x+c.r21*y+c.r22*z+c.tz AS zi, d.r00*x+d.r01*y+d.r02*z+d.tx AS aj, d.r10*x+d.r11*y+d.r12*z+d.ty AS bj, d.r20*x+d.r21*y+d.r22*z+d.tz AS zj
   FROM tv JOIN mp USING (i, j, a, b) JOIN cameras c ON c.img_id = i JOIN cameras d ON d.img_id = j),
tq AS (SELECT *, sqrt(x*x+y*y+z*z) AS far, CASE WHEN zi > 1e-12 THEN sqrt((ai/zi*fx+cx-xi)*(ai/zi*fx+cx-xi)+(bi/zi*fy+cy-yi)*(bi/zi*fy+cy-yi)) END AS ei, CASE WHEN zj > 1e-12 THEN sqrt((aj/zj*fx+cx-xj)*(aj/zj*fx+cx-xj)+(bj/zj*fy+cy-yj)*(bj/zj*fy+cy-yj)) END AS ej,
   degrees(acos(greatest(-1.0, least(1.0, ((x-ix)*(x-jx)+(y-iy)*(y-jy)+(z-iz)*(z-jz)) / (({_NRM('i')} + 1e-12) * ({_NRM('j')} + 1e-12)))))) AS angle FROM td),
tr2 AS (SELECT *, CAST(CASE WHEN NOT isfinite(x+y+z) THEN 1 WHEN far > 1e6 THEN 2 WHEN zi <= 1e-12 THEN 3 WHEN zj <= 1e-12 THEN 4 WHEN greatest(zi, zj) >= 1e6 THEN 5 WHEN ei > 1.5 THEN 6 WHEN ej > 1.5 THEN 7 WHEN angle < 3 THEN 8 ELSE 0 END AS INTEGER) AS reason FROM tq)
"""


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scene(spark, sf_dir)
    return triangulate.two_view_reasons(s.pixels.select("i", "j", "a", "b", "xi", "yi", "xj", "yj"), s.cameras)


@query(f"{SQL}, {FUND}, {TWO} SELECT i, j, a, b, {R('x', 'x')}, {R('y', 'y')}, {R('z', 'z')}, {R('angle', 'angle')} FROM tr2 WHERE reason = 0")
def two_view_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_two(spark, sf_dir).where("reason = 0").select("i", "j", "a", "b", "x", "y", "z", "angle"))


@query(
    f"""{SQL}, {FUND}, {TWO} SELECT i, j, a, b FROM td WHERE sqrt((ai/zi*fx+cx-xi)*(ai/zi*fx+cx-xi)+(bi/zi*fy+cy-yi)*(bi/zi*fy+cy-yi)) <= 3
    AND sqrt((aj/zj*fx+cx-xj)*(aj/zj*fx+cx-xj)+(bj/zj*fy+cy-yj)*(bj/zj*fy+cy-yj)) <= 3"""
)
def two_view_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scene(spark, sf_dir)
    return triangulate.near_both(s.pixels.select("i", "j", "a", "b", "xi", "yi", "xj", "yj"), s.cameras).select("i", "j", "a", "b")


@query(f"{SQL}, {FUND}, {TWO} SELECT reason, count(*) AS n FROM tr2 GROUP BY 1")
def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two(spark, sf_dir).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""{SQL}, f AS (SELECT * FROM errs WHERE zc > 1e-6), md AS (SELECT track_id, count(*) AS n, median(err) AS m FROM f GROUP BY 1),
    ma AS (SELECT track_id, any_value(n) AS n, any_value(m) AS m, median(abs(err - m)) AS mad FROM f JOIN md USING (track_id) GROUP BY 1),
    li AS (SELECT track_id, n, CASE WHEN n >= 3 THEN greatest(0.75 * 1.5, least(m + 3.5 * 1.4826 * mad, 4.0 * 1.5)) ELSE 1.5 END::DOUBLE AS t FROM ma),
    g AS (SELECT track_id, any_value(n) AS n, any_value(t) AS t, count(*) FILTER (WHERE err <= t) AS n_good, stddev_pop(CASE WHEN err <= t THEN zc END) / avg(CASE WHEN err <= t THEN zc END) AS cov FROM f JOIN li USING (track_id) GROUP BY 1)
    SELECT track_id, n AS n_views, {R('t', 'threshold')}, n_good, n >= 3 AND n_good >= greatest(ceil(0.6::DOUBLE * n), 3) AND (n_good < 3 OR cov <= 1) AS valid FROM g"""
)
def validate_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scene(spark, sf_dir)
    return rounded(triangulate.validate(s.points, s.obs, s.cameras))


ANG = f"""
vw AS (SELECT track_id, img_id, x, y, z, cx_w, cy_w, cz_w FROM obs JOIN cameras USING (img_id)),
ag AS (SELECT p.track_id, p.img_id AS img_a, q.img_id AS img_b, p.x, p.y, p.z, p.cx_w AS ix, p.cy_w AS iy, p.cz_w AS iz, q.cx_w AS jx, q.cy_w AS jy, q.cz_w AS jz FROM vw p JOIN vw q ON p.track_id = q.track_id AND p.img_id < q.img_id),
an AS (SELECT track_id, img_a, img_b, degrees(acos(greatest(-1.0, least(1.0, ((x-ix)*(x-jx)+(y-iy)*(y-jy)+(z-iz)*(z-jz)) / (({_NRM('i')} + 1e-12) * ({_NRM('j')} + 1e-12)))))) AS angle FROM ag)
"""


@query(f"{SQL}, {ANG} SELECT track_id, img_a, img_b, {R('angle', 'angle')} FROM an")
def angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scene(spark, sf_dir)
    return rounded(triangulate.angles(s.points, s.obs, s.cameras))


@query(
    f"""{SQL}, {SUMMARY}, {ANG}, w AS (SELECT track_id, max(angle) AS mx, median(angle) AS md FROM an GROUP BY 1), l AS (SELECT track_id, count(*) AS n, string_agg(img_id::VARCHAR, ',' ORDER BY img_id) AS views FROM obs GROUP BY 1)
    SELECT p.track_id, coalesce(views, '') AS views, coalesce(n, 0) AS track_len, {R('coalesce(mx, 0)', 'max_angle')}, {R('coalesce(md, 0)', 'median_angle')}, {R('median_err', 'median_err')}
    FROM points p LEFT JOIN l USING (track_id) LEFT JOIN w USING (track_id) LEFT JOIN per USING (track_id)"""
)
def point_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scene(spark, sf_dir)
    return rounded(triangulate.point_meta(s.points, s.obs, s.cameras).withColumn("views", F.array_join("views", ",")))


@query(f"{SQL} SELECT img_id, count(*) AS n_visible FROM errs WHERE zc > 1e-6 AND err < 1.5 GROUP BY 1 HAVING count(*) >= 3")
def register_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scene(spark, sf_dir)
    return register.visible(s.points, s.obs, s.cameras)


SCORES = """
sc AS (SELECT c.img_id, max(sqrt((c.cx_w-k.cx_w)*(c.cx_w-k.cx_w) + (c.cy_w-k.cy_w)*(c.cy_w-k.cy_w) + (c.cz_w-k.cz_w)*(c.cz_w-k.cz_w))) AS baseline FROM cameras c, cameras k WHERE k.img_id IN (0, 1, 5) AND c.img_id NOT IN (0, 1, 5) GROUP BY 1),
co AS (SELECT img_id, count(*) AS n FROM obs GROUP BY 1),
sx AS (SELECT img_id, coalesce(n, 0) AS n, baseline, round(coalesce(n, 0) + 0.1::DOUBLE * baseline, 9) AS score FROM sc LEFT JOIN co USING (img_id))
"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scene(spark, sf_dir)
    return register.scores(s.obs, s.points, s.cameras, [0, 1, 5])


@query(f"{SQL}, {SCORES} SELECT img_id, n, {R('baseline', 'baseline')}, {R('score', 'score')} FROM sx")
def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_scores(spark, sf_dir))


@query(f"{SQL}, {SCORES} SELECT img_id, n, {R('baseline', 'baseline')}, {R('score', 'score')} FROM sx ORDER BY sx.score DESC, img_id LIMIT 1")
def next_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(register.next_image(_scores(spark, sf_dir)))


@query(
    f"""{SQL}, me AS (SELECT track_id FROM obs WHERE img_id = 7), mc AS (SELECT cx_w AS a, cy_w AS b, cz_w AS c FROM cameras WHERE img_id = 7),
    ot AS (SELECT track_id, img_id, round(sqrt((cx_w-a)*(cx_w-a) + (cy_w-b)*(cy_w-b) + (cz_w-c)*(cz_w-c)), 9) AS d FROM obs JOIN cameras USING (img_id), mc WHERE img_id IN (0, 1, 2, 3, 4, 5) AND track_id IN (SELECT track_id FROM me))
    SELECT track_id, img_id AS partner, {R('d', 'baseline')} FROM ot QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY d DESC, img_id) = 1"""
)
def best_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scene(spark, sf_dir)
    return rounded(triangulate.best_baseline(s.obs, s.cameras, 7, [0, 1, 2, 3, 4, 5]))


@query()
def known_pose_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of triangulation and registration from two cameras with known poses."""
    s = Scene(spark, sf_dir)
    return rounded(register.fixpoint(cut(s.obs), s.cameras, (0, 1)).points)


@query()
def incremental_multicam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image by image with known poses."""
    s = Scene(spark, sf_dir)
    kps = cut(s.kps)
    matches = cut(scene.matches(kps))
    return rounded(register.incremental(matches, kps, cut(tracks.build(tracks.labelled(matches))), cut(s.cameras)).points)


@query()
def reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From keypoints and raw matches to a clean cloud."""
    s = Scene(spark, sf_dir)
    kps = cut(s.kps)
    return rounded(reconstruct.known_cameras(cut(s.cameras), kps, cut(scene.matches(kps)))["points"])


# --- single camera and adjustment ---------------------------------------------------------------------------------------


@query()
def essential_inliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return twoview.verify_pairs(Scene(spark, sf_dir).pixels, K, 3.0)


@query()
def two_view_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return twoview.two_view_poses(Scene(spark, sf_dir).pixels, K, 3.0)


@query()
def single_camera_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a reconstruction without known poses."""
    s = Scene(spark, sf_dir)
    kps = cut(s.kps)
    return rounded(reconstruct.single_camera(kps, cut(scene.matches(kps)), K)["points"].select("track_id", "x", "y", "z"), 3)


@query()
def pnp_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scene(spark, sf_dir)
    return twoview.pnp(s.obs.join(s.points, "track_id").select("img_id", "track_id", "u", "v", "x", "y", "z"), K)


@query(
    f"""{SQL}, ch AS (SELECT track_id, img_id FROM obs WHERE img_id IN (2, 3, 5, 7)), hi AS (SELECT track_id, count(*) AS n FROM ch GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, track_id LIMIT 100),
    nu AS (SELECT track_id, CAST(row_number() OVER (ORDER BY n DESC, track_id) - 1 AS INTEGER) AS pt_idx FROM hi)
    SELECT track_id, img_id, pt_idx, CAST(list_position([2, 3, 5, 7], img_id) - 1 AS INTEGER) AS cam_idx FROM ch JOIN nu USING (track_id)"""
)
def ba_problem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjust.problem(Scene(spark, sf_dir).obs, [2, 3, 5, 7], 100)


@query()
def ba_points_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scene(spark, sf_dir)
    return rounded(adjust.points_only(triangulate.triangulate(s.obs, s.cameras, 3), s.obs, s.cameras))


@query()
def ba_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cameras and all tracks, three rounds."""
    s = Scene(spark, sf_dir)
    seen = cut(s.obs)
    return rounded(adjust.full(triangulate.triangulate(seen, s.cameras, 3), seen, s.cameras, rounds=3)[0])


# --- text, clouds, exports, diagnostics ---------------------------------------------------------------------------------

_BODY = "'K: [' || p_size || ', ' || p_partkey || '.5e-1; -.' || p_size || ' 1.e5] x' || p_size || '.'"
_NUMBER = text.NUMBER.replace("'", "''")


@query(f"SELECT p_partkey, len(regexp_extract_all(b, '{_NUMBER}')) AS n, {R('list_sum(list_transform(regexp_extract_all(b, ' + chr(39) + _NUMBER + chr(39) + '), lambda s: CAST(s AS DOUBLE)))', 'total')} FROM (SELECT p_partkey, {_BODY} AS b FROM part)")
def extract_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    body = F.concat(F.lit("K: ["), size, F.lit(", "), key, F.lit(".5e-1; -."), size, F.lit(" 1.e5] x"), size, F.lit("."))
    found = scene.read(spark, sf_dir, "part").select("p_partkey", text.floats(body).alias("f"))
    return rounded(found.select("p_partkey", F.size("f").cast("long").alias("n"), F.aggregate("f", F.lit(0.0), lambda a, x: a + x).alias("total")))


_KTEXT = "concat_ws(' ', 700 + n_nationkey, 0, 512, 0, 701 + n_nationkey, 384.5, 0, 0, CASE WHEN n_nationkey % 6 = 5 THEN 2 ELSE 1 END)"


@query(
    f"""WITH t AS (SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN {_KTEXT} WHEN 1 THEN {_KTEXT} || ' 0.1 -0.2' WHEN 2 THEN '{{"fx": ' || (700 + n_nationkey) || ', "fy": 701.5, "cx": 512, "cy": 384}}' ELSE '{{"camera": {{"K": [[' || (700 + n_nationkey) || ',0,512],[0,702,384],[0,0,1]], "dist": [0.5]}}}}' END AS body FROM nation),
    k AS (SELECT n_nationkey, CAST(700 + n_nationkey AS DOUBLE) AS fx, CAST(CASE n_nationkey % 4 WHEN 2 THEN 701.5 WHEN 3 THEN 702 ELSE 701 + n_nationkey END AS DOUBLE) AS fy, CASE n_nationkey % 4 WHEN 1 THEN 2 WHEN 3 THEN 1 END AS n_dist, NOT (n_nationkey % 4 < 2 AND n_nationkey % 6 = 5) AS valid FROM t)
    SELECT n_nationkey, fx, fy, CAST(n_dist AS INTEGER) AS n_dist, valid FROM k"""
)
def parse_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    s = lambda e: e.cast("string")
    plain = F.concat_ws(" ", s(700 + n), F.lit("0 512 0"), s(701 + n), F.lit("384.5 0 0"), F.when(n % 6 == 5, "2").otherwise("1"))
    four = F.concat(F.lit('{"fx": '), s(700 + n), F.lit(', "fy": 701.5, "cx": 512, "cy": 384}'))
    nested = F.concat(F.lit('{"camera": {"K": [['), s(700 + n), F.lit(',0,512],[0,702,384],[0,0,1]], "dist": [0.5]}}'))
    body = F.when(n % 4 == 0, plain).when(n % 4 == 1, F.concat(plain, F.lit(" 0.1 -0.2"))).when(n % 4 == 2, four).otherwise(nested)
    files = scene.read(spark, sf_dir, "nation").select(n.cast("string").alias("stem"), body.alias("body"))
    made = calibration.read_intrinsics(files)
    dist = F.when(F.col("dist").isNotNull(), F.size("dist"))
    return made.select(F.col("stem").cast("int").alias("n_nationkey"), F.col("k")[0].alias("fx"), F.col("k")[4].alias("fy"), dist.alias("n_dist"), "valid")


@query("SELECT n_nationkey, CAST(n_nationkey AS DOUBLE) AS first, CAST(n_nationkey + 11 AS DOUBLE) AS last, 12 AS n FROM nation")
def parse_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    numbers = F.transform(F.sequence(n, n + 11), lambda x: x.cast("string"))
    body = F.when(n % 2 == 0, F.array_join(numbers, " ")).otherwise(F.concat(F.lit('{"camera": {"projection": ['), F.array_join(numbers, ","), F.lit("]}}")))
    made = calibration.read_projections(scene.read(spark, sf_dir, "nation").select(n.cast("string").alias("stem"), body.alias("body")))
    return made.select(F.col("stem").cast("int").alias("n_nationkey"), F.col("p")[0].alias("first"), F.col("p")[11].alias("last"), F.size("p").alias("n"))


@query(f"{SQL} SELECT track_id AS pid, {R('x', 'x')}, {R('y', 'y')}, {R('z', 'z')} FROM points")
def parse_ply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points, written as the lines of a PLY file and parsed again."""
    points = Scene(spark, sf_dir).points.withColumnRenamed("track_id", "pid")
    count = points.agg(F.concat(F.lit("element vertex "), F.count(F.lit(1)).cast("string")).alias("line"))
    fixed = ["ply", "format ascii 1.0", None, "property float x", "property float y", "property float z", "end_header"]
    head = spark.createDataFrame([(k, x) for k, x in enumerate(fixed) if x], "nth long, line string").unionByName(count.select(F.lit(2).cast("long").alias("nth"), "line"))
    body = clouds.ply_lines(points).select((F.col("nth") + len(fixed)).alias("nth"), "line")
    parsed = clouds.parse_ply(head.unionByName(body).withColumn("file", F.lit("cloud")))
    return rounded(parsed.select("pid", "x", "y", "z"))


@query(f"{SQL} SELECT img_id, CAST(round_even(u, 0) AS INTEGER) AS cx, CAST(round_even(v, 0) AS INTEGER) AS cy, count(*) AS n FROM kps WHERE round_even(u, 0) BETWEEN 0 AND 1023 AND round_even(v, 0) BETWEEN 0 AND 767 GROUP BY ALL")
def kp_heat_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.heat_cells(Scene(spark, sf_dir).kps, WIDTH, HEIGHT)


ALL = """
pr AS (SELECT track_id, img_id, r00*x+r01*y+r02*z+tx AS a, r10*x+r11*y+r12*z+ty AS b, r20*x+r21*y+r22*z+tz AS d, fx, fy, cx, cy FROM points, cameras),
uv AS (SELECT track_id, img_id, CASE WHEN d > 1e-12 THEN a/d*fx+cx END AS u, CASE WHEN d > 1e-12 THEN b/d*fy+cy END AS v FROM pr),
ins AS (SELECT uv.*, uv.u IS NOT NULL AS valid, coalesce(uv.u BETWEEN 0 AND 1023 AND uv.v BETWEEN 0 AND 767, false) AS inside, o.h IS NOT NULL AS seen FROM uv LEFT JOIN obs o USING (track_id, img_id))
"""


@query(f"{SQL}, {ALL} SELECT img_id, count(*) FILTER (WHERE valid) AS n_valid, count(*) FILTER (WHERE inside) AS n_inside, count(*) FILTER (WHERE valid AND NOT inside) AS n_outside, count(*) FILTER (WHERE inside AND seen) AS n_observed, count(*) FILTER (WHERE inside AND NOT seen) AS n_unobserved FROM ins GROUP BY 1")
def all_projection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scene(spark, sf_dir)
    return diagnostics.projection_counts(s.points, s.cameras, s.obs, WIDTH, HEIGHT)


@query(
    f"""{SQL}, {ALL}, {RUNS}, j AS (SELECT track_id, NOT EXISTS (SELECT 1 FROM runs r WHERE r.img_id = ins.img_id AND r.v = CAST(round_even(ins.v, 0) AS INTEGER) AND CAST(round_even(ins.u, 0) AS INTEGER) BETWEEN r.u0 AND r.u1) AS out FROM ins WHERE inside)
    SELECT track_id, count(*) AS n_views, {R('avg(out::INTEGER)', 'ratio')} FROM j GROUP BY 1 HAVING avg(out::INTEGER) >= 0.5"""
)
def outside_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scene(spark, sf_dir)
    return rounded(diagnostics.outside_masks(s.points, s.cameras, s.runs, WIDTH, HEIGHT))


#: Tracks that have a point here: those with a median error of up to one pixel.
POINTS = f"{SUMMARY}, pt AS (SELECT points.* FROM points JOIN per USING (track_id) WHERE round(median_err, 9) <= 1)"


def _numbered(s: Scene) -> tuple[DataFrame, DataFrame, DataFrame]:
    kps = s.kps
    fine = errors.point_summary(s.star).where(F.round("median_err", 9) <= 1).select("track_id")
    points = s.points.join(fine, "track_id", "left_semi").withColumn("pid", F.col("track_id"))
    return kps.select("img_id", "kp_id", "x", "y"), kps.select("track_id", "img_id", "kp_id"), points


@query(f"{SQL}, {POINTS} SELECT CAST(img_id + 1 AS INTEGER) AS image_id, kp_id, {R('u', 'x')}, {R('v', 'y')}, coalesce(pt.track_id + 1, -1) AS point_id FROM kps LEFT JOIN pt USING (track_id)")
def sparse_points2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(exports.points2d(*_numbered(Scene(spark, sf_dir))))


@query(f"{SQL}, {POINTS}, t AS (SELECT track_id, string_agg((img_id + 1) || ' ' || kp_id, ' ' ORDER BY img_id, kp_id) AS track FROM kps GROUP BY 1) SELECT track_id + 1 AS point_id, {R('coalesce(median_err, 0)', 'error')}, coalesce(track, '') AS track FROM pt LEFT JOIN t USING (track_id) LEFT JOIN per USING (track_id)")
def sparse_points3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Scene(spark, sf_dir)
    _, seen, points = _numbered(s)
    made = exports.points3d(points, seen, errors.point_summary(s.star))
    track = F.array_join(F.transform("track", lambda t: F.concat_ws(" ", t["image_id"].cast("string"), t["kp_id"].cast("string"))), " ")
    return rounded(made.select("point_id", "error", F.coalesce(track, F.lit("")).alias("track")))


@query(f"{SQL} SELECT img_id, printf('images/image_%04d', img_id) AS file_path, {R('cx_w', 'x')}, {R('-r21', 'm12')}, {R('fx', 'fl_x')} FROM cameras")
def transform_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    cameras = Scene(spark, sf_dir).cameras.withColumn("width", F.lit(WIDTH)).withColumn("height", F.lit(HEIGHT))
    parsed = F.from_json("frame", "file_path string, transform_matrix array<array<double>>, fl_x double")
    frames = exports.frames(cameras).select("img_id", parsed.alias("f"))
    return rounded(frames.select("img_id", "f.file_path", F.col("f.transform_matrix")[0][3].alias("x"), F.col("f.transform_matrix")[1][2].alias("m12"), "f.fl_x"))
