"""A synthetic scene out of the test tables: cameras on a ring, points, noisy observations, matches.

    cameras    <- nation: 25 cameras on a ring of radius 6 at height 1.5, looking at the origin
    points     <- part: coordinates from -1 to 1 by modular arithmetic on the key
    obs        <- lineitem (line numbers 1 and 2): which image sees which point, with up to 1 px of noise, some 9 px off
    keypoints  <- obs, numbered in each image
    matches    <- neighbouring images of a point, some left out, some wrong
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from manyview.functions.projection import pixel

CENTRE = math.sqrt(38.25)
WIDTH, HEIGHT = 1024, 768


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    angle = 2 * F.pi() * F.col("n_nationkey") / 25
    base = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("img_id"), F.cos(angle).alias("c"), F.sin(angle).alias("s"))
    c, s = F.col("c"), F.col("s")
    n, zero = F.lit(CENTRE), F.lit(0.0)
    turned = {"r00": -s, "r01": c, "r02": zero, "r10": 1.5 * c / n, "r11": 1.5 * s / n, "r12": F.lit(-6.0) / n, "r20": -6 * c / n, "r21": -6 * s / n, "r22": F.lit(-1.5) / n}
    placed = base.select("img_id", *[F.lit(v).alias(k) for k, v in (("fx", 800.0), ("fy", 800.0), ("cx", 512.0), ("cy", 384.0))], *[v.alias(k) for k, v in turned.items()], (6 * c).alias("cx_w"), (6 * s).alias("cy_w"), F.lit(1.5).alias("cz_w"))
    t = [-(F.col(f"r{i}0") * F.col("cx_w") + F.col(f"r{i}1") * F.col("cy_w") + F.col(f"r{i}2") * F.col("cz_w")) for i in range(3)]
    return placed.select("*", *[x.alias(k) for x, k in zip(t, ("tx", "ty", "tz"))])


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    axes = [(((key * k) % 2001 - 1000) / 1000).alias(n) for k, n in ((7919, "x"), (104729, "y"), (1299709, "z"))]
    return read(spark, sf_dir, "part").select(key.alias("track_id"), *axes)


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track_id, img_id, h, u, v). The sums of u go in the order of the SQL's, as errors that differ by their last bits alone tell the
    worst from the next."""
    h = F.min(F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17)
    seen = read(spark, sf_dir, "lineitem").where("l_linenumber <= 2").groupBy(F.col("l_partkey").alias("track_id"), (F.col("l_suppkey") % 25).cast("int").alias("img_id")).agg(h.alias("h"))
    placed = seen.join(points(spark, sf_dir), "track_id").join(cameras(spark, sf_dir), "img_id")
    u, v, _ = pixel((F.col("x"), F.col("y"), F.col("z")))
    du, dv = ((F.col("h") * k % 2001 - 1000) / 1000 for k in (7, 13))
    off = F.when(F.col("h") % 53 == 0, 9.0).otherwise(0.0)
    return placed.select("track_id", "img_id", "h", (u + du + off).alias("u"), (v + dv).alias("v"))


def wall(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Points and observations as above, but with all points on a plane and a hundredth of the noise; wrong places are as wrong, but
    downwards, as a shift along an epipolar line can't be told from depth."""
    flat = points(spark, sf_dir).withColumn("z", 0.05 * F.col("x") - 0.5)
    placed = obs(spark, sf_dir).select("track_id", "img_id", "h").join(flat, "track_id").join(cameras(spark, sf_dir), "img_id")
    u, v, _ = pixel((F.col("x"), F.col("y"), F.col("z")))
    dv = (F.col("h") * 13 % 2001 - 1000) / 100_000 + F.when(F.col("h") % 53 == 0, 9.0).otherwise(0.0)
    return flat, placed.select("track_id", "img_id", "h", (u + (F.col("h") * 7 % 2001 - 1000) / 100_000).alias("u"), (v + dv).alias("v"))


def keypoints(seen: DataFrame) -> DataFrame:
    """(img_id, kp_id, x, y, track_id): the observations, numbered in each image."""
    number = F.row_number().over(Window.partitionBy("img_id").orderBy("track_id")) - 1
    return seen.select("img_id", number.alias("kp_id"), F.col("u").alias("x"), F.col("v").alias("y"), "track_id", "h")


def matches(kps: DataFrame) -> DataFrame:
    """(i, j, a, b), i < j."""
    order = Window.partitionBy("track_id").orderBy("img_id")
    chain = kps.select("track_id", "h", F.col("img_id").alias("i"), F.col("kp_id").alias("a"), F.lead("img_id").over(order).alias("j"), F.lead("kp_id").over(order).alias("b"))
    right = chain.where("j is not null and h % 17 <> 0").select("i", "j", "a", "b")
    other = kps.select(F.col("track_id").alias("next_id"), F.col("img_id").alias("j2"), F.col("kp_id").alias("b2"))
    wrong = chain.where("h % 97 = 0").join(other, (F.col("next_id") == F.col("track_id") + 1) & (F.col("j2") > F.col("i"))).select("i", F.col("j2").alias("j"), "a", F.col("b2").alias("b"))
    return right.unionAll(wrong).distinct()


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img_id, kp_id, desc): the label is the image."""
    return read(spark, sf_dir, "embeddings").where("embedding is not null").select(F.col("label").cast("int").alias("img_id"), F.col("vec_id").cast("int").alias("kp_id"), F.col("embedding").alias("desc"))


#: The same scene for DuckDB, as the beginning of a WITH clause.
SQL = f"""
WITH RECURSIVE cam0 AS (SELECT CAST(n_nationkey AS INTEGER) AS img_id, cos(2 * pi() * n_nationkey / 25) AS c, sin(2 * pi() * n_nationkey / 25) AS s FROM nation),
cam1 AS (
  SELECT img_id, CAST(800 AS DOUBLE) AS fx, CAST(800 AS DOUBLE) AS fy, CAST(512 AS DOUBLE) AS cx, CAST(384 AS DOUBLE) AS cy,
    -s AS r00, c AS r01, CAST(0 AS DOUBLE) AS r02,
    CAST(1.5 AS DOUBLE) * c / {CENTRE!r}::DOUBLE AS r10, CAST(1.5 AS DOUBLE) * s / {CENTRE!r}::DOUBLE AS r11, CAST(-6 AS DOUBLE) / {CENTRE!r}::DOUBLE AS r12,
    -6 * c / {CENTRE!r}::DOUBLE AS r20, -6 * s / {CENTRE!r}::DOUBLE AS r21, CAST(-1.5 AS DOUBLE) / {CENTRE!r}::DOUBLE AS r22,
    6 * c AS cx_w, 6 * s AS cy_w, CAST(1.5 AS DOUBLE) AS cz_w
  FROM cam0),
cameras AS (
  SELECT *, -(r00 * cx_w + r01 * cy_w + r02 * cz_w) AS tx, -(r10 * cx_w + r11 * cy_w + r12 * cz_w) AS ty, -(r20 * cx_w + r21 * cy_w + r22 * cz_w) AS tz FROM cam1),
points AS (
  SELECT p_partkey AS track_id, CAST((p_partkey * 7919) % 2001 - 1000 AS DOUBLE) / 1000 AS x,
    CAST((p_partkey * 104729) % 2001 - 1000 AS DOUBLE) / 1000 AS y, CAST((p_partkey * 1299709) % 2001 - 1000 AS DOUBLE) / 1000 AS z
  FROM part),
seen AS (
  SELECT l_partkey AS track_id, CAST(l_suppkey % 25 AS INTEGER) AS img_id, min(l_orderkey * 31 + l_linenumber * 17) AS h
  FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL),
placed AS (
  SELECT seen.*, p.x, p.y, p.z, fx, fy, cx, cy,
    r00 * p.x + r01 * p.y + r02 * p.z + tx AS xc, r10 * p.x + r11 * p.y + r12 * p.z + ty AS yc, r20 * p.x + r21 * p.y + r22 * p.z + tz AS zc
  FROM seen JOIN points p USING (track_id) JOIN cameras USING (img_id)),
proj AS (SELECT *, CASE WHEN zc > 1e-12 THEN xc / zc * fx + cx END AS pu, CASE WHEN zc > 1e-12 THEN yc / zc * fy + cy END AS pv FROM placed),
obs AS (
  SELECT track_id, img_id, h, x, y, z, zc, pu, pv,
    pu + CAST(h * 7 % 2001 - 1000 AS DOUBLE) / 1000 + CASE WHEN h % 53 = 0 THEN 9 ELSE 0 END AS u,
    pv + CAST(h * 13 % 2001 - 1000 AS DOUBLE) / 1000 AS v
  FROM proj),
kps AS (SELECT *, CAST(row_number() OVER (PARTITION BY img_id ORDER BY track_id) - 1 AS INTEGER) AS kp_id FROM obs),
chain AS (
  SELECT track_id, h, img_id AS i, kp_id AS a, lead(img_id) OVER w AS j, lead(kp_id) OVER w AS b
  FROM kps WINDOW w AS (PARTITION BY track_id ORDER BY img_id)),
matches AS (
  SELECT i, j, a, b FROM chain WHERE j IS NOT NULL AND h % 17 <> 0
  UNION SELECT c.i, k.img_id, c.a, k.kp_id FROM chain c JOIN kps k ON k.track_id = c.track_id + 1 AND k.img_id > c.i WHERE c.h % 97 = 0),
errs AS (SELECT track_id, img_id, zc, sqrt((pu - u) * (pu - u) + (pv - v) * (pv - v)) AS err FROM obs)
"""
