"""Outlier removal: the strict multi-view filter, the spatial gate and the adaptive filter.

Every function takes points (track_id, x, y, z) and gives the points with a verdict; `kept` drops the others and numbers
what stays by `pid`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from manyview.functions.projection import DEPTH_MEDIAN, DEPTH_MULTIVIEW
from manyview.operators.errors import XYZ, observed
from manyview.operators.quantiles import away_from, exact_percentiles
from manyview.session import cut

BEHIND = 1000.0
MAD_TO_SIGMA = 1.4826
MEDIANS = {c: (c, 0.5) for c in XYZ}


def strict(points: DataFrame, obs: DataFrame, cameras: DataFrame, any_view: float = 5.0, median: float = 1.0, good_views: int = 3) -> DataFrame:
    """(track_id, x, y, z, n_obs, max_err, median_err, n_good, reason); reason is NULL for points that stay.

    A view that the point isn't in front of counts BEHIND to the median and nothing to the maximum.
    """
    star = observed(points, obs, cameras, DEPTH_MULTIVIEW)
    per = star.groupBy("track_id").agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.max("err").alias("max_err"),
        F.median(F.coalesce("err", F.lit(BEHIND))).alias("median_err"),
        F.count_if(F.col("err") <= any_view).alias("n_good"),
    )
    judged = points.select("track_id", *XYZ).join(per, "track_id", "left")
    reason = F.when(F.col("n_obs").isNull(), "few_good").when(F.col("max_err") > any_view, "any_view").when(F.col("median_err") > median, "median").when(F.coalesce("n_good", F.lit(0)) < good_views, "few_good")
    return judged.withColumn("reason", reason)


def spatial(points: DataFrame, percentile: float = 0.95, multiplier: float = 2.0, least: int = 10) -> DataFrame:
    """points with distance (to the median centre) and keep: distances up to multiplier x percentile stay; all of fewer than `least`."""
    points = cut(points)
    middle = exact_percentiles(points, MEDIANS)
    far = points.withColumn("distance", away_from(middle))
    limit = exact_percentiles(far, {"limit": ("distance", percentile)})["limit"]
    keep = F.lit(middle["n"] < least) | (F.col("distance") <= F.lit(limit).cast("double") * multiplier)
    return far.withColumn("keep", keep)


def kept(points: DataFrame) -> DataFrame:
    """(pid, track_id, x, y, z): dense numbers by track_id.

    Each range of track ids is counted, and numbers start at the count of the ranges before; no task sorts all rows.
    """
    block = F.floor(F.col("track_id") / 65536)
    rows = points.select("track_id", *XYZ).withColumn("block", block)
    sizes = rows.groupBy("block").agg(F.count(F.lit(1)).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("block", before.alias("start"))
    nth = F.row_number().over(Window.partitionBy("block").orderBy("track_id")) - 1
    return rows.withColumn("nth", nth).join(starts, "block").select((F.col("start") + F.col("nth")).cast("long").alias("pid"), "track_id", *XYZ)


def adaptive_threshold(star: DataFrame, least_obs: int = 2) -> DataFrame:
    """One row (n, median, mad, threshold) of the errors of points with at least least_obs views; of all points if there are none."""
    fine = star.where((F.col("depth") > DEPTH_MEDIAN) & F.col("err").isNotNull())
    counted = fine if "views" in star.columns else fine.withColumn("views", F.count(F.lit(1)).over(Window.partitionBy("track_id")))
    any_with = counted.agg(F.coalesce(F.max("views") >= least_obs, F.lit(False)).alias("enough"))
    used = counted.crossJoin(any_with).where((F.col("views") >= least_obs) | ~F.col("enough"))
    used = cut(used.select("err"))
    middle = exact_percentiles(used, {"median": ("err", 0.5)})
    apart = used.select(F.abs(F.col("err") - F.lit(middle["median"]).cast("double")).alias("apart"))
    mad = exact_percentiles(apart, {"mad": ("apart", 0.5)})["mad"]
    row = star.sparkSession.createDataFrame([(middle["n"], middle["median"], mad)], "n long, median double, mad double")
    loose = F.col("median") + 3.5 * MAD_TO_SIGMA * (F.col("mad") + 1e-9)
    top = F.greatest(F.lit(2.0), 4.0 * F.greatest("median", F.lit(1e-6)))
    return row.withColumn("threshold", F.least(F.greatest(loose, F.lit(0.75)), top))


def adaptive(points: DataFrame, obs: DataFrame, cameras: DataFrame, least_obs: int = 2, depth_cov: float = 1.0) -> DataFrame:
    """(track_id, x, y, z, n_views, n_good, keep): by a threshold that follows the errors, view ratios, depths, then place."""
    star = observed(points, obs, cameras, DEPTH_MEDIAN).where((F.col("depth") > DEPTH_MEDIAN) & F.col("err").isNotNull())
    return adaptive_of(points, star.select("track_id", "depth", "err"), least_obs, depth_cov)


def adaptive_of(points: DataFrame, star: DataFrame, least_obs: int = 2, depth_cov: float = 1.0) -> DataFrame:
    """As adaptive, from the depths and errors (track_id, depth, err) of the views that points lie before; and views, how many a track has of
    them, if that is known."""
    star = cut(star)  # read three times
    limit = adaptive_threshold(star, least_obs).select("threshold")
    good = F.col("err") < F.col("threshold")
    depth = F.when(good, F.col("depth"))
    per = star.crossJoin(limit).groupBy("track_id").agg(F.count(F.lit(1)).alias("n_views"), F.count_if(good).alias("n_good"), (F.stddev_pop(depth) / F.avg(depth)).alias("cov"))
    needed = F.when(F.col("n_views") == 2, 1.0).when(F.col("n_views") == 3, 2.0 / 3.0).otherwise(0.6)
    passes = (F.col("n_views") >= least_obs) & (F.col("n_good") / F.col("n_views") >= needed) & (F.coalesce("cov", F.lit(0.0)) <= depth_cov)
    joined = cut(points.select("track_id", *XYZ).join(per.withColumn("passes", passes), "track_id", "left").withColumn("passes", F.coalesce("passes", F.lit(False))))
    stay = joined.where("passes")
    middle = exact_percentiles(stay, MEDIANS)
    far = cut(stay.select("track_id", away_from(middle).alias("away")))
    centre = exact_percentiles(far, {"away": ("away", 0.5)})["away"]
    spread = exact_percentiles(far.select(F.abs(F.col("away") - F.lit(centre).cast("double")).alias("apart")), {"mad": ("apart", 0.5)})["mad"]
    limit = F.lit(centre).cast("double") + 4.0 * MAD_TO_SIGMA * F.lit(spread).cast("double")
    gate = far.select("track_id", (F.lit(middle["n"] <= 20) | (F.col("away") <= limit)).alias("near"))
    return joined.join(gate, "track_id", "left").select("track_id", *XYZ, F.coalesce("n_views", F.lit(0)).alias("n_views"), F.coalesce("n_good", F.lit(0)).alias("n_good"), (F.col("passes") & F.coalesce("near", F.lit(False))).alias("keep"))


def statistics(points: DataFrame) -> DataFrame:
    """One row about a cloud: centre, box and distances to the median centre."""
    points = cut(points)
    middle = exact_percentiles(points, MEDIANS)
    far = cut(points.withColumn("away", away_from(middle)))
    parts = exact_percentiles(far, {"median": ("away", 0.5), "p90": ("away", 0.9), "p95": ("away", 0.95), "p99": ("away", 0.99)})
    number = {k: F.lit(v).cast("double") for k, v in parts.items() if k != "n"}
    return far.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.lit(middle[c]).cast("double").alias(f"median_{c}") for c in XYZ],
        *[F.avg(c).alias(f"mean_{c}") for c in XYZ],
        *[f(c).alias(f"{n}_{c}") for c in XYZ for n, f in (("min", F.min), ("max", F.max))],
        F.avg("away").alias("away_mean"), number["median"].alias("away_median"), F.stddev_pop("away").alias("away_std"),
        F.min("away").alias("away_min"), F.max("away").alias("away_max"), number["p90"].alias("away_p90"),
        number["p95"].alias("away_p95"), number["p99"].alias("away_p99"), F.count_if(F.col("away") > number["p95"]).alias("n_outliers"),
    )


def length_histogram(obs: DataFrame, most: int = 8) -> DataFrame:
    """(length, n_tracks): tracks of 2 views and more by length; `most` stands for all longer ones too."""
    sizes = obs.groupBy("track_id").agg(F.count(F.lit(1)).alias("views")).where("views >= 2")
    return sizes.groupBy(F.least("views", F.lit(most)).cast("int").alias("length")).agg(F.count(F.lit(1)).alias("n_tracks"))
