"""Descriptor and contour matching as joins and windows.

Keypoints are (img_id, kp_id, x, y), descriptors (img_id, kp_id, desc), matches (i, j, a, b) with image i < j and the
keypoints a of i and b of j. Every place where order decides has a total order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from manyview.functions.linalg import cross, dot, norm, once, rotation, times, transposed, vector
from manyview.operators.triangulate import near_both
from manyview.session import cut


def image_pairs(images: DataFrame) -> DataFrame:
    """(i, j) of all pairs of images; the table of images is small, its pairs are the work list."""
    a, b = images.select(F.col("img_id").alias("i")), images.select(F.col("img_id").alias("j"))
    return a.join(b, F.col("i") < F.col("j"))


def window_pairs(images: DataFrame, window: int) -> DataFrame:
    """(i, j), i < j <= i + window, by position: each image lists its followers, which is an equi-join."""
    numbered = images.select("img_id", (F.row_number().over(Window.orderBy("img_id")) - 1).alias("nth"))
    wanted = numbered.select(F.col("img_id").alias("i"), F.explode(F.sequence(F.col("nth") + 1, F.col("nth") + window)).alias("nth"))
    return wanted.join(numbered.withColumnRenamed("img_id", "j"), "nth").select("i", "j")


ROWS_AT_ONCE = 512
DESCRIPTORS = 4096
NEARLY = 1e-6


def _nearest(left: np.ndarray, right: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of left, ids of right, distances) of each row's two nearest, in order; distances to nine decimals, then ids, decide.

    Products of blocks find who may be among them, up to their rounding error; these few are measured by differences. One table
    of squares is held at a time and worked on in place."""
    squares, out = (right**2).sum(axis=1), []
    for low in range(0, len(left), ROWS_AT_ONCE):
        part = left[low : low + ROWS_AT_ONCE]
        rough = (-2 * part) @ right.T
        rough += squares
        rough += (part**2).sum(axis=1)[:, None]
        own = np.arange(len(part)), rough.argmin(axis=1)
        limit = rough[own]
        if len(right) > 1:  # the second
            rough[own] = np.inf
            first, limit = limit, rough.min(axis=1)
            rough[own] = first
        limit = np.sqrt(np.maximum(limit, 0))
        rows, columns = np.nonzero(rough <= ((limit + NEARLY * (1 + limit)) ** 2)[:, None])
        exact = np.round(np.sqrt(((part[rows] - right[columns]) ** 2).sum(axis=1)), 9)
        order = np.lexsort((ids[columns], exact, rows))
        rows, columns, exact = rows[order], columns[order], exact[order]
        two = np.arange(len(rows)) - np.searchsorted(rows, rows) < 2
        out.append((low + rows[two], ids[columns[two]], exact[two]))
    return tuple(np.concatenate(c) for c in zip(*out))


def two_nearest(desc: DataFrame, pairs: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(i, j, a, b, place, dist): for each keypoint a of i its two nearest of j. queries: (i, j, a), if not all are asked for.

    An image's descriptors travel in blocks of about DESCRIPTORS, so a pair of images is a few rows with two blocks each, and
    not a row for each pair of keypoints; the nearest of all blocks of j are the nearest.
    """
    counts = desc.groupBy("img_id").agg(F.ceil(F.count(F.lit(1)) / DESCRIPTORS).cast("int").alias("parts"))  # a row for each image
    part = F.pmod(F.xxhash64("kp_id"), F.col("parts")).alias("part")
    dealt = desc.join(F.broadcast(counts), "img_id").select("img_id", part, "kp_id", F.col("desc").cast("array<double>").alias("v"))
    blocks = dealt.groupBy("img_id", "part").agg(F.sort_array(F.collect_list(F.struct("kp_id", "v"))).alias("rows"))
    sides = [blocks.select(F.col("img_id").alias(k), F.col("rows.kp_id").alias(f"{k}_ids"), F.flatten("rows.v").alias(f"{k}_rows")) for k in "ij"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                i, j, left_ids, left, right_ids, right = (c[at].values.to_numpy() if k > 1 else c[at].as_py() for k, c in enumerate(batch.columns))
                rows, b, dist = _nearest(left.reshape(len(left_ids), -1), right.reshape(len(right_ids), -1), right_ids)
                columns = [np.full(len(rows), i), np.full(len(rows), j), left_ids[rows], b]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns), pa.array(dist)], ["i", "j", "a", "b", "dist"])

    met = pairs.join(sides[0], "i").join(sides[1], "j").select("i", "j", "i_ids", "i_rows", "j_ids", "j_rows")
    if queries is not None:  # these take the place of the whole image
        asked = queries.join(dealt.select(F.col("img_id").alias("i"), F.col("kp_id").alias("a"), "v"), ["i", "a"])
        deal = F.floor(F.pmod(F.xxhash64("a"), F.lit(1 << 20)) / F.lit(1 << 20) * F.ceil(F.count(F.lit(1)).over(Window.partitionBy("i", "j")) / DESCRIPTORS))
        own = asked.withColumn("deal", deal).groupBy("i", "j", "deal").agg(F.sort_array(F.collect_list(F.struct("a", "v"))).alias("rows"))
        met = own.select("i", "j", F.col("rows.a").alias("i_ids"), F.flatten("rows.v").alias("i_rows")).join(sides[1], "j").select("i", "j", "i_ids", "i_rows", "j_ids", "j_rows")
    found = met.mapInArrow(run, "i int, j int, a int, b int, dist double")
    two = found.groupBy("i", "j", "a").agg(F.slice(F.sort_array(F.collect_list(F.struct("dist", "b"))), 1, 2).alias("two"))  # two of each block
    return two.select("i", "j", "a", F.posexplode("two").alias("nth", "hit")).select("i", "j", "a", "hit.b", (F.col("nth") + 1).alias("place"), "hit.dist")


def ratio_test(nearest: DataFrame, ratio: float) -> DataFrame:
    """(i, j, a, b, dist): the nearest, where it is nearer than ratio times the second. One candidate is not enough."""
    best = F.min_by(F.struct("b", "dist"), "place")
    both = nearest.groupBy("i", "j", "a").agg(best.alias("best"), F.max_by("dist", "place").alias("second"), F.count(F.lit(1)).alias("n"))
    return both.where((F.col("n") == 2) & (F.col("best.dist") < ratio * F.col("second"))).select("i", "j", "a", "best.b", "best.dist")


def unique_by_distance(matches: DataFrame) -> DataFrame:
    """One match for each b: the nearest, then the smallest a. As each a has one match, this is the greedy choice."""
    order = Window.partitionBy("i", "j", "b").orderBy("dist", "a")
    return matches.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def mutual(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """The forward matches that the other direction has too; backward rows are (i, j, a, b) with a of the later image i."""
    swapped = backward.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("b").alias("a"), F.col("a").alias("b"))
    return forward.join(swapped, ["i", "j", "a", "b"], "left_semi")


def mutual_within(forward: DataFrame, backward: DataFrame, slack: int = 1) -> DataFrame:
    """The forward matches whose b has a backward match within `slack` of a; for keypoints in an order, such as contours."""
    f = forward.alias("f")
    r = backward.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("b").alias("a"), F.col("a").alias("b")).alias("r")
    same = (F.col("f.i") == F.col("r.i")) & (F.col("f.j") == F.col("r.j")) & (F.col("f.b") == F.col("r.b"))
    return f.join(r, same & (F.abs(F.col("f.a") - F.col("r.a")) <= slack), "left_semi")


def unique_in_order(matches: DataFrame) -> DataFrame:
    """Matches (i, j, a, b, nth) whose a and b are both still free, in the order of nth; one pair of images is one group."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        seen_a, seen_b, keep = set(), set(), []
        group = group.sort_values(["nth", "a", "b"])
        for a, b in zip(group["a"], group["b"]):
            keep.append(a not in seen_a and b not in seen_b)
            if keep[-1]:
                seen_a.add(a)
                seen_b.add(b)
        return group[keep]

    return matches.groupBy("i", "j").applyInPandas(run, matches.schema)


#: Edges that are left to one sequential pass for each pair of images; rounds take care of all others.
FEW_EDGES = 200_000


def unique_greedy(matches: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """Of matches (i, j, a, b, dist), several for an a or b, those that a pass by (dist, a, b) keeps if it takes what is free at both
    ends.

    In each round an edge that is first at both of its ends is kept, as nothing before it can take an end away, and the edges
    at its ends go; the pass would do the same. Random orders need about the logarithm of the edges in rounds. A long chain of
    ever later edges needs as many as it has edges; when `few` edges are left, the pass itself ends it.
    """
    order = F.struct("dist", "a", "b")
    at_a, at_b = ["i", "j", "a"], ["i", "j", "b"]
    open_, kept = cut(matches.select("i", "j", "a", "b", "dist").distinct()), []
    while (n := open_.count()) > few:
        first = open_.withColumn("at_a", F.min(order).over(Window.partitionBy(*at_a))).withColumn("at_b", F.min(order).over(Window.partitionBy(*at_b)))
        won = cut(first.where((F.col("at_a") == order) & (F.col("at_b") == order)).select("i", "j", "a", "b", "dist"))
        kept.append(won)
        open_ = cut(open_.join(won.select(*at_a), at_a, "left_anti").join(won.select(*at_b), at_b, "left_anti"))
    if n:
        nth = F.row_number().over(Window.partitionBy("i", "j").orderBy("dist", "a", "b"))
        kept.append(unique_in_order(open_.withColumn("nth", nth)).select("i", "j", "a", "b", "dist"))
    return reduce(DataFrame.unionByName, kept) if kept else open_


def match_contours(contours: DataFrame, cameras: DataFrame, pairs: DataFrame, most: float = 5.0, least: int = 8, slack: int = 5, most_error: float = 3.0) -> DataFrame:
    """(i, j, a, b) of contour matches both ways, in order along the contour, near their two-view points, of pairs with `least`."""
    turned = pairs.select(F.col("j").alias("i"), F.col("i").alias("j"))
    both = mutual(contour_matches(contours, cameras, pairs, most), contour_matches(contours, cameras, turned, most))
    spots = contours.select("img_id", F.col("idx").alias("kp_id"), "x", "y")
    ordered = with_pixels(monotonic(both.select("i", "j", "a", "b"), slack), spots).select("i", "j", "a", "b", "xi", "yi", "xj", "yj")
    return enough(near_both(ordered, cameras, most_error).select("i", "j", "a", "b"), least)


def match_descriptors(desc: DataFrame, pairs: DataFrame, ratio: float = 0.8, both_ways: bool = True) -> DataFrame:
    found = unique_by_distance(ratio_test(two_nearest(desc, pairs), ratio))
    if both_ways:
        turned = pairs.select(F.col("j").alias("i"), F.col("i").alias("j"))
        found = mutual(found, unique_by_distance(ratio_test(two_nearest(desc, turned), ratio)))
    return found


def fundamental(cameras: DataFrame, pairs: DataFrame) -> DataFrame:
    """(i, j, f00..f22): x_j^T F x_i = 0, scaled to norm 1; from calibrated cameras without skew."""
    names = [c for c in cameras.columns if c != "img_id"]
    a = cameras.select(F.col("img_id").alias("i"), *[F.col(c).alias(f"i_{c}") for c in names])
    b = cameras.select(F.col("img_id").alias("j"), *[F.col(c).alias(f"j_{c}") for c in names])
    spots = [(r, c) for r in range(3) for c in range(3)]
    lens = [f"{k}_{n}" for k in "ij" for n in ("fx", "fy", "cx", "cy")]
    turned = times(rotation("j_"), transposed(rotation("i_")))
    moved = [t - dot(row, vector("i_t")) for t, row in zip(vector("j_t"), turned)]
    posed = once(pairs.join(a, "i").join(b, "j"), ["i", "j", *lens], {f"q{r}{c}": turned[r][c] for r, c in spots} | {f"t{k}": m for k, m in enumerate(moved)})
    columns = [cross([F.col(f"t{k}") for k in range(3)], [F.col(f"q{r}{c}") for r in range(3)]) for c in range(3)]
    essential = once(posed, ["i", "j", *lens], {f"e{r}{c}": columns[c][r] for r, c in spots})

    def unlensed(side: str, v: list[Column]) -> list[Column]:
        """The transposed inverse of K times a vector."""
        fx, fy, cx, cy = (F.col(f"{side}_{n}") for n in ("fx", "fy", "cx", "cy"))
        return [v[0] / fx, v[1] / fy, v[2] - cx / fx * v[0] - cy / fy * v[1]]

    left = [unlensed("j", [F.col(f"e{r}{c}") for r in range(3)]) for c in range(3)]
    half = once(essential, ["i", "j", *lens], {f"h{r}{c}": left[c][r] for r, c in spots})
    right = [unlensed("i", [F.col(f"h{r}{c}") for c in range(3)]) for r in range(3)]
    raw = once(half, ["i", "j"], {f"g{r}{c}": right[r][c] for r, c in spots})
    size = norm([F.col(f"g{r}{c}") for r, c in spots]) + 1e-12
    return once(raw, ["i", "j"], {f"f{r}{c}": F.col(f"g{r}{c}") / size for r, c in spots})


def epipolar_distance(xi: Column, yi: Column, xj: Column, yj: Column) -> Column:
    """Mean distance of both points to the other's line; needs the columns f00..f22."""
    f = [[F.col(f"f{r}{c}") for c in range(3)] for r in range(3)]
    one = F.lit(1.0)
    line_j = [dot(row, (xi, yi, one)) for row in f]
    line_i = [dot(column, (xj, yj, one)) for column in zip(*f)]
    to_j = F.abs(dot(line_j, (xj, yj, one))) / (F.sqrt(line_j[0] * line_j[0] + line_j[1] * line_j[1]) + 1e-12)
    to_i = F.abs(dot(line_i, (xi, yi, one))) / (F.sqrt(line_i[0] * line_i[0] + line_i[1] * line_i[1]) + 1e-12)
    return (to_i + to_j) / 2


def with_pixels(matches: DataFrame, kps: DataFrame) -> DataFrame:
    """matches with xi, yi, xj, yj."""
    a = kps.select(F.col("img_id").alias("i"), F.col("kp_id").alias("a"), F.col("x").alias("xi"), F.col("y").alias("yi"))
    b = kps.select(F.col("img_id").alias("j"), F.col("kp_id").alias("b"), F.col("x").alias("xj"), F.col("y").alias("yj"))
    return matches.join(a, ["i", "a"]).join(b, ["j", "b"])


def epipolar_filter(matches: DataFrame, kps: DataFrame, cameras: DataFrame, most: float = 3.0) -> DataFrame:
    """(i, j, a, b, epipolar) of matches nearer than `most` to their epipolar lines."""
    pairs = matches.select("i", "j").distinct()
    measured = with_pixels(matches, kps).join(fundamental(cameras, pairs), ["i", "j"])
    far = epipolar_distance(*[F.col(c) for c in ("xi", "yi", "xj", "yj")])
    return measured.select("i", "j", "a", "b", far.alias("epipolar")).where(F.col("epipolar") < most)


def pair_scores(matches: DataFrame) -> DataFrame:
    return matches.groupBy("i", "j").agg(F.count(F.lit(1)).alias("score"))


def enough(matches: DataFrame, least: int) -> DataFrame:
    """Matches of the pairs that have at least `least`."""
    return matches.join(pair_scores(matches).where(F.col("score") >= least).select("i", "j"), ["i", "j"], "left_semi")


def initial_pair(scores: DataFrame, least: int = 8, contour_only: DataFrame | None = None) -> DataFrame:
    """The pair with the highest score, the first of equals; no row if none has `least`. Of equals, pairs of contour_only (i, j), which
    have matches of contours alone, come after all others."""
    if contour_only is not None:
        scores = scores.join(contour_only.select("i", "j", F.lit(1).alias("late")).distinct(), ["i", "j"], "left")
    late = [] if contour_only is None else [F.coalesce("late", F.lit(0))]
    return scores.where(F.col("score") >= least).orderBy(F.desc("score"), *late, "i", "j").limit(1).drop("late")


def monotonic(matches: DataFrame, slack: int = 5) -> DataFrame:
    """Matches in the order of a whose b isn't more than slack below the largest b so far (dropped ones included)."""
    before = Window.partitionBy("i", "j").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    most = F.max("b").over(before)
    return matches.withColumn("most", most).where(F.col("most").isNull() | (F.col("b") >= F.col("most") - slack)).drop("most")


def contour_matches(contours: DataFrame, cameras: DataFrame, pairs: DataFrame, most: float = 5.0) -> DataFrame:
    """(i, j, a, b, dist): for each contour point of i the point of j nearest to its line, under `most`; the first a to choose
    a b keeps it. contours: (img_id, idx, x, y), short lists for each image."""
    a = contours.select(F.col("img_id").alias("i"), F.col("idx").alias("a"), F.col("x").alias("xi"), F.col("y").alias("yi"))
    b = contours.select(F.col("img_id").alias("j"), F.col("idx").alias("b"), F.col("x").alias("xj"), F.col("y").alias("yj"))
    f = [[F.col(f"f{r}{c}") for c in range(3)] for r in range(3)]
    line = [dot(row, (F.col("xi"), F.col("yi"), F.lit(1.0))) for row in f]
    lined = fundamental(cameras, pairs).join(a, "i").select("i", "j", "a", *[x.alias(f"l{k}") for k, x in enumerate(line)])
    far = F.abs(F.col("l0") * F.col("xj") + F.col("l1") * F.col("yj") + F.col("l2")) / (F.sqrt(F.col("l0") * F.col("l0") + F.col("l1") * F.col("l1")) + 1e-12)
    near = lined.join(b, "j").select("i", "j", "a", "b", F.round(far, 9).alias("dist")).where(F.col("dist") < most)
    best = near.groupBy("i", "j", "a").agg(F.min(F.struct("dist", "b")).alias("m")).select("i", "j", "a", "m.b", "m.dist")
    first = F.row_number().over(Window.partitionBy("i", "j", "b").orderBy("a"))
    return best.withColumn("nth", first).where("nth = 1").drop("nth")


def merge_contours(matches: DataFrame, kps: DataFrame, contours: DataFrame, contour: DataFrame, near: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """(keypoints, matches) with contour points after each image's keypoints. A contour match goes if an earlier match of its
    pair has its keypoint of i within `near` pixels; both are looked up by grid cells of that size."""
    offset = kps.groupBy("img_id").agg((F.max("kp_id") + 1).alias("offset"))
    added = contours.join(offset, "img_id", "left").select("img_id", (F.coalesce("offset", F.lit(0)) + F.col("idx")).cast("int").alias("kp_id"), "x", "y")
    spot = contours.select(F.col("img_id").alias("i"), F.col("idx").alias("a"), F.col("x").alias("xi"), F.col("y").alias("yi"))
    placed = contour.join(spot, ["i", "a"])
    cells = placed.withColumn("gx", F.floor(F.col("xi") / near)).withColumn("gy", F.floor(F.col("yi") / near))
    at = matches.join(kps.select(F.col("img_id").alias("i"), F.col("kp_id").alias("a"), F.col("x").alias("px"), F.col("y").alias("py")), ["i", "a"])
    around = at.select("i", "j", "px", "py", F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("dx")).select("*", F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("dy"))
    around = around.select("i", "j", "px", "py", (F.floor(F.col("px") / near) + F.col("dx")).alias("gx"), (F.floor(F.col("py") / near) + F.col("dy")).alias("gy"))
    l, r = cells.alias("l"), around.alias("r")
    away = F.sqrt((F.col("l.xi") - F.col("r.px")) * (F.col("l.xi") - F.col("r.px")) + (F.col("l.yi") - F.col("r.py")) * (F.col("l.yi") - F.col("r.py")))
    same = (F.col("l.i") == F.col("r.i")) & (F.col("l.j") == F.col("r.j")) & (F.col("l.gx") == F.col("r.gx")) & (F.col("l.gy") == F.col("r.gy"))
    fresh = l.join(r, same & (away < near), "left_anti").select("l.i", "l.j", "l.a", "l.b")
    oi, oj = (offset.select(F.col("img_id").alias(k), F.col("offset").alias(f"o{k}")) for k in "ij")
    moved = fresh.join(oi, "i", "left").join(oj, "j", "left").select("i", "j", (F.col("a") + F.coalesce("oi", F.lit(0))).cast("int").alias("a"), (F.col("b") + F.coalesce("oj", F.lit(0))).cast("int").alias("b"))
    return kps.select("img_id", "kp_id", "x", "y").unionByName(added), matches.select("i", "j", "a", "b").unionByName(moved)


def in_mask(kps: DataFrame, runs: DataFrame, width: int, height: int, margin: int = 0) -> DataFrame:
    """Keypoints whose rounded, clipped pixel lies in a mask run (img_id, v, u0, u1) widened by margin; numbered anew as new_id."""
    u = F.greatest(F.lit(0), F.least(F.lit(width - 1), F.rint("x").cast("int")))
    v = F.greatest(F.lit(0), F.least(F.lit(height - 1), F.rint("y").cast("int")))
    k = kps.withColumn("pu", u).withColumn("pv", v).alias("k")
    r = runs.alias("r")
    inside = (F.col("k.img_id") == F.col("r.img_id")) & (F.col("k.pv") == F.col("r.v")) & F.col("k.pu").between(F.col("r.u0") - margin, F.col("r.u1") + margin)
    stay = k.join(r, inside, "left_semi")
    return stay.select("img_id", "kp_id", "x", "y", (F.row_number().over(Window.partitionBy("img_id").orderBy("kp_id")) - 1).alias("new_id"))
