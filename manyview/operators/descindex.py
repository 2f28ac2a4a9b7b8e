"""Nearest descriptors by an index: a forest of random splits as a table of (tree, leaf) keys.

A tree is a list of directions with the medians of a sample along them; a descriptor's leaf has a bit for each, the side it
lies on. Each descriptor is dealt once for each tree. As a query it also visits the leaves behind the splits that it lies nearest
to. What meets in a leaf is compared exactly, and the two nearest of all leaves are kept. So a descriptor travels as often as
there are trees and visits, however many pairs of images there are.

Directions and medians come from a bounded sample (SAMPLE rows); how many leaves a query visits is the least power of two for which
the sample finds its own nearest neighbours often enough. All rows are indexed. Where that takes more than MOST_VISITS visits, or as many as a
tree has leaves, as for rows without any structure, an index moves or compares no less than all pairs do, and those are compared in
blocks. Leaves that hold more than a few blocks, such as
those of many equal descriptors, are dealt in parts, and so are their queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyview.operators.matching import two_nearest

SAMPLE, TRIED = 8_192, 256
LEAF, TREES, RECALL = 1_024, 8, 0.97
#: Leaves that a query visits in all trees; where more are needed, blocks are compared.
MOST_VISITS = 64
#: Leaves' worth of rows that one task compares with as many queries.
BLOCKS = 4


@dataclass
class Forest:
    """directions (trees, splits, size) and medians (trees, splits); probes: leaves of each tree that a query visits."""

    directions: np.ndarray
    medians: np.ndarray
    probes: int

    def sides(self, rows: np.ndarray) -> np.ndarray:
        """(trees, rows, splits): how far behind each split a row lies; before it if negative."""
        return np.einsum("rd,tsd->trs", rows, self.directions) - self.medians[:, None]

    def visited(self, rows: np.ndarray, probes: int) -> np.ndarray:
        """(trees, rows, visits): leaves in the order of what it costs to cross to them, the row's own first."""
        gaps = self.sides(rows)
        trees, n, splits = gaps.shape
        leaves, costs = np.zeros((trees, n, 1), np.int64), np.zeros((trees, n, 1))
        for k in range(splits):
            own = (gaps[..., k] > 0).astype(np.int64)[..., None] << k
            leaves = np.concatenate([leaves | own, leaves | (own ^ (1 << k))], -1)
            costs = np.concatenate([costs, costs + gaps[..., k, None] ** 2], -1)
            if leaves.shape[-1] > probes:
                order = np.argsort(costs, axis=-1, kind="stable")[..., :probes]
                leaves, costs = np.take_along_axis(leaves, order, -1), np.take_along_axis(costs, order, -1)
        return leaves

    def recall(self, rows: np.ndarray, probes: int) -> float:
        """Of the first rows as queries, the share whose nearest other row one of the trees brings them to."""
        queries = rows[:TRIED]
        far = (queries**2).sum(1)[:, None] + (rows**2).sum(1) - 2 * queries @ rows.T
        far[np.arange(len(queries)), np.arange(len(queries))] = np.inf
        nearest = far.argmin(1)
        homes = self.visited(rows, 1)[..., 0]
        return float((self.visited(queries, probes) == homes[:, nearest][..., None]).any((0, 2)).mean())


def grown(desc: DataFrame, trees: int = TREES, leaf: int = LEAF, wanted: float = RECALL, seed: int = 7) -> Forest:
    """A forest for desc (img_id, kp_id, desc), with leaves of about `leaf` rows."""
    n = desc.count()
    some = desc.orderBy(F.xxhash64("img_id", "kp_id"), "img_id", "kp_id").limit(SAMPLE).select("desc").collect()  # a bounded sample
    rows = np.array([r["desc"] for r in some], np.float64) if some else np.zeros((0, 1))
    splits = max(0, int(np.ceil(np.log2(max(n, 1) / leaf)))) if len(some) else 0
    rng = np.random.default_rng(seed)
    directions = rng.normal(size=(trees, splits, rows.shape[1]))
    directions /= np.maximum(np.linalg.norm(directions, axis=-1, keepdims=True), 1e-300)
    forest = Forest(directions, np.median(np.einsum("rd,tsd->trs", rows, directions), axis=1) if len(some) else np.zeros((trees, splits)), 1)
    while forest.probes < 1 << splits and forest.recall(rows, forest.probes) < wanted:
        forest.probes *= 2
    return forest


def _dealt(desc: DataFrame, forest: Forest, visits: int) -> DataFrame:
    """(tree, leaf, img_id, kp_id, v) for each tree and leaf that a row visits."""
    shared = desc.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            leaves = shared.value.visited(rows, visits)  # (trees, rows, visits)
            for tree, of in enumerate(leaves):
                take = pa.array(np.repeat(np.arange(batch.num_rows), of.shape[1]))
                copies = [c.take(take) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(take), tree, np.int32)), pa.array(of.ravel()), *copies], ["tree", "leaf", "img_id", "kp_id", "v"])

    plain = desc.select("img_id", "kp_id", F.col("desc").cast("array<double>").alias("v"))
    return plain.mapInArrow(run, "tree int, leaf long, img_id int, kp_id int, v array<double>")


def _compared(base: pa.Table, queries: pa.Table) -> pa.Table:
    """The two nearest rows of each other image for every query of a leaf's part."""
    out: list[list[np.ndarray]] = [[] for _ in range(5)]
    if base.num_rows and queries.num_rows:
        base = base.sort_by([("img_id", "ascending"), ("kp_id", "ascending")])
        images, ids, rows = np.asarray(base["img_id"]), np.asarray(base["kp_id"]), np.array(base["v"].to_pylist())
        q_images, q_ids, q_rows = np.asarray(queries["img_id"]), np.asarray(queries["kp_id"]), np.array(queries["v"].to_pylist())
        rough = (q_rows**2).sum(1)[:, None] + (rows**2).sum(1) - 2 * q_rows @ rows.T
        bounds = np.flatnonzero(np.diff(images, prepend=images[0] - 1, append=images[-1] + 1))
        for low, high in zip(bounds, bounds[1:]):
            part = rough[:, low:high]
            limit = np.partition(part, min(1, high - low - 1), axis=1)[:, min(1, high - low - 1)]
            at, column = np.nonzero((part <= limit[:, None] + 1e-6 * (1 + np.abs(limit[:, None]))) & (q_images != images[low])[:, None])
            column = column + low
            far = np.round(np.sqrt(((q_rows[at] - rows[column]) ** 2).sum(1)), 9)
            order = np.lexsort((ids[column], far, at))
            at, column, far = at[order], column[order], far[order]
            two = np.arange(len(at)) - np.searchsorted(at, at) < 2
            for o, x in zip(out, (q_images[at], np.full(len(at), images[low]), q_ids[at], ids[column], far)):
                o.append(x[two])
    kinds = [pa.int32()] * 4 + [pa.float64()]
    return pa.table([pa.array(np.concatenate(o) if o else [], t) for o, t in zip(out, kinds)], names=["i", "j", "a", "b", "dist"])


def two_nearest_indexed(desc: DataFrame, pairs: DataFrame, trees: int = TREES, leaf: int = LEAF, wanted: float = RECALL) -> DataFrame:
    """(i, j, a, b, place, dist) as matching.two_nearest has them, for pairs (i, j), but for the neighbours that no leaf shows."""
    forest = grown(desc, trees, leaf, wanted)
    if trees * forest.probes > min(MOST_VISITS, 1 << forest.medians.shape[1]):
        return two_nearest(desc, pairs)
    base, queries = _dealt(desc, forest, 1), _dealt(desc, forest, forest.probes)
    most, key = BLOCKS * leaf, ["tree", "leaf"]
    parts = base.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts"))
    shares = queries.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("shares"))
    large = parts.join(shares, key).where("parts > 1 or shares > 1")  # leaves with several blocks, the others need no table
    dealt = F.pmod(F.xxhash64("img_id", "kp_id"), F.col("count_")).cast("int")

    def placed(rows: DataFrame, own: str, other: str, own_name: str, other_name: str) -> DataFrame:
        joined = rows.join(large, key, "left")
        mine = joined.withColumn("count_", F.coalesce(own, F.lit(1))).withColumn(own_name, dealt)
        return mine.withColumn(other_name, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))).drop("count_", "parts", "shares")

    group = [*key, "part", "share"]
    left, right = placed(base, "parts", "shares", "part", "share"), placed(queries, "shares", "parts", "share", "part")
    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(_compared, "i int, j int, a int, b int, dist double")
    two = found.join(pairs, ["i", "j"], "left_semi").groupBy("i", "j", "a").agg(F.slice(F.sort_array(F.collect_set(F.struct("dist", "b"))), 1, 2).alias("two"))
    return two.select("i", "j", "a", F.posexplode("two").alias("nth", "hit")).select("i", "j", "a", "hit.b", (F.col("nth") + 1).alias("place"), "hit.dist")
