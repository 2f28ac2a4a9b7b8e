"""Exact top-k search by pivot-table elimination (operator 2).

Vectors become integers. PIVOTS vectors that lie far apart, out of a bounded sample, are pivots, and the distances to them bound
inner products from above, in three places:

1. Blocks. Rows are dealt into blocks by their nearest pivot. A block keeps the interval of its distances to each pivot. By the
   triangle inequality the largest gap between two blocks' intervals bounds the distance of any two of their rows from
   below. A query's k-th best score within one block around its own nearest pivot is its first threshold; pairs of blocks whose
   bound is below the thresholds of all queries are dropped before any row is shuffled to meet a query.
2. Candidates of a group of queries: the same gap, between the group's intervals and a candidate's distances.
3. Candidates of one query. Distances to pivots fix where a vector lies along the directions that the pivots span; the greatest lower
   bound that the distances to JOINT of them allow adds the difference of what stands off that span.

Block pairs and, within a pair, candidates are evaluated in the order of their bounds, until the next bound is below the k-th
best score of each query; what is left out can't be among the best, so the result is exact.

Sizes. Pivots and the numbers of rows near each are all that the driver holds. Bounds of block pairs are computed for tiles of at
most TILE by TILE blocks.

Defined results: a null vector, or one with null or non-finite components, takes no part, nor does a null id; candidates
are vectors of the query's length with another id; ties go to the smaller id; repeated rows are repeated candidates; queries
with the same id and vector are one query, those with other vectors have a list each; a query with fewer than k candidates
gets all of them; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from manyview.llm.common import cut, table

TOP = 20
PIVOTS, JOINT, SAMPLE = 256, 48, 4096
SCALE = 64
EVERY = 20
#: Rows of a block; rows for which there is a pivot that blocks gather around, up to all pivots; blocks of a tile.
QUERY_BLOCK, BLOCK, ROWS_PER_CELL, TILE = 1024, 4096, 2048, 2048
GROUP, STEP = 64, 128
FINITE = float("inf")


def quantised(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(scale * x.cast("double")))


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(FINITE)), F.lit(False)))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def _small(matrix: np.ndarray) -> np.ndarray:
    """The narrowest integers that hold the values."""
    low, high = (int(matrix.min()), int(matrix.max())) if matrix.size else (0, 0)
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return np.ascontiguousarray(matrix, kind)


def far_apart(rows: np.ndarray, n: int) -> np.ndarray:
    """At most n of the rows, each as far as can be from those before it; none twice."""
    chosen, away = [0], ((rows - rows[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(rows)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
    return rows[chosen]


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (rows**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


class Pivots:
    """The pivots of each vector length, and the directions that the first JOINT of them span."""

    def __init__(self, sample: list[list[int]], pivots: int, joint: int):
        by_width: dict[int, list] = {}
        for v in sample:
            by_width.setdefault(len(v), []).append(v)
        self.of = {w: far_apart(np.array(v, np.float64).reshape(len(v), w), pivots) for w, v in by_width.items()}
        self.axes = {w: self._axes(p[:joint]) for w, p in self.of.items()}

    @staticmethod
    def _axes(pivots: np.ndarray) -> np.ndarray:
        if not pivots.size:
            return np.zeros((0, pivots.shape[1]))
        _, size, axes = np.linalg.svd(pivots, full_matrices=False)
        return axes[size > 1e-9 * size.max()]

    def __call__(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        nothing = np.zeros((0, width))
        return self.of.get(width, nothing), self.axes.get(width, nothing)


def numbered(rows: DataFrame, pivots: Pivots, cells: int) -> DataFrame:
    """(id, width, cell, kind, v): vectors as bytes, with the number of the nearest of the first `cells` pivots."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            widths = vectors.value_lengths().to_numpy(zero_copy_only=False)
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                flat = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
                matrix = flat.reshape(len(at), width)
                near = shared.value(int(width))[0][:cells]
                cell = distances(matrix.astype(np.float64), near).argmin(axis=1) if len(near) else np.zeros(len(at), np.int64)
                small = _small(matrix)
                values = [pa.array(ids[at], pa.int64()), pa.array(np.full(len(at), width, np.int32)), pa.array(cell.astype(np.int32))]
                values += [pa.array([small.dtype.str] * len(at)), pa.array([x.tobytes() for x in small], pa.binary())]
                yield pa.RecordBatch.from_arrays(values, ["id", "width", "cell", "kind", "v"])

    return rows.select("id", "v").mapInArrow(run, "id long, width int, cell int, kind string, v binary")


BLOCKS = "width int, cell int, n int, ids binary, kind string, rows binary, low binary, high binary, most double"
_BLOCKS = pa.schema({"width": pa.int32(), "cell": pa.int32(), "n": pa.int32(), "ids": pa.binary(), "kind": pa.string(), "rows": pa.binary(), "low": pa.binary(), "high": pa.binary(), "most": pa.float64()})


def blocks(rows: DataFrame, pivots: Pivots, size: int) -> DataFrame:
    """Rows of `numbered` as blocks of at most `size` rows around one pivot, with the intervals of their distances to all pivots.

    Cells of more than `size` rows are split by a hash of the id, so that a cell that holds most rows is many blocks. There are
    at most as many numbers of rows as sampled vectors.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(pivots)
    few = F.when(F.col("width").isin(list(pivots.of)), F.col("width")).otherwise(F.lit(-1)) if pivots.of else F.lit(-1)
    counts = rows.groupBy(few.alias("of"), "cell").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > size)
    parts = spark.createDataFrame([(r["of"], r["cell"], -(-r["rows"] // size)) for r in counts.collect()], "of int, of_cell int, parts int")
    split = rows.withColumn("few", few).join(F.broadcast(parts), (F.col("few") == F.col("of")) & (F.col("cell") == F.col("of_cell")), "left")
    dealt = split.withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")).repartition("width", "cell", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def block(at: tuple) -> pa.RecordBatch:
            ids, vectors = zip(*held.pop(at))
            matrix = _small(np.stack(vectors) if at[0] else np.zeros((len(ids), 0), np.int8))
            away = distances(matrix.astype(np.float64), shared.value(at[0])[0])
            low, high = away.min(axis=0).astype(np.float32), away.max(axis=0).astype(np.float32)
            most = float((matrix.astype(np.float64) ** 2).sum(axis=1).max())
            values = [at[0], at[1], len(ids), np.array(ids, np.int64).tobytes(), matrix.dtype.str, matrix.tobytes(), low.tobytes(), high.tobytes(), most]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _BLOCKS)], schema=_BLOCKS)

        for batch in batches:
            for i, width, cell, part, kind, v in zip(*(c.to_pylist() for c in batch.columns)):
                at = (width, cell, part)
                held.setdefault(at, []).append((i, np.frombuffer(v, kind)))
                if len(held[at]) == size:
                    yield block(at)
        for at in list(held):
            yield block(at)

    return dealt.select("id", "width", "cell", "part", "kind", "v").mapInArrow(run, BLOCKS).withColumn("block", F.monotonically_increasing_id())


class Block:
    def __init__(self, width: int, kind: str, ids: bytes, rows: bytes, pivots: Pivots):
        self.ids = np.frombuffer(ids, np.int64)
        self.whole = np.frombuffer(rows, kind).reshape(len(self.ids), width)
        rows_ = self.whole.astype(np.float64)
        self.squares = (rows_**2).sum(axis=1)
        at, axes = pivots(width)
        self.away = distances(rows_, at).astype(np.float32)
        self.along = rows_ @ axes.T
        self.off = np.sqrt(np.maximum(self.squares - (self.along**2).sum(axis=1), 0))
        self.along = self.along.astype(np.float32)
        self.most = float(np.abs(rows_).max(initial=0))

    def exact(self, other: Block) -> str | type:
        """The type in which inner products of rows of the two are exact."""
        reach = self.most * other.most * max(1, self.whole.shape[1])
        return np.float32 if reach < 2**24 else np.float64 if reach < 2**52 else object


def gaps(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """The largest gap, over pivots, between each interval of the first and each of the second."""
    out = np.zeros((len(low), len(lows)), np.float32)
    for p in range(low.shape[1]):
        np.maximum(out, low[:, p, None] - highs[None, :, p], out=out)
        np.maximum(out, lows[None, :, p] - high[:, p, None], out=out)
    return np.maximum(out - 1e-5 * (1 + float(max(high.max(initial=0), highs.max(initial=0)))), 0).astype(np.float64)  # what rounding may have added


class Search:
    """The best k so far of each query of a block: score and id, best first, and `kth`, which a candidate has to reach."""

    def __init__(self, queries: Block, k: int, kth: np.ndarray | None = None):
        self.queries, self.k = queries, k
        self.kth = np.full(len(queries.ids), -np.inf) if kth is None else kth.copy()
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries.ids)
        self.evaluated = np.zeros(len(queries.ids), np.int64)

    def meet(self, candidates: Block) -> None:
        """Brings the best up to date with a block of candidates: each query goes down the order of its bounds until it is done."""
        queries, kind = self.queries, self.queries.exact(candidates)
        rows, own = candidates.whole.astype(kind), queries.whole.astype(kind)
        for low in range(0, len(queries.ids), GROUP):
            part = slice(low, low + GROUP)
            away, squares = queries.away[part], queries.squares[part]
            near = gaps(away.min(axis=0)[None], away.max(axis=0)[None], candidates.away, candidates.away)[0]
            lengths = squares.max() + candidates.squares
            at = np.flatnonzero((lengths - near**2) / 2 + 1e-9 * lengths + 1e-6 >= self.kth[part].min())
            most = queries.along[part] @ candidates.along[at].T + queries.off[part, None] * candidates.off[None, at]
            most += 2e-5 * (1 + np.sqrt(squares[:, None] * candidates.squares[None, at]))  # what rounding may have taken
            for q in range(len(squares)):
                open_ = np.flatnonzero(most[q] >= self.kth[low + q])
                self._descend(low + q, own[low + q], open_[np.argsort(-most[q, open_])], most[q], at, candidates, rows)

    def _descend(self, q: int, query: np.ndarray, order: np.ndarray, most: np.ndarray, at: np.ndarray, candidates: Block, rows: np.ndarray) -> None:
        for begin in range(0, len(order), STEP):
            some = order[begin : begin + STEP]
            if most[some[0]] < self.kth[q]:
                return
            scores, ids = (rows[at[some]] @ query).astype(np.int64), candidates.ids[at[some]]
            self.evaluated[q] += len(some)
            new = np.flatnonzero((scores >= self.kth[q]) & (ids != self.queries.ids[q]))
            if len(new):
                both, names = np.concatenate([self.best[q][0], scores[new]]), np.concatenate([self.best[q][1], ids[new]])
                first = np.lexsort((names, -both))[: self.k]
                self.best[q] = (both[first], names[first])
                if len(first) == self.k:
                    self.kth[q] = max(self.kth[q], both[first][-1])


def with_thresholds(asked: DataFrame, held: DataFrame, pivots: Pivots, k: int) -> DataFrame:
    """asked with kth: for each query the k-th best score in one block of its cell (minus infinity where there are fewer)."""
    shared = asked.sparkSession.sparkContext.broadcast(pivots)
    home = held.groupBy("width", "cell").agg(F.max(F.struct("n", "block")).alias("of")).select("of.block")
    home = held.join(home, "block").select("width", "cell", F.col("kind").alias("home_kind"), F.col("ids").alias("home_ids"), F.col("rows").alias("home_rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                search = Search(Block(row["width"], row["kind"], row["ids"], row["rows"], shared.value), k)
                if row["home_ids"] is not None:
                    search.meet(Block(row["width"], row["home_kind"], row["home_ids"], row["home_rows"], shared.value))
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), pa.array([search.kth.tobytes()]), pa.array([float(search.kth.min())])], ["block", "kth", "least"])

    rows = asked.join(home, ["width", "cell"], "left").select("block", "width", "kind", "ids", "rows", "home_kind", "home_ids", "home_rows")
    return asked.join(rows.repartition("block").mapInArrow(run, "block long, kth binary, least double"), "block")


def open_pairs(asked: DataFrame, held: DataFrame) -> DataFrame:
    """(q_block, block, bound): the pairs of blocks whose bound reaches the least threshold of the queries."""
    tiles = [max(1, -(-x.count() // TILE)) for x in (asked, held)]

    def meta(df: DataFrame, n: int, other: int, own: str, *more: str) -> DataFrame:
        share = F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
        met = df.select("width", share.alias(own), "block", "low", "high", "most", *more)
        return met.withColumn("q_tile" if own == "tile" else "tile", F.explode(F.sequence(F.lit(0), F.lit(other - 1))))

    def run(queries: pd.DataFrame, blocks_: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(blocks_):
            return pd.DataFrame({"q_block": pd.Series(dtype="int64"), "block": pd.Series(dtype="int64"), "bound": pd.Series(dtype="float64")})
        low, high, lows, highs = (np.stack([np.frombuffer(x, np.float32) for x in s]) for s in (queries["low"], queries["high"], blocks_["low"], blocks_["high"]))
        lengths = queries["most"].to_numpy()[:, None] + blocks_["most"].to_numpy()[None, :]
        bound = (lengths - gaps(low, high, lows, highs) ** 2) / 2 + 1e-9 * lengths + 1e-6
        at, other = np.nonzero(bound >= queries["least"].to_numpy()[:, None])
        return pd.DataFrame({"q_block": queries["block"].to_numpy()[at], "block": blocks_["block"].to_numpy()[other], "bound": bound[at, other]})

    keys = ["width", "q_tile", "tile"]
    left, right = meta(asked, tiles[0], tiles[1], "q_tile", "least"), meta(held, tiles[1], tiles[0], "tile")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "q_block long, block long, bound double")


def top_k(rows: DataFrame, queries: DataFrame, k: int = TOP, pivots: int = PIVOTS, joint: int = JOINT) -> DataFrame:
    """(query_id, rank, vec_id, score, evaluated) of the k largest inner products of each query; both inputs: (id, v) with v
    array<long>. evaluated: how many inner products the query took, beside those for its first threshold."""
    spark = rows.sparkSession
    # At most SAMPLE rows:
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]
    table_ = Pivots(sample, pivots, joint)
    shared = spark.sparkContext.broadcast(table_)
    cells = max(1, min(pivots, rows.count() // ROWS_PER_CELL))
    held = cut(blocks(numbered(rows, table_, cells), table_, BLOCK))
    asked = cut(blocks(numbered(queries.select("id", "v").distinct(), table_, cells), table_, QUERY_BLOCK))
    asked = cut(with_thresholds(asked, held, table_, k))
    pairs = cut(open_pairs(asked, held))
    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // max(1, asked.count()))
    met = pairs.join(held.select("block", "width", "kind", "ids", "rows"), "block")
    met = met.join(asked.select(F.col("block").alias("q_block"), F.col("kind").alias("q_kind"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), "kth"), "q_block")
    met = met.withColumn("share", F.pmod(F.xxhash64("block"), F.lit(spread)))
    met = met.repartition("q_block", "share").sortWithinPartitions("q_block", "share", F.col("bound").desc())
    met = met.select("q_block", "share", "bound", "width", "q_kind", "q_ids", "q_rows", "kth", "kind", "ids", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, search = None, None

        def found() -> pa.RecordBatch:
            size = [max(1, len(s)) for s, _ in search.best]
            flat = lambda i, none: np.concatenate([x[i] if len(x[i]) else [none] for x in search.best])
            who, nth, cost = (np.repeat(x, size) for x in (search.queries.ids, np.arange(len(size)), search.evaluated))
            empty = np.repeat([not len(s) for s, _ in search.best], size)
            columns = [pa.array(who), pa.array(np.full(len(who), now[0])), pa.array(nth), pa.array(flat(1, 0).astype(np.int64), mask=empty), pa.array(flat(0, 0).astype(np.int64), mask=empty)]
            first = np.concatenate([[True], nth[1:] != nth[:-1]])
            return pa.RecordBatch.from_arrays([*columns, pa.array(np.where(first, cost, 0))], ["query_id", "q_block", "nth", "vec_id", "score", "evaluated"])

        for batch in batches:
            for row in batch.to_pylist():
                if (row["q_block"], row["share"]) != now:
                    if search:
                        yield found()
                    now = (row["q_block"], row["share"])
                    search = Search(Block(row["width"], row["q_kind"], row["q_ids"], row["q_rows"], shared.value), k, np.frombuffer(row["kth"], np.float64))
                if row["bound"] >= search.kth.min():
                    search.meet(Block(row["width"], row["kind"], row["ids"], row["rows"], shared.value))
        if search:
            yield found()

    hits = met.mapInArrow(run, "query_id long, q_block long, nth long, vec_id long, score long, evaluated long")
    # Each share has at most k rows of a query; the k best of them all:
    hit = F.when(F.col("vec_id").isNotNull(), F.struct((-F.col("score")).alias("less"), "vec_id"))
    best = hits.groupBy("query_id", "q_block", "nth").agg(F.slice(F.sort_array(F.collect_list(hit)), 1, k).alias("top"), F.sum("evaluated").alias("evaluated"))
    best = best.select("query_id", "evaluated", F.posexplode("top").alias("at", "hit"))
    return best.select("query_id", (F.col("at") + 1).alias("rank"), "hit.vec_id", (-F.col("hit.less")).alias("score"), "evaluated")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all vectors for each vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    vectors = vectors.select(F.col("vec_id").cast("long").alias("id"), quantised(F.col("embedding"), SCALE).alias("v"))
    return top_k(vectors, vectors.where(F.col("id") % EVERY == 0)).drop("evaluated")


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
