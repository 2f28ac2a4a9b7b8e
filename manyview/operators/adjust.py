"""Bundle adjustment.

Points only (cameras fixed) is separable: each point is a row with the list of its observations, and Arrow batches of
points take Gauss-Newton steps together. The full problem alternates with Spark jobs: tasks eliminate their points' 3x3
blocks and give sums for the reduced camera system, a table of 6x6 blocks that conjugate gradients multiply with vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from manyview.session import cut

INVALID = 1e6
#: Points that one step of numpy takes, and pairs of observations.
POINTS, PAIRS = 2_000, 100_000
#: Blocks that a task adds up, 288 bytes each.
HELD = 40_000
#: Cameras up to which the pairs of all are one product.
DENSE = 60
#: Free cameras up to which the driver adds up the blocks of all tasks, 24 kB each at most.
WINDOW = 8
#: With which an adjustment starts.
DAMPING = 1e-3


def problem(obs: DataFrame, images: list[int], points_cap: int, least_views: int = 2) -> DataFrame:
    """(track_id, img_id, pt_idx, cam_idx): observations in the chosen images of the points with the most of them, relabelled.
    Ties go to the smaller track_id; the cap is the feature, a bound on the work of one adjustment, for those who ask for one."""
    chosen = obs.where(F.col("img_id").isin(images))
    hits = chosen.groupBy("track_id").agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= least_views)
    most = hits.orderBy(F.desc("hits"), "track_id").limit(points_cap)
    numbered = most.select("track_id", (F.row_number().over(Window.orderBy(F.desc("hits"), "track_id")) - 1).alias("pt_idx"))
    place = F.array_position(F.array(*[F.lit(i) for i in images]), F.col("img_id")) - 1
    return chosen.join(numbered, "track_id").select("track_id", "img_id", "pt_idx", place.cast("int").alias("cam_idx"))


def _camera_table(cameras: DataFrame) -> dict[int, dict[str, np.ndarray]]:
    """A row for each image, as arrays."""
    out = {}
    for r in cameras.collect():
        out[r["img_id"]] = {"k": np.array([r["fx"], r["fy"], r["cx"], r["cy"]]), "r": np.array([[r[f"r{i}{j}"] for j in range(3)] for i in range(3)]), "t": np.array([r["tx"], r["ty"], r["tz"]])}
    return out


def rodrigues(w: np.ndarray) -> np.ndarray:
    angle = np.linalg.norm(w)
    if angle < 1e-12:
        return np.eye(3)
    a = w / angle
    s = skew(a)
    return np.eye(3) + np.sin(angle) * s + (1 - np.cos(angle)) * s @ s


def skew(v: np.ndarray) -> np.ndarray:
    """The matrix (or matrices) of the cross product with v (..., 3)."""
    x, y, z = v[..., 0], v[..., 1], v[..., 2]
    zero = np.zeros_like(x)
    return np.stack([np.stack([zero, -z, y], -1), np.stack([z, zero, -x], -1), np.stack([-y, x, zero], -1)], -2)


def linearised(x: np.ndarray, r: np.ndarray, t: np.ndarray, k: np.ndarray, uv: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Residuals (..., 2) of points x (..., 3) in cameras r (..., 3, 3), t (..., 3), k (..., 4: fx, fy, cx, cy), and their derivatives
    by the camera's rotation and translation (..., 2, 6) and by the point (..., 2, 3). A point that no camera has before it
    has residuals INVALID and no derivatives."""
    turned = np.stack([r[..., n, 0] * x[..., 0] + r[..., n, 1] * x[..., 1] + r[..., n, 2] * x[..., 2] for n in range(3)], -1)
    p = turned + t
    fine = p[..., 2] > 1e-9
    depth = np.where(fine, p[..., 2], 1.0)
    fx, fy = k[..., 0] / depth, k[..., 1] / depth
    u, v = p[..., 0] / depth, p[..., 1] / depth
    residual = np.stack([k[..., 0] * u + k[..., 2], k[..., 1] * v + k[..., 3]], -1) - uv
    fx, fy = np.where(fine, fx, 0.0), np.where(fine, fy, 0.0)
    x, y, z = turned[..., 0], turned[..., 1], turned[..., 2]
    of_camera, of_point = np.empty((*fx.shape, 2, 6)), np.empty((*fx.shape, 2, 3))
    for n, column in enumerate((-fx * u * y, fx * (z + u * x), -fx * y, fx, 0.0, -fx * u)):
        of_camera[..., 0, n] = column
    for n, column in enumerate((-fy * (z + v * y), fy * v * x, fy * x, 0.0, fy, -fy * v)):
        of_camera[..., 1, n] = column
    for n in range(3):
        of_point[..., 0, n] = fx * (r[..., 0, n] - u * r[..., 2, n])
        of_point[..., 1, n] = fy * (r[..., 1, n] - v * r[..., 2, n])
    return np.where(fine[..., None], residual, INVALID), of_camera, of_point


#: Of a squared residual over the squared scale: the loss, and its derivative, which is the weight of the residual.
LOSSES = {
    "linear": (lambda z: z, np.ones_like),
    "huber": (lambda z: np.where(z <= 1, z, 2 * np.sqrt(z) - 1), lambda z: np.where(z <= 1, 1.0, 1 / np.sqrt(np.maximum(z, 1)))),
    "soft_l1": (lambda z: 2 * (np.sqrt(1 + z) - 1), lambda z: 1 / np.sqrt(1 + z)),
    "cauchy": (np.log1p, lambda z: 1 / (1 + z)),
    "arctan": (np.arctan, lambda z: 1 / (1 + z * z)),
}


def listed(points: DataFrame, obs: DataFrame) -> DataFrame:
    """(track_id, x, y, z, img, u, v): each point with its observations as arrays, at most one for each image."""
    seen = obs.groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct("img_id", "u", "v"))).alias("seen"))
    return points.select("track_id", "x", "y", "z").join(seen.select("track_id", F.col("seen.img_id").alias("img"), "seen.u", "seen.v"), "track_id")


class Cameras:
    """A table of cameras as stacked arrays, a row for each image."""

    def __init__(self, table: dict[int, dict[str, np.ndarray]]):
        self.images = np.array(sorted(table))
        self.k, self.r, self.t = (np.array([table[i][n] for i in self.images.tolist()]) for n in ("k", "r", "t"))


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows as `listed` gives them, POINTS at once, and their points (n, 3)."""
    for batch in batches:
        for low in range(0, batch.num_rows, POINTS):
            part = batch.slice(low, POINTS)
            yield part, np.stack([part.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3)], 1)


def _triples(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()), pa.array(values.ravel()))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Batch:
    """The observations of some points, one after another; sums over those of each point."""

    def __init__(self, rows: pa.RecordBatch, cameras: Cameras):
        img, *uv = (rows.column(k) for k in (4, 5, 6))
        camera = np.searchsorted(cameras.images, img.flatten().to_numpy(zero_copy_only=False))
        self._set(img.value_lengths().to_numpy(zero_copy_only=False), camera, np.stack([c.flatten().to_numpy(zero_copy_only=False) for c in uv], 1).astype(float))

    def _set(self, sizes: np.ndarray, camera: np.ndarray, uv: np.ndarray) -> None:
        self.sizes, self.camera, self.uv = sizes, camera, uv
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.starts = np.cumsum(sizes) - sizes

    @classmethod
    def of(cls, sizes: np.ndarray, camera: np.ndarray, uv: np.ndarray) -> Batch:
        """From the number of each point's observations, one at least, and their cameras and pixels, point after point."""
        made = cls.__new__(cls)
        made._set(sizes, camera, uv)
        return made

    def summed(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts, axis=0)

    def linearised(self, x: np.ndarray, cameras: Cameras) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = self.camera
        return linearised(x[self.owner], cameras.r[at], cameras.t[at], cameras.k[at], self.uv)


def _costs(residual: np.ndarray, scale: float, loss: str) -> tuple[np.ndarray, np.ndarray]:
    """Cost and weight of each residual."""
    z = (residual**2).sum(axis=-1) / scale**2
    return scale**2 * LOSSES[loss][0](z), LOSSES[loss][1](z)


def _damped(a: np.ndarray, damping: np.ndarray | float, floor: float) -> np.ndarray:
    """Matrices (..., n, n) with their diagonals raised."""
    diagonal = np.einsum("...ii->...i", a)
    return a + np.einsum("...i,ij->...ij", np.asarray(damping)[..., None] * (diagonal + floor), np.eye(a.shape[-1]))


def moved_points(x: np.ndarray, batch: Batch, cameras: Cameras, rounds: int, scale: float, loss: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points after damped Gauss-Newton steps that all take together, each with a damping of its own; costs before and after."""

    def cost(y: np.ndarray) -> np.ndarray:
        return batch.summed(_costs(batch.linearised(y, cameras)[0], scale, loss)[0])

    before = now = cost(x)
    damping, open_ = np.full(len(x), 1e-3), np.ones(len(x), bool)
    for _ in range(rounds):
        if not open_.any():
            break
        r, _, j = batch.linearised(x, cameras)
        w = _costs(r, scale, loss)[1][:, None, None]
        a = batch.summed(w * j.transpose(0, 2, 1) @ j)
        g = batch.summed((w * j.transpose(0, 2, 1) @ r[:, :, None])[..., 0])
        tried = x - np.linalg.solve(_damped(a, damping, 1e-12) + 1e-15 * np.eye(3), g[..., None])[..., 0]
        new = cost(tried)
        better = open_ & (new < now)
        open_ &= ~better | (now - new >= 1e-10 * (1 + new))
        x, now = np.where(better[:, None], tried, x), np.where(better, new, now)
        damping = np.where(better, damping / 3, damping * 5)
    return x, before, now


def points_only(points: DataFrame, obs: DataFrame, cameras: DataFrame, rounds: int = 8, scale: float = 2.0, loss: str = "cauchy") -> DataFrame:
    """(track_id, x, y, z, before, after): points moved to the least robust error under fixed cameras; costs before and after."""
    table = points.sparkSession.sparkContext.broadcast(_camera_table(cameras))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cams = Cameras(table.value)
        for part, x in _sliced(batches):
            x, before, after = moved_points(x, Batch(part, cams), cams, rounds, scale, loss)
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, (*x.T, before, after))], ["track_id", *"xyz", "before", "after"])

    return listed(points, obs).mapInArrow(run, "track_id long, x double, y double, z double, before double, after double")


@dataclass(frozen=True)
class Bounds:
    """How far rotations (as vectors), translations and points may get from where they start; None: as far as they like."""

    rotation: float | None = None
    translation: float | None = None
    point: float | None = None

    def camera(self) -> np.ndarray:
        return np.repeat([np.inf if v is None else v for v in (self.rotation, self.translation)], 3)


def blocked(way: np.ndarray, gone: np.ndarray, reach: np.ndarray | float) -> np.ndarray:
    """Which unknowns stand at their bound and would go beyond it. gone: how far each is from its start; way: where it wants to go."""
    return (np.abs(gone) >= np.asarray(reach) * (1 - 1e-9)) & (way * gone > 0)


def _summed(codes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different codes, and the sums of their rows."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    starts = np.flatnonzero(np.diff(codes, prepend=codes[:1] - 1))
    return codes[starts], np.add.reduceat(values[order], starts, axis=0) if len(starts) else values[:0]


class Reduced:
    """A batch's points eliminated: their damped inverse blocks, gradients, and coupling to the free cameras.

    place: by camera, its number among the free ones, or -1. peak: the largest diagonals of each point's block so far, by which the
    damping scales its columns; start: where the points started.
    """

    def __init__(self, x: np.ndarray, rows: pa.RecordBatch | Batch, cameras: Cameras, place: np.ndarray, damping: float, scale: float, loss: str, peak: np.ndarray, start: np.ndarray, bounds: Bounds):
        self.batch = batch = rows if isinstance(rows, Batch) else Batch(rows, cameras)
        r, jc, jp = batch.linearised(x, cameras)
        costs, w = _costs(r, scale, loss)
        self.cost = float(costs.sum())
        root = np.sqrt(w)[:, None]
        r, jp = r * root, jp * root[:, :, None]
        v = batch.summed(np.einsum("nki,nkj->nij", jp, jp))
        self.peak = np.maximum(peak, np.einsum("nii->ni", v))
        self.g = -batch.summed(np.einsum("nki,nk->ni", jp, r))
        self.start, self.reach = start, np.inf if bounds.point is None else bounds.point
        self.open = ~blocked(self.g, x - start, self.reach)
        v = v * self.open[:, :, None] * self.open[:, None, :] + (damping * (self.peak + 1e-9) + ~self.open)[:, :, None] * np.eye(3)
        self.g = self.g * self.open
        self.inverse = np.linalg.inv(v)
        free = place[batch.camera]
        use = slice(None) if (free >= 0).all() else np.flatnonzero(free >= 0)
        self.at, self.owner = free[use], batch.owner[use]
        self.r, self.jc, self.jp = r[use], jc[use] * root[use][:, :, None], jp[use]

    def blocks(self, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, values of 36): this batch's share of the reduced system, only for pairs of cameras that share points; with j = -1
        of its right side, with j = -2 of the diagonals before the elimination."""
        if not n or not len(self.at):
            return
        w = np.einsum("nki,nkj->nij", self.jc, self.jp) * self.open[self.owner][:, None, :]
        yield from (self._dense if n <= DENSE else self._sparse)(w, n)
        pull = (w @ (self.inverse @ self.g[..., None])[self.owner])[..., 0]
        order = np.argsort(self.at, kind="stable")
        starts = np.flatnonzero(np.diff(self.at[order], prepend=-1))
        at, jc, r = self.at[order][starts], self.jc[order], self.r[order]
        parts = [(jc[s:e].reshape(-1, 6), r[s:e].ravel()) for s, e in zip(starts, [*starts[1:], len(order)])]
        u, gc = np.array([m.T @ m for m, _ in parts]), -np.array([m.T @ e for m, e in parts])
        yield at, at, u.reshape(-1, 36)
        for k, part in ((-1, gc - np.add.reduceat(pull[order], starts, axis=0)), (-2, np.einsum("nii->ni", u))):
            yield at, np.full(len(at), k), np.pad(part, ((0, 0), (0, 30)))

    def _dense(self, w: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """One product for all pairs of a few cameras: -W V W' with V = L L' is the product of -W L with its own transpose."""
        try:
            half = np.linalg.cholesky(self.inverse)
        except np.linalg.LinAlgError:  # not positive by rounding
            yield from self._sparse(w, n)
            return
        spread = np.zeros((len(self.g), 3, n, 6))
        spread[self.owner, :, self.at] = (w @ half[self.owner]).transpose(0, 2, 1)
        flat = spread.reshape(-1, 6 * n)
        values = -(flat.T @ flat).reshape(n, 6, n, 6).transpose(0, 2, 1, 3).reshape(n * n, 36)
        some = np.flatnonzero(values.any(axis=1))
        yield some // n, some % n, values[some]

    def _sparse(self, w: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        y = w @ self.inverse[self.owner]
        sizes = np.bincount(self.owner, minlength=len(self.g))
        starts = np.cumsum(sizes) - sizes
        times = sizes[self.owner]  # each observation meets all of its point
        one = np.repeat(np.arange(len(self.owner)), times)
        other = np.arange(len(one)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(starts[self.owner], times)

        left, right = (np.ascontiguousarray(m.transpose(1, 0, 2)) for m in (-y, w))
        for low in range(0, len(one), PAIRS):
            i, j = one[low : low + PAIRS], other[low : low + PAIRS]
            codes = self.at[i] * n + self.at[j]
            order = np.argsort(codes, kind="stable")
            i, j, codes = i[order], j[order], codes[order]
            starts = np.flatnonzero(np.diff(codes, prepend=-1))
            if 8 * len(starts) < len(codes):  # one product for each pair of cameras
                a, b = left[:, i], right[:, j]
                values = np.array([(a[:, s:e].reshape(6, -1) @ b[:, s:e].reshape(6, -1).T).ravel() for s, e in zip(starts, [*starts[1:], len(codes)])])
            else:
                values = np.add.reduceat((-y[i] @ w[j].transpose(0, 2, 1)).reshape(-1, 36), starts, axis=0)
            yield codes[starts] // n, codes[starts] % n, values

    def moved(self, x: np.ndarray, delta: np.ndarray) -> np.ndarray:
        """The points after the cameras' step delta (cameras, 6), inside their bounds."""
        step = np.einsum("nki,ni->nk", self.jc, delta[self.at])
        pull = np.einsum("nki,nk->ni", self.jp, step) * self.open[self.owner]
        back = np.stack([np.bincount(self.owner, pull[:, k], len(self.g)) for k in range(3)], 1)
        new = x + (self.inverse @ (self.g - back)[..., None])[..., 0]
        return np.clip(new, self.start - self.reach, self.start + self.reach)


def added(made: Iterator[Reduced], n: int) -> Iterator[pa.RecordBatch]:
    """(i, j, v) of a task's batches, added up, and given away where they are too many; at -1, -1 cost, points and observations."""
    cost, held, size = np.zeros(36), [], 0

    def given(i: np.ndarray, j: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), _triples(v)], ["i", "j", "v"])

    def together() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes, v = _summed(np.concatenate([i * (n + 2) + j + 2 for i, j, _ in held]), np.concatenate([v for *_, v in held]))
        return codes // (n + 2), codes % (n + 2) - 2, v

    for one in made:
        cost[:3] += one.cost, len(one.g), len(one.batch.owner)
        for block in one.blocks(n):
            held.append(block)
            size += len(block[0])
        if size > HELD:
            held = [together()]
            size = len(held[0][0])
            if size > HELD // 2:
                yield given(*held.pop())
                size = 0
    if held:
        yield given(*together())
    yield given(np.array([-1]), np.array([-1]), cost[None])


#: Blocks (of 36 doubles, 12 MB in all) that the driver multiplies itself; more stay a table, and each product is a job.
FEW_BLOCKS = 40_000


def solved(product: Callable[[np.ndarray], np.ndarray], diagonal: np.ndarray, b: np.ndarray, precision: float = 1e-10, most: int = 500) -> np.ndarray:
    """x (n, 6) of a positive definite system, of which `product` gives products and `diagonal` (n, 6, 6) the blocks: conjugate
    gradients, preconditioned by the inverse blocks. Stops at `precision` or after `most` products; a step that is cut short
    is a descent as well, and the outer loop takes it only if the cost falls."""
    inverse = np.linalg.pinv(diagonal, hermitian=True)
    x, r = np.zeros_like(b), b.copy()
    z = (inverse @ r[..., None])[..., 0]
    p, rz = z, float((r * z).sum())
    first = rz
    for _ in range(most):
        if rz <= precision**2 * first or rz <= 0:
            break
        q = product(p)
        step = rz / max(float((p * q).sum()), 1e-300)
        x, r = x + step * p, r - step * q
        z = (inverse @ r[..., None])[..., 0]
        rz, before = float((r * z).sum()), rz
        p = z + rz / before * p
    return x


def block_product(blocks: DataFrame, n: int) -> Callable[[np.ndarray], np.ndarray]:
    """Products of a table of blocks (i, j, v) with vectors (n, 6): the vector, a row for each image, goes to all tasks, each task sums
    its rows of the result, and one aggregation adds them up."""
    spark = blocks.sparkSession

    def product(p: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(p)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((n, 6))
            for batch in batches:
                i, j, v = (batch.column(k) for k in range(3))
                if batch.num_rows:
                    values = v.flatten().to_numpy().reshape(-1, 6, 6)
                    np.add.at(out, i.to_numpy(), (values @ shared.value[j.to_numpy()][..., None])[..., 0])
            some = np.flatnonzero(out.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(out[some, k]) for k in range(6))], ["i", *(f"v{k}" for k in range(6))])

        parts = blocks.mapInArrow(run, "i int, " + ", ".join(f"v{k} double" for k in range(6)))
        rows = parts.groupBy("i").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in range(6)]).toPandas()  # a row for each image
        shared.unpersist()
        out = np.zeros((n, 6))
        out[rows["i"].to_numpy(int)] = rows[[f"v{k}" for k in range(6)]].to_numpy()
        return out

    return product


def local_product(i: np.ndarray, j: np.ndarray, values: np.ndarray, n: int) -> Callable[[np.ndarray], np.ndarray]:
    def product(p: np.ndarray) -> np.ndarray:
        out = np.zeros((n, 6))
        np.add.at(out, i, (values @ p[j][..., None])[..., 0])
        return out

    return product


class System:
    """The reduced system of n free cameras, out of the parts (i, j, v) that `added` gives: right side, diagonals before the elimination,
    diagonal blocks, cost, and how many points and observations there are. Where all pairs of cameras are at most `few` blocks, one job brings
    their sums to the driver; else they are a table."""

    def __init__(self, parts: DataFrame, n: int, few: int):
        self.n, self.few = n, few
        self.table = None
        if n <= WINDOW and n * n <= few:
            rows = parts.toArrow()  # some rows for each task
        else:
            rows = parts.groupBy("i", "j").agg(*[F.sum(F.get("v", F.lit(k))).alias(f"v{k}") for k in range(36)]).select("i", "j", F.array(*[f"v{k}" for k in range(36)]).alias("v"))
            if n * n > few:
                self.table = rows = cut(rows)
                rows = rows.where("j < 0 or i = j")  # three rows for each image
            rows = rows.toArrow()
        i, j, v = rows["i"].to_numpy().astype(np.int64), rows["j"].to_numpy(), np.concatenate([np.zeros((0, 36)), *(_matrix(c) for c in rows["v"].chunks if len(c))])
        codes, v = _summed(i * (n + 2) + j + 2, v)  # i = -1 only with j = -1
        i, j = codes // (n + 2), codes % (n + 2) - 2
        total = v[i < 0].sum(axis=0)
        self.cost, self.points, self.obs = float(total[0]), int(total[1]), int(total[2])
        self.b, self.diagonals, self.diagonal = np.zeros((n, 6)), np.zeros((n, 6)), np.zeros((n, 6, 6))
        for part, out in ((j == -1) & (i >= 0), self.b), (j == -2, self.diagonals):
            out[i[part]] = v[part, :6]
        self.diagonal[i[(i == j) & (i >= 0)]] = v[(i == j) & (i >= 0)].reshape(-1, 6, 6)
        self.held = i[j >= 0], j[j >= 0], v[j >= 0].reshape(-1, 6, 6)

    def product(self) -> Callable[[np.ndarray], np.ndarray]:
        if self.table is None:
            return local_product(*self.held, self.n)
        blocks = self.table.where("j >= 0")
        if blocks.count() > self.few:
            return block_product(blocks, self.n)
        rows = blocks.toPandas()
        return local_product(rows["i"].to_numpy(int), rows["j"].to_numpy(int), np.array(rows["v"].tolist()).reshape(-1, 6, 6), self.n)


def descended[S](state: S, table: dict, free: list[int], rounds: int, bounds: Bounds, reduced: Callable[[S, dict, float], System], moved: Callable[[S, dict, float, np.ndarray], S], first: System | None = None) -> tuple[S, dict, list[float]]:
    """(state, table, costs) after `rounds` damped steps of the free cameras. reduced(state, table, damping): the system of a state's
    points; moved(state, table, damping, delta): its points after the cameras' step. The damping scales each unknown by the
    largest derivatives it has had; a step that does not lower the cost is not taken and raises it."""
    n, damping = len(free), DAMPING
    peak, gone = np.zeros((n, 6)), np.zeros((n, 6))
    now = first or reduced(state, table, damping)
    costs = [now.cost]
    for _ in range(rounds if n else 0):
        peak = np.maximum(peak, now.diagonals)
        open_ = ~blocked(now.b, gone, bounds.camera())
        more = damping * (peak + 1e-9)
        of_blocks = now.product()
        diagonal = now.diagonal * open_[:, :, None] * open_[:, None, :] + (more + ~open_)[:, :, None] * np.eye(6)
        delta = solved(lambda p: np.where(open_, of_blocks(p) + more * p, p), diagonal, now.b * open_)  # noqa: B023
        delta = np.clip(gone + delta, -bounds.camera(), bounds.camera()) - gone
        tried, trial = moved(state, table, damping, delta), dict(table)
        for img, d in zip(free, delta):
            trial[img] = {"k": table[img]["k"], "r": rodrigues(d[:3]) @ table[img]["r"], "t": table[img]["t"] + d[3:]}
        new = reduced(tried, trial, damping / 5)
        if new.cost < now.cost:
            state, table, now, damping, gone = tried, trial, new, damping / 5, gone + delta
        else:
            damping *= 10
            now = reduced(state, table, damping)
        costs.append(now.cost)
    return state, table, costs


def places(table: dict, fixed: int | list[int]) -> tuple[list[int], np.ndarray]:
    """The free images, and by camera its number among them or -1. fixed: image ids, or how many of the smallest."""
    held = set(sorted(table)[:fixed] if isinstance(fixed, int) else fixed)
    free = [i for i in sorted(table) if i not in held]
    number = {img: k for k, img in enumerate(free)}
    return free, np.array([number.get(i, -1) for i in sorted(table)])


def full(
    points: DataFrame, obs: DataFrame, cameras: DataFrame, rounds: int = 5, scale: float = 2.0, fixed: int | list[int] = 1, loss: str = "cauchy", bounds: Bounds = Bounds(),
    few: int = FEW_BLOCKS,
) -> tuple[DataFrame, DataFrame, list[float]]:
    """(points, cameras, costs): all points and all cameras are free, but for the `fixed` ones (image ids, or how many of the smallest).

    Each round: one job that gives the reduced camera system as blocks of pairs of cameras that share points, conjugate
    gradients over them, one job that moves the points. The damping scales each unknown by the largest derivatives it has had; a
    round that does not lower the cost raises it. What is as long as there are images (six numbers each) is on the
    driver; blocks are, only if they are few. Unknowns at a bound stay there while they push outwards.
    """
    spark = points.sparkSession
    start = F.array("x", "y", "z")
    rows = cut(listed(points, obs).withColumn("start", start).withColumn("peak", F.array(*[F.lit(0.0)] * 3)))
    names_, table = rows.columns, _camera_table(cameras)
    free, place = places(table, fixed)
    n = len(free)

    def parts(batches: Iterator[pa.RecordBatch], cams: Cameras, lam: float) -> Iterator[tuple[pa.RecordBatch, np.ndarray, Reduced]]:
        for part, x in _sliced(batches):
            yield part, x, Reduced(x, part, cams, place, lam, scale, loss, _matrix(part.column(8)), _matrix(part.column(7)), bounds)

    def moved(df: DataFrame, cams: dict, lam: float, delta: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast(cams)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, x, made in parts(batches, Cameras(shared.value), lam):
                points_ = [pa.array(c) for c in made.moved(x, delta).T]
                yield pa.RecordBatch.from_arrays([part.column(0), *points_, *(part.column(k) for k in (4, 5, 6, 7)), _triples(made.peak)], names_)

        return cut(df.mapInArrow(run, df.schema))

    def reduced(df: DataFrame, cams: dict, lam: float) -> System:
        shared = spark.sparkContext.broadcast(cams)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return added((made for *_, made in parts(batches, Cameras(shared.value), lam)), n)

        return System(df.mapInArrow(run, "i int, j int, v array<double>"), n, few)

    rows, table, costs = descended(rows, table, free, rounds, bounds, reduced, moved)
    return rows.select("track_id", "x", "y", "z"), camera_rows(spark, table), costs


def camera_rows(spark: SparkSession, table: dict) -> DataFrame:
    flat = [(img, *map(float, c["k"]), *map(float, c["r"].ravel()), *map(float, c["t"]), *map(float, -c["r"].T @ c["t"])) for img, c in sorted(table.items())]
    names = ["fx", "fy", "cx", "cy", *[f"r{i}{j}" for i in range(3) for j in range(3)], "tx", "ty", "tz", "cx_w", "cy_w", "cz_w"]
    return spark.createDataFrame(flat, "img_id int, " + ", ".join(f"{n_} double" for n_ in names))


def updated(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with the new place where there is one."""
    fresh = new.select("track_id", *[F.col(c).alias(f"new_{c}") for c in "xyz"])
    return old.join(fresh, "track_id", "left").select(*[F.coalesce(f"new_{c}", c).alias(c) if c in "xyz" else c for c in old.columns])


def run(
    points: DataFrame, obs: DataFrame, cameras: DataFrame, images: list[int], points_cap: int | None = None, least_points: int = 50, least_obs: int = 200,
    scale: float = 2.0, loss: str = "cauchy", rounds: int = 5,
) -> tuple[DataFrame, DataFrame]:
    """(points, cameras) after an adjustment of the chosen images and of all points with two views in them, or of the `points_cap` with the
    most; both as they were if there is too little to adjust. The first two chosen images stay in place, which also fixes the scale."""
    mine = obs.join(points.select("track_id"), "track_id", "left_semi")
    if points_cap is None:
        mine = mine.where(F.col("img_id").isin(images)).select("track_id", "img_id")
        chosen = cut(mine.join(mine.groupBy("track_id").agg(F.count(F.lit(1)).alias("hits")).where("hits >= 2"), "track_id", "left_semi"))
    else:
        chosen = cut(problem(mine, images, points_cap))
    size = chosen.agg(F.countDistinct("track_id").alias("points"), F.count(F.lit(1)).alias("obs")).first()
    if len(images) < 2 or size["points"] < least_points or size["obs"] < least_obs:
        return points, cameras
    seen = obs.join(chosen.select("track_id", "img_id"), ["track_id", "img_id"], "left_semi")
    some = points.join(chosen.select("track_id").distinct(), "track_id", "left_semi")
    moved, placed, _ = full(some, seen, cameras.where(F.col("img_id").isin(images)), rounds, scale, fixed=images[:2], loss=loss)
    others = cameras.where(~F.col("img_id").isin(images)).select(placed.columns)
    return updated(points, moved), placed.unionByName(others)
