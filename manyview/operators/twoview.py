"""Poses from pixels alone: essential matrices and PnP by seeded RANSAC, one group of correspondences for each image pair or
image. Groups are bounded by the keypoints of an image."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from manyview.operators.adjust import rodrigues, skew
from manyview.operators.minimal import five_points, three_points

ROUNDS, POSE_ROUNDS = 200, 100
#: Hypotheses times correspondences that are judged at once.
CELLS = 1_000_000
#: Partitions of groups. They take long for their size, so Spark is not left to put small ones together.
DEALT = 128
#: Correspondences that one step of numpy takes.
BLOCK = 8_192
#: Correspondences whose tables (21 numbers each) are kept from step to step.
KEPT = 500_000


def normalised(pixels: np.ndarray, k: np.ndarray) -> np.ndarray:
    return (pixels - k[2:]) / k[:2]


def least_vectors(rows: np.ndarray) -> np.ndarray:
    """For matrices (..., n, m), the unit vectors that they take nearest to zero, from the m x m products with their transposes."""
    return np.linalg.eigh(np.swapaxes(rows, -1, -2) @ rows)[1][..., 0]


def eight_points(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Essential matrices of (..., n, 2) correspondences, eight at least, in normalised coordinates."""
    ax, ay, bx, by = a[..., 0], a[..., 1], b[..., 0], b[..., 1]
    e = least_vectors(np.stack([bx * ax, bx * ay, bx, by * ax, by * ay, by, ax, ay, np.ones_like(ax)], -1))
    u, _, v = np.linalg.svd(e.reshape(*e.shape[:-1], 3, 3))
    return u @ np.diag([1.0, 1.0, 0.0]) @ v


def epipolar(e: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(..., n): signed distances (Sampson's) of n correspondences to each of the matrices."""
    out, (top, square) = np.empty((*e.shape[:-2], len(a))), _coefficients(e)
    for low in range(0, len(a), BLOCK):
        part = slice(low, low + BLOCK)
        k, m = _tables(a[part], b[part])
        out[..., part] = (top @ k) / np.sqrt(np.maximum(square @ m, 0) + 1e-18)
    return out


def _monomials(a: np.ndarray) -> np.ndarray:
    """(6, n): x x, y y, 1, x y, x, y of n points."""
    x, y = a.T
    return np.stack([x * x, y * y, np.ones_like(x), x * y, x, y])


def _quadratic(m: np.ndarray) -> np.ndarray:
    """(..., 6): the coefficients of _monomials in the squared lengths of m (..., 2, 3) times (x, y, 1)."""
    q = np.swapaxes(m, -1, -2) @ m
    return np.stack([q[..., 0, 0], q[..., 1, 1], q[..., 2, 2], 2 * q[..., 0, 1], 2 * q[..., 0, 2], 2 * q[..., 1, 2]], -1)


def _coefficients(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(..., 9) and (..., 12): their products with the two tables of correspondences are the numerators of the signed distances and the
    squares of their divisors."""
    return e.reshape(*e.shape[:-2], 9), np.concatenate([_quadratic(e[..., :2, :]), _quadratic(np.swapaxes(e[..., :2], -1, -2))], -1)


def _tables(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.vstack([a.T, np.ones(len(a))]), np.vstack([b.T, np.ones(len(b))])
    return (y[:, None] * x[None]).reshape(9, -1), np.concatenate([_monomials(a), _monomials(b)])


def sampson(e: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.abs(epipolar(e, a, b))


def samples(rng: np.random.Generator, n: int, size: int, rounds: int) -> np.ndarray:
    """rounds x size different numbers below n."""
    if n < 16 * size:
        return rng.random((rounds, n)).argsort(axis=1)[:, :size]
    out = rng.integers(0, n, (rounds, size))
    while len(again := np.flatnonzero((np.diff(np.sort(out, axis=1), axis=1) == 0).any(axis=1))):
        out[again] = rng.integers(0, n, (len(again), size))
    return out


def inliers(tried: int, n: int, inside) -> np.ndarray:
    """How many inliers each hypothesis has, of all n correspondences; inside(slice) gives a row for each hypothesis, over those of
    a slice, so that what is held at once doesn't grow with n."""
    out = np.zeros(tried, int)
    step = max(1, CELLS // max(1, tried))
    for low in range(0, n if tried else 0, step):
        out += inside(slice(low, low + step)).sum(axis=1)
    return out


def near_lines(e: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """(..., n): which correspondences are nearer than the threshold."""
    (top, square), (k, m) = _coefficients(e), _tables(a, b)
    far, limit = top @ k, (threshold * threshold * square) @ m
    np.square(far, out=far)
    return far < np.maximum(limit, 0, out=limit) + threshold * threshold * 1e-18


def polished(r: np.ndarray, t: np.ndarray, a: np.ndarray, b: np.ndarray, steps: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """A rotation and a direction after damped Gauss-Newton steps on the epipolar distances, in the five unknowns that they have."""
    size, damping = 1e-7, 1e-6
    parts = [(a[low : low + BLOCK], b[low : low + BLOCK]) for low in range(0, len(a), BLOCK)]
    tables = [_tables(*part) for part in parts] if len(a) <= KEPT else None

    def each() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        return iter(tables) if tables is not None else (_tables(*part) for part in parts)

    def moved(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = t + d[3] * side[1] + d[4] * side[2]
        return rodrigues(d[:3]) @ r, new / np.linalg.norm(new)

    def cost(e: np.ndarray) -> float:
        top, square = _coefficients(e)
        return sum(float(np.square(u).dot(1 / (v + 1e-18))) for u, v in ((top @ k, np.maximum(square @ m, 0)) for k, m in each()))

    now = cost(skew(t) @ r)
    for _ in range(steps):
        side = np.linalg.svd(t[None])[2]
        around = [_coefficients(skew(y) @ x) for x, y in map(moved, size * np.vstack([np.eye(5), -np.eye(5)]))]
        d_top, d_square = (np.array([(around[k][c] - around[k + 5][c]) / (2 * size) for k in range(5)]) for c in (0, 1))
        top, square = _coefficients(skew(t) @ r)
        normal, pull = np.zeros((5, 5)), np.zeros(5)
        for k, m in each():  # derivatives of top / sqrt(square)
            v = 1 / (np.maximum(square @ m, 0) + 1e-18)
            root = np.sqrt(v)
            u = top @ k
            jacobian = (d_top @ k - (0.5 * u * v) * (d_square @ m)) * root
            normal += jacobian @ jacobian.T
            pull += jacobian @ (u * root)
        for _ in range(4):
            tried = moved(-np.linalg.solve(normal + damping * np.diag(np.diag(normal) + 1e-12), pull))
            new = cost(skew(tried[1]) @ tried[0])
            if new < now:
                break
            damping *= 30
        else:
            break
        gain = 1 - new / max(now, 1e-300)
        (r, t), now, damping = tried, new, damping / 10
        if gain < 1e-9:
            break
    return r, t


def _depths(r: np.ndarray, t: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each correspondence, numbers with the signs of its depths in both cameras, where its rays come nearest to each other."""
    (ax, ay), (bx, by) = a.T, b.T
    px, py, pz = (row[0] * ax + row[1] * ay + row[2] for row in r)
    pp, qq, pq = px * px + py * py + pz * pz, bx * bx + by * by + 1.0, px * bx + py * by + pz
    pt, qt = px * t[0] + py * t[1] + pz * t[2], bx * t[0] + by * t[1] + t[2]
    return pq * qt - qq * pt, pp * qt - pq * pt


def before_both(r: np.ndarray, t: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which correspondences meet before both cameras."""
    one, other = _depths(r, t, a, b)
    return (one > 0) & (other > 0)


def pose_of(e: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the four (R, t) of an essential matrix, the one with the most of all points before both cameras."""
    u, _, v = np.linalg.svd(e)
    u, v = u * np.sign(np.linalg.det(u)), v * np.sign(np.linalg.det(v))
    w = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    poses, counts = [(r, t) for r in (u @ w @ v, u @ w.T @ v) for t in (u[:, 2], -u[:, 2])], np.zeros(4, int)
    for low in range(0, len(a), BLOCK):
        for k in (0, 2):  # the other direction turns both signs
            one, other = _depths(*poses[k], a[low : low + BLOCK], b[low : low + BLOCK])
            counts[k] += ((one > 0) & (other > 0)).sum()
            counts[k + 1] += ((one < 0) & (other < 0)).sum()
    return poses[int(counts.argmax())]


#: Different hypotheses whose points are looked at, as those of a plane's other solution have as many inliers; how many of them
#: are polished; and the product of two unit matrices from which on they count as one.
FINALISTS, POLISHED, ALIKE = 24, 4, 0.995


def relative_pose(a: np.ndarray, b: np.ndarray, threshold: float, seed: int, rounds: int = ROUNDS) -> tuple[np.ndarray | None, np.ndarray | None, np.ndarray]:
    """R, t (of length one) and the inliers of correspondences in normalised coordinates; None where fewer than eight agree.

    Hypotheses of five points each; the best of them are polished over their inliers, and the one with the most inliers that
    lie before both cameras is taken. Points of a plane fit two matrices, of which the places of the points choose one.
    """
    none = np.zeros(len(a), bool)
    if len(a) < 8:
        return None, None, none
    pick = samples(np.random.default_rng(seed), len(a), 5, rounds)
    tried = five_points(a[pick], b[pick]).reshape(-1, 3, 3)
    tried = tried[np.isfinite(tried).all((1, 2))]
    counts = inliers(len(tried), len(a), lambda part: near_lines(tried, a[part], b[part], threshold))
    finalists, seen = [], np.zeros((0, 9))
    for at in np.argsort(-counts, kind="stable"):
        if len(finalists) == FINALISTS or counts[at] < max(8, counts.max() / 2):
            break
        if not (np.abs(seen @ tried[at].ravel()) > ALIKE).any():
            seen = np.vstack([seen, tried[at].ravel()])
            inside = sampson(tried[at], a, b) < threshold
            pose = pose_of(tried[at], a[inside], b[inside])
            finalists.append((int(before_both(*pose, a[inside], b[inside]).sum()), -len(finalists), pose, inside))
    best: tuple = (-1, 0.0, None)
    for *_, pose, inside in sorted(finalists, key=lambda x: x[:2], reverse=True)[:POLISHED]:
        for _ in range(2):
            pose = polished(*pose, a[inside], b[inside])
            far = sampson(skew(pose[1]) @ pose[0], a, b)
            if (far < threshold).sum() < 8:
                break
            inside = far < threshold
        pose = pose_of(skew(pose[1]) @ pose[0], a[inside], b[inside])
        ahead = int(before_both(*pose, a[inside], b[inside]).sum())
        score = (ahead, -float(np.square(far[inside]).sum()), (*pose, inside))
        if score[:2] > best[:2]:
            best = score
    return best[2] if best[2] is not None else (None, None, none)


def essential(a: np.ndarray, b: np.ndarray, threshold: float, seed: int, rounds: int = ROUNDS) -> tuple[np.ndarray | None, np.ndarray]:
    """The essential matrix of relative_pose, and which correspondences are its inliers."""
    r, t, inside = relative_pose(a, b, threshold, seed, rounds)
    return (None if r is None else skew(t) @ r), inside


def _sorted(group: pa.Table, *order: str) -> np.ndarray:
    return np.lexsort([group[c].to_numpy() for c in reversed(order)])


def _columns(group: pa.Table, names: tuple[str, ...], at: np.ndarray) -> np.ndarray:
    """(n, names): doubles of the columns, in the order of `at`."""
    out = np.empty((len(at), len(names)))
    for k, name in enumerate(names):
        out[:, k] = group[name].to_numpy()[at]
    return out


def _pair(group: pa.Table, kk: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    at = _sorted(group, "a", "b")
    x, y = (normalised(_columns(group, c, at), kk) for c in (("xi", "yi"), ("xj", "yj")))
    return group["i"][0].as_py(), group["j"][0].as_py(), at, x, y


_PIXELS = ("i", "j", "a", "b", "xi", "yi", "xj", "yj")


def verify_pairs(pixels: DataFrame, k: tuple[float, float, float, float], threshold: float = 1.0, least: int = 8) -> DataFrame:
    """(i, j, a, b) of the inliers of each pair's essential matrix; pairs with fewer than `least` give none. pixels: (i, j, a,
    b, xi, yi, xj, yj)."""
    kk = np.array(k)

    def run(group: pa.Table) -> pa.Table:
        i, j, at, x, y = _pair(group, kk)
        _, inside = essential(x, y, threshold / float(kk[:2].mean()), i * 100_003 + j)
        kept = group.select(["i", "j", "a", "b"]).take(at[inside] if inside.sum() >= least else at[:0])
        return kept.cast(pa.schema([(c, pa.int32()) for c in kept.column_names]))

    return pixels.select(*_PIXELS).repartition(DEALT, "i", "j").groupBy("i", "j").applyInArrow(run, "i int, j int, a int, b int")


def two_view_poses(pixels: DataFrame, k: tuple[float, float, float, float], threshold: float = 1.0) -> DataFrame:
    """(i, j, r, t, n_inliers) of each pair with a pose; r row by row, t of length one."""
    kk = np.array(k)
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("r", pa.list_(pa.float64())), ("t", pa.list_(pa.float64())), ("n_inliers", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        i, j, _, x, y = _pair(group, kk)
        r, t, inside = relative_pose(x, y, threshold / float(kk[:2].mean()), i * 100_003 + j)
        rows = [] if r is None else [{"i": i, "j": j, "r": r.ravel().tolist(), "t": t.tolist(), "n_inliers": int(inside.sum())}]
        return pa.Table.from_pylist(rows, schema)

    return pixels.select(*_PIXELS).repartition(DEALT, "i", "j").groupBy("i", "j").applyInArrow(run, "i int, j int, r array<double>, t array<double>, n_inliers long")


def posed_pairs(pixels: DataFrame, k: tuple[float, float, float, float], threshold: float, least: int, score: Callable[[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray], int]) -> DataFrame:
    """(i, j, a, b, pose): as verify_pairs; and for each of its pairs a row without a and b, whose pose is the bytes of r (row by row), t and
    score(i, j, r, t, pixels in i, pixels in j), over the inliers of that pose."""
    kk = np.array(k)

    def run(group: pa.Table) -> pa.Table:
        i, j, at, x, y = _pair(group, kk)
        r, t, inside = relative_pose(x, y, threshold / float(kk[:2].mean()), i * 100_003 + j)
        kept = at[inside] if r is not None and inside.sum() >= least else at[:0]
        rows = group.select(["i", "j", "a", "b"]).take(kept).cast(pa.schema([(c, pa.int32()) for c in "ijab"])).append_column("pose", pa.nulls(len(kept), pa.binary()))
        if not len(kept):
            return rows
        value = score(i, j, r, t, _columns(group, ("xi", "yi"), kept), _columns(group, ("xj", "yj"), kept))
        pose = pa.Table.from_pylist([{"i": i, "j": j, "a": None, "b": None, "pose": np.array([*r.ravel(), *t, value], float).tobytes()}], rows.schema)
        return pa.concat_tables([rows, pose])

    return pixels.select(*_PIXELS).repartition(DEALT, "i", "j").groupBy("i", "j").applyInArrow(run, "i int, j int, a int, b int, pose binary")


def reprojected(r: np.ndarray, t: np.ndarray, x: np.ndarray, uv: np.ndarray) -> np.ndarray:
    """(..., n): how far n points fall from their pixels in each pose; infinitely where they lie behind it."""
    out = np.empty((*r.shape[:-2], len(x))) if x.ndim == 2 else None
    if out is None:
        p = x @ np.swapaxes(r, -1, -2) + t[..., None, :]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            far = np.linalg.norm(p[..., :2] / p[..., 2:] - uv, axis=-1)
        return np.where(p[..., 2] > 1e-12, far, np.inf)
    step = max(1, CELLS // (4 * max(1, r[..., 0, 0].size)))
    for low in range(0, len(x), step):
        part = slice(low, low + step)
        across, down, depth = ((r[..., k, :] @ x[part].T) + t[..., k, None] for k in range(3))
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            across, down = across / depth - uv[part, 0], down / depth - uv[part, 1]
            out[..., part] = np.where(depth > 1e-12, np.sqrt(across * across + down * down), np.inf)
    return out


def _pose_sums(r: np.ndarray, t: np.ndarray, x: np.ndarray, uv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 6 x 6 normal matrix of a pose's rotation and translation over n points, and its right side, block by block."""
    a, g = np.zeros((6, 6)), np.zeros(6)
    for low in range(0, len(x), BLOCK):
        px, py, pz = r @ x[low : low + BLOCK].T
        fine = pz + t[2] > 1e-9
        size = np.where(fine, 1 / np.where(fine, pz + t[2], 1.0), 0.0)
        u, v, none = (px + t[0]) * size, (py + t[1]) * size, np.zeros_like(size)
        of_u = np.stack([-py * u, pz + px * u, -py, np.ones_like(u), none, -u]) * size
        of_v = np.stack([-(py * v + pz), px * v, px, none, np.ones_like(v), -v]) * size
        a += of_u @ of_u.T + of_v @ of_v.T
        g += of_u @ np.where(fine, u - uv[low : low + BLOCK, 0], 0.0) + of_v @ np.where(fine, v - uv[low : low + BLOCK, 1], 0.0)
    return a, g


def refined_pose(r: np.ndarray, t: np.ndarray, x: np.ndarray, uv: np.ndarray, steps: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """A pose after Gauss-Newton steps over n points; it stops at a step that is none better. What is held at once doesn't grow with n,
    but for a number a point."""
    cost = float(np.square(reprojected(r, t, x, uv)).sum())
    for _ in range(steps):
        a, g = _pose_sums(r, t, x, uv)
        d = -np.linalg.solve(a + (1e-12 * np.trace(a) + 1e-18) * np.eye(6), g)
        tried = rodrigues(d[:3]) @ r, t + d[3:]
        new = float(np.square(reprojected(*tried, x, uv)).sum())
        if not new < cost:
            break
        (r, t), cost = tried, new
    return r, t


def absolute_pose(x: np.ndarray, uv: np.ndarray, limit: float, seed: int, rounds: int = POSE_ROUNDS) -> tuple[np.ndarray | None, np.ndarray | None, np.ndarray]:
    """R, t and the inliers of points and their normalised pixels; no inliers where no pose has six."""
    none = np.zeros(len(x), bool)
    if len(x) < 6:
        return None, None, none
    pick = samples(np.random.default_rng(seed), len(x), 4, rounds)
    r, t = three_points(x[pick[:, :3]], uv[pick[:, :3]])
    miss = np.nan_to_num(reprojected(r, t, x[pick[:, None, 3:]], uv[pick[:, None, 3:]])[..., 0], nan=np.inf)
    chosen = np.arange(rounds), miss.argmin(axis=1)
    some = np.isfinite(miss[chosen])
    r, t = r[chosen][some], t[chosen][some]
    counts = inliers(len(r), len(x), lambda part: reprojected(r, t, x[part], uv[part]) < limit)
    out = None, None, none
    for at in np.argsort(-counts, kind="stable")[:3]:
        pose, best = (r[at], t[at]), reprojected(r[at], t[at], x, uv) < limit
        for _ in range(4):  # the inliers of the refined pose are fitted again
            if best.sum() < 6:
                break
            pose = refined_pose(*pose, x[best], uv[best])
            best = reprojected(*pose, x, uv) < limit
        if best.sum() >= max(6, out[2].sum() + 1):
            out = *pose, best
    return out


def pnp(links: DataFrame, k: tuple[float, float, float, float], threshold: float = 3.0, least: int = 6) -> DataFrame:
    """(img_id, r, t, n_inliers) of each image with `least` inliers. links: (img_id, track_id, u, v, x, y, z).

    Hypotheses of three points each, of whose four poses a fourth point chooses one; the best is fitted to its inliers."""
    kk = np.array(k)

    limit = threshold / float(kk[:2].mean())
    schema = pa.schema([("img_id", pa.int32()), ("r", pa.list_(pa.float64())), ("t", pa.list_(pa.float64())), ("n_inliers", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        image, at = group["img_id"][0].as_py(), _sorted(group, "track_id")
        x, uv = _columns(group, ("x", "y", "z"), at), normalised(_columns(group, ("u", "v"), at), kk)
        r, t, best = absolute_pose(x, uv, limit, image) if len(x) >= least else (None, None, np.zeros(0, bool))
        rows = [] if best.sum() < least else [{"img_id": image, "r": r.ravel().tolist(), "t": t.tolist(), "n_inliers": int(best.sum())}]
        return pa.Table.from_pylist(rows, schema)

    return links.select("img_id", "track_id", "u", "v", "x", "y", "z").repartition(DEALT, "img_id").groupBy("img_id").applyInArrow(run, "img_id int, r array<double>, t array<double>, n_inliers long")
