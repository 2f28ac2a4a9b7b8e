"""Pinhole projection of world points by cameras (fx, fy, cx, cy, r00..r22, tx, ty, tz)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manyview.functions.linalg import Vector, applied, clean, dot, finite, norm, once, rotation, sub, transposed, vector

#: Least depths: of projection, of per-point medians, of the multi-view tests.
DEPTH_PROJECT, DEPTH_MEDIAN, DEPTH_MULTIVIEW = 1e-12, 1e-9, 1e-6


def in_camera(point: Vector, camera: str = "") -> Vector:
    """The point in the camera's frame."""
    turned = applied(rotation(camera), point)
    return tuple(a + b for a, b in zip(turned, vector(f"{camera}t")))


def pixel(point: Vector, camera: str = "", least_depth: float = DEPTH_PROJECT) -> tuple[Column, Column, Column]:
    """(u, v, depth); u and v are NULL for a point that isn't finite or not in front of the camera."""
    x, y, z = in_camera(point, camera)
    fine = finite(*point) & (z > least_depth)
    u = F.when(fine, x / z * F.col(f"{camera}fx") + F.col(f"{camera}cx"))
    v = F.when(fine, y / z * F.col(f"{camera}fy") + F.col(f"{camera}cy"))
    return u, v, z


def distance(u: Column, v: Column, at_u: Column, at_v: Column) -> Column:
    return F.sqrt((u - at_u) * (u - at_u) + (v - at_v) * (v - at_v))


def centre(camera: str = "") -> Vector:
    """-R^T t."""
    return tuple(-x for x in applied(transposed(rotation(camera)), vector(f"{camera}t")))


def projection_matrix(camera: str = "") -> list[list[Column]]:
    """K [R | t] without skew, three rows of four."""
    rows = [[*row, t] for row, t in zip(rotation(camera), vector(f"{camera}t"))]
    fx, fy, cx, cy = (F.col(f"{camera}{k}") for k in ("fx", "fy", "cx", "cy"))
    return [[fx * a + cx * c for a, c in zip(rows[0], rows[2])], [fy * b + cy * c for b, c in zip(rows[1], rows[2])], rows[2]]


def angle(point: Vector, a: Vector, b: Vector, epsilon: float = 1e-12) -> Column:
    """Degrees between the rays from two centres to the point."""
    p, q = sub(point, a), sub(point, b)
    cosine = dot(p, q) / ((norm(p) + epsilon) * (norm(q) + epsilon))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def angle_plain(point: Vector, a: Vector, b: Vector, least: float = 1e-12) -> Column:
    """As `angle`, but 0 where the point lies on a centre, and with nothing added to the divisor."""
    p, q = sub(point, a), sub(point, b)
    cosine = F.try_divide(dot(p, q), norm(p) * norm(q))
    there = (norm(p) < least) | (norm(q) < least)
    return F.when(there, 0.0).otherwise(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))


def quaternion(camera: str = "") -> list[Column]:
    """(w, x, y, z) of the rotation, w >= 0; by its largest component, so no divisor is small."""
    m = rotation(camera)
    trace = m[0][0] + m[1][1] + m[2][2]
    four = [1 + trace, 1 + m[0][0] - m[1][1] - m[2][2], 1 - m[0][0] + m[1][1] - m[2][2], 1 - m[0][0] - m[1][1] + m[2][2]]
    pairs = {
        0: [four[0], m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1]],
        1: [m[2][1] - m[1][2], four[1], m[0][1] + m[1][0], m[0][2] + m[2][0]],
        2: [m[0][2] - m[2][0], m[0][1] + m[1][0], four[2], m[1][2] + m[2][1]],
        3: [m[1][0] - m[0][1], m[0][2] + m[2][0], m[1][2] + m[2][1], four[3]],
    }
    most = F.greatest(*four)
    raw = []
    for k in range(4):
        chosen = F.when(four[0] >= most, pairs[0][k])
        for case in (1, 2):
            chosen = chosen.when(four[case] >= most, pairs[case][k])
        raw.append(chosen.otherwise(pairs[3][k]) / (2 * F.sqrt(most)))
    sign = F.when(raw[0] < 0, -1.0).otherwise(1.0)
    return [q * sign for q in raw]


def rotation_of(q: list[Column]) -> list[list[Column]]:
    """The rotation of a quaternion (w, x, y, z) of any length but zero."""
    w, x, y, z = q
    n = w * w + x * x + y * y + z * z
    s = F.try_divide(F.lit(2.0), n)
    return [
        [1 - s * (y * y + z * z), s * (x * y - w * z), s * (x * z + w * y)],
        [s * (x * y + w * z), 1 - s * (x * x + z * z), s * (y * z - w * x)],
        [s * (x * z - w * y), s * (y * z + w * x), 1 - s * (x * x + y * y)],
    ]


def undistorted(df: DataFrame, keep: list[str], distortion: tuple[float, float, float, float, float], steps: int = 10) -> DataFrame:
    """keep and x, y: pixels (x, y) of cameras (fx, fy, cx, cy) without their lens distortion (k1, k2, p1, p2, k3), by fixed-point
    steps."""
    k1, k2, p1, p2, k3 = distortion
    lens = ["fx", "fy", "cx", "cy"]
    start = {"x0": (F.col("x") - F.col("cx")) / F.col("fx"), "y0": (F.col("y") - F.col("cy")) / F.col("fy")}
    now = once(df, [*keep, *lens], start | {"xn": start["x0"], "yn": start["y0"]})
    x, y = F.col("xn"), F.col("yn")
    r = x * x + y * y
    radial = 1 + r * (k1 + r * (k2 + r * k3))
    for _ in range(steps):
        moved = {"xn": (F.col("x0") - (2 * p1 * x * y + p2 * (r + 2 * x * x))) / radial, "yn": (F.col("y0") - (p1 * (r + 2 * y * y) + 2 * p2 * x * y)) / radial}
        now = once(now, [*keep, *lens, "x0", "y0"], moved)
    return now.select(*keep, (x * F.col("fx") + F.col("cx")).alias("x"), (y * F.col("fy") + F.col("cy")).alias("y"))


def rounded(**columns: Column) -> list[Column]:
    return [clean(column).alias(name) for name, column in columns.items()]
