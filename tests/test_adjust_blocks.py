"""The full adjustment: its step against dense normal equations, its products by Spark, its bounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from manyview.operators import adjust, triangulate
from manyview.plans import queries
from manyview.session import cut

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def problem(spark):
    s = queries.Scene(spark, SF)
    obs, cameras = cut(s.obs.where("track_id < 60")), cut(s.cameras)
    points = cut(triangulate.triangulate(obs, cameras, 3).select("track_id", (F.col("x") + 0.03).alias("x"), "y", "z"))
    return points, cut(obs.join(points.select("track_id"), "track_id", "left_semi")), cameras


def test_conjugate_gradients():
    rng = np.random.default_rng(1)
    n = 20
    a = rng.normal(size=(6 * n, 6 * n))
    a = a @ a.T + np.eye(6 * n)
    b = rng.normal(size=(n, 6))
    blocks = a.reshape(n, 6, n, 6)
    x = adjust.solved(lambda p: (a @ p.ravel()).reshape(n, 6), np.stack([blocks[i, :, i] for i in range(n)]), b, 1e-12, 2000)
    assert np.allclose(x.ravel(), np.linalg.solve(a, b.ravel()), atol=1e-6)
    assert (adjust.solved(lambda p: p, np.tile(np.eye(6), (n, 1, 1)), np.zeros((n, 6))) == 0).all()


def test_first_step_equals_dense_equations(problem):
    points, obs, cameras = problem
    _, _, costs = adjust.full(points, obs, cameras, rounds=1, fixed=2)
    cams, seen, x = adjust.Cameras(adjust._camera_table(cameras)), obs.collect(), {r["track_id"]: np.array(r[1:4]) for r in points.collect()}
    ids, n = sorted(x), len(cams.images)
    size = 6 * (n - 2)
    j, r = np.zeros((2 * len(seen), size + 3 * len(ids))), np.zeros(2 * len(seen))

    def residual(o, place, rotation, t):
        return adjust.linearised(place, rotation, t, cams.k[int(np.searchsorted(cams.images, o["img_id"]))], np.array([o["u"], o["v"]]))

    for k, o in enumerate(seen):
        c, p = int(np.searchsorted(cams.images, o["img_id"])), ids.index(o["track_id"])
        e, of_camera, of_point = residual(o, x[o["track_id"]], cams.r[c], cams.t[c])
        w = np.sqrt(adjust._costs(e[None], 2.0, "cauchy")[1][0])
        rows = slice(2 * k, 2 * k + 2)
        r[rows], j[rows, size + 3 * p : size + 3 * p + 3] = w * e, w * of_point
        if c >= 2:
            j[rows, 6 * (c - 2) : 6 * (c - 2) + 6] = w * of_camera
    normal = j.T @ j
    delta = -np.linalg.solve(normal + 1e-3 * np.diag(np.diag(normal) + 1e-9), j.T @ r)
    total = 0.0
    for o in seen:
        c, p = int(np.searchsorted(cams.images, o["img_id"])), ids.index(o["track_id"])
        rotation, t = cams.r[c], cams.t[c]
        if c >= 2:
            d = delta[6 * (c - 2) : 6 * (c - 2) + 6]
            rotation, t = adjust.rodrigues(d[:3]) @ rotation, t + d[3:]
        total += adjust._costs(residual(o, x[o["track_id"]] + delta[size + 3 * p : size + 3 * p + 3], rotation, t)[0][None], 2.0, "cauchy")[0][0]
    assert costs[1] == pytest.approx(total, rel=1e-6) and costs[1] < costs[0]


def test_products_by_spark_equal_those_of_the_driver(problem):
    costs = [adjust.full(*problem, rounds=2, fixed=2, few=few)[2] for few in (0, 1_000_000)]
    assert costs[0] == pytest.approx(costs[1], rel=1e-6)


def test_bounds_hold(problem):
    points, obs, cameras = problem
    bounds = adjust.Bounds(rotation=1e-3, translation=5e-3, point=0.01)
    moved, placed, costs = adjust.full(points, obs, cameras, rounds=4, fixed=2, bounds=bounds)
    gap = moved.join(points.toDF("track_id", "a", "b", "c"), "track_id").select(F.greatest(F.abs(F.col("x") - F.col("a")), F.abs(F.col("y") - F.col("b")), F.abs(F.col("z") - F.col("c"))).alias("g"))
    most, stand = gap.agg(F.max("g"), F.count_if(F.col("g") > 0.0099)).first()
    assert most <= 0.01 + 1e-9 and stand > 5 and costs[-1] < costs[0]
    was = adjust._camera_table(cameras)
    assert all(np.abs(c["t"] - was[i]["t"]).max() <= 5e-3 + 1e-9 for i, c in adjust._camera_table(placed).items())
    assert adjust.full(points, obs, cameras, rounds=4, fixed=2)[2][-1] < costs[-1]


def test_fixed_images_and_nothing_free(problem):
    points, obs, cameras = problem
    images = sorted(r["img_id"] for r in obs.select("img_id").distinct().collect())
    was, now = (adjust._camera_table(c) for c in (cameras, adjust.full(points, obs, cameras, rounds=1, fixed=images[3:5])[1]))
    assert {i for i in images if np.array_equal(was[i]["t"], now[i]["t"])} == set(images[3:5])
    moved, _, costs = adjust.full(points, obs, cameras, rounds=2, fixed=len(was))
    assert moved.count() == points.count() and len(costs) == 1
