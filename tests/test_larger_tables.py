"""Mends for larger tables."""

import tracemalloc

import duckdb
import numpy as np

from manyview.operators import twoview
from manyview.plans import scene


def test_pixels_have_the_bits_of_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("nation", "part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    expected = con.execute(f"{scene.SQL} SELECT track_id, img_id, u, v FROM obs").fetchall()
    got = scene.obs(spark, sf).select("track_id", "img_id", "u", "v").collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_poses_hold_few_numbers_a_point():
    n, rng = 300_000, np.random.default_rng(1)
    x = rng.uniform(-1, 1, (n, 3))
    uv = x[:, :2] / (x[:, 2:] + 6)
    twoview.absolute_pose(x[:100], uv[:100], 1e-3, 0)
    tracemalloc.start()
    r, t, inside = twoview.absolute_pose(x, uv, 1e-3, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert inside.all() and np.allclose(r, np.eye(3), atol=1e-6) and np.allclose(t, [0, 0, 6], atol=1e-6)
    assert peak < 16 * 8 * n, peak / n


def test_hypotheses_are_judged_by_blocks_of_points():
    sizes = []

    def inside(part: slice) -> np.ndarray:
        sizes.append((part.stop - part.start) * 2_000)
        return np.ones((2_000, len(range(*part.indices(300_000)))), bool)

    assert (twoview.inliers(2_000, 300_000, inside) == 300_000).all()
    assert max(sizes) <= twoview.CELLS


def test_blocks_are_compared_in_little_memory():
    """One table of squares at a time; ties by ids, and blocks of one row or of equal rows."""
    from manyview.operators import matching

    rng = np.random.default_rng(2)
    left, right, ids = rng.integers(0, 3, (700, 8)).astype(float), rng.integers(0, 3, (900, 8)).astype(float), rng.permutation(900)
    far = np.round(np.sqrt(((left[:, None] - right) ** 2).sum(2)), 9)
    for n in (900, 2, 1):
        rows, b, dist = matching._nearest(left, right[:n], ids[:n])
        expected = [(a, ids[k], far[a, k]) for a in range(700) for k in np.lexsort((ids[:n], far[a, :n]))[:2]]
        assert list(zip(rows, b, dist)) == expected
    a, b = rng.normal(size=(2, 4_096, 64))
    tracemalloc.start()
    matching._nearest(a, b, np.arange(4_096))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6, peak
