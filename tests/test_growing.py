"""Tracks with their views as arrays give the numbers of the relational steps."""

import numpy as np
from pyspark.sql import functions as F

from manyview.operators import growing, triangulate
from manyview.plans import queries
from manyview.session import cut

SF = "/root/testdata/sf0.001"


def _run(tracks, rig, fn):
    return {r["track_id"]: (r["x"], r["y"], r["z"]) for r in growing.tried(tracks, rig, 7, fn)[0].collect()}


def _near(got, expected):
    assert got.keys() == expected.keys() and got
    assert all(np.allclose(got[t], expected[t], rtol=0, atol=1e-9) for t in got)


def test_points_equal_the_relational_ones(spark):
    s = queries.Scene(spark, SF)
    cameras, obs = cut(s.cameras), cut(s.obs.select("track_id", "img_id", "u", "v"))
    rig, order = growing.rig_of(cameras), [0, 2, 3, 5, 7, 8, 9]
    mine = cut(obs.join(obs.where("img_id = 7").select("track_id"), "track_id", "left_semi"))
    known = rig.known(order)

    def several(views):
        x = growing.checked(views.only(known[views.camera]), rig, 1.5, 2)
        return np.where(growing.valid(x, views, rig, 1.5, 3)[:, None], x, np.nan)

    points = triangulate.triangulate_checked(mine.where(F.col("img_id").isin(order)), cameras, 1.5, 2)
    good = triangulate.validate(points, mine, cameras, 1.5, 3).where("valid")
    _near(_run(growing.listed(obs), rig, several), {r["track_id"]: (r["x"], r["y"], r["z"]) for r in points.join(good, "track_id").collect()})

    partner = triangulate.best_baseline(obs, cameras, 7, order).select("track_id", F.col("partner").alias("i"))
    sides = [obs.select("track_id", F.col("img_id").alias(c), F.col("u").alias(f"x{c}"), F.col("v").alias(f"y{c}")) for c in "ij"]
    pairs = partner.join(sides[0], ["track_id", "i"]).join(sides[1].where("j = 7"), "track_id")
    fine = triangulate.two_view_reasons(pairs, cameras, 2.0, 2.0).where("reason = 0")
    _near(_run(growing.listed(obs), rig, lambda v: growing.of_two_views(v, rig, 7, known, 2.0, 2.0)), {r["track_id"]: (r["x"], r["y"], r["z"]) for r in fine.collect()})


def test_rounds_do_not_shuffle_tracks(spark, monkeypatch):
    s = queries.Scene(spark, SF)
    tracks, plans, real = cut(growing.listed(s.obs)), [], growing.cut
    monkeypatch.setattr(growing, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    rig = growing.rig_of(s.cameras)
    new, open_, n, seen = growing.tried(tracks, rig, 7, lambda v: growing.checked(v, rig, 1.5, 3))
    assert len(plans) == 2 and not any("Exchange" in p for p in plans)
    assert n == new.count() > 0 and n + open_.count() == tracks.count() and seen[7] == n
    assert growing.shown(new, 7).count() == n


def test_tracks_without_known_views_stay_open(spark):
    rig = growing.rig_of(queries.Scene(spark, SF).cameras)
    rows = [(1, [7], [1.0], [2.0]), (2, [], [], []), (3, [7, 99], [1.0, 1.0], [2.0, 2.0]), (4, [0, 7], [None, 1.0], [None, 1.0])]
    tracks = spark.createDataFrame(rows, growing.TRACK)
    for made in (lambda v: growing.checked(v, rig, 1.5, 2), lambda v: growing.of_two_views(v, rig, 7, rig.known([0]), 2.0, 2.0)):
        new, open_, n, _ = growing.tried(tracks, rig, 7, made)
        assert n == new.count() == 0 and open_.count() == 4


def test_observations_of_a_batch_stay_arrays():
    """Without an object for each observation; and the sums of pairs are the same by one product for each pair of cameras as one by one."""
    import tracemalloc

    import pyarrow as pa

    from manyview.operators import adjust

    rng, n, k = np.random.default_rng(1), 4_000, 5
    cams = adjust.Cameras({i: {"k": np.array([800.0, 800, 512, 384]), "r": adjust.rodrigues(rng.normal(size=3) / 9), "t": np.array([0.1 * i, 0, 6])} for i in range(k)})
    lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k), pa.int32()), pa.array(v)) for v in (np.tile(np.arange(k, dtype=np.int32), n), *rng.uniform(0, 700, (2, n * k)))]
    x = rng.normal(size=(n, 3))
    rows = pa.RecordBatch.from_arrays([pa.array(range(n)), *map(pa.array, x.T), *lists], ["track_id", *"xyz", "img", "u", "v"])
    tracemalloc.start()
    adjust.Batch(rows, cams)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * n * k

    def blocks(part, at):
        made = adjust.Reduced(x[at], part, cams, np.arange(k), 1e-3, 2.0, "cauchy", np.zeros((len(at), 3)), x[at], adjust.Bounds())
        return {(int(i), int(j), p): b for p, (ii, jj, v) in enumerate(made.blocks(k)) for i, j, b in zip(ii, jj, v) if p == 0}

    some = np.arange(200)
    together = blocks(rows.slice(0, 200), some)
    single = [blocks(rows.slice(t, 1), np.array([t])) for t in some]
    assert len(together) == k * k and all(np.allclose(b, sum(s[key] for s in single), rtol=1e-9, atol=1e-9 * np.abs(b).max()) for key, b in together.items())


def test_masks_are_looked_up_without_a_shuffle_of_projections(spark):
    """Points in all images are as many rows as both together; only a point's counts may be shuffled."""
    from manyview.operators import diagnostics

    s = queries.Scene(spark, SF)
    runs = s.runs.where("img_id < 20").unionByName(s.runs.where("img_id = 3"))  # a line twice, images without a mask
    judged = diagnostics.outside_masks(s.points, s.cameras, runs, queries.WIDTH, queries.HEIGHT, 1, 0.0)
    got = {r["track_id"]: (r["n_views"], r["ratio"]) for r in judged.collect()}
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan.split("Initial Plan")[0] and plan.split("Initial Plan")[0].count("Exchange hashpartitioning") <= 1
    masks = {}
    for r in runs.collect():
        masks.setdefault((r["img_id"], r["v"]), []).append((r["u0"] - 1, r["u1"] + 1))
    outs = {}
    for r in diagnostics.projected(s.points, s.cameras).collect():
        if r["u"] is not None and 0 <= r["u"] <= queries.WIDTH - 1 and 0 <= r["v"] <= queries.HEIGHT - 1:
            lines = masks.get((r["img_id"], round(r["v"])), [])
            outs.setdefault(r["track_id"], []).append(not any(a <= round(r["u"]) <= b for a, b in lines))
    assert got == {t: (len(o), sum(o) / len(o)) for t, o in outs.items()} and got
