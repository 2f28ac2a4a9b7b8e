"""Tracks in blocks: the same views, points and adjustments as the relational steps give, over all points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from manyview.operators import adjust, cleanup, errors, graph, growing, growth, triangulate, twoview
from manyview.plans import queries
from manyview.plans.config import PRESETS, Config
from manyview.session import cut

SF = "/root/testdata/sf0.001"
IMAGES = [3, 2, 5, 7]


@pytest.fixture(scope="module")
def scene(spark):
    s = queries.Scene(spark, SF)
    obs, cameras = cut(s.obs.select("track_id", "img_id", "u", "v")), cut(s.cameras)
    return obs, cameras, cut(triangulate.triangulate(obs, cameras, 2).select("track_id", "x", "y", "z"))


class Given:
    """Sets the points of the tracks to those of a table."""

    def __init__(self, points):
        self.table = {r["track_id"]: (r["x"], r["y"], r["z"]) for r in points.collect()}

    def __call__(self, block):
        block.x[:] = [self.table.get(t, (np.nan,) * 3) for t in block.ids.tolist()]


def _grown(scene):
    grown = growth.Growth(scene[0])
    grown.then(Given(scene[2]))
    return grown


def _rows(points):
    return {r["track_id"]: (r["x"], r["y"], r["z"]) for r in points.collect()}


def _table(cameras):
    return {r["img_id"]: tuple(r[n] for n in growing.NAMES) for r in cameras.collect()}


@pytest.mark.parametrize(("records", "tracks"), [(7, 3), (10_000, 2_000)])
def test_blocks_have_all_views(spark, scene, monkeypatch, records, tracks):
    """Tracks go on from batch to batch, and blocks are cut between them."""
    monkeypatch.setattr(growth, "TRACKS", tracks)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    try:
        blocks = [b for batch in growth.packed(scene[0]).toArrow().to_batches() for b in growth._blocks([batch], ())]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    got = {}
    for b in blocks:
        assert len(b.ids) <= tracks and not b.made().any()
        for n, t in enumerate(b.ids.tolist()):
            mine = b.owner == n
            assert t not in got
            got[t] = list(zip(b.img[mine].tolist(), b.u[mine].tolist(), b.v[mine].tolist()))
    assert got == {r["track_id"]: list(zip(r["img"], r["u"], r["v"])) for r in growing.listed(scene[0]).collect()}


def test_all_points_are_adjusted(scene):
    """No cap is set, and the points and cameras are those of the adjustment by joins, which has all points with two views as well."""
    assert all(c.adjustment.local_cap is None and c.adjustment.global_cap is None for c in (*PRESETS.values(), Config()))
    obs, cameras, points = scene
    grown, table = _grown(scene), _table(cameras)
    placed = grown.adjust(table, IMAGES, None, 10, 30, 2.0, "cauchy")
    moved, others = adjust.run(points, obs, cameras, IMAGES, None, 10, 30)
    was, got, expected = _rows(points), _rows(grown.points()), _rows(moved)
    views = {r["track_id"] for r in obs.where(F.col("img_id").isin(IMAGES)).groupBy("track_id").count().where("count >= 2").collect()}
    assert got.keys() == was.keys() and {t for t in was if got[t] != was[t]} == views & was.keys() and len(views) > 50
    assert all(np.allclose(got[t], expected[t], atol=1e-7) for t in got)
    assert list(placed) == list(table) and all(np.allclose(placed[i], c, atol=1e-7) for i, c in _table(others).items())
    assert {i for i in table if placed[i] != table[i]} == {5, 7}


def test_a_cap_is_for_those_who_ask(scene):
    obs, cameras, points = scene
    grown, was = _grown(scene), _rows(points)
    grown.adjust(_table(cameras), IMAGES, 40, 10, 30, 2.0, "cauchy")
    got = _rows(grown.points())
    chosen = adjust.problem(obs.join(points.select("track_id"), "track_id", "left_semi"), IMAGES, 40)
    assert {t for t in was if got[t] != was[t]} == {r["track_id"] for r in chosen.select("track_id").distinct().collect()}
    few, table = _grown(scene), _table(cameras)
    assert few.adjust(table, IMAGES, None, 10_000, 30, 2.0, "cauchy") is table and _rows(few.points()) == was


def test_steps_are_run_over_again(scene, monkeypatch):
    """What is not written yet is the same as what is; a round neither shuffles nor writes the tracks."""
    obs, cameras, _ = scene
    rig, plans = growing.rig_of(cameras), []
    steps = [growth.New(growing.Rig({i: c for i, c in _table(cameras).items() if i <= at}), at, 2.0, 1.0, 2 if at > 1 else None) for at in (1, 2, 3, 4, 5)]
    written, kept = growth.Growth(obs), growth.Growth(obs)
    monkeypatch.setattr(growth, "REPLAYED", 100)
    for step in steps:
        written.then(step)
        written.write()
        kept.then(step)
    monkeypatch.setattr(growth, "cut", lambda df: plans.append(df) or cut(df))
    assert _rows(written.points()) == _rows(kept.points()) and written.counts() == kept.counts()
    n, found = kept.counts()
    made = kept.points()
    seen = {r["img_id"]: r["n"] for r in obs.join(made, "track_id").groupBy("img_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n == made.count() > 30 and found == seen and kept.shown(3).count() == seen[3]
    assert not plans and "Exchange" not in kept.shown(3)._jdf.queryExecution().executedPlan().toString()
    star = errors.observed(made, obs, cameras, cleanup.DEPTH_MEDIAN).where(F.col("depth") > cleanup.DEPTH_MEDIAN)
    got, expected = ({(r["track_id"], round(r["depth"], 6), round(r["err"], 6)) for r in d.select("track_id", "depth", "err").collect()} for d in (kept.errors(rig), star))
    assert got == expected and got
    judged = [sorted((r["track_id"], r["n_views"], r["n_good"], r["keep"]) for r in d.collect()) for d in (cleanup.adaptive_of(made, kept.errors(rig)), cleanup.adaptive(made, obs, cameras))]
    assert judged[0] == judged[1] and any(r[3] for r in judged[0])


def test_pairs_with_poses_equal_verified_pairs(spark):
    pixels = cut(queries.Scene(spark, SF).pixels)
    score = lambda i, j, r, t, x, y: len(x)
    both = cut(twoview.posed_pairs(pixels, queries.K, 3.0, 10, score))
    verified = {tuple(r) for r in twoview.verify_pairs(pixels, queries.K, 3.0, 10).collect()}
    rows = both.collect()
    assert verified and {tuple(r)[:4] for r in rows if r["a"] is not None} == verified
    poses = {(r["i"], r["j"]): np.frombuffer(r["pose"]) for r in rows if r["a"] is None}
    assert poses.keys() == {v[:2] for v in verified}
    for pair, p in poses.items():
        turn = p[:9].reshape(3, 3)
        assert np.allclose(turn @ turn.T, np.eye(3), atol=1e-8) and np.isclose(np.linalg.norm(p[9:12]), 1) and p[12] == sum(v[:2] == pair for v in verified)


@pytest.mark.parametrize("steps", [1, 2, 100])
def test_adjustment_of_all_images(scene, monkeypatch, steps):
    """Points and their largest derivatives are written on the way."""
    monkeypatch.setattr(growth, "STEPS", steps)
    obs, cameras, points = scene
    images = sorted(r["img_id"] for r in obs.select("img_id").distinct().collect())
    grown, table = _grown(scene), {i: c for i, c in _table(cameras).items() if i in images}
    placed = grown.adjust(table, images, None, 10, 30, 2.0, "cauchy")
    moved, others = adjust.run(points, obs, cameras, images, None, 10, 30)
    got, expected, was = _rows(grown.points()), _rows(moved), _rows(points)
    assert got.keys() == expected.keys() and any(got[t] != was[t] for t in was)
    assert all(np.allclose(got[t], expected[t], rtol=1e-6, atol=1e-6) for t in got)
    assert all(np.allclose(c, placed[i], atol=1e-6) for i, c in _table(others).items() if i in placed)
    assert not grown.steps and len(grown.base.first()["peak"]) == 0


def test_an_adjustment_reads_only_its_tracks(scene):
    grown = _grown(scene)
    work = growth.Moved((3, 2, 5, 7), np.array([-1, -1, 0, 1]), 2.0, "cauchy")
    part = grown.taken(work)
    blocks = [b for batch in part.base.toArrow().to_batches() for b in growth._blocks([batch], ())]
    mine = scene[0].where("img_id in (2, 3, 5, 7)").join(scene[2].select("track_id"), "track_id", "left_semi")
    twice = mine.join(mine.groupBy("track_id").count().where("count >= 2"), "track_id", "left_semi").select("track_id", "img_id").collect()
    assert twice and {(b.ids[o], i) for b in blocks for o, i in zip(b.owner, b.img)} == {tuple(r) for r in twice}


def test_sorted_components(spark):
    """Duplicates, both directions, loops, chains, a star, and links of wrong matches."""
    rng = np.random.default_rng(3)
    chain = [(k, k + 1) for k in range(100, 140)] + [(k + 1, k) for k in range(120, 130)]
    some = [tuple(int(x) for x in p) for p in rng.integers(200, 600, (220, 2))]
    links = spark.createDataFrame([*chain, (5, 5), *[(7, k) for k in range(1000, 1200)], (3, 1), (3, 2), (3, 1), *some, *some[:50]], "a long, b long")
    got, expected = (sorted(map(tuple, f(links).collect())) for f in (graph.sorted_components, graph.components))
    assert got == expected and len(got) > 500
    assert graph.sorted_components(links.limit(0)).count() == 0
    plan = graph._sorted_star(graph._sorted_star(cut(links), True), False)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange") == 2 and "Join" not in plan
