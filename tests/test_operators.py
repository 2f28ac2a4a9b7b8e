"""Operators against plain Python and NumPy, and the edge cases of each."""

import inspect
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from manyview.functions import text
from manyview.functions.projection import quaternion, undistorted
from manyview.operators import adjust, cleanup, diagnostics, errors, graph, matching, register, tracks, triangulate, twoview
from manyview.plans import queries, reconstruct, scene
from manyview.plans.config import PRESETS, Config
from manyview.session import cut
from manyview.sources import calibration, clouds, exports, images

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rig(spark):
    cameras, points = cut(scene.cameras(spark, SF)), cut(scene.points(spark, SF))
    obs = cut(scene.obs(spark, SF))
    return cameras, points, obs, cut(scene.keypoints(obs))


def exact(rig):
    """Observations without noise."""
    cameras, points, obs, _ = rig
    return errors.observed(points, obs, cameras).select("track_id", "img_id", F.col("pu").alias("u"), F.col("pv").alias("v"))


def test_triangulation_inverts_projection(rig):
    cameras, points, _, _ = rig
    made = triangulate.triangulate(exact(rig), cameras).join(points.select("track_id", *[F.col(c).alias(f"t{c}") for c in "xyz"]), "track_id")
    assert made.where("n_views >= 2").agg(F.max(sum((F.abs(F.col(c) - F.col(f"t{c}")) for c in "xyz"), F.lit(0.0)))).first()[0] < 1e-8


def test_null_vector_equals_svd(rig):
    cameras, _, obs, _ = rig
    table = {r["img_id"]: r for r in cameras.collect()}
    got = {r["track_id"]: (r["x"], r["y"], r["z"]) for r in triangulate.triangulate(obs, cameras, 3).collect()}
    views = {}
    for r in obs.collect():
        views.setdefault(r["track_id"], []).append(r)
    for track, xyz in list(got.items())[:60]:
        rows = []
        for o in views[track]:
            c = table[o["img_id"]]
            p = np.array([[c["fx"], 0, c["cx"]], [0, c["fy"], c["cy"]], [0, 0, 1]]) @ np.column_stack([[[c[f"r{i}{j}"] for j in range(3)] for i in range(3)], [c["tx"], c["ty"], c["tz"]]])
            rows += [o["u"] * p[2] - p[0], o["v"] * p[2] - p[1]]
        n = np.linalg.svd(np.array(rows))[2][-1]
        assert np.allclose(n[:3] / n[3], xyz, atol=1e-8)


def test_points_behind_and_not_finite(spark, rig):
    cameras, _, _, _ = rig
    odd = spark.createDataFrame([(1, 100.0, 0.0, 0.0), (2, float("nan"), 0.0, 0.0), (3, float("inf"), 0.0, 0.0), (4, None, 0.0, 0.0)], "track_id long, x double, y double, z double")
    seen = spark.createDataFrame([(t, 0, 5.0, 5.0) for t in (1, 2, 3, 4)], "track_id long, img_id int, u double, v double")
    star = errors.observed(odd, seen, cameras)
    assert all(r["err"] is None for r in star.collect())
    assert all(r["err"] == float("inf") for r in errors.errors_or_infinite(star).collect())
    assert {r["reason"] for r in cleanup.strict(odd, seen, cameras).collect()} == {"median"}


def test_small_clouds_pass_the_gate(spark):
    few = spark.createDataFrame([(k, float(k**5), 0.0, 0.0) for k in range(9)], "track_id long, x double, y double, z double")
    assert cleanup.spatial(few).where("keep").count() == 9
    more = few.unionAll(spark.createDataFrame([(k, 0.0, 0.0, 0.0) for k in range(9, 60)], few.schema))
    assert cleanup.spatial(more).where("keep").count() < 60
    assert cleanup.kept(few.where("track_id <> 4")).orderBy("pid").select("pid", "track_id").collect()[-1] == (7, 8)
    assert cleanup.spatial(few.limit(0)).count() == 0


def test_unique_matches_are_greedy(spark):
    rng = random.Random(3)
    rows = [(0, 1, a, rng.randrange(12), rng.randrange(6) / 2) for a in range(40)]
    got = {(r["a"], r["b"]) for r in matching.unique_by_distance(spark.createDataFrame(rows, "i int, j int, a int, b int, dist double")).collect()}
    taken, expected = set(), set()
    for _, _, a, b, _ in sorted(rows, key=lambda r: (r[4], r[2])):
        if b not in taken:
            taken.add(b)
            expected.add((a, b))
    assert got == expected


def test_unique_in_order(spark):
    rng = random.Random(5)
    rows = [(0, k % 2, rng.randrange(10), rng.randrange(10), k) for k in range(60)]
    got = {(r["j"], r["a"], r["b"]) for r in matching.unique_in_order(spark.createDataFrame(rows, "i int, j int, a int, b int, nth int")).collect()}
    used, expected = set(), set()
    for _, j, a, b, _ in rows:
        if not {(j, "a", a), (j, "b", b)} & used:
            used |= {(j, "a", a), (j, "b", b)}
            expected.add((j, a, b))
    assert got == expected


def test_mutual_within(spark):
    kind = "i int, j int, a int, b int"
    forward = spark.createDataFrame([(0, 1, 5, 7), (0, 1, 9, 2), (0, 1, 3, 3)], kind)
    backward = spark.createDataFrame([(1, 0, 7, 6), (1, 0, 2, 4), (1, 0, 3, 3)], kind)
    assert {(r["a"], r["b"]) for r in matching.mutual_within(forward, backward).collect()} == {(5, 7), (3, 3)}
    assert {(r["a"], r["b"]) for r in matching.mutual(forward, backward).collect()} == {(3, 3)}


def test_undistorted_inverts_the_lens(spark):
    k1, k2, p1, p2, k3 = 0.05, -0.01, 0.001, -0.0005, 0.002
    rows, true = [], {}
    for n, (x, y) in enumerate([(0.0, 0.0), (0.3, -0.2), (-0.4, 0.3)]):
        r = x * x + y * y
        radial = 1 + k1 * r + k2 * r * r + k3 * r**3
        rows.append((n, 800 * (x * radial + 2 * p1 * x * y + p2 * (r + 2 * x * x)) + 512, 800 * (y * radial + p1 * (r + 2 * y * y) + 2 * p2 * x * y) + 384, 800.0, 800.0, 512.0, 384.0))
        true[n] = (800 * x + 512, 800 * y + 384)
    df = spark.createDataFrame(rows, "n int, x double, y double, fx double, fy double, cx double, cy double")
    for r in undistorted(df, ["n"], (k1, k2, p1, p2, k3)).collect():
        assert np.allclose((r["x"], r["y"]), true[r["n"]], atol=1e-5)


def test_single_camera(spark):
    kps = cut(scene.keypoints(scene.obs(spark, "/root/testdata/sf0.01")))
    k = (800.0, 800.0, 512.0, 384.0)
    made = reconstruct.single_camera(kps, cut(scene.matches(kps)), k, images=3)
    assert made["cameras"].count() == 3 and made["points"].count() >= 30
    pixels = made["track_obs"].join(kps.select("img_id", "kp_id", F.col("x").alias("u"), F.col("y").alias("v")), ["img_id", "kp_id"])
    star = errors.observed(made["points"], pixels, made["cameras"])
    assert star.agg(F.median("err")).first()[0] < 1.5


def test_monotonic(spark):
    rng = random.Random(4)
    rows = [(0, 1, a, rng.randrange(60)) for a in range(50)]
    got = [r["b"] for r in matching.monotonic(spark.createDataFrame(rows, "i int, j int, a int, b int")).orderBy("a").collect()]
    most, expected = None, []
    for *_, b in rows:
        if most is None or b >= most - 5:
            expected.append(b)
        most = b if most is None else max(most, b)
    assert got == expected


def test_one_candidate_fails_the_ratio_test(spark):
    desc = spark.createDataFrame([(0, 0, [0.0, 1.0]), (0, 1, [1.0, 0.0]), (1, 0, [0.0, 1.0])], "img_id int, kp_id int, desc array<double>")
    pairs = spark.createDataFrame([(0, 1)], "i int, j int")
    assert matching.ratio_test(matching.two_nearest(desc, pairs), 0.9).count() == 0
    two = desc.unionAll(spark.createDataFrame([(1, 1, [0.0, -1.0])], desc.schema))
    assert [(r["a"], r["b"]) for r in matching.match_descriptors(two, pairs, 0.9).collect()] == [(0, 0)]


def test_tracks_with_conflicts(spark):
    rows = [(0, 1, 0, 0), (1, 2, 0, 0), (0, 2, 1, 0), (0, 1, 5, 5), (3, 4, 0, 0), (3, 4, 0, 1), (3, 4, 2, 1)]
    nodes = cut(tracks.labelled(spark.createDataFrame(rows, "i int, j int, a int, b int")))
    got = {}
    for r in tracks.build(nodes).collect():
        got.setdefault(r["track_id"], []).append((r["img_id"], r["kp_id"]))
    assert {k: sorted(v) for k, v in got.items()} == {0: [(0, 0), (1, 0), (2, 0)], 1: [(0, 5), (1, 5)], 2: [(3, 0), (4, 1)]}
    first = {(r["img_id"], r["kp_id"]) for r in tracks.build(nodes, "first").collect()}
    assert (4, 0) in first and (4, 1) not in first
    s = tracks.statistics(nodes).first()
    assert (s["components"], s["multi_view"], s["conflicts"], s["dropped"]) == (3, 3, 2, 3)
    none = spark.createDataFrame([], "i int, j int, a int, b int")
    assert tracks.build(tracks.labelled(none)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, 299), (5, 5), (400, 400)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for link in links for x in link if link[0] != link[1]}
    assert got == {x: find(x) for x in linked}


def test_fixpoint_and_incremental(rig):
    cameras, points, obs, kps = rig
    grown = register.fixpoint(obs, cameras, (0, 1))
    assert len(grown.order) >= 9 and grown.counts == sorted(grown.counts)
    matches = cut(scene.matches(kps))
    result = reconstruct.known_cameras(cameras, kps, matches, images=4)
    assert result["points"].count() > 5 and [r["ordinal"] for r in result["order"].orderBy("ordinal").collect()] == [0, 1, 2, 3]
    near = result["points"].join(result["track_obs"], "track_id").join(kps.select("img_id", "kp_id", F.col("track_id").alias("true_id")), ["img_id", "kp_id"])
    best = near.groupBy("pid", "x", "y", "z").agg(F.mode("true_id").alias("true_id")).join(points.select(F.col("track_id").alias("true_id"), *[F.col(c).alias(f"t{c}") for c in "xyz"]), "true_id")
    assert best.agg(F.median(F.sqrt(sum(((F.col(c) - F.col(f"t{c}")) * (F.col(c) - F.col(f"t{c}")) for c in "xyz"), F.lit(0.0))))).first()[0] < 0.05


def test_adjustment_lowers_the_cost(rig):
    cameras, _, obs, _ = rig
    start = cut(triangulate.triangulate(obs, cameras, 3))
    moved = adjust.points_only(start, obs, cameras).collect()
    assert all(r["after"] <= r["before"] for r in moved)
    chosen = cut(obs.where("track_id < 40"))
    points, refined, costs = adjust.full(start.where("track_id < 40"), chosen, cameras, rounds=3)
    assert costs == sorted(costs, reverse=True) and costs[-1] < costs[0] and refined.count() == cameras.count() and points.count() > 20
    assert adjust.updated(start.select("track_id", "x", "y", "z"), points).count() == start.count()


def test_poses_from_pixels(rig):
    cameras, points, obs, _ = rig
    k = (800.0, 800.0, 512.0, 384.0)
    rng = np.random.default_rng(2)
    spots = rng.uniform(-1, 1, (60, 3))
    table = {r["img_id"]: r for r in cameras.collect()}

    def seen(img):
        c = table[img]
        r, t = np.array([[c[f"r{i}{j}"] for j in range(3)] for i in range(3)]), np.array([c["tx"], c["ty"], c["tz"]])
        p = spots @ r.T + t
        return r, t, p[:, :2] / p[:, 2:]

    (r0, t0, a), (r1, t1, b) = seen(0), seen(3)
    bad = b.copy()
    bad[:12] += rng.uniform(0.05, 0.2, (12, 2))
    e, inside = twoview.essential(a, bad, 0.002, 1)
    assert inside[12:].mean() > 0.95 and inside[:12].mean() < 0.3
    r, t = twoview.pose_of(e, a[inside], b[inside])
    true_t = t1 - r1 @ r0.T @ t0
    assert np.allclose(r, r1 @ r0.T, atol=1e-3) and np.allclose(t, true_t / np.linalg.norm(true_t), atol=1e-3)
    links = obs.where("img_id = 4").join(points, "track_id").select("img_id", "track_id", "u", "v", "x", "y", "z")
    found = twoview.pnp(links, k).first()
    true = np.array([[table[4][f"r{i}{j}"] for j in range(3)] for i in range(3)])
    assert np.allclose(np.array(found["r"]).reshape(3, 3), true, atol=5e-3)


def test_pose_counts_all_inliers():
    rng = np.random.default_rng(5)
    turn = np.array([[np.cos(0.2), 0, np.sin(0.2)], [0, 1, 0], [-np.sin(0.2), 0, np.cos(0.2)]])
    move = np.array([1.0, 0.1, 0.05])
    spots = rng.uniform(-1, 1, (200, 3)) + [0, 0, 5]
    spots[:60] *= -1  # a prefix of rows whose points lie behind the cameras
    ahead = spots @ turn.T + move
    a, b = spots[:, :2] / spots[:, 2:], ahead[:, :2] / ahead[:, 2:]
    r, t = twoview.pose_of(twoview.eight_points(a, b), a, b)
    assert np.allclose(r, turn, atol=1e-6) and np.allclose(t, move / np.linalg.norm(move), atol=1e-6)


@pytest.mark.parametrize(("name", "module", "step"), [("essential_inliers", twoview, "verify_pairs"), ("two_view_poses", twoview, "two_view_poses"), ("pnp_poses", twoview, "pnp"), ("contour_matches_all", matching, "match_contours"), ("ba_full", adjust, "full")])
def test_queries_hand_over_all_rows(spark, monkeypatch, name, module, step):
    """What the operator is given; the operators themselves have other tests."""
    given = []

    def kept(*args, **kwargs):
        given.extend(args)
        raise InterruptedError

    monkeypatch.setattr(module, step, kept)
    with pytest.raises(InterruptedError):
        queries.QUERIES[name](spark, SF)
    s = queries.Scene(spark, SF)
    if name == "ba_full":
        assert given[1].count() == s.obs.count() and given[0].count() == triangulate.triangulate(s.obs, s.cameras, 3).count() > 100
    elif name == "contour_matches_all":
        assert given[0].select("img_id").distinct().count() == 25 and given[2].count() == 300
    else:
        assert given[0].count() == (s.obs.join(s.points, "track_id") if name == "pnp_poses" else s.pixels).count()


@pytest.mark.parametrize(("name", "module", "loop"), [("incremental_multicam", register, "incremental"), ("reconstruction", reconstruct, "known_cameras"), ("single_camera_points", reconstruct, "single_camera")])
def test_loops_are_not_capped(spark, monkeypatch, name, module, loop):
    """The whole loops take minutes; here only that no number of images is handed to them."""
    bound = {}

    def kept(*args, **kwargs):
        bound.update(inspect.signature(whole).bind(*args, **kwargs).arguments)
        raise InterruptedError

    whole = getattr(module, loop)
    monkeypatch.setattr(module, loop, kept)
    monkeypatch.setattr(tracks, "labelled", lambda matches: matches)
    monkeypatch.setattr(tracks, "build", lambda matches: matches)
    with pytest.raises(InterruptedError):
        queries.QUERIES[name](spark, SF)
    assert bound.get("most_images") is None and bound.get("images") is None


def test_calibration_text(spark):
    odd = ["1e-3 -.5 5. 1.e5", "K = [[700, 0, 512], [0, 700, 384], [0, 0, 2]]", "1 2 3", "", '{"intrinsics": {"K": [[7,0,5],[0,7,4],[0,0,1]]}}', '{"x": 1}']
    df = spark.createDataFrame(list(enumerate(odd)), "stem string, body string")
    assert df.orderBy("stem").select(text.floats(F.col("body"))).first()[0] == [1e-3, -0.5, 5.0, 1.0, 5.0]
    got = {r["stem"]: r for r in calibration.read_intrinsics(df).collect()}
    assert not got["1"]["valid"] and got["2"]["k"] is None and got["3"]["k"] is None and got["4"]["valid"] and got["5"]["k"] is None
    both, no_camera, no_image = calibration.pair_with_images(spark.createDataFrame([("a",), ("b",)], "stem string"), spark.createDataFrame([("b",), ("c",)], "stem string"))
    assert [(r["stem"], r["img_id"]) for r in both.collect()] == [("b", 0)] and no_camera.first()[0] == "a" and no_image.first()[0] == "c"


def test_projection_matrix_decomposes(spark, rig):
    cameras, *_ = rig
    from manyview.functions.projection import projection_matrix

    p = projection_matrix()
    rows = cameras.select(F.col("img_id").cast("string").alias("stem"), F.array(*[p[i][j] * -2.0 for i in range(3) for j in range(4)]).alias("p"))
    got = {r["stem"]: r for r in calibration.decompose(rows).collect()}
    for c in cameras.collect():
        g = got[str(c["img_id"])]
        assert all(abs(g[k] - c[k]) < 1e-6 for k in ("fx", "fy", "cx", "cy", "cx_w", "cy_w", "cz_w")) and abs(g["skew"]) < 1e-6
        assert all(abs(g[f"r{i}{j}"] - c[f"r{i}{j}"]) < 1e-9 for i in range(3) for j in range(3)) and abs(g["tx"] - c["tx"]) < 1e-8


def test_quaternions_are_rotations(spark, rig):
    cameras, *_ = rig
    for r in cameras.select(*[q.alias(k) for q, k in zip(quaternion(), "wxyz")], "r00", "r01", "r21").collect():
        w, x, y, z = (r[k] for k in "wxyz")
        assert abs(w * w + x * x + y * y + z * z - 1) < 1e-12 and w >= 0
        assert abs(1 - 2 * (y * y + z * z) - r["r00"]) < 1e-9 and abs(2 * (x * y - w * z) - r["r01"]) < 1e-9 and abs(2 * (y * z + w * x) - r["r21"]) < 1e-9


def test_ply_and_checkpoint(spark, tmp_path):
    cloud = spark.createDataFrame([(k, k / 3, -k / 7, 1e-7, k, 2, 255) for k in range(300)], "pid long, x double, y double, z double, r int, g int, b int")
    clouds.write_ply(cloud, str(tmp_path / "cloud.ply"), True)
    back = clouds.read_ply(spark, str(tmp_path / "cloud.ply")).orderBy("pid").collect()
    assert [(r["pid"], round(r["x"], 5), r["r"], r["b"]) for r in back] == [(k, round(k / 3, 5), k, 255) for k in range(300)]
    (tmp_path / "bad.ply").write_text("ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n")
    with pytest.raises(ValueError):
        clouds.read_ply(spark, str(tmp_path / "bad.ply"))
    clouds.save({"cloud": cloud}, str(tmp_path / "saved"), {"k": 1})
    assert clouds.load(spark, str(tmp_path / "saved"))["cloud"].count() == 300


def test_exports(spark, rig, tmp_path):
    cameras, points, obs, kps = rig
    sized = cameras.withColumn("width", F.lit(1024)).withColumn("height", F.lit(768))
    numbered = points.where("track_id < 20").withColumn("pid", F.col("track_id"))
    bundle = {"cameras": sized, "keypoints": kps.select("img_id", "kp_id", "x", "y"), "track_obs": kps.select("track_id", "img_id", "kp_id"), "points": numbered, "errors": errors.point_summary(errors.observed(points, obs, cameras))}
    for kind in ("colmap text".replace(" ", "_"), "colmap", "NeRFStudio", "instant-ngp"):
        exports.export(kind, bundle, str(tmp_path / kind))
    import json
    import struct

    raw, at = (tmp_path / "colmap/cameras.bin").read_bytes(), 8
    assert struct.unpack("<Q", raw[:8])[0] == 25 and len(raw) == 8 + 25 * 56
    for r in exports.cameras_table(sized).orderBy("camera_id").collect():
        assert struct.unpack_from("<iiQQ4d", raw, at) == (r["camera_id"], 1, 1024, 768, r["fx"], r["fy"], r["cx"], r["cy"])
        at += 56
    raw, at = (tmp_path / "colmap/images.bin").read_bytes(), 8
    assert struct.unpack("<Q", raw[:8])[0] == 25
    spots = exports.points2d(bundle["keypoints"], bundle["track_obs"], bundle["points"]).collect()
    for r in exports.poses_table(sized).orderBy("image_id").collect():
        assert struct.unpack_from("<i7di", raw, at) == (r["image_id"], *[r[k] for k in ("qw", "qx", "qy", "qz", "tx", "ty", "tz")], r["camera_id"])
        end = raw.index(b"\0", at + 64)
        assert raw[at + 64 : end].decode() == r["name"]
        own = sorted((s["kp_id"], s["x"], s["y"], s["point_id"]) for s in spots if s["image_id"] == r["image_id"])
        assert struct.unpack_from("<Q", raw, end + 1)[0] == len(own)
        assert [struct.unpack_from("<ddq", raw, end + 9 + 24 * k) for k in range(len(own))] == [s[1:] for s in own]
        at = end + 9 + 24 * len(own)
    assert at == len(raw)
    raw, at = (tmp_path / "colmap/points3D.bin").read_bytes(), 8
    assert struct.unpack("<Q", raw[:8])[0] == 20
    for r in exports.points3d(bundle["points"], bundle["track_obs"], bundle["errors"]).orderBy("point_id").collect():
        assert struct.unpack_from("<Q3d3Bd", raw, at) == (r["point_id"], r["x"], r["y"], r["z"], exports.GREY, exports.GREY, exports.GREY, r["error"])
        own = [(t["image_id"], t["kp_id"]) for t in r["track"] or []]
        assert struct.unpack_from("<Q", raw, at + 43)[0] == len(own) and [struct.unpack_from("<ii", raw, at + 51 + 8 * k) for k in range(len(own))] == own
        at += 51 + 8 * len(own)
    assert at == len(raw)
    lines = [line for part in sorted((tmp_path / "colmap_text/images").glob("part*")) for line in part.read_text().splitlines()]
    assert len(lines) == 50
    assert len(json.loads((tmp_path / "NeRFStudio/transforms.json").read_text())["frames"]) == 25
    with pytest.raises(ValueError):
        exports.export("obj", bundle, str(tmp_path))


def test_images(spark, tmp_path):
    rng = np.random.default_rng(1)
    disc = np.full((90, 120), 200, np.uint8)
    yy, xx = np.mgrid[:90, :120]
    disc[(yy - 40) ** 2 + (xx - 60) ** 2 <= 25**2] = 20
    (tmp_path / "b.pgm").write_bytes(b"P5\n# note\n120 90\n255\n" + disc.tobytes())
    (tmp_path / "a.PPM").write_bytes(b"P6 120 90 255\n" + np.repeat(rng.integers(0, 255, (9, 12, 1), np.uint8).repeat(10, 0).repeat(10, 1), 3, 2).tobytes())
    (tmp_path / "notes.txt").write_text("no image")
    files = images.list_images(spark, str(tmp_path), ["ppm", "pgm"])
    assert [(r["img_id"], r["stem"]) for r in files.orderBy("img_id").collect()] == [(0, "a"), (1, "b")]
    assert {(r["height"], r["width"]) for r in images.sizes(files).collect()} == {(90, 120)}
    runs = images.mask_runs(files.where("stem = 'b'"), grow=0).collect()
    assert sum(r["u1"] - r["u0"] + 1 for r in runs) == int((disc < 128).sum())
    border = images.contours(files.where("stem = 'b'")).collect()
    assert 100 < len(border) <= 150 and all(abs(np.hypot(r["x"] - 60, r["y"] - 40) - 25) < 1.5 for r in border)
    found = images.features(files.where("stem = 'a'")).collect()
    assert len(found) > 5 and all(abs(np.linalg.norm(r["desc"]) - 1) < 1e-6 for r in found)
    assert images.shrunk(np.zeros((100, 50, 3), np.uint8), 20).shape == (20, 10, 3)


def test_config():
    made = Config().with_values(ratio=0.7, good_views=4).adapted(40, 2000, 1000)
    assert made.matching.ratio == 0.7 and made.cleanup.good_views == 4 and made.matching.pair_window == 10 and made.matching.ransac_px == 4.0
    assert Config.from_dict(made.to_dict()) == made and PRESETS["singlecam"].adjustment.has("local")
    with pytest.raises(ValueError):
        Config().with_values(nothing=1)


def test_stream_appends(spark, tmp_path):
    from manyview.streaming import MATCHES, append_matches

    for rows in ([(0, 1, 0, 0), (0, 1, 1, 1)], [(0, 1, 1, 1), (1, 2, 0, 0)]):
        spark.createDataFrame(rows, MATCHES).write.mode("append").parquet(str(tmp_path / "in"))
        append_matches(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_two_nearest_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, k, rng.integers(0, 4, 6).astype(float).tolist()) for i in (0, 1) for k in range(40)]
    df = spark.createDataFrame(rows, "img_id int, kp_id int, desc array<double>")
    pairs = spark.createDataFrame([(0, 1)], "i int, j int")
    whole = sorted(map(tuple, matching.two_nearest(df, pairs).collect()))
    monkeypatch.setattr(matching, "DESCRIPTORS", 7)
    assert sorted(map(tuple, matching.two_nearest(df, pairs).collect())) == whole and len(whole) == 80
    for a in range(40):
        far = sorted((round(float(np.linalg.norm(np.array(rows[a][2]) - np.array(v))), 9), k) for i, k, v in rows if i == 1)[:2]
        assert sorted((r[5], r[3]) for r in whole if r[2] == a) == far


def test_objects_and_largest_border():
    from manyview.sources.images import border, largest_border, objects

    on = np.zeros((40, 60), bool)
    on[0, 0] = on[1, 1] = True  # touch by a corner
    on[10:30, 20:50] = True
    on[15:25, 25:45] = False  # a hole
    on[18:20, 30:32] = True
    on[35, 3:9] = True
    found = sorted((int(m.sum()), top, left) for m, top, left in objects(on))
    assert found == [(2, 0, 0), (4, 18, 30), (6, 35, 3), (400, 10, 20)]
    line = largest_border(on, 50)
    assert len(line) == 2 * (20 + 30) - 4 and min(line) == (20, 10) and max(line) == (49, 29)
    assert largest_border(on, 200) == [] and largest_border(np.zeros((5, 5), bool), 1) == [] and border(np.zeros((3, 3), bool)) == []


def test_features_over_octaves(spark):
    from manyview.sources.images import _described

    y, x = np.mgrid[0:160, 0:160]
    image = np.exp(-((x - 70) ** 2 + (y - 80) ** 2) / 20) + 0.6 * np.exp(-((x - 78) ** 2 + (y - 80) ** 2) / 9)  # a blob with a tail
    first, turned = (np.array([d for *_, d in sorted(_described(v, 0.04, 1.6), reverse=True)[:2]]) for v in (image, np.rot90(image)))
    assert (turned @ first.T).max() > 0.9
    assert len(_described(np.zeros((64, 64)), 0.04, 1.6)) == 0


def test_npy_and_stems(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.array([[700, 0, 512], [0, 700, 384], [0, 0, 1.0]]))
    np.save(tmp_path / "b.npy", np.zeros(4))
    got = {r["stem"]: r for r in calibration.read_npy(spark, str(tmp_path)).collect()}
    assert got["a"]["k"] == [700, 0, 512, 0, 700, 384, 0, 0, 1] and got["a"]["valid"] and got["b"]["k"] is None and not got["b"]["valid"]
    paths = spark.createDataFrame([("/x/a.ppm",), ("/y/a.pgm",), ("/x/b.ppm",)], "path string")
    assert {tuple(r) for r in calibration.stem_index(paths).collect()} == {("a", "/y/a.pgm"), ("b", "/x/b.ppm")}


@pytest.mark.parametrize("loss", sorted(adjust.LOSSES))
def test_losses(loss):
    """The weight is the derivative of the loss; a small residual counts as its square, but for none is it more."""
    value, weight = adjust.LOSSES[loss]
    z = np.array([1e-6, 0.3, 0.9, 2.0, 50.0])
    assert np.allclose((value(z + 1e-7) - value(z - 1e-7)) / 2e-7, weight(z), rtol=1e-3) and np.allclose(value(z[:1]), z[:1]) and (value(z) <= z + 1e-12).all()


def test_adjustment_of_chosen_images(spark):
    s = queries.Scene(spark, SF)
    obs, cameras = s.obs.cache(), s.cameras.cache()
    points = triangulate.triangulate(obs, cameras, 2).select("track_id", "x", "y", "z").cache()
    images = sorted(r["img_id"] for r in obs.select("img_id").distinct().collect())[:4]
    moved, placed = adjust.run(points, obs, cameras, images, 40, 10, 30)
    assert moved.count() == points.count() and placed.count() == cameras.count()
    changed = moved.join(points.toDF("track_id", "a", "b", "c"), "track_id").where("x <> a or y <> b or z <> c").count()
    assert 10 <= changed <= 40
    same = placed.join(cameras.select("img_id", F.col("tx").alias("was")), "img_id").where("tx = was").count()
    assert same >= cameras.count() - 3 and placed.where(F.col("img_id") == images[0]).first()["tx"] == pytest.approx(cameras.where(F.col("img_id") == images[0]).first()["tx"])
    nothing, as_before = adjust.run(points, obs, cameras, images, 40, 10_000, 30)
    assert nothing is points and as_before is cameras


def test_report_is_written_and_read(spark, tmp_path):
    s = queries.Scene(spark, SF)
    kps = s.kps
    track_obs = kps.select("track_id", "img_id", "kp_id")
    judged = cleanup.strict(s.points, s.obs, s.cameras)
    tables = diagnostics.report(s.points, kps, track_obs, s.cameras, judged, 1024, 768, most=50)
    diagnostics.export(str(tmp_path), tables)
    for name, table in tables.items():
        assert spark.read.parquet(str(tmp_path / name)).count() == table.count() > 0


def test_window_matches_of_one_camera(spark, rig):
    """Descriptors that tell tracks apart, and one in eight that lies."""
    cameras, points, obs, kps = rig
    some = sorted(r["img_id"] for r in kps.groupBy("img_id").count().orderBy(F.desc("count")).limit(4).collect())
    rng = np.random.default_rng(5)
    rows = []
    for r in kps.where(F.col("img_id").isin(some)).collect():
        track = r["track_id"] if rng.random() > 0.12 else int(rng.integers(10**6))
        rows.append((r["img_id"], r["kp_id"], np.random.default_rng(track).normal(size=16).tolist()))
    desc = spark.createDataFrame(rows, "img_id int, kp_id int, desc array<double>")
    config = PRESETS["singlecam"].with_values(least_inliers=8, ratio=0.8, ransac_px=3.0)
    found = reconstruct.match_window(desc, kps, (800.0, 800.0, 512.0, 384.0), config)
    named = [kps.select(F.col("img_id").alias(s), F.col("kp_id").alias(c), F.col("track_id").alias(f"t{s}")) for s, c in (("i", "a"), ("j", "b"))]
    both = found.join(named[0], ["i", "a"]).join(named[1], ["j", "b"])
    assert both.count() >= 8 and both.where("ti <> tj").count() == 0


def test_run_takes_the_way_that_the_cameras_allow(monkeypatch):
    monkeypatch.setattr(reconstruct, "known_cameras", lambda *a: ("known", a))
    monkeypatch.setattr(reconstruct, "single_camera", lambda *a: ("single", a))
    assert reconstruct.run("m", "kps", cameras="c", k=(1, 1, 0, 0)) == ("known", ("c", "kps", "m", None))
    assert reconstruct.run("m", "kps", k=(1, 1, 0, 0)) == ("single", ("kps", "m", (1, 1, 0, 0), None))
    with pytest.raises(ValueError):
        reconstruct.run("m", "kps")
