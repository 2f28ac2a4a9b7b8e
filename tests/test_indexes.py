"""Descriptor forests, Hamming neighbours and greedy one-to-one matches against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from manyview.operators import binary, descindex, matching


def descriptors(spark, rng, images=4, each=150, size=16, noise=0.15, copies=0):
    """Images that see the same places, with noise; `copies` equal ones more in each image."""
    places = rng.normal(size=(each, size))
    rows = [(i, k, (places[k] + rng.normal(0, noise, size)).tolist()) for i in range(images) for k in range(each)]
    rows += [(i, each + k, [1.0] * size) for i in range(images) for k in range(copies)]
    return spark.createDataFrame(rows, "img_id int, kp_id int, desc array<double>")


def found(df):
    return {tuple(r) for r in df.select("i", "j", "a", "place", F.round("dist", 6)).collect()}


def test_forest_finds_what_all_pairs_show(spark):
    desc = descriptors(spark, np.random.default_rng(1), copies=40).repartition(3)
    pairs = matching.image_pairs(desc.select("img_id").distinct())
    exact, made = found(matching.two_nearest(desc, pairs)), found(descindex.two_nearest_indexed(desc, pairs, leaf=32))
    nearest = {x for x in exact if x[3] == 1}
    assert len(nearest & made) / len(nearest) >= 0.95
    distances = {x[:4]: x[4] for x in exact}
    assert all(x[4] >= distances[x[:4]] - 1e-6 for x in made)  # never nearer than the nearest
    forest = descindex.grown(desc, leaf=32)
    assert forest.directions.shape[1] == 5 and 8 * forest.probes <= 32  # more than one leaf, and not all of them
    loose = spark.createDataFrame([(k % 3, k, v.tolist()) for k, v in enumerate(np.random.default_rng(8).normal(size=(600, 48)))], "img_id int, kp_id int, desc array<double>")
    assert 8 * descindex.grown(loose, leaf=16).probes > 64  # no structure, so blocks are compared
    pairs = matching.image_pairs(loose.select("img_id").distinct())
    assert found(descindex.two_nearest_indexed(loose, pairs, leaf=16)) == found(matching.two_nearest(loose, pairs))


def test_forest_of_few_rows_is_exact(spark):
    desc = descriptors(spark, np.random.default_rng(2), images=3, each=20)
    pairs = matching.image_pairs(desc.select("img_id").distinct())
    assert found(descindex.two_nearest_indexed(desc, pairs)) == found(matching.two_nearest(desc, pairs))
    assert descindex.two_nearest_indexed(desc.limit(0), pairs).collect() == []
    one = desc.where("kp_id = 0 or img_id = 0")
    assert {r["place"] for r in descindex.two_nearest_indexed(one, pairs).collect()} == {1}


@pytest.mark.parametrize("flips", [4, 90])
def test_hamming_equals_all_pairs(spark, flips):
    rng = np.random.default_rng(3)
    places = rng.integers(0, 2, (30, 256))
    rows = []
    for i in range(3):
        for k in range(30):
            bits = places[k // 2 * 2].copy()  # two keypoints of one place, so second neighbours are near too
            bits[rng.choice(256, rng.integers(0, flips), replace=False)] ^= 1
            rows.append((i, k, [int(np.packbits(w, bitorder="little").view("<i8")[0]) for w in bits.reshape(4, 64)], bits))
    desc = spark.createDataFrame([r[:3] for r in rows], "img_id int, kp_id int, bits array<long>")
    pairs = matching.image_pairs(desc.select("img_id").distinct())
    expected = set()
    for i, a, _, x in rows:
        for j in range(i + 1, 3):
            order = sorted((int((x != y).sum()), b) for jj, b, _, y in rows if jj == j)
            expected |= {(i, j, a, b, place + 1, dist) for place, (dist, b) in enumerate(order[:2])}
    got = binary.two_nearest_binary(desc, pairs, 4)
    assert {tuple(r) for r in got.select("i", "j", "a", "b", "place", "dist").collect()} == expected
    assert binary.two_nearest_binary(desc.limit(0), pairs, 4).collect() == []


def test_greedy_equals_one_pass(spark):
    draw = random.Random(4)
    rows = {(0, draw.randrange(1, 3), draw.randrange(40), draw.randrange(40), float(draw.randrange(12))) for _ in range(700)}
    rows |= {(5, 6, k // 2, (k + 1) // 2, float(k)) for k in range(20)}  # a chain in which only one edge is free at a time
    for few in (40, 10_000):
        out = {tuple(r) for r in matching.unique_greedy(spark.createDataFrame(sorted(rows), "i int, j int, a int, b int, dist double"), few).collect()}
        expected = set()
        for pair in sorted({r[:2] for r in rows}):
            seen_a, seen_b = set(), set()
            for r in sorted((r for r in rows if r[:2] == pair), key=lambda r: (r[4], r[2], r[3])):
                if r[2] not in seen_a and r[3] not in seen_b:
                    seen_a.add(r[2])
                    seen_b.add(r[3])
                    expected.add(r)
        assert out == expected
    assert matching.unique_greedy(spark.createDataFrame([], "i int, j int, a int, b int, dist double")).collect() == []
