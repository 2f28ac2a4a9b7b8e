"""Flat arrays and the key `intrinsic` as camera matrices, and where contour-only pairs come in the order."""

import numpy as np
from pyspark.sql import functions as F

from manyview.functions.text import distortion, intrinsics
from manyview.operators import matching
from manyview.sources.calibration import read_npy


def test_flat_arrays(spark, tmp_path):
    k = np.array([[700.0, 0, 512], [0, 701, 384], [0, 0, 1]])
    for name, array in (("flat", k.ravel()), ("square", k), ("wide", np.hstack([k, np.ones((3, 1))])), ("odd", np.ones(8))):
        np.save(tmp_path / f"{name}.npy", array)
    found = {r["stem"]: r["k"] for r in read_npy(spark, str(tmp_path)).collect()}
    assert found == {"flat": k.ravel().tolist(), "square": k.ravel().tolist(), "wide": k.ravel().tolist(), "odd": None}


def test_intrinsic_key_and_many_numbers(spark):
    body = '{"intrinsic": [[700, 0, 512], [0, 701, 384], [0, 0, 1]]}'
    long = " ".join(str(i) for i in range(300))
    row = spark.createDataFrame([(body, long)], "a string, b string").select(intrinsics(F.col("a")).alias("k"), distortion(F.col("b")).alias("d")).first()
    assert row["k"] == [700, 0, 512, 0, 701, 384, 0, 0, 1] and row["d"] == [float(i) for i in range(9, 300)]


def test_contour_pairs_come_last(spark):
    scores = spark.createDataFrame([(0, 1, 9), (0, 2, 12), (1, 2, 12), (3, 4, 7)], "i int, j int, score long")
    late = spark.createDataFrame([(0, 2)], "i int, j int")
    assert tuple(matching.initial_pair(scores).first()) == (0, 2, 12)
    assert tuple(matching.initial_pair(scores, contour_only=late).first()) == (1, 2, 12)
    assert matching.initial_pair(scores, 13).first() is None
