"""Exact percentiles by counts, against those of numpy."""

import random

import numpy as np
import pytest

from manyview.operators.quantiles import exact_percentiles


@pytest.mark.parametrize("few", [20, 10_000])
def test_equal_to_sorting(spark, few):
    rng = random.Random(2)
    cases = {"even": [rng.gauss(0, 1) for _ in range(300)], "tied": [float(rng.randrange(3)) for _ in range(501)], "one": [4.0], "spread": [10.0 ** rng.uniform(-300, 300) * rng.choice([-1, 1]) for _ in range(100)]}
    for name, values in cases.items():
        df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 3, "v double")
        got = exact_percentiles(df, {str(p): ("v", p) for p in (0.0, 0.5, 0.95, 1.0)}, few)
        assert got.pop("n") == len(values) + 3
        for p, v in got.items():
            assert np.isclose(v, np.percentile(values, 100 * float(p)), rtol=1e-12), (name, p)
    assert exact_percentiles(spark.createDataFrame([], "v double"), {"m": ("v", 0.5)}, few) == {"n": 0, "m": None}
    assert exact_percentiles(spark.createDataFrame([(None,)] * 9, "v double"), {"m": ("v", 0.5)}, few)["m"] is None


SPECIAL = [float("nan"), float("inf"), -float("inf"), -0.0, 0.0, 5e-324, -5e-324, 1e-323, 1.7e308, -1.7e308, 1.0, 1.0 + 2**-52]


@pytest.mark.parametrize("few", [1, 10_000])
def test_no_value_is_special(spark, few):
    """Infinities, NaN, zeros of both signs, the least and largest doubles: as one aggregation has them, at any size."""
    draw = random.Random(3)
    for _ in range(6):
        values = [draw.choice(SPECIAL) for _ in range(draw.randint(2, 40))]
        df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
        wanted = {str(p): ("v", p) for p in (0.0, 0.3, 0.5, 0.95, 1.0)}
        expected = df.selectExpr(*[f"percentile(v, {p}) as `{p}`" for p in wanted]).first()
        got = exact_percentiles(df, wanted, few)
        for p in wanted:
            assert got[p] == expected[p] or np.isnan(got[p]) and np.isnan(expected[p]) or np.isclose(got[p], expected[p], rtol=1e-12), (values, p)
