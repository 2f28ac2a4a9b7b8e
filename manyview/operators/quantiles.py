"""Exact percentiles of whole tables.

`F.percentile` without a group keeps a map of all distinct values in one task. Beyond FEW rows this selects by counts instead:
the interval that holds the wanted rank is cut into CELLS, their rows are counted by one aggregation with map-side
combine, and the cell with the rank is the next interval, until it holds few enough values. Doubles need a handful of rounds.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that one task may hold: 8 MB of doubles in a map of a hundred MB.
FEW = 500_000
CELLS = 4096


def _ranked(df: DataFrame, column: str, rank: int, low: float, high: float, few: int) -> tuple[float, float]:
    """The value with `rank` others before it, of finite values, which lies between low and high, and the next one (itself if it is the last)."""
    value = F.col(column)
    before, after = 0, high
    while low < high:
        scale = 1.0 if math.isfinite(high - low) else 0.5
        width = (high * scale - low * scale) / CELLS
        # Where a cell would be narrower than doubles can tell, fewer than CELLS doubles are left, and each is a cell.
        cell = F.least(F.floor((value * scale - F.lit(low * scale)) / width), F.lit(CELLS - 1)) if width > 0 else value
        inside = df.where((value >= low) & (value <= high)).groupBy(cell.alias("cell"))
        cells = sorted(inside.agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).collect(), key=lambda r: r["low"])  # CELLS rows at most
        for k, r in enumerate(cells):
            if before + r["n"] > rank:
                low, high, n = r["low"], r["high"], r["n"]
                after = cells[k + 1]["low"] if k + 1 < len(cells) else after
                break
            before += r["n"]
        if rank + 1 == before + n:  # the last of its cell
            return high, after
        if n <= few and low < high:
            held = np.sort(df.where((value >= low) & (value <= high)).select(value.alias("value")).toArrow()["value"].to_numpy())  # few rows
            return float(held[rank - before]), float(held[rank - before + 1])
    return low, low


def exact_percentiles(df: DataFrame, wanted: dict[str, tuple[str, float]], few: int = FEW) -> dict[str, float | None]:
    """{name: percentile} for wanted {name: (column of doubles, share)}, nulls left out, with linear interpolation; and "n", the
    number of rows. None where a column has no value. Infinities are the least and the largest numbers, NaN comes after all of
    them, as in F.percentile. df is read several times, so it should be cut first."""
    columns = sorted({c for c, _ in wanted.values()})
    tallies = []
    for c in columns:
        x, infinity = F.col(c), F.lit(math.inf)
        finite = F.when((x < infinity) & (x > -infinity), x)
        tallies += [F.count(x).alias(f"count_{c}"), F.count_if(x == -infinity).alias(f"below_{c}"), F.count(finite).alias(f"finite_{c}"), F.count_if(x == infinity).alias(f"above_{c}"), F.min(finite).alias(f"min_{c}"), F.max(finite).alias(f"max_{c}")]
    found = df.agg(F.count(F.lit(1)).alias("n"), *tallies).first()
    if found["n"] <= few:
        row = df.agg(F.lit(1).alias("one"), *[F.percentile(c, F.lit(p)).alias(name) for name, (c, p) in wanted.items()]).first()
        return {"n": found["n"], **{name: row[name] for name in wanted}}

    def at(c: str, rank: int) -> tuple[float, float]:
        """The value of a rank, and that of the next."""
        below, finite, above = (found[f"{part}_{c}"] for part in ("below", "finite", "above"))

        def outside(rank: int) -> float:
            return -math.inf if rank < below else math.inf if rank < below + finite + above else math.nan

        if not below <= rank < below + finite:
            return outside(rank), found[f"min_{c}"] if finite and rank + 1 == below else outside(rank + 1)
        here, after = _ranked(df, c, rank - below, found[f"min_{c}"], found[f"max_{c}"], few)
        return here, after if rank + 1 < below + finite else outside(rank + 1)

    out: dict[str, float | None] = {"n": found["n"]}
    for name, (c, p) in wanted.items():
        if not found[f"count_{c}"]:
            out[name] = None
            continue
        place = p * (found[f"count_{c}"] - 1)
        low, high = at(c, math.floor(place))
        out[name] = low if low == high or not place % 1 else low * (math.ceil(place) - place) + high * (place - math.floor(place)) if place % 1 else low
    return out


def away_from(middle: dict[str, float | None], names: tuple[str, str, str] = ("x", "y", "z")) -> Column:
    """The distance of a point to the place that `middle` has by the same names; NULL where that has none."""
    gaps = [F.col(c) - F.lit(middle[c]).cast("double") for c in names]
    return F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2])
