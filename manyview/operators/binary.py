"""Nearest binary descriptors by Hamming distance, exact: substrings as join keys, blocks for what these leave open.

Descriptors are (img_id, kp_id, bits: array<long>), all of one length. Two codes that differ in r bits agree in one of r + 1 or more
substrings, and differ in one bit at most in one of (r + 2) / 2 or more. So an equi-join by substring, with the substrings of
queries also changed by one bit, finds every code within a radius. A query whose second neighbour lies within it is done;
the others are compared with all codes of their image pairs, in blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from manyview.operators.matching import two_nearest
from manyview.session import cut

WIDTH = 16  # bits of a substring
CODE = (1 << WIDTH) - 1


def hamming(a: Column, b: Column, words: int) -> Column:
    return reduce(lambda x, y: x + y, (F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(words))).cast("int")


def _substrings(words: int) -> Column:
    """(part, code) of each WIDTH bits."""
    per = 64 // WIDTH
    return F.array(*[F.struct(F.lit(w * per + k).alias("part"), F.shiftrightunsigned(F.get("bits", F.lit(w)), k * WIDTH).bitwiseAND(F.lit(CODE).cast("long")).alias("code")) for w in range(words) for k in range(per)])


def two_nearest_binary(desc: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """(i, j, a, b, place, dist int): for each keypoint a of i its two nearest of j; of equal ones the smaller b."""
    count, flips = words * 64 // WIDTH, F.array(F.lit(0).cast("long"), *[F.lit(1 << k).cast("long") for k in range(WIDTH)])
    rows = desc.select("img_id", "kp_id", "bits", F.explode(_substrings(words)).alias("s"))
    other = rows.select(F.col("img_id").alias("j"), F.col("kp_id").alias("b"), F.col("bits").alias("other"), "s.part", "s.code")
    query = rows.select(F.col("img_id").alias("i"), F.col("kp_id").alias("a"), "bits", "s.part", "s.code").withColumn("code", F.explode(F.transform(flips, lambda x: F.col("code").bitwiseXOR(x))))
    radius = 2 * count - 1  # two bits in each of `count` substrings are needed to hide from one-bit changes
    met = query.join(pairs, "i").join(other, ["j", "part", "code"]).withColumn("dist", hamming(F.col("bits"), F.col("other"), words))
    near = met.where(F.col("dist") <= radius).groupBy("i", "j", "a").agg(F.slice(F.sort_array(F.collect_set(F.struct("dist", "b"))), 1, 2).alias("two"))
    proved = cut(near.where(F.size("two") == 2))

    every = desc.select(F.col("img_id").alias("i"), F.col("kp_id").alias("a")).join(pairs, "i")
    open_ = cut(every.join(proved, ["i", "j", "a"], "left_anti"))
    unpacked = F.flatten(F.transform("bits", lambda w: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("shiftrightunsigned", w, k).bitwiseAND(F.lit(1).cast("long")).cast("double"))))
    flat = desc.select("img_id", "kp_id", unpacked.alias("desc"))
    rest = two_nearest(flat, open_.select("i", "j").distinct(), open_.select("i", "j", "a"))
    found = proved.select("i", "j", "a", F.posexplode("two").alias("nth", "hit")).select("i", "j", "a", "hit.b", (F.col("nth") + 1).alias("place"), "hit.dist")
    return found.unionByName(rest.withColumn("dist", F.round(F.col("dist") * F.col("dist")).cast("int")))


def match_binary(desc: DataFrame, pairs: DataFrame, words: int, ratio: float = 0.8) -> DataFrame:
    """(i, j, a, b, dist) of matches both ways that pass the ratio test, one for each b."""
    from manyview.operators.matching import mutual, ratio_test, unique_by_distance

    turned = pairs.select(F.col("j").alias("i"), F.col("i").alias("j"))
    both = cut(two_nearest_binary(desc, pairs.unionByName(turned), words))
    fine = unique_by_distance(ratio_test(both, ratio))
    return mutual(fine.where("i < j"), fine.where("i > j"))
