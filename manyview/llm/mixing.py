"""Mixing sources to target weights by subset-sum budget fitting (operator 10).

Each source has a target in words. Whole copies of the source come first; what is left of the target is less than one
copy and is fitted by length: documents are counted by (source, size), a share of each count is taken, and a bounded
knapsack over the counts fills the remaining budget exactly, or as nearly as the lengths allow. Which documents of a
length are taken follows a seeded hash, ranked within hash buckets so that no length lands in one task.

Defined results: the size of a null text is 0; sources go by code point, null last, and weigh 1, 2, 3, repeating; documents
of size 0 take part with 0 words; a source of size 0 has the target 0; rows that share a doc_id, have none or are repeated are
separate documents; sources are ranked in one task, which sees a row for each of them;
an empty table gives no rows; columns other than doc_id, text and source are not read.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from manyview.llm.common import cut, table, text_or_empty

SEED = 20
CYCLE = 3
MOST_COPIES = 3
HASH_BUCKETS = 64
#: Words that are left to the knapsack at least, where the budget has as many, and at most.
RESERVE, KNAPSACK = 1 << 13, 1 << 15
PLAN = "source string, size long, whole int, picked long"


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, text_key, size, h, bucket) of each document; text_key tells texts apart where rows share a doc_id."""
    size = F.size(F.regexp_extract_all(text_or_empty(), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(0))).cast("long")
    h = F.xxhash64(F.lit(seed), F.col("doc_id"))
    return docs.select("doc_id", "source", F.xxhash64("text").alias("text_key"), size.alias("size"), h.alias("h"), F.pmod(h, F.lit(HASH_BUCKETS)).cast("int").alias("bucket"))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target), a row for each source.

    A target is min(3 * size, level * weight). The level is that of the first source, by 3 * size / weight, that the
    level of what the sources before it leave over does not fill.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    each = each.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % CYCLE + 1)
    each = each.withColumn("most", MOST_COPIES * F.col("source_size")).withColumn("fill", F.col("most") / F.col("weight"))
    before = Window.orderBy("fill", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0))
    level = left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    each = each.withColumn("level", level)
    first = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", F.coalesce("source", F.lit("")), "level"))).over(whole)
    return each.select("source", "source_size", F.least(F.col("most").cast("double"), first["level"] * F.col("weight")).alias("target"))


def knapsack(lengths: list[tuple[int, int]], budget: int) -> dict[int, int]:
    """How many of each length reach the largest sum up to budget; lengths: (length, how many there are)."""
    items = []
    for length, count in lengths:
        count, step = min(count, budget // length), 1
        while count:
            items.append((length, min(step, count)))
            count -= min(step, count)
            step *= 2
    mask, reached, history = (1 << budget + 1) - 1, 1, []
    for length, times in items:
        history.append(reached)
        reached |= reached << length * times & mask
        if reached >> budget:
            break
    at, out = reached.bit_length() - 1, {}
    for (length, times), earlier in zip(reversed(items[: len(history)]), reversed(history)):
        if not earlier >> at & 1:
            at -= length * times
            out[length] = out.get(length, 0) + times
    return out


def fit(counts: dict[int, int], target: float) -> tuple[int, dict[int, int]]:
    """Whole copies of the source, and how many documents of each size come once more."""
    total = sum(size * n for size, n in counts.items())
    if not total:
        return 0, {}
    whole = min(MOST_COPIES, int(target // total))
    budget = 0 if whole == MOST_COPIES else min(total, math.floor(target) - whole * total)
    shared = max(0, budget - RESERVE)
    picked = {size: n * shared // total for size, n in counts.items()}
    budget -= sum(size * n for size, n in picked.items())
    for size in sorted(counts, reverse=True):
        if size and budget > KNAPSACK:
            more = min(counts[size] - picked[size], -(-(budget - KNAPSACK) // size), budget // size)
            picked[size] += more
            budget -= more * size
    rest = [(size, n - picked[size]) for size, n in sorted(counts.items(), reverse=True) if 0 < size <= budget and n > picked[size]]
    for size, n in knapsack(rest, budget).items():
        picked[size] += n
    return whole, picked


def _plan(group: pd.DataFrame) -> pd.DataFrame:
    counts = dict(zip(group["size"].tolist(), group["n"].tolist()))
    whole, picked = fit(counts, float(group["target"].iloc[0]))
    return pd.DataFrame({"source": group["source"], "size": group["size"], "whole": whole, "picked": [picked.get(s, 0) for s in group["size"].tolist()]})


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, text_key, size, source_size, target, copies, taken) of each document; copies: how often the mix has it."""
    sizes = cut(sized(docs, seed))
    goal = cut(targets(sizes))
    per = sizes.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = per.groupBy("source", "size").agg(F.sum("n").alias("n"))
    source = F.col("source")
    named = goal.withColumnRenamed("source", "goal_source")
    plan = counts.join(named, source.eqNullSafe(F.col("goal_source"))).drop("goal_source").groupBy("source").applyInPandas(_plan, PLAN)
    plan = cut(plan)
    start = F.sum("n").over(Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = per.select("source", "size", "bucket", F.coalesce(start, F.lit(0)).alias("start"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("h", "doc_id", "text_key")) - 1)

    def same(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
        b = b.select(*[F.col(k).alias(f"other_{k}") if k in keys else F.col(k) for k in b.columns])
        condition = [F.col(k).eqNullSafe(F.col(f"other_{k}")) for k in keys]
        return a.join(b, condition).drop(*[f"other_{k}" for k in keys])

    out = same(same(same(ranked, starts, "source", "size", "bucket"), plan, "source", "size"), goal, "source")
    copies = F.col("whole") + (F.col("start") + F.col("rank") < F.col("picked")).cast("int")
    return out.withColumn("copies", copies).select("doc_id", "source", "text_key", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: their size, their source's size and target, and the words that the mix takes of each."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def taken_rows(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of docs as often as the mix takes them, which may be never; repeated rows take turns."""
    keys = ["doc_id", "source", "text_key"]
    counts = cut(mix(docs, seed).groupBy(*keys).agg(F.sum("copies").alias("total"), F.count(F.lit(1)).alias("rows")).where("total > 0"))
    keyed = docs.withColumn("text_key", F.xxhash64("text"))

    def met(part: DataFrame) -> DataFrame:
        part = part.select(*[F.col(k).alias(f"of_{k}") for k in keys], "total", "rows")
        same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]
        return keyed.join(part.hint("shuffle_hash"), same)

    even = met(counts.where("total % rows = 0")).withColumn("times", (F.col("total") / F.col("rows")).cast("int"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
    uneven = met(counts.where("total % rows > 0")).withColumn("nth", nth)
    more = (F.col("nth") <= F.col("total") % F.col("rows")).cast("int")
    uneven = uneven.withColumn("times", F.floor(F.col("total") / F.col("rows")).cast("int") + more).where("times > 0").drop("nth")
    return even.unionByName(uneven).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(docs.columns)
