"""Near-duplicate classes by DartMinHash signatures and banded joining (operator 3).

Signatures. Each element of a weighted set is a column over the axis of ranks, as wide as its weight. Hashed darts fall
on that plane with one expected dart for each unit of area and coordinate; both axes are cut into dyadic strips, and a
cell's number of darts and their places follow from hashes of the element and the cell alone. A dart counts if it lies
within the element's weight. Each coordinate keeps its earliest dart; two sets agree in a coordinate with the
probability of their weighted Jaccard similarity. Only strips up to a rank that fills all coordinates are thrown, and
the rank is doubled for the few sets that it leaves gaps in, so a set costs its elements plus about k ln k darts.

Joining. Sets that are equal collapse into one row first. Bands of `rows` coordinates make buckets. No large bucket's pairs
are written out; two rounds find all links that matter for the classes:

1. Each row of a bucket is compared with the bucket's head: the row whose buckets hold the most rows, which lies in the
   middle of a group of near copies.
2. Rows that this left outside the class of the head are compared with all rows of other classes: in buckets of up to
   SMALL rows with each, in larger ones with those that share one of their rarest shingles, which similar sets must.
   Texts that only have a frequent passage in common don't meet.

Candidates pass a sketch of four bits a coordinate, whose limit a pair of the least similarity exceeds no more often than it has
no band in common; then the exact similarity of their shingle sets decides. Classes are the connected components of the links.

Defined results: shingles are runs of `width` lower-cased words (Unicode letters, digits, underscore); a document of
fewer words is one shingle of all its words; documents without words are in one class if their texts are equal, null
counting as empty; the similarity that is asked for is that of sets, so all weights are one here (`Darts` takes any, for uses where
repeats of a shingle count); rows with a null doc_id take no part; rows that share a doc_id are one document that has the
links of all of them; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from manyview.llm.common import cut, in_modest_batches, table
from manyview.operators.graph import components
from manyview.operators.skew import hot_keys, joined_by_hot_key

WIDTH = 5
SIMILARITY = (4, 5)
BANDS, ROWS = 40, 5
SLICE = 1 << 20
SMALL = 32
FEW_IDS = 200_000
#: Hash values that shingles are counted by.
COUNTERS = 1 << 20
GROUP = 200_000

_U = np.uint64
_WORD = re.compile(r"\w+")


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the input changes about half of the output's."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(x + _U(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


class WordHashes(dict):
    """Hashes of words, computed once each."""

    def __missing__(self, word: str) -> int:
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


def shingles(text: str | None, width: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles. words: a cache of hashes of words."""
    found = _WORD.findall((text or "").lower())
    if not found:
        return np.array([xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass"), 7)], np.uint64)
    if len(words) > 250_000:
        words.clear()
    hashes = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    width = min(width, len(found))
    count = len(found) - width + 1
    total = np.full(count, width, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            total = total * _U(0x9E3779B97F4A7C15) + hashes[i : count + i]
    return np.unique(mixed(total))


class Darts:
    """Signatures of k coordinates; strips of ranks are [0, 2^low), [2^low, 2^(low+1)), ..."""

    def __init__(self, k: int, low: int = -14):
        self.k, self.low = k, low
        self.tables: dict[float, np.ndarray] = {}

    def counts(self, hashes: np.ndarray, mean: float) -> np.ndarray:
        """A Poisson number for each hash, by the inverse of its distribution."""
        if mean > 500:  # in parts, so that the terms don't underflow
            return sum(self.counts(salted(hashes, 77 + i), mean / 2) for i in range(2))
        if mean not in self.tables:
            terms, total, out, i = np.exp(-mean), 0.0, [], 0
            while total < 1 - 1e-15 and i < 60 + 4 * mean:
                total += terms
                out.append(min(total, 1.0) * 2.0**53)
                i += 1
                terms *= mean / i
            self.tables[mean] = np.ceil(out).astype(np.uint64)
        table, parts = self.tables[mean], hashes >> _U(11)
        out = np.zeros(len(parts), np.int64)
        some = np.flatnonzero(parts >= table[0])
        out[some] = np.searchsorted(table, parts[some], "right")
        return out

    def signatures(self, elements: np.ndarray, weights: np.ndarray, sets: np.ndarray, n: int) -> np.ndarray:
        """n x k; elements with weights over 0 belong to sets 0..n-1, none of them empty. Coordinates hold the earliest darts."""
        k = self.k
        best = np.full(n * k, np.iinfo(np.uint64).max, np.uint64)
        weight = np.bincount(sets, weights, n)
        need = np.ceil(np.log2((np.log(k) + 2) / np.maximum(weight, 1e-300))).astype(int)
        done = np.full(n, self.low - 1)
        open_sets = np.ones(n, bool)
        while open_sets.any():
            for strip in range(int(done[open_sets].min()) + 1, int(need[open_sets].max()) + 1):
                use = (open_sets & (done < strip) & (need >= strip))[sets]
                at = np.flatnonzero(use)
                for low in range(0, len(at), SLICE):  # so that a very long text needs little more than its shingles
                    part = at[low : low + SLICE]
                    self._throw(elements[part], weights[part], sets[part], strip, best)
            done[open_sets] = np.maximum(done, need)[open_sets]
            open_sets = (best.reshape(n, k) == np.iinfo(np.uint64).max).any(axis=1)
            need[open_sets] = np.maximum(done, need)[open_sets] + 1
        return best.reshape(n, k)

    def _throw(self, elements: np.ndarray, weights: np.ndarray, sets: np.ndarray, strip: int, best: np.ndarray) -> None:
        start, width = (0.0, 2.0**self.low) if strip < self.low else (2.0 ** (strip - 1), 2.0 ** (strip - 1))
        if strip == self.low:
            start, width = 0.0, 2.0**self.low
        layer, floor = 0, 0.0
        while True:
            on = weights > floor
            if not on.any():
                return
            high = 2.0**layer
            x, w, s = elements[on], weights[on], sets[on]
            cell = salted(x, (strip + 200) * 1000 + layer + 1)
            times = self.counts(cell, self.k * width * (high - floor))
            if times.any():
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                with np.errstate(over="ignore"):
                    dart = mixed(np.repeat(cell, times) + (nth.astype(np.uint64) + _U(1)) * _U(0xD1342543DE82EF95))
                place = (salted(dart, 1) >> _U(11)).astype(np.float64) / 2.0**53
                in_weight = floor + place * (high - floor) < np.repeat(w, times)
                dart, owner = dart[in_weight], np.repeat(s, times)[in_weight]
                at = owner * self.k + (salted(dart, 2) % _U(self.k)).astype(np.int64)
                rank = start + (salted(dart, 3) >> _U(11)).astype(np.float64) / 2.0**53 * width
                np.minimum.at(best, at, rank.view(np.uint64))  # floats over 0 sort as their bits
            layer, floor = layer + 1, high


def banded(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """n x bands hashes of a signature's groups of coordinates."""
    out = np.zeros((len(signatures), bands), np.uint64)
    out += np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(rows):
        out = mixed(out ^ mixed(signatures[:, i * bands : (i + 1) * bands] + _U(i)))
    return out


def sketched(signatures: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate, packed into 64-bit integers."""
    bits = (mixed(signatures) & _U(15)).astype(np.uint8)
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 16)))
    return (bits[:, 0::2] | bits[:, 1::2] << 4).view(np.int64)


def sign(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, f1, f2, n, bands, sketch) of each row: a 128-bit fingerprint of the shingle set, its size, bands, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        darts, words = Darts(bands * rows), WordHashes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            low = 0
            while low < len(ids):
                sets, total, high = [], 0, low
                while high < len(ids) and (total < GROUP and high - low < 2000):
                    sets.append(shingles(texts[high].as_py(), width, words))
                    total += len(sets[-1])
                    high += 1
                sizes = np.array([len(x) for x in sets])
                owner = np.repeat(np.arange(len(sets)), sizes)
                sig = darts.signatures(np.concatenate(sets), np.ones(total), owner, len(sets))
                raw = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
                prints = np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)
                sketch = sketched(sig)
                banks = banded(sig, bands, rows).view(np.int64)
                lists = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * bands, pa.array(banks.ravel()))
                sketches = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * sketch.shape[1], pa.array(sketch.ravel()))
                columns = [pa.array(ids[low:high], batch.column(0).type), *(pa.array(prints[:, i]) for i in range(2)), pa.array(sizes, pa.int64()), lists, sketches]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "f1", "f2", "n", "bands", "sketch"])
                low = high

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_modest_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, f1 long, f2 long, n long, bands array<long>, sketch array<long>")


def shingle_arrays(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, shingles) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                sets = [shingles(x, width, words).view(np.int64) for x in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets)))], ["doc_id", "shingles"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_modest_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, shingles array<long>")


def most_different(k: int, lost: float) -> int:
    """In how many of k coordinates the sketches of a pair of the least similarity differ at most, but for a chance of `lost`."""
    least, of = SIMILARITY
    chance = (1 - least / of) * 15 / 16
    tail, most = 0.0, k
    while most and (tail := tail + comb(k, most) * chance**most * (1 - chance) ** (k - most)) <= lost:
        most -= 1
    return most


def _near_sketches(bands: int, rows: int) -> Column:
    """Whether two sketches differ in as many coordinates as those of similar sets may; it loses no more than the bands do."""
    least, of = SIMILARITY
    k = bands * rows
    most = most_different(k, (1 - (least / of) ** rows) ** bands)

    def differ(i: int) -> Column:
        x = F.col("a_sketch")[i].bitwiseXOR(F.col("b_sketch")[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111)))

    return reduce(lambda x, y: x + y, map(differ, range(-(-k // 16)))) <= most


def _sizes_near() -> Column:
    least, of = SIMILARITY
    return (F.col("a_n") * of >= F.col("b_n") * least) & (F.col("b_n") * of >= F.col("a_n") * least)


def _as(df: DataFrame, prefix: str, *but: str) -> DataFrame:
    return df.select(*[F.col(c) if c in but else F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def of_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs with an id in ids (doc_id); few ids are sent to all tasks, else both sides are shuffled."""
    ids = cut(ids.select(F.col("doc_id").alias("need")).distinct())
    how = "broadcast" if ids.count() <= FEW_IDS else "shuffle_hash"
    return docs.join(ids.hint(how), F.col("doc_id") == F.col("need"), "left_semi")


def _met_heads(pairs: DataFrame, other: DataFrame) -> DataFrame:
    """pairs joined by b: the head of a large group meets all its members, while no row is often on the other side."""
    counts = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    return joined_by_hot_key(pairs, other, hot_keys(counts, ["b"], pairs.count()), ["b"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets are as similar as asked for."""
    least, of = SIMILARITY
    x = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    both = _met_heads(pairs.join(x, "a"), y)
    common = F.size(F.array_intersect("x", "y"))
    kept = both.select("a", "b", common.alias("c"), (F.size("x") + F.size("y")).alias("t"))
    return kept.where(F.col("c") * of >= (F.col("t") - F.col("c")) * least).select("a", "b")


def sets_of(docs: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    return cut(shingle_arrays(of_ids(docs, pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b"))), width))


def counted_shingles(sets: DataFrame) -> np.ndarray:
    """How many sets have a shingle of each of COUNTERS hash values. A task counts in a table of that size, few tasks go over all
    sets, Spark adds up their counts, and COUNTERS numbers at most come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total[x.values.to_numpy() & (COUNTERS - 1)] += 1
        at = np.flatnonzero(total)
        for low in range(0, len(at), 1 << 16):
            some = at[low : low + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["key", "n"])

    tasks = sets.sparkSession.sparkContext.defaultParallelism
    counts = sets.select("shingles").coalesce(tasks).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(COUNTERS, np.int64)
    out[counts["key"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    return out


def sharing_a_rare_shingle(rows: DataFrame, sets: DataFrame, bands: int, band_rows: int) -> DataFrame:
    """Pairs (a, b) of rows, a loose, with different labels, that share a shingle among their rarest.

    Sets of n and m shingles with similarity s or more have at least s * n, s * m and s / (1 + s) * (n + m) in common. In an
    order that all sets have, their first common one is thus among the first n - s * n + 1 of each, and from its place
    on each has s / (1 + s) * (n + m) left. The rarest come first here, by counts in a table of fixed size.
    """
    least, of = SIMILARITY
    often = rows.sparkSession.sparkContext.broadcast(counted_shingles(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                ids, places, found = [], [], []
                for i, x in zip(part.column(0).to_pylist(), part.column(1)):
                    x = x.values.to_numpy()
                    first = x[np.lexsort((x, often.value[x & (COUNTERS - 1)]))][: len(x) - -(-len(x) * least // of) + 1]
                    ids += [i] * len(first)
                    places.append(np.arange(len(first)))
                    found.append(first)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, part.column(0).type), pa.array(np.concatenate(places)), pa.array(np.concatenate(found))], ["doc_id", "nth", "shingle"])

    kind = sets.schema["doc_id"].dataType.simpleString()
    first = sets.select("doc_id", "shingles").mapInArrow(run, f"doc_id {kind}, nth long, shingle long")
    marked = cut(first.join(rows, "doc_id"))
    a, b = _as(marked.where("loose"), "a_", "shingle"), _as(marked, "b_", "shingle")
    left = F.least(F.col("a_n") - F.col("a_nth"), F.col("b_n") - F.col("b_nth"))
    met = a.join(b, "shingle").where((left * (of + least) >= (F.col("a_n") + F.col("b_n")) * least) & _may_link(bands, band_rows))
    return met.select(F.col("a_doc_id").alias("a"), F.col("b_doc_id").alias("b")).distinct()


def _may_link(bands: int, rows: int) -> Column:
    once = ~F.col("b_loose") | (F.col("a_doc_id") < F.col("b_doc_id"))
    return once & _sizes_near() & (F.col("a_label") != F.col("b_label")) & _near_sketches(bands, rows)


def near_links(unique: DataFrame, docs: DataFrame, width: int = WIDTH, bands: int = BANDS, band_rows: int = ROWS) -> DataFrame:
    """Links (a, b) that join all that is similar among `unique` (rows of `sign` with different fingerprints)."""
    n_docs = unique.count()
    buckets = unique.select("doc_id", F.explode("bands").alias("key"))
    sizes = cut(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    hot = hot_keys(sizes.withColumnRenamed("rows", "n"), ["key"], bands * n_docs)
    shared = cut(joined_by_hot_key(buckets, sizes, hot, ["key"]))
    crowd = shared.groupBy("doc_id").agg(F.sum("rows").alias("crowd"))
    heads = shared.join(crowd, "doc_id").groupBy("key").agg(F.max(F.struct("crowd", (-F.col("doc_id")).alias("less"))).alias("most"))
    heads = heads.select("key", (-F.col("most.less")).alias("head"))
    members = cut(joined_by_hot_key(shared, heads, hot, ["key"]).select("key", "rows", "doc_id", "head"))
    rows = unique.drop("bands", "f1", "f2")
    first = members.where(F.col("doc_id") != F.col("head")).select(F.col("doc_id").alias("a"), F.col("head").alias("b")).distinct()
    first = first.join(_as(rows, "a_").withColumnRenamed("a_doc_id", "a"), "a")
    first = _met_heads(cut(first), _as(rows, "b_").withColumnRenamed("b_doc_id", "b"))
    first = cut(first.where(_sizes_near() & _near_sketches(bands, band_rows)).select("a", "b"))
    links = cut(verified(first, sets_of(docs, first, width)))
    labels = cut(components(links))

    # What the first round left: rows that are not in the class of their bucket's head.
    state = members.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    of_head = labels.select(F.col("node").alias("head"), F.col("label").alias("head_label"))
    by_head = hot_keys(members.groupBy("head").agg(F.count(F.lit(1)).alias("n")), ["head"], bands * n_docs)
    state = joined_by_hot_key(state, of_head, by_head, ["head"], "left").withColumn("loose", F.col("label") != F.coalesce("head_label", "head"))
    state = cut(state.select("key", "rows", "doc_id", "label", "loose"))
    open_keys = state.where("loose").select("key").distinct()
    state = cut(joined_by_hot_key(state, open_keys, hot, ["key"]).join(rows, "doc_id"))
    small = state.where(F.col("rows") <= SMALL).drop("rows")
    pairs = _as(small.where("loose"), "a_", "key").join(_as(small, "b_", "key"), "key").where(_may_link(bands, band_rows))
    pairs = cut(pairs.select(F.col("a_doc_id").alias("a"), F.col("b_doc_id").alias("b")).distinct())
    if not pairs.isEmpty():
        links = links.unionAll(verified(pairs, sets_of(docs, pairs, width)))
    large = state.where(F.col("rows") > SMALL).groupBy("doc_id", "label", "n", "sketch").agg(F.max("loose").alias("loose"))
    large = cut(large)
    if not large.isEmpty():
        sets = cut(shingle_arrays(of_ids(docs, large), width))
        links = links.unionAll(verified(cut(sharing_a_rare_shingle(large, sets, bands, band_rows)), sets))
    return links


def near_duplicates(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id, class_size) of each document; class_id: the smallest doc_id of its class."""
    docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    signed = cut(sign(docs, width, bands, rows))
    n_docs = signed.count()
    equal = cut(signed.groupBy("f1", "f2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    prints = signed.select("doc_id", "f1", "f2")
    members = joined_by_hot_key(prints, equal.drop("n"), hot_keys(equal.select("f1", "f2", "n"), ["f1", "f2"], n_docs), ["f1", "f2"])
    members = cut(members.select("doc_id", "first").distinct())
    unique = signed.join(equal.select("f1", "f2", F.col("first").alias("doc_id")), ["doc_id", "f1", "f2"], "left_semi")
    unique = cut(unique.dropDuplicates(["doc_id", "f1", "f2"]))
    # Only one document of each set of equal ones is in links; and a document of several texts links theirs.
    several = members.groupBy("doc_id").agg(F.min("first").alias("b"), F.max("first").alias("most")).where("b <> most")
    tied = members.join(several.select("doc_id", "b"), "doc_id").select(F.col("first").alias("a"), "b").where("a <> b")
    labels = cut(components(near_links(unique, docs, width, bands, rows).unionAll(tied))).withColumnRenamed("node", "first")
    by_first = hot_keys(equal.groupBy("first").agg(F.sum("n").alias("n")), ["first"], n_docs)
    named = joined_by_hot_key(members, labels, by_first, ["first"], "left")
    named = cut(named.groupBy("doc_id").agg(F.min(F.coalesce("label", "first")).alias("class_id")))
    sizes = cut(named.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size")))
    hot = hot_keys(sizes.withColumnRenamed("class_size", "n"), ["class_id"], n_docs)
    return joined_by_hot_key(named, sizes, hot, ["class_id"]).select("doc_id", "class_id", "class_size")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: the class of near duplicates that each is in."""
    return near_duplicates(table(spark, sf_dir, "documents"))


#: Every pair of documents with a common shingle, then the closure of the links.
OP3_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS words FROM documents WHERE doc_id IS NOT NULL),
words AS (SELECT doc_id, len(words) AS n, unnest(words) AS w, unnest(range(len(words))) AS pos FROM docs),
runs AS (
  SELECT doc_id, n, pos, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS s
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
shingles AS (
  SELECT DISTINCT doc_id, hash(s) AS s FROM runs WHERE s IS NOT NULL
  UNION SELECT doc_id, hash(array_to_string(words, ' ')) FROM docs WHERE len(words) BETWEEN 1 AND 4
  UNION SELECT doc_id, hash('no words: ' || text) FROM docs WHERE len(words) = 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
classes AS (SELECT DISTINCT docs.doc_id, least(docs.doc_id, coalesce(m, docs.doc_id)) AS class_id FROM docs LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY 1) r ON r.a = docs.doc_id)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size FROM classes
"""
