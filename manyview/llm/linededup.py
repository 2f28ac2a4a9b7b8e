"""Line dedup over levelled sorted runs of line hashes (operator 4, DataFrame operations only).

Documents come in batches of rising doc_id. The keys of all earlier batches lie in sorted runs, bucketed by hash. A
batch's own keys are merge-anti-joined with every run; what is left is new and becomes a run of level 0 that also holds
the first document of each key. As soon as a level has `fanout` runs, they are merged into one of the next level. A line
goes if its key isn't new in its batch, or is new but first held by an earlier document of the batch. The number of batches is a
parameter: all documents at hand in few batches, as here, or one for each delivery. Partitions that a very common
line fills are split by Spark where lines meet their keys.

Defined results: a null or empty text is one empty line and stays as it is; keys shorter than min_chars never go; rows
with a null doc_id keep all lines and shield none; rows that share a doc_id count as one document, so lines that only
they share stay, but each row keeps its own lines; repeated rows are alike; a document whose lines all go has the empty text; an empty table gives no rows; other columns are kept
by `dedup_lines`, but for those named n_lines, n_dropped and kept, which it replaces, and those of WORK, which it drops.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from manyview.llm.common import ascii_lower, scratch, table, text_or_empty

STRIPPED = " \t\n\x0b\x0c\r"
OUT = ("n_lines", "n_dropped", "kept")
WORK = ("gone_id", "gone_key", "gone_pos", "lines", "whole")
#: With it, Spark takes the order of a bucket's one file as it is and doesn't sort runs again.
RUN_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(STRIPPED)))


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, text_key, pos, h1, h2): the lines that may go, their keys as 128 bits of hash."""
    lines = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(lines_of(text_or_empty())).alias("pos", "line"))
    keys = lines.where(F.length("line") >= min_chars).select("doc_id", "text_key", "pos", line_key(F.col("line")).alias("key"))
    return keys.where(F.length("key") >= min_chars).select("doc_id", "text_key", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), F.col("key")).alias("h2"))


class Runs:
    """Sorted runs of keys by level, as external bucketed tables in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int):
        self.spark, self.fanout, self.base, self.count = spark, fanout, scratch(spark, "runs"), 0
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The keys that no run has."""
        for name in [name for level in self.levels for name in level]:
            keys = keys.join(self.spark.table(name).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return keys

    def write(self, keys: DataFrame) -> tuple[str, str]:
        name = f"run_{self.base[-32:]}_{self.count}"
        path = f"{self.base}/{self.count}"
        self.count += 1
        dealt = keys.repartition(self.buckets, "h1", "h2")
        dealt.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).option("compression", "uncompressed").format("parquet").saveAsTable(name)
        return name, path

    def add(self, keys: DataFrame) -> str:
        """Adds the keys as a run and compacts the levels that are full; where the new run's files are."""
        name, path = self.write(keys)
        level = 0
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(name)
            if len(self.levels[level]) < self.fanout:
                return path
            full, self.levels[level] = self.levels[level], []
            name, _ = self.write(reduce(DataFrame.unionByName, (self.spark.table(x).select("h1", "h2") for x in full)))
            for old in full:
                self.spark.sql(f"DROP TABLE {old}")
            level += 1

    def forget(self) -> None:
        """Takes the tables out of the catalog; the files stay for the plans that read them."""
        for name in [name for level in self.levels for name in level]:
            self.spark.sql(f"DROP TABLE {name}")


def dropped_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4, fanout: int = 3) -> DataFrame:
    """(doc_id, text_key, pos) of the lines that go."""
    spark = docs.sparkSession
    bounds = docs.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    batch = reduce(lambda a, b: a + b, [(F.col("doc_id") > bound).cast("int") for bound in bounds], F.lit(0))
    staged = scratch(spark, "lines")
    hashed_lines(docs, min_chars).withColumn("batch", batch).write.partitionBy("batch").option("compression", "uncompressed").parquet(staged)
    kind = docs.schema["doc_id"].dataType.simpleString()
    runs, gone = Runs(spark, fanout), []
    before = spark.conf.get(RUN_ORDER, None)
    spark.conf.set(RUN_ORDER, "true")  # for the jobs below, which all end in here
    try:
        for i in range(len(bounds) + 1):
            own = spark.read.schema(f"doc_id {kind}, text_key long, pos int, h1 long, h2 long, batch int").parquet(staged).where(F.col("batch") == i).drop("batch")
            path = runs.add(runs.unseen(own.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))))
            new = spark.read.schema(f"h1 long, h2 long, first {kind}").parquet(path)
            late = F.col("first").isNull() | (F.col("doc_id") > F.col("first"))
            gone.append(own.join(new, ["h1", "h2"], "left").where(late).select("doc_id", "text_key", "pos"))
    finally:
        runs.forget()
        spark.conf.unset(RUN_ORDER) if before is None else spark.conf.set(RUN_ORDER, before)
    return reduce(DataFrame.unionAll, gone)


def dedup_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4, fanout: int = 3) -> DataFrame:
    """docs with n_lines, n_dropped and kept: the text without the lines that an earlier document holds."""
    docs = docs.drop(*OUT, *WORK)
    gone = dropped_lines(docs, min_chars, batches, fanout)
    gone = gone.groupBy(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).agg(F.collect_set("pos").alias("gone_pos"))
    same = (F.col("doc_id") == F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_key"))
    joined = docs.join(gone.hint("shuffle_hash"), same, "left")
    # Lines in a step of their own: inside the function below they would be split anew for each line.
    split = joined.select(*docs.columns, "gone_pos", lines_of(text_or_empty()).alias("lines"), text_or_empty().alias("whole"))
    n = F.size("lines")
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.col("gone_pos"))
    left = F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n")
    kept = F.when(F.col("gone_pos").isNull(), F.col("whole")).otherwise(left)
    return split.select(*docs.columns, n.cast("long").alias("n_lines"), F.coalesce(F.size("gone_pos"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: lines before, lines dropped, and a digest of what is kept."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
firsts AS (SELECT k, min(doc_id) AS first_id FROM keyed WHERE length(k) >= 10 GROUP BY k),
judged AS (
  SELECT keyed.*, coalesce(keyed.doc_id > first_id, false) AS gone
  FROM keyed LEFT JOIN firsts ON keyed.k = firsts.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
