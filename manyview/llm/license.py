r"""License scans by diagonal voting (operator 5, DataFrame operations only).

The rolling hashes of all runs of LONG words of every document are joined to the positions that such runs have in license
templates; for the short phrases of the base labels, runs of two words. A match is a vote for a diagonal: the place in the
document less the place in the template. Votes are counted by row, template and diagonal. A phrase stands at a diagonal on
which all its pairs voted. For longer templates, diagonals within GAP of the one before (words inserted or left out)
merge into a span, and the span is verified: read in the order of the document, only votes whose template place lies after
those of all earlier votes are in line, and the words of the template that they cover must be COVER of it. Runs of function words
alone don't vote, as nearly every text has some of them.

Matching is done in the task that reads the document; only votes and one row for each document are shuffled.

Defined results: words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the text with A-Z lower-cased; a null or empty text has no
words; each row is judged by itself, also where rows share a doc_id or have none; repeated rows are repeated in the result;
places that overlap each count; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from manyview.llm.common import ascii_lower, table, text_or_empty
from manyview.llm.license_texts import NOTICES, PHRASES, TEXTS

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LONG = 4
GAP = 3
COVER = 0.6
FUNCTION_WORDS = set("a an and any as at by for in is it of on or that the this to under use with you".split())


def template_words() -> list[tuple[str, bool, list[str]]]:
    """(label, base, words) of each template."""
    texts = [(label, True, text) for text, label in PHRASES.items()] + [(label, False, text) for label, text in NOTICES + TEXTS]
    return [(label, base, [w for w in re.split(NOT_WORD, text.lower()) if w]) for label, base, text in texts]


def template_grams() -> list[tuple]:
    """(template, label, base, size, votes, at, words) of each voting run of each template; votes: how many it has."""
    rows = []
    for number, (label, base, words) in enumerate(template_words()):
        k = 2 if base else LONG
        runs = [(i, words[i : i + k]) for i in range(len(words) - k + 1)]
        runs = [(i, run) for i, run in runs if base or not set(run) <= FUNCTION_WORDS]
        rows += [(number, label, base, len(words), len(runs), i, run) for i, run in runs]
    return rows


def words_of(text: Column) -> Column:
    """The words of a text; the ends of the text leave no empty ones."""
    return F.filter(F.split(ascii_lower(text), NOT_WORD, -1), lambda w: w != "")


def doubled(values: Column, step: int) -> Column:
    """The hashes of each element with the one `step` places on; of words they are those of pairs, of pairs two apart of runs of four."""
    n = F.greatest(F.size(values) - step, F.lit(0))
    return F.zip_with(F.slice(values, 1, n), F.slice(values, step + 1, n), lambda a, b: F.xxhash64(a, b))


def templates(spark: SparkSession) -> DataFrame:
    """(template, label, base, size, votes, at, key): a row for each voting run of each template, whose number this module fixes."""
    made = spark.createDataFrame(template_grams(), "template int, label string, base boolean, size int, votes int, at int, run array<string>")
    pairs = doubled(F.col("run"), 1)
    key = F.when(F.col("base"), pairs[0]).otherwise(F.get(doubled(pairs, 2), F.lit(0)))
    return made.withColumn("key", key).drop("run")


def votes(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, n_words, template, label, base, size, votes, at, start) of each run that a template has; and a row with
    template -1 for each document. h1 and h2 are 128 bits of hash of the text.

    The template table is broadcast: its size is fixed by license_texts.
    """
    spark = docs.sparkSession
    known = templates(spark)
    short = [r["key"] for r in known.where("base").select("key").distinct().collect()]  # as many as PHRASES has pairs
    hashes = F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), F.col("text")).alias("h2")
    worded = docs.select("doc_id", *hashes, words_of(text_or_empty()).alias("words"))
    paired = worded.select("doc_id", "h1", "h2", F.size("words").cast("long").alias("n_words"), doubled(F.col("words"), 1).alias("pairs"))
    runs = paired.select("doc_id", "h1", "h2", "n_words", "pairs", doubled(F.col("pairs"), 2).alias("runs"))
    at = F.array_compact(F.transform("pairs", lambda key, i: F.when(key.isin(short), i)))
    keys = F.concat(F.array(F.lit(0).cast("long")), F.col("runs"), F.filter("pairs", lambda key: key.isin(short)))
    # In a step of its own, as what stands beside a generator is computed for each row that it makes; and outer, as else a filter
    # on the size of the array is put before it, whose expressions are copied into each other down to the scan.
    ready = runs.select("doc_id", "h1", "h2", "n_words", F.size("runs").alias("n_runs"), at.alias("places"), keys.alias("keys"))
    keyed = ready.select("doc_id", "h1", "h2", "n_words", "n_runs", "places", F.posexplode_outer("keys").alias("nth", "key"))
    own = {"template": F.lit(-1), "label": F.lit(None).cast("string"), "base": F.lit(False), "size": F.lit(1), "votes": F.lit(0), "at": F.lit(0), "key": F.lit(0).cast("long")}
    known = known.unionByName(spark.range(1).select(*[v.alias(k) for k, v in own.items()]))
    met = keyed.join(F.broadcast(known), "key").where((F.col("template") >= 0) == (F.col("nth") > 0))
    start = F.when(F.col("nth") <= F.col("n_runs"), F.col("nth") - 1).otherwise(F.get("places", F.col("nth") - F.col("n_runs") - 1))
    return met.select("doc_id", "h1", "h2", "n_words", "template", "label", "base", "size", "votes", "at", start.alias("start"))


def places(met: DataFrame) -> DataFrame:
    """A row for each span of `met` (distinct votes, with `times`): its first diagonal, score, and whether it is verified."""
    row = ["doc_id", "h1", "h2", "template"]
    met = met.withColumn("diagonal", F.col("start") - F.col("at"))
    by_diagonal = Window.partitionBy(*row).orderBy("diagonal")
    fresh = F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > F.when(F.col("base"), 0).otherwise(GAP)
    met = met.withColumn("fresh", F.coalesce(fresh, F.lit(False)).cast("int"))
    met = met.withColumn("span", F.sum("fresh").over(by_diagonal))
    in_order = Window.partitionBy(*row, "span").orderBy("start", "at").rowsBetween(Window.unboundedPreceding, -1)
    new = F.least(F.lit(LONG), F.col("at") - F.coalesce(F.max("at").over(in_order), F.lit(-LONG)))
    met = met.withColumn("covered", F.greatest(new, F.lit(0)))
    spans = met.groupBy(*row, "span", "label", "base", "size", "votes").agg(
        F.min("diagonal").alias("diagonal"), F.countDistinct("at").alias("seen"), F.sum("covered").alias("covered"),
        F.max("n_words").alias("n_words"), F.max("times").alias("times"),
    )
    score = F.when(F.col("base"), (F.col("seen") == F.col("votes")).cast("double")).otherwise(F.col("covered") / F.col("size"))
    return spans.withColumn("score", score).withColumn("found", (F.col("template") >= 0) & F.when(F.col("base"), F.col("score") == 1).otherwise(F.col("score") >= COVER))


def summary(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row."""
    met = votes(docs)
    # Rows of one doc_id and text vote once and come back as often as they are there.
    spans = places(met.groupBy(*met.columns).agg(F.count(F.lit(1)).alias("times")))
    base = F.when(F.col("found") & F.col("base"), F.col("diagonal").cast("long"))
    label = F.when(F.col("found"), F.col("label"))
    judged = spans.groupBy("doc_id", "h1", "h2").agg(
        F.max("n_words").alias("n_words"),
        F.count(base).alias("n_base"),
        F.min(base).alias("first_word"),
        F.max(base).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), label))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(label)), ",").alias("labels"),
        F.max(F.when(F.col("found"), F.least("score", F.lit(1.0))).otherwise(F.lit(0.0))).alias("score"),
        F.max(F.when(F.col("template") < 0, F.col("times"))).alias("copies"),
    )
    return judged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("h1", "h2", "copies", "copy")


def op5_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: their words, the places of the phrases, and labels."""
    return summary(table(spark, sf_dir, "documents"))


def _values() -> str:
    rows = [(t, f"'{label}'", base, size, votes_, at, f"'{' '.join(run)}'") for t, label, base, size, votes_, at, run in template_grams()]
    return ", ".join(f"({', '.join(map(str, row))})" for row in rows)


OP5_SQL = rf"""
WITH t(template, label, base, size, votes, place, run) AS (VALUES {_values()}),
docs AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{NOT_WORD}'), lambda w: w <> '') AS ws
  FROM documents),
words AS (SELECT rid, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM docs),
runs AS (
  SELECT rid, pos, w || ' ' || lead(w) OVER o AS two,
    w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o AS four
  FROM words WINDOW o AS (PARTITION BY rid ORDER BY pos)),
met AS (
  SELECT rid, pos AS start, t.*, pos - place AS diagonal FROM runs JOIN t ON run = two WHERE base
  UNION ALL SELECT rid, pos, t.*, pos - place FROM runs JOIN t ON run = four WHERE NOT base),
near AS (
  SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) > CASE WHEN base THEN 0 ELSE {GAP} END AS fresh FROM met),
marked AS (SELECT *, sum(coalesce(fresh, false)::INT) OVER (PARTITION BY rid, template ORDER BY diagonal) AS span FROM near),
lined AS (
  SELECT *, greatest(0, least({LONG}, place - coalesce(max(place) OVER (
    PARTITION BY rid, template, span ORDER BY start, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -{LONG}))) AS covered
  FROM marked),
spans AS (
  SELECT rid, label, base, min(diagonal) AS diagonal,
    CASE WHEN base THEN (count(DISTINCT place) = any_value(votes))::INT::DOUBLE ELSE sum(covered) / any_value(size) END AS score
  FROM lined GROUP BY rid, template, span, label, base),
found AS (SELECT * FROM spans WHERE score >= CASE WHEN base THEN 1 ELSE {COVER} END),
judged AS (
  SELECT rid, count(*) FILTER (WHERE base) AS n_base, min(diagonal) FILTER (WHERE base) AS first_word, max(diagonal) FILTER (WHERE base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
    max(least(score, 1)) AS score
  FROM found GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM docs LEFT JOIN judged USING (rid)
"""
