"""A training-data pipeline over `documents`: five stages, each an operator of manyview.llm over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again for the next. All
but the last give the columns of `documents`. An empty table passes through as an empty table; repeated rows and null
columns follow the rules of each operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyview.llm import bpe, langid, linededup, minhash, mixing
from manyview.llm.common import scratch, table
from manyview.session import ship_package

#: No SQL: language models, near-duplicate classes and token merges have none. The tests compare with plain versions.
ORACLE_SQL = None

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned go on; those without letters, or that no language fits best, are rejected.
    A missing lang becomes the language found."""
    judged = langid.identify(docs, langid.default_model(docs), COLUMNS)
    known = judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that a document with a smaller doc_id holds; n_chars follows."""
    kept = linededup.dedup_lines(docs.select(COLUMNS))
    return kept.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast("long")).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document with the smallest doc_id; rows without a doc_id go."""
    classes = minhash.near_duplicates(docs)
    first = classes.where(F.col("doc_id") == F.col("class_id")).select(F.col("doc_id").alias("first_id"))
    return docs.join(first.hint("shuffle_hash"), F.col("doc_id") == F.col("first_id"), "left_semi").select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, which may be never."""
    return mixing.taken_rows(docs.select(COLUMNS))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids, decoded_sha256) of each row: packed little-endian unsigned 32-bit ids, and a digest of the bytes
    that they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode_decode(docs, path, public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what the last one gives."""
    docs = table(ship_package(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
