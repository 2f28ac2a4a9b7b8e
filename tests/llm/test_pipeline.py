"""The pipeline's stages against plain versions of each, and the queries' SQL."""

import hashlib

import duckdb
import public_tokenizers
import tiktoken

import corpus_pipeline
from manyview.llm import bpe, langid, registry
from tests.llm.test_operators import classes_by_force, lines_by_force

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs, before = spark.read.parquet(f"{SF}/documents.parquet"), None
    model = langid.default_model(docs)
    for name, stage in corpus_pipeline.STAGES:
        rows = [tuple(r) for r in docs.select(corpus_pipeline.COLUMNS).collect()]
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        out = docs.collect()
        if name != "bpe":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "language_id":
            judged = langid.Scorer(model).judge([r[1] for r in rows])
            assert {r["doc_id"] for r in out} == {r[0] for r, (lang, _) in zip(rows, judged) if lang != "und"}
        if name == "line_dedup":
            assert {r["doc_id"]: r["text"] for r in out} == {i: kept for i, (_, _, kept) in lines_by_force([r[:2] for r in rows]).items()}
            assert all(r["n_chars"] == len(r["text"]) for r in out)
        if name == "near_dedup":
            assert {r["doc_id"] for r in out} == set(classes_by_force([r[:2] for r in rows]).values())
        if name == "mixing":
            texts = {r[0]: r[1] for r in rows}
            assert all(texts[r["doc_id"]] == r["text"] for r in out)
            assert abs(sum(len(r["text"].split()) for r in out) - sum(len(t.split()) for t in texts.values())) <= 20 * 20
        if name == "bpe":
            ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
            plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            expected = sorted((r[0], b"".join(i.to_bytes(4, "little") for i in plain.encode_ordinary(r[1]))) for r in rows)
            assert sorted((r["doc_id"], bytes(r["token_ids"])) for r in out) == expected
            texts = {(r[0], hashlib.sha256(r[1].encode()).hexdigest()) for r in rows}
            assert {(r["doc_id"], r["decoded_sha256"]) for r in out} == texts
    assert corpus_pipeline.run(spark, SF).count() == len(out)


def test_odd_rows_pass_through(spark):
    """Null ids and texts, repeated rows, rows that share a doc_id, a very long text."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    first = docs.first()
    rows = [(None, first["text"], "en", "src0", 1), (900, None, "en", None, 0), (901, "", None, "src1", 0), (902, first["text"] + " and more", "en", "src1", 1), (902, "12 !!", "en", "src1", 1)]
    rows += [(903, "a line that is long enough here\nand one more line of text", "en", "src2", 1)] * 3 + [(904, "the word of a text and " * 20_000, "en", "src3", 1)]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "bpe":
            out = spark.createDataFrame(out.collect(), docs.schema)
        if name == "language_id":
            assert out.where("text is null or text = '' or text = '12 !!'").count() == 0 and out.where("doc_id is null").count() == 1
        if name == "near_dedup":
            assert out.where("doc_id is null").count() == 0 and out.where("doc_id = 904").count() == 1
        docs = out
    assert docs.count() > 10


def test_empty_table_passes_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_sql(spark):
    for name, sql in registry.SQL.items():
        con = duckdb.connect()
        for t in ("documents", "embeddings", "conversations"):  # every query with SQL, over whole tables
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        expected = con.execute(sql).fetchdf()
        got = registry.QUERIES[name](spark, SF).toPandas()[list(expected.columns)]
        keys = list(expected.columns[:2])
        assert got.sort_values(keys).reset_index(drop=True).equals(expected.sort_values(keys).reset_index(drop=True).astype(dict(got.dtypes))), name
