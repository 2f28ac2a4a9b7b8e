"""Surrogates that differ by name alone, and scores of texts with very long words."""

import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from manyview.llm import langid, pii


def test_surrogates_of_all_genders_differ(spark):
    names = [(g, f"name{draw}x") for draw in range(3000) for g in "fmn"]
    entities = spark.createDataFrame([("person", f"{g} {n}") for g, n in names], "kind string, canon string")
    first = entities.withColumn("r", pii.surrogate(F.col("kind"), F.col("canon"), F.lit(0), "k")).select(F.lower(F.substring("r", 3, 99)).alias("name")).groupBy("name").count().where("count > 1")
    assert first.count() > 5  # the first attempts meet, across genders too
    taken = spark.createDataFrame([("person", "n " + r["name"]) for r in first.limit(3).collect()], "kind string, canon string")
    whole = entities.unionByName(taken).distinct()
    out = pii.surrogates(whole, "k").collect()
    shown = [r["replacement"][2:].lower() for r in out]
    assert len(out) == whole.count() and len(set(shown)) == len(shown)
    assert not set(shown) & {r["canon"][2:] for r in out}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=300), min_size=1, max_size=3))
def test_scores_lie_between_0_and_1(spark, texts):
    for lang, score in _scorer(spark).judge(texts):
        assert 0 <= score <= 1 and lang in ("en", "ru", "ja", langid.UNKNOWN)


def test_very_long_words(spark):
    scorer, draw = _scorer(spark), random.Random(1)
    long = {"latin": "thequick", "cyrillic": "быстрая", "kana": "すばやい"}
    for a in long.values():
        for b in long.values():
            text = "".join(draw.choices(a, k=900)) + " " + "".join(draw.choices(b, k=2100))
            lang, score = scorer.judge([text])[0]
            assert 0 <= score <= 1 and not math.isnan(score)
    assert [scorer.judge([w * 300])[0][0] for w in long.values()] == ["en", "ru", "ja"]
    whole, parts = scorer.model.forward(langid._points([long["latin"] * 40]))[0], scorer.model.forward(langid._points([long["latin"]]))[0] * 40
    assert (whole > -math.inf).all() and (whole >= parts - 1e-6).all()  # all segmentations, those at the seams among them


_MODEL = {}


def _scorer(spark):
    if not _MODEL:
        import public_tokenizers

        texts = {"en": "the quick brown fox jumps over the lazy dog", "ru": "быстрая лиса прыгает через ленивую собаку", "ja": "すばやい きつね が いぬ を とびこえる"}
        labelled = spark.createDataFrame([(i, text, lang) for i, (lang, text) in enumerate(texts.items())], "doc_id long, text string, lang string")
        _MODEL["m"] = langid.train(labelled, langid.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    return langid.Scorer(_MODEL["m"])


def test_columns_that_clash_and_long_texts(spark):
    """Columns named as an operator's own, and very long texts, where earlier tests have none."""
    import public_tokenizers

    from manyview.llm import bpe, minhash, mixing

    long = "many different words " + " ".join(f"w{i}" for i in range(120_000))
    rows = [(1, "Mail bob@example.org or 10.1.2.3"), (2, long), (3, long + " end"), (4, None), (5, "")]
    docs = spark.createDataFrame([(*r, "en", "a", 1, 7, "c", "k", 9) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, n_tokens int, canon string, kind string, size int")
    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert coded.columns == ["doc_id", "n_tokens", "token_ids", "decoded"]
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in coded.collect()} == {i: t or "" for i, t in rows}
    hidden = {r["doc_id"]: r for r in pii.pseudonymise(docs).collect()}
    assert hidden[1]["n_entities"] == 2 and "bob@" not in hidden[1]["text"] and hidden[2]["text"] == long and hidden[4]["text"] is None
    classes = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs).collect()}
    assert classes[2] == classes[3] == 2 and classes[1] == 1
    mixed = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    assert mixed[2]["size"] == 120_003 and set(mixed) == {1, 2, 3, 4, 5} and all(r["taken"] <= 3 * r["size"] for r in mixed.values())
