"""Words by speculation and verification against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from manyview.llm import wordbpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def content():
    with open(PATH, encoding="utf-8") as file:
        return file.read()


@pytest.fixture(scope="module")
def codec(content):
    return wordbpe.Codec(content)


def plain(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def same(codec, texts):
    for text, packed in zip(texts, codec.encode_batch(texts)):
        assert (np.frombuffer(packed, "<i4").tolist(), codec.decode(packed)) == plain(text), repr(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=4))
def test_any_text(codec, texts):
    same(codec, texts)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aaaehinorst'sd<|>/w0é́İΣſ中 \n\x1c\x85", max_size=80))
def test_close_letters(codec, text):
    same(codec, [text])


def test_special_tokens_and_long_words(codec):
    draw = random.Random(2)
    same(codec, ["<|endoftext|>", "a<|startoftext|>B<|endoftext|><|endoftext|>́", "<|EndOfText|> </w> a</w>", "Ɤ\U00010d50 xꟋ", "", " \n "])
    same(codec, ["a" * 3001, "ab" * 999, "the" * 700, "".join(draw.choices("abc", k=4000)), "".join(draw.choices("eatinorshl", k=9000)), "ha" * 20 + " x"])


def test_pairs_equal_merging(codec):
    """The check of neighbours against merging the two tokens' letters."""
    merges, draw = codec.merges, random.Random(7)
    inner = [(k, i) for k, i in merges.proposed.items() if not k.endswith(wordbpe.END)]
    pairs = [(draw.choice(inner), draw.choice(list(merges.proposed.items()))) for _ in range(20_000)]
    close = [k for k in inner if set(k[0]) <= set("aehlnot")]
    pairs += [(draw.choice(close), draw.choice(close)) for _ in range(20_000)]
    good = merges.compatible(np.array([a[1] for a, _ in pairs]), np.array([b[1] for _, b in pairs]))
    assert good.tolist() == [merges.exact(a[0] + b[0]) == [a[1], b[1]] for a, b in pairs]
    assert 0.05 < good.mean() < 0.95


def test_only_failing_words_are_merged(codec, spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    before = codec.seen, codec.failed
    same(codec, texts)
    assert 0 < codec.failed - before[1] < (codec.seen - before[0]) / 2


def test_query_with_odd_rows(spark, content, tmp_path):
    long = "word " * 30_000 + "x" * 50_000
    rows = [(1, None), (2, ""), (None, "Null id"), (4, long), (5, "Same"), (5, "Same"), (6, "<|endoftext|>")]
    spark.createDataFrame([(*r, 7, "k") for r in rows], "doc_id long, text string, n_tokens int, decoded string").write.parquet(str(tmp_path / "documents.parquet"))
    out = wordbpe.op12_word_bpe(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    expected = []
    for doc_id, text in rows:
        ids, decoded = plain(text or "")
        expected.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(decoded)))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(expected, key=repr)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert wordbpe.encode_decode(empty, content).collect() == []
