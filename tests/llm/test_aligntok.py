"""Alignment of two vocabularies against a plain version over whole texts."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from manyview.llm import aligntok

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """Rows of (doc_id, text) to the result's rows, each text tokenized as a whole."""
    first, second = Tokenizer.from_file(FIRST), SentencePieceProcessor(model_file=SECOND)
    first.encode_special_tokens = True
    letters = {c: b for b, c in enumerate(__import__("manyview.llm.wordbpe", fromlist=["byte_letters"]).byte_letters())}

    def of(text):
        if not text:
            return []
        a = [(i, bytes(letters[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()) for i in second.encode(text)]
        if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
            return []
        groups, done = [([], [])], [0, 0]
        while a or b:
            side = 0 if b == [] or (a and done[0] <= done[1]) else 1
            i, raw = (a if side == 0 else b).pop(0)
            groups[-1][side].append(i)
            done[side] += len(raw)
            if done[0] == done[1]:
                groups.append(([], []))
        return groups[:-1]

    def rows(docs):
        every = [of(t) for _, t in docs]
        held = Counter(p for groups in every for p in {(x, y) for a, b in groups for x in a for y in b})
        most = {}
        for (x, _), n in held.items():
            most[x] = max(n, most.get(x, 0))
        out = []
        for (doc_id, _), groups in zip(docs, every):
            links = [(x, y) for a, b in groups for x in a for y in b]
            text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
            sums = (sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links))
            out.append((doc_id, *sums, hashlib.sha256(text.encode()).hexdigest() if groups else ""))
        return out

    return rows


def test_documents_equal_whole_texts(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(map(tuple, aligntok.op13_align(spark, "/root/testdata/sf0.001").collect()))
    assert got == sorted(plain(rows))


def test_pieces_and_odd_rows(spark, plain, tmp_path, monkeypatch):
    draw = random.Random(4)
    texts = ["".join(draw.choices(["a", "the", " ", "  ", "\n", " \n", "\t", "é", "中", ".", "'s", "12", "\x1c", "　", "<0x41>", "</s>", "<|endoftext|>"], k=draw.randint(1, 40))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (3, None), (3, ""), (4, "repeated row"), (4, "repeated row"), (5, " "), (6, "a▁b ok"), (7, "word " * 20_000 + "x" * 5_000)]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, number int, piece string")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out = aligntok.op13_align(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(plain(rows), key=repr)
    for t in texts:
        assert " ".join(aligntok.pieces_of(t)) == t
    with open(FIRST, encoding="utf-8") as file:
        content = file.read()
    assert aligntok.align(docs.limit(0), content, SECOND).collect() == []
    assert aligntok.align(docs.where("text = '' or text is null"), content, SECOND).count() == 2


def test_links_are_counted_not_listed(spark):
    """Both vocabularies take such a run by twos, one a character later, so all its tokens are one group: about 2.5e9 links of few pairs."""
    n = 100_000
    docs = spark.createDataFrame([(1, "l" * n), (2, "l" * n), (3, "some words")], "doc_id long, text string")
    with open(FIRST, encoding="utf-8") as file:
        rows = {r.doc_id: r for r in aligntok.align(docs, file.read(), SECOND).collect()}
    first, second = Tokenizer.from_file(FIRST), SentencePieceProcessor(model_file=SECOND)
    a, b = Counter(first.encode(" " + "l" * n, add_special_tokens=False).ids), Counter(second.encode("l" * n))
    assert rows[1][1:] == rows[2][1:]
    assert (rows[1].n_a, rows[1].n_b, rows[1].n_groups) == (a.total(), b.total(), 1)
    assert rows[1].n_links == rows[1].n_best == a.total() * b.total() > 2**31
    assert rows[1].count_sum == 2 * rows[1].n_links


def test_many_blocks_and_shuffled_counts(spark, plain, monkeypatch):
    monkeypatch.setattr(aligntok, "BLOCK_CHARS", 3_000)
    monkeypatch.setattr(aligntok, "PIECES_AT_ONCE", 70)
    monkeypatch.setattr(aligntok, "PAIRS_AT_ONCE", 100)
    monkeypatch.setattr(aligntok, "MOST_SENT", 0)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60)
    docs = docs.unionByName(spark.createDataFrame([(-1, "sign▁inside a text " + "of words " * 40), (-2, "")], "doc_id long, text string"), allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    with open(FIRST, encoding="utf-8") as file:
        got = aligntok.align(docs, file.read(), SECOND).collect()
    assert sorted(map(tuple, got)) == sorted(plain(rows))
