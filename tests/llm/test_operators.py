"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from manyview.llm import bpe, chat, fingerprint, langid, license, linededup, minhash, mixing, pii, topk

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
CODEC = bpe.Codec(RANKS, public_tokenizers.PATTERN)
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(raw) -> str:
    return hashlib.sha256(raw if isinstance(raw, bytes) else raw.encode()).hexdigest()


def odd_docs(spark):
    long = "word " * 30_000 + "end"
    rows = [(1, None, None, None, 0), (2, "", "en", "a", 0), (3, long, "en", "a", 1), (4, "Same line of text here\nshort\nX", "en", None, 1), (5, "Same line of text here \nother", None, "b", 1), (5, "Same line of text here \nother", None, "b", 1), (7, "!!! ???", "en", "b", 1)]
    return spark.createDataFrame([(*r, 9, "z") for r in rows], DOCS + ", n_tokens long, kept string")


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


# --- 1 ------------------------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab'sreé中 \n\t1²\x1c\x85.", max_size=80), st.integers(1, 12), st.integers(2, 9))
def test_bpe_tree_equals_whole(text, leaf_chars, leaf_bytes):
    before = bpe.LEAF_CHARS, bpe.LEAF_BYTES
    bpe.LEAF_CHARS, bpe.LEAF_BYTES = leaf_chars, leaf_bytes
    try:
        CODEC.words.clear()
        ids = CODEC.encode(text)
    finally:
        bpe.LEAF_CHARS, bpe.LEAF_BYTES = before
    assert np.frombuffer(ids, "<u4").tolist() == REFERENCE.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


def test_bpe_long_word_and_heap():
    for word in ("a" * 3001, "ab" * 999, "the" * 700, "".join(random.Random(1).choices("abc", k=4000))):
        assert np.frombuffer(CODEC.encode(word), "<u4").tolist() == REFERENCE.encode_ordinary(word)


def test_bpe_rows(spark):
    out = bpe.encode_decode(odd_docs(spark), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert len(out) == 7
    texts = {r["doc_id"]: r["text"] or "" for r in odd_docs(spark).collect()}
    for r in out:
        assert bytes(r["decoded"]).decode() == texts[r["doc_id"]]
        assert r["n_tokens"] == len(REFERENCE.encode_ordinary(texts[r["doc_id"]]))
    odd = bpe.encode_decode(spark.createDataFrame([(None, "no id"), (None, None)], "doc_id long, text string"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert sorted((r["doc_id"], bytes(r["decoded"])) for r in odd.collect()) == [(None, b""), (None, b"no id")]
    assert bpe.encode_decode(empty_docs(spark), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


# --- 2 ------------------------------------------------------------------------------------------------------------------


def test_topk(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=8).round(2).tolist()) for i in range(300)] + [(i, [0.25] * 8) for i in range(300, 360)]
    odd = [(400, None), (401, [None] * 8), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (420, [1.0, 2.0]), (440, [3.0, 1.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>").repartition(3)
    df = df.where(df.vec_id.isNotNull() & topk.usable(df.embedding)).select(df.vec_id.alias("id"), topk.quantised(df.embedding, 64).alias("v"))
    rows = {r["id"]: r["v"] for r in df.collect()}
    assert set(rows) == set(range(360)) | {420, 440}
    got = {}
    for r in topk.top_k(df, df.where("id % 20 = 0"), k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for q, v in rows.items():
        if q % 20 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows.items() if i != q and len(w) == len(v)))[:5]
            assert got[q] == [(i, -s) for s, i in scores], q
    none = spark.createDataFrame([], "id long, v array<long>")
    assert topk.top_k(none, none).count() == 0


def by_force(rows, queries, k):
    """{(query id, vector): its list} over (id, vector) pairs."""
    out = {}
    for q, v in {(q, tuple(v)) for q, v in queries}:
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))
        out[q, v] = [(i, -s) for s, i in scores[:k]]
    return out


def test_topk_leaves_out_most_of_clustered_vectors(spark, monkeypatch):
    """Clusters, one with a third of all rows, repeated rows and query ids, vectors of 2,000 components, an extra column."""
    for name, value in (("BLOCK", 64), ("QUERY_BLOCK", 16), ("ROWS_PER_CELL", 60), ("SAMPLE", 700), ("TILE", 3), ("STEP", 8)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16)) * 60
    of = np.where(rng.random(1500) < 0.33, 0, rng.integers(0, 12, 1500))
    rows = [(i, [int(x) for x in centres[c] + rng.normal(size=16) * 4]) for i, c in enumerate(of)]
    rows += [(i, rows[0][1]) for i in range(2000, 2100)] + [rows[7]] * 3 + [(3000 + i, rng.integers(-9, 9, 2000).tolist()) for i in range(8)]
    queries = [r for r in rows if r[0] % 20 == 0] + [rows[20], (20, rows[21][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, v array<long>, score int").repartition(5)
    out = topk.top_k(df, spark.createDataFrame(queries, "id long, v array<long>"), k=6, pivots=40, joint=8).collect()
    expected = by_force(rows, queries, 6)
    lists = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        lists.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in lists:
        assert sorted(lists[q]) == sorted((n + 1, *hit) for (i, _), hits in expected.items() if i == q for n, hit in enumerate(hits)), q
    assert set(lists) == {q for q, _ in expected}
    cost = {(r["query_id"], r["evaluated"]) for r in out if r["query_id"] < 3000}
    assert sum(n for _, n in cost) < 0.25 * len(rows) * len(cost)


def test_topk_of_large_components(spark):
    """Inner products beyond what a double holds exactly."""
    rows = [(i, [10**8 + i, -(10**8) + 3 * i, 7]) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    got = {}
    for r in topk.top_k(df, df.where("id % 20 = 0"), k=4).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == {q: hits for (q, _), hits in by_force(rows, [r for r in rows if r[0] % 20 == 0], 4).items()}


# --- 3 ------------------------------------------------------------------------------------------------------------------


def test_darts_estimate_weighted_jaccard():
    darts, rng = minhash.Darts(400), np.random.default_rng(5)
    items = rng.integers(0, 2**63, 200).astype(np.uint64)
    a, b = rng.choice([0.5, 1, 3, 0], 200), rng.choice([0.5, 1, 3, 0], 200)
    b[:120] = a[:120]
    use = [np.flatnonzero(a), np.flatnonzero(b)]
    sig = darts.signatures(np.concatenate([items[u] for u in use]), np.concatenate([a[use[0]], b[use[1]]]), np.repeat([0, 1], [len(u) for u in use]), 2)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 0.1


def test_darts_do_not_depend_on_company():
    darts, rng = minhash.Darts(100), np.random.default_rng(6)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 3, 5000, 40)]
    together = darts.signatures(np.concatenate(sets), np.ones(sum(map(len, sets))), np.repeat(range(4), [len(s) for s in sets]), 4)
    for i, s in enumerate(sets):
        assert (darts.signatures(s, np.ones(len(s)), np.zeros(len(s), int), 1)[0] == together[i]).all()


def classes_by_force(rows):
    sets = {i: set(minhash.shingles(t, 5, minhash.WordHashes()).tolist()) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_near_duplicates(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows, base = [], [rng.choice(words) for _ in range(120)]
    for i in range(60):  # a large group of near copies, and texts that share a long passage
        copy = list(base)
        copy[rng.randrange(120)] = "edited"
        rows.append((i, " ".join(copy)))
    passage = [rng.choice(words) for _ in range(70)]
    rows += [(i, " ".join(passage + [rng.choice(words) for _ in range(60)])) for i in range(60, 100)]
    rows += [(i, " ".join(rng.choice(words) for _ in range(80))) for i in range(100, 130)]
    rows += [(130, None), (131, ""), (132, "  "), (133, "one two"), (134, "One, two!"), (135, rows[110][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows] + [(None, "text without an id", "x")], "doc_id long, text string, class_id string")
    got = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in minhash.near_duplicates(df).collect()}
    expected = classes_by_force([(i, t) for i, t in rows])
    sizes = Counter(expected.values())
    assert got == {i: (c, sizes[c]) for i, c in expected.items()}
    assert minhash.near_duplicates(empty_docs(spark)).count() == 0


def test_sketch_loses_no_more_than_the_bands(spark):
    k, chance = minhash.BANDS * minhash.ROWS, 0.2 * 15 / 16
    bands_lose = (1 - 0.8**minhash.ROWS) ** minhash.BANDS
    over = lambda most: sum(math.comb(k, i) * chance**i * (1 - chance) ** (k - i) for i in range(most + 1, k + 1))
    most = minhash.most_different(k, bands_lose)
    assert over(most) <= bands_lose < over(most - 1) < over(59)  # 59: four deviations
    assert str(minhash._near_sketches(minhash.BANDS, minhash.ROWS)).endswith(f", {most})'>")


# --- 4 ------------------------------------------------------------------------------------------------------------------


def lines_by_force(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keys = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            keys.setdefault(line.strip(" \t\n\x0b\x0c\r").translate(lower), set()).add(i)
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(k := x.strip(" \t\n\x0b\x0c\r").translate(lower)) < 10 or min(keys[k]) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2)])
def test_line_dedup(spark, batches, fanout):
    rng = random.Random(7)
    pool = [f"A repeated line number {i}" for i in range(12)] + ["short", "", " A REPEATED line number 3\t", "É accents stay É as is", "é accents stay É as is"]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"unique {i} {j} line" for j in range(rng.randrange(1, 9)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "\n\n"), (63, "A repeated line number 1\r\n" * 3)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, n_lines string").repartition(3)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept"]) for r in linededup.dedup_lines(df, 10, batches, fanout).collect()}
    assert got == lines_by_force(rows)
    assert linededup.dedup_lines(empty_docs(spark)).count() == 0


def test_line_dedup_uses_the_order_of_runs(spark):
    """A batch is sorted once to be merged with any number of runs; a very long text, repeated rows and a common line."""
    key = linededup.RUN_ORDER
    runs = linededup.Runs(spark, 9)
    keys = lambda low, high: spark.range(low, high).selectExpr("id as h1", "id * 7 as h2", "id as first")
    for low in (0, 100, 200):
        runs.add(keys(low, low + 60))
    spark.conf.set(key, "true")
    fresh = runs.unseen(keys(0, 300).repartition(3).groupBy("h1", "h2").agg({"first": "min"}))
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and plan.count("Sort [") == 1 and fresh.count() == 120
    spark.conf.unset(key)
    runs.forget()
    rows = [(i, "one very common line\nown line number %d" % i) for i in range(50)] + [(60, "a line of a long text\n" * 50_000 + "one very common line")]
    rows += [(3, "one very common line\nown line number 3"), (3, "another text of number 3\none very common line")]
    got = sorted((r["doc_id"], r["n_lines"], r["n_dropped"]) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(i, 2, int(i > 0)) for i in range(50)] + [(60, 50_001, 1), (3, 2, 1), (3, 2, 1)]) and spark.conf.get(key, None) in (None, "false")


def test_line_dedup_null_ids(spark):
    df = spark.createDataFrame([(None, "the very same line"), (1, "the very same line"), (2, "the very same line")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["kept"]) for r in linededup.dedup_lines(df).collect()) == [(0, "the very same line"), (1, "the very same line"), (2, "")]


# --- 5 ------------------------------------------------------------------------------------------------------------------


def scanned(text):
    """A text's result by plain loops."""
    words = [w for w in re.split(license.NOT_WORD, (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if w]
    base, labels, score = [], [], 0.0
    for label, is_base, known in license.template_words():
        if is_base:
            at = [i for i in range(len(words)) if words[i : i + len(known)] == known]
            base += [(i, label) for i in at]
            score = max([score] + [1.0] * len(at))
            continue
        k, places = license.LONG, {}
        for i in range(len(known) - k + 1):
            if not set(known[i : i + k]) <= license.FUNCTION_WORDS:
                places.setdefault(tuple(known[i : i + k]), []).append(i)
        found = sorted((i - at, i, at) for i in range(len(words) - k + 1) for at in places.get(tuple(words[i : i + k]), []))
        spans = []
        for hit in found:
            if not spans or hit[0] - spans[-1][-1][0] > license.GAP:
                spans.append([])
            spans[-1].append(hit)
        for span in spans:
            last, covered = -k, 0
            for _, at in sorted(hit[1:] for hit in span):
                if at > last:
                    covered, last = covered + min(k, at - last), at
            if covered / len(known) >= license.COVER:
                labels.append(label)
                score = max(score, min(1.0, covered / len(known)))
    starts = [i for i, _ in base]
    join = lambda x: ",".join(sorted(set(x)))
    return len(words), len(base), min(starts, default=None), max(starts, default=None), join(x for _, x in base), join([x for _, x in base] + labels), score


def test_license_equals_plain_loops(spark):
    rng = random.Random(5)
    texts = ["See the MIT License, mit LICENSE! mit-license", None, "", "cc by cc by by", "the mit éLicense", "of the software is in this", "gnu general", "zzz yyy general public license"]
    for label, text in license.NOTICES + license.TEXTS:
        words = text.split()
        for _ in range(2):  # words left out, put in, exchanged
            changed = list(words)
            for _ in range(len(words) // 15 + 1):
                at = rng.randrange(len(changed))
                changed[at : at + rng.randrange(3)] = rng.choices(words + ["other"], k=rng.randrange(3))
            texts.append("intro words " + " ".join(changed).upper() + " end")
        texts += [" ".join(words[: len(words) // 2]), " ".join(rng.sample(words, len(words))), text + " and " + text]
    texts.append("word " * 50_000 + license.TEXTS[0][1] + " word" * 50_000)
    rows = [(i // 2 if i % 7 else None, t) for i, t in enumerate(texts)] + [(3, texts[0])] * 3
    got = license.summary(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, label string")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *scanned(t))) for i, t in rows)
    found = [scanned(t)[5] for t in texts]
    assert sum(map(bool, found)) > 60 and found[7] == "" and found[6] == ""
    assert license.summary(empty_docs(spark)).count() == 0


# --- 6 ------------------------------------------------------------------------------------------------------------------


def test_fingerprints_of_neighbours(spark):
    rng = random.Random(8)
    texts = {i * 3: " ".join(rng.choices(["alpha", "béta", "gamma", "delta"], k=rng.randrange(0, 60))) for i in range(50)}
    texts[7], texts[8] = "", "ab"
    import pyarrow as pa

    schema = pa.schema({"doc_id": pa.int64(), "edited": pa.string()})
    df = spark.createDataFrame([(i, t or None) for i, t in texts.items()], "doc_id long, text string").repartition(4)
    out = fingerprint.with_next(df, lambda i, a, b: (i, fingerprint.edited(a, b)), schema, "doc_id long, edited string")
    ids = sorted(texts, reverse=True)
    assert {r["doc_id"]: r["edited"] for r in out.collect()} == {a: fingerprint.edited(texts[a], texts[b]) for a, b in zip(ids, ids[1:] + ids[:1])}
    rows = [(9, "a"), (9, "b"), (None, "lost"), (3, "word " * 50_000), (9, "b"), (5, None)]
    odd = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fingerprint string")
    got = [(r["doc_id"], r["edited"]) for r in fingerprint.with_next(odd, lambda i, a, b: (i, a[:1] + ">" + b[:1]), schema, "doc_id long, edited string").collect()]
    assert sorted(got) == [(3, "w>a"), (5, ">w"), (9, "a>b"), (9, "b>"), (9, "b>b")]
    alone = spark.createDataFrame([(4, "abcdef")], "doc_id long, text string")
    assert fingerprint.with_next(alone, lambda i, a, b: (i, a + b), schema, "doc_id long, edited string").first()["edited"] == "abcdefabcdef"
    assert fingerprint.with_next(empty_docs(spark), lambda i, a, b: (i, a), schema, "doc_id long, edited string").count() == 0


def test_fingerprint_scores():
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("etaoinshr", k=rng.randrange(2, 9)))
    a = " ".join(word() for _ in range(600))
    near = a[:1500] + "CHANGED" + a[1510:]
    far = " ".join("".join(rng.choices("qwxzkvjp", k=5)) for _ in range(600))
    d = [fingerprint.digest(x.encode()) for x in (a, near, far)]
    assert fingerprint.likeness(d[0], d[0]) == 1 and fingerprint.likeness(d[0], d[1]) > 0.9 and fingerprint.likeness(d[0], d[2]) < 0.3
    assert all(len(fingerprint.digest(x)) == 132 for x in (b"", b"a", b"ab", b"abc")) and fingerprint.digest(b"a") != fingerprint.digest(b"b")
    assert 0 <= fingerprint.difference(d[0], d[2]) <= fingerprint.MOST


# --- 7 ------------------------------------------------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "ba", "abb"]
    codes = np.array([int(langid._codes(langid._points([p]), len(p))[len(p) - 1][0, 0]) for p in pieces], np.uint64)
    order = np.argsort(codes)
    chances = np.array([[0.1], [0.2], [0.3], [0.15], [0.25], [0]])
    model = langid.Model(["x"], codes[order], np.vstack([chances[order], [[0]]]), 3)
    by_piece = dict(zip(pieces, chances[:, 0]))

    def total(word):
        return 1.0 if not word else sum(p * total(word[len(k) :]) for k, p in by_piece.items() if word.startswith(k))

    for word in ("a", "abb", "abbab", "babbaabbab" * 4):
        assert np.isclose(model.forward(langid._points([word]))[0, 0], np.log(total(word)))


def test_language_id(spark):
    words = {"en": "the house of wind and rain that was there with them".split(), "de": "das haus und der wind mit regen war nicht schön über".split(), "fr": "la maison et le vent avec une pluie était où çà".split()}
    rng = random.Random(10)
    rows = [(i, " ".join(rng.choices(words[lang], k=30)), lang) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    rows += [(500, None, "en"), (501, "", None), (502, "12 !?", "de"), (503, "Δοκιμή", None), (504, "the wind and the rain", None)]
    rows += [(505, "² ½ ① Ⅷ _ 12", None), (506, "²½①", "en"), (507, "the " * 60_000, "en"), (504, "the wind and the rain", None)] + [(600, rows[0][1], "en")] * 1500
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df, langid.default_model(df)).collect()}
    lang = {i: x for i, _, x in rows}
    assert all(found[i][0] == lang[i] for i in range(180)) and found[504][0] == "en"
    assert all(found[i] == ("und", 0.0) for i in (500, 501, 502, 505, 506)) and found[507][0] == "en" and found[503][0] in words and all(0 <= s <= 1 for _, s in found.values())
    assert langid.identify(df, langid.default_model(empty_docs(spark))).where("lang_pred != 'und'").count() == 0
    assert langid.identify(df, langid.default_model(df)).count() == len(rows)
    by_lang = Counter(r["lang"] for r in langid.sampled(df, 20, 2).collect())
    assert sorted(by_lang.values()) == [20, 20] and langid.sampled(df.where("doc_id = 600"), 20, 2).count() == 1
    assert langid.identify(df, langid.default_model(df), df.columns).columns == ["doc_id", "text", "lang", "lang_pred", "score"]


# --- 8 ------------------------------------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "x>\\<", ""]), st.lists(st.sampled_from(["<s>", "</s>", "[INST]", " ", "\\", "[/INST]", "<<SYS>>", "<role a>", "a", "\n", ">"])).map("".join)), max_size=4))
def test_template_reads_back(turns):
    assert chat.read_back(chat.BEGIN + "".join(chat.piece(r, t)[0] for r, t in turns)) == turns


def test_packs(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t}" if t < 2 else f"own {c % 5} {t}") for c in range(40) for t in range(c % 6 + 1)]
    rows += [(100, 0, None, None), (None, 0, "user", "lost"), (101, 1, "assistant", "second"), (101, 0, "system", "first")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, pack string")
    nodes = chat.format_chats(df, pack=8)
    back = {r["conv_id"]: r for r in chat.read_packs(nodes).collect()}
    for conv in {r[0] for r in rows} - {None}:
        turns = [(r or "", t or "") for _, _, r, t in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])]
        assert [(t["role"], t["text"]) for t in back[conv]["turns"]] == turns
        assert back[conv]["loss"] == "".join(t for r, t in turns if r == "assistant")
    held = nodes.collect()
    whole = sum(len(r["formatted"]) for r in back.values())
    assert sum(r["length"] for r in held) < whole / 2  # shared turns are there once for each pack
    for r in held:  # positions count what is visible
        assert sum(v["high"] - v["low"] for v in r["visible"]) == r["position"] + r["length"] and r["visible"][-1]["high"] == r["start"] + r["length"]
    assert chat.read_packs(chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_packs_share_deep_turns(spark):
    """512 conversations under one system prompt, eight for each second turn."""
    rows = [r for c in range(512) for r in ((c, 0, "system", "be kind " * 9), (c, 1, "user", f"question {c % 64}"), (c, 2, "assistant", f"answer {c}"))]
    nodes = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), pack=8).collect()
    packs, borders = len({r["pack"] for r in nodes}), 8
    assert sorted(c for r in nodes for c in r["ends"]) == list(range(512)) and packs <= 64 + borders
    assert len(nodes) <= (64 + 512) + 2 * packs + borders  # distinct turns below the first, <s> and the first for each pack


def test_odd_turns(spark):
    """Null turns come first, repeated rows are repeated turns, equal turns go by role and text; a very long text is whole."""
    rows = [(1, 1, "user", "b"), (1, None, "system", "a"), (1, 1, "assistant", None), (2, 0, "user", "x"), (2, 0, "user", "x"), (3, 0, "assistant", "</s>\\[" * 100_000)]
    nodes = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = {r["conv_id"]: r for r in chat.read_packs(nodes).collect()}
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [("system", "a"), ("assistant", ""), ("user", "b")]
    assert [(t["role"], t["text"]) for t in back[2]["turns"]] == [("user", "x")] * 2
    assert back[3]["loss"] == "</s>\\[" * 100_000 and len(back[3]["formatted"]) == 3 + 4 + 9 * 100_000


def test_packs_of_equal_conversations(spark):
    rows = [(c, 0, "user", "same") for c in range(300)]
    nodes = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), pack=8).collect()
    assert sorted(c for r in nodes for c in r["ends"]) == list(range(300)) and max(len(r["ends"]) for r in nodes) <= 8


# --- 9 ------------------------------------------------------------------------------------------------------------------


def test_surrogates(spark):
    rows = [
        (1, "Mail bob.Smith@acme.example.org or +1 (017) 555-7713, +1-017-555-7713. IP 10.2.33.4, card 4111 1111 1111 1111 and 4111111111111111!"),
        (2, 'TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"!! token = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b" Mrs Anna Schmidt met Mr. Иван Петров. Mrs Anna Schmidt'),
        (3, None), (4, ""), (5, "nothing here, 12 things"), (6, "BOB.SMITH@ACME.EXAMPLE.ORG 123-45-6789 DE89 3704 0044 0532 0130 00"), (6, "BOB.SMITH@ACME.EXAMPLE.ORG 123-45-6789 DE89 3704 0044 0532 0130 00"), (None, "a@b.cd"),
    ]
    got = pii.pseudonymise(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kinds string")).collect()
    by = {r["doc_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and by[3] is None and by[4] == "" and by[5] == rows[4][1]
    for secret in ("bob", "Smith", "7713", "10.2.33.4", "1111", "9233", "Anna Schmidt", "Иван", "6789", "3704"):
        assert all(secret.lower() not in (t or "").lower() for t in by.values()), secret
    mail, mail_again = re.search(r"\S+@\S+", by[1])[0], re.search(r"\S+@\S+", by[6])[0]
    assert mail_again == mail.upper() and mail.endswith(".org")
    phones = re.findall(r"\+1[^,.]*", by[1])
    assert [re.sub(r"\D", "", p) for p in phones][0] == [re.sub(r"\D", "", p) for p in phones][1] and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phones[0])
    card = re.search(r"\d{16}", by[1])[0]
    assert sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(card)) % 10 == 0
    assert re.search(r"Mrs (\w+ \w+) met Mr\. ([А-Яа-я]+ [А-Яа-я]+)\. Mrs (\w+ \w+)", by[2])[1] == by[2].split("Mrs ")[2]
    assert by[2].split("Mrs ")[1].split()[0] in pii.GIVEN["latin", "f"]
    assert pii.pseudonymise(empty_docs(spark)).count() == 0


def test_surrogates_do_not_collide(spark):
    found = spark.createDataFrame([("person", f"f x{i}") for i in range(3000)] + [("ssn", f"{i:03d}") for i in range(400)], "kind string, canon string")
    out = pii.surrogates(found, "k").collect()
    assert len({(r["kind"], r["replacement"]) for r in out}) == len(out) == 3400
    real = {(r["kind"], r["canon"]) for r in out}
    assert not any((r["kind"], r["replacement"]) in real for r in out)


def twin(rows, replacements):
    """The rows rewritten by plain loops, given the surrogate of each entity; and the entities found."""
    import regex

    python = lambda pattern: pattern.replace("(?iu:", "(?i:").replace(r"\p{IsCyrillic}", r"\p{Cyrillic}")
    any_, kinds = regex.compile(python(pii.ANY)), {k: regex.compile(python(p)) for k, p in pii.PATTERNS.items() if k != "person"}
    named = {g: {x.lower() for x in names} for g, names in pii._NAMED.items()}
    seen, out = set(), []

    def split(kind, text):
        if kind == "secret":
            stays = (regex.match(python(pii._SECRET_NAME) + "[\"']?", text) or [""])[0]
        elif kind == "person":
            stays = (regex.match(rf"(?:(?:{pii._TITLE})\.? )++", text) or [""])[0]
        else:
            stays = (regex.match(r"\+\d{1,3}(?=[ .\-(])", text) or [""])[0] if kind == "phone" else ""
        quote = stays[-1] if kind == "secret" and stays[-1:] in ("'", '"') and stays else ""
        return stays, text[len(stays) : len(text) - len(quote)], quote

    def canon(kind, stays, body):
        if kind in ("email", "ip"):
            return body.lower()
        if kind == "person":
            first = body.split(" ")[0].lower() if " " in body else ""
            gender = next((g for g in "mf" if first in named[g]), None)
            shown = {x.strip(".").upper() for x in stays.split()}
            return f"{gender or next((g for g in 'mf' if shown & {t.upper() for t in pii.TITLES[g]}), 'n')} {body.lower()}"
        if kind == "phone":
            return regex.sub(r"\D", "", stays) + "/" + regex.sub(r"\D", "", body)
        if kind == "secret":
            return body.lower() if regex.fullmatch("[0-9a-fA-F]+", body) else body
        return regex.sub(r"[^\p{L}\p{N}]", "", body).lower()

    def one(found):
        text = found.group()
        kind = next((k for k, p in kinds.items() if p.fullmatch(text)), "person")
        stays, body, quote = split(kind, text)
        entity = (kind, canon(kind, stays, body))
        seen.add(entity)
        new = replacements.get(entity, "?")
        if kind in ("email", "ip", "person", "secret"):
            new = new[2:] if kind == "person" else new
            hexed = kind == "secret" and regex.fullmatch("[0-9a-fA-F]+", body)
            new = new.upper() if body.isupper() and (kind in ("email", "person") or hexed) else new
        else:
            rest = list(new.split("/")[-1] if kind == "phone" else new)
            new = "".join((rest.pop(0).upper() if c.isupper() else rest.pop(0)) if regex.match(r"[\p{L}\p{N}]", c) and rest else c for c in body) + "".join(rest)
        return stays + new + quote

    for i, text in rows:
        out.append((i, None if text is None else any_.sub(one, text)))
    return out, seen


PRIVATE = [
    'password="******" and password="******", pwd = hunter22x, api_key: \'abcd efgh\' token = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b"',
    "Dr. Anna Schmidt, Anna Schmidt and Frau Anna Schmidt met John A. Smith. My name is Peter Jones. MR SMITH, Mr. Smith, Mr. smith; Mr. and Mrs. Brown",
    "Herr Dr. von der Leyen; ANNA MARIA SCHMIDT; Clara de la Cruz; Mr. Žižek's; Ms. Ελένη Παπαδοπούλου; Г-н Петров; Mr. Иван Петров",
    "DE89 3704 0044 0532 0130 00, de89, 4111-1111-1111-1111, 4111111111111111, 123-45-6789, +49 (030) 1234 5678, 10.0.0.1 999.999.999.999",
    "x@" + "a." * 3000 + "com", "A" * 20_000 + " B", "Mr. " * 3000 + "Brown", None, "", "clean text of Great Britain, 12 things", "A@B.CD a@b.cd",
]


def test_surrogates_equal_plain_loops(spark):
    """Whole texts against plain loops; the table of surrogates is one to one, disjoint from the entities, and keeps each form."""
    rows = [*enumerate(PRIVATE), (33, PRIVATE[0]), (None, PRIVATE[1]), (5, PRIVATE[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    entities = pii.mentions(df).select("kind", "canon").distinct()
    table = {(r["kind"], r["canon"]): r["replacement"] for r in pii.surrogates(entities, "k1").collect()}
    expected, seen = twin(rows, table)
    order = lambda rows: sorted(rows, key=repr)
    assert order((r["doc_id"], r["text"]) for r in pii.pseudonymise(df, "k1").collect()) == order(expected)
    assert seen == set(table) and len({(k, v) for (k, _), v in table.items()}) == len(table)
    assert not seen & {(k, v.lower() if k == "person" else v) for (k, _), v in table.items()}
    assert {k for k, _ in seen} == {"secret", "person", "iban", "card", "ssn", "phone", "ip", "email"}
    other = {(r["kind"], r["canon"]): r["replacement"] for r in pii.surrogates(entities, "k2").collect()}
    assert sum(other[e] == table[e] for e in table) < len(table) / 4
    text = dict(expected)
    assert text[9] == PRIVATE[9] and "******" not in text[0] and not re.search("Schmidt|SCHMIDT|Jones|Smith|smith|SMITH|Leyen|Cruz", text[1] + text[2])
    iban = re.search(r"DE[\d ]+", text[3])[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    names = re.match(r"Dr\. (\w+ \w+), (\w+ \w+) and Frau (\w+ \w+) met \w+ \w\. \w+\. My name is (\w+)", text[1])
    assert names[1] == names[2] == names[3] and names[1].split()[0] in pii.GIVEN["latin", "f"] and names[4] in pii.GIVEN["latin", "m"]
    assert re.search("Ms. (.*?);", text[2])[1].split()[0] in pii.GIVEN["greek", "f"]


def test_small_forms_never_run_out(spark):
    """All mailboxes of one letter at a domain, and a thousand secrets of four symbols, all of them taken."""
    rows = [(i, f"{c}@mail.example.org") for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")] + [(100 + i, f"Mr. X{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i // 100]}") for i in range(1000)]
    out = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r["text"] for r in out}) == len(rows) and not {r["text"] for r in out} & {t for _, t in rows}
    tiny = spark.createDataFrame([("ssn", str(i)) for i in range(10)], "kind string, canon string")
    out = [r["replacement"] for r in pii.surrogates(tiny, "k").collect()]
    assert len(set(out)) == 10 and not set(out) & set("0123456789")


# --- 10 -----------------------------------------------------------------------------------------------------------------


def water(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, total, capped = {s: i % 3 + 1 for i, s in enumerate(order)}, sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in sizes if s not in capped)
        now = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / free for s in sizes}
        over = {s for s in sizes if s not in capped and now[s] > 3 * sizes[s]}
        if not over:
            return now
        capped |= over


def test_mixing(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(["w"] * rng.choice([1, 5, 9, 40, 300])), rng.choices(["a", "b", None, "é", "tiny", "zero"], [70, 20, 10, 10, 1, 3])[0]) for i in range(500)]
    rows = [(i, None if s == "zero" else t, s) for i, t, s in rows] + [(600, "", "a"), (601, None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, size string")
    out = mixing.mix(df).collect()
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(df.repartition(5)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in out} and len(out) == len(rows)
    sizes, taken = Counter(), Counter()
    for r in out:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
    goal = water(sizes)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and np.isclose(r["target"], goal[r["source"]])
    assert all(abs(taken[s] - goal[s]) <= 5 for s in sizes), (taken, goal)
    assert mixing.mix(empty_docs(spark)).count() == 0


def test_mixing_takes_repeated_rows_in_turns(spark):
    rows = [(i, f"text {i} " + "w " * (i % 7), "ab"[i % 2]) for i in range(40)] + [(7, "w " * 30_000, "a"), (None, "no id", "c"), (3, "another text", "b")] + [(50, "the same row", "a")] * 9
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, copies string")
    mixed = Counter()
    for r in mixing.mix(df).collect():
        mixed[r["doc_id"], r["source"], r["size"]] += r["copies"]
    got = Counter((r["doc_id"], r["source"], len(r["text"].split())) for r in mixing.taken_rows(df).collect())
    assert got == +mixed and mixing.taken_rows(empty_docs(spark)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 5), min_size=1, max_size=6), st.integers(0, 200))
def test_knapsack(counts, budget):
    sums = {0}
    for size, n in counts.items():
        sums = {s + k * size for s in sums for k in range(n + 1)}
    got = mixing.knapsack(sorted((s, n) for s, n in counts.items() if s <= budget), budget) if budget else {}
    assert all(n <= counts[s] for s, n in got.items())
    assert sum(s * n for s, n in got.items()) == max(s for s in sums if s <= budget)
