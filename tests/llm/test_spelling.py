"""Spelling variants against all pairs of words, and on odd rows."""

import random
import re
import zlib
from collections import Counter

from manyview.llm import spelling


def words_by_force(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def variants_by_force(n):
    out, form = {}, {}
    for w in n:
        found = [v for v in n if near(w, v)]
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if found and n[best] >= 10 * n[w] else None
        out[w] = len(found)
    rows = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n[w], out[w], n.get(form[w])))
    return rows


def rows_of(df):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]


def test_variants_equal_all_pairs(spark):
    draw = random.Random(5)
    n = Counter()
    for _ in range(150):  # families of close words over few letters, so that bigrams repeat, tie and stand at both ends
        word = "".join(draw.choices("abé÷", k=draw.randint(7, 11)))
        for _ in range(6):
            i, how = draw.randrange(len(word)), draw.randrange(3)
            word = [word[:i] + word[i + 1 :], word[:i] + "b" + word[i:], word[:i] + "a" + word[i + 1 :]][how]
            if len(word) >= 7:
                n[word] = draw.choice([2, 3, 20, 30, 300, 4000])
    n |= {"aaaaaaa": 2, "aaaaaaaa": 20, "aaaaaaaaa": 200, "aaaaaaaaaa": 2000, "aaaaaaab": 200}
    got = rows_of(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert len(got) == len(n) and set(got) == variants_by_force(n)
    assert any(r[1] != r[2] and r[1] for r in got)


def test_documents_with_odd_rows(spark):
    long = "abcdefgh" * 1_000
    rows = [(i, f"{'Zeitung' if i % 5 else 'Zeitungen'} L'ÉQUIPE1demain{'e' * (i % 3)} ohne ×÷×÷×÷×") for i in range(200)]
    rows += [(None, "ZEITUNG zeitung"), (None, None), (3, ""), (3, ""), (900, f"{long} {long} {long}x"), (901, f"x {long}x")] + rows[:1]
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int")
    got = rows_of(spelling.variants(spelling.words_of(docs)))
    assert len(got) == len(set(got)) and set(got) == variants_by_force(words_by_force(rows))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert rows_of(spelling.variants(spelling.words_of(empty))) == []
