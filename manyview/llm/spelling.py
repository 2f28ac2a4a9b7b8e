"""Spelling variant grouping by a rare-first prefix filter on positional bigrams (operator 11).

Two words are near if one inserted, deleted or replaced code point turns one into the other. Bigrams are ordered by their
frequency over all words, the rarest first, and by their place. One edit leaves all but two of a word's bigrams as they are, and in
the same order; so the first of those that near words share has two others before it at most, and is among the three
rarest of both. It lies wholly before or wholly behind the edit: either the words agree from their start to its end, or from its place to their end. Of
what is left on the side of the edit, one half agrees as well. That part of the word, the half and the length are the key of an
equi-join, which limits the bigram's position to the one that an edit allows; Levenshtein's distance decides about each pair that meets.

How many bigrams there are follows from the letters that words have, not from the words: at most the square of 90.
Words of a form are followed to the root by doubling: a form has ten times the occurrences of its word, so chains are short.

Defined results: null and empty texts have no words; a null id counts as an empty one; repeated rows count again, with the same
words; of equally frequent near words the smallest in code-point order is the form; an empty table gives no rows;
columns other than the id and the text are not read; a word may have any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from manyview.llm.common import ascii_lower, table
from manyview.session import cut

LEAST_LENGTH, LEAST_COUNT, SPOILED_BY, RATIO = 7, 2, 31, 10
LETTERS = "A-Za-zÀ-ÿ"
#: Bigrams that one edit can't all spoil.
RAREST = 3


def words_of(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, n): all words of the documents, those that a rule spoils among them, by their number of occurrences.

    The lower-cased run whose checksum SPOILED_BY divides loses one code point, as a made-up misspelling.
    """
    runs = F.regexp_extract_all(F.col(text_column), F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    lower = found.select("id", ascii_lower(F.col("run")).alias("run"))
    summed = lower.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    spoiled = F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))
    word = F.when(F.col("h") % SPOILED_BY == 0, spoiled).otherwise(F.col("run"))
    words = summed.withColumn("at", at).select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def rarest_bigrams(words: DataFrame) -> DataFrame:
    """(id, pos): where the RAREST bigrams of each word start (from 0); of equal ones, the first.

    words: (id, word). The table of bigrams is bounded by the letters, and is sent to all tasks.
    """
    letters, n = F.split("word", ""), F.length("word")
    pairs = F.zip_with(F.slice(letters, F.lit(1), n - 1), F.slice(letters, F.lit(2), n - 1), lambda x, y: F.concat(x, y))
    grams = words.select("id", F.posexplode(pairs).alias("pos", "gram"))
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    ranked = grams.join(F.broadcast(often), "gram").select("id", F.struct("often", "gram", "pos").alias("g"))
    listed = ranked.groupBy("id").agg(F.slice(F.sort_array(F.collect_list("g")), 1, RAREST).alias("grams"))
    return listed.select("id", F.explode("grams.pos").alias("pos"))


def _keys(words: DataFrame, places: DataFrame) -> DataFrame:
    """(key, role, word): what a word shares with a near one, for each rare bigram and in each role.

    Roles: one of two words of equal length (0), the shorter (1) or the longer (2) of two that differ by one code point. The edit
    lies behind the bigram (sides 0 and 1) or before it (2 and 3). What is left there is cut into halves, at the same place in
    both words as the shorter one's length decides it; one of the halves is the same in both, counted from its outer end.
    """
    roles = F.array(*[F.struct(F.lit(role).alias("role"), F.lit(more).alias("more"), F.lit(grown).alias("grown")) for role, more, grown in ((0, 0, 0), (1, 1, 1), (2, 1, 0))])
    each = words.join(places, "id").withColumn("r", F.explode(roles)).select("word", "pos", "r.role", "r.more", (F.length("word") + F.col("r.grown")).alias("length"), F.length("word").alias("size"))
    least = F.col("length") - F.col("more")  # the shorter word's
    parted = each.withColumn("behind", least - F.col("pos") - 2).withColumn("before", least - F.col("size") + F.col("pos"))
    start, end = F.expr("substring(word, 1, pos + 2)"), F.expr("substring(word, pos + 1)")

    def key(side: int, room: str, *parts: Column) -> Column:
        return F.when(F.col(room) >= 0, F.xxhash64(F.lit(side), "more", "length", *parts))

    keys = F.array(
        key(0, "behind", start, F.expr("substring(word, pos + 3, behind div 2)")),
        key(1, "behind", start, F.expr("right(word, cast(behind - behind div 2 as int))")),
        key(2, "before", end, F.expr("substring(word, cast(pos + 1 - before div 2 as int), before div 2)")),
        key(3, "before", end, F.expr("substring(word, 1, cast(before - before div 2 as int))")),
    )
    return parted.select("word", "role", F.explode(keys).alias("key")).where(F.col("key").isNotNull())


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b): all pairs of near words, once, in one of the two orders. words: (id, word), distinct and cut.

    Words that share a key agree in all but a part of a half; where still many do, Spark splits the skewed join. Only
    key and word travel: the key tells words of one length (which meet themselves) from those of neighbouring lengths.
    """
    keys = _keys(words, rarest_bigrams(words))
    left = keys.where("role < 2").select("key", F.col("word").alias("a"))
    right = keys.where("role <> 1").select("key", F.col("word").alias("b"))
    once = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
    return left.join(right, "key").where(once & (F.levenshtein("a", "b", 1) == 1)).select("a", "b").distinct()


def variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each row of words: (word, n)."""
    known = cut(words.withColumn("id", F.monotonically_increasing_id()))
    pairs = near_pairs(known.select("id", "word"))
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = known.select(F.col("word").alias("b"), F.col("n").alias("near_n"))
    best = both.join(other, "b").groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("b").alias("near"))).alias("best"))
    joined = known.join(best.withColumnRenamed("a", "word"), "word", "left")
    chosen = -F.col("best.minus") >= RATIO * F.col("n")
    formed = cut(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("best.near")).alias("form"), F.when(chosen, -F.col("best.minus")).alias("form_n")))
    return formed.join(_roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(formed: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form; each round doubles the part of a chain that is followed."""
    links = formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    most = formed.agg(F.max("n")).first()[0] or 1
    steps = 1
    while RATIO ** steps <= most:  # a chain has at most as many steps as the largest count has digits
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = cut(links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
        steps *= 2
    return links


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of all documents with their forms and roots."""
    return variants(words_of(table(spark, sf_dir, "documents")))


#: Checksums by the usual table of 256 entries; near words meet by what one deletion leaves of them.
OP11_SQL = r"""
WITH RECURSIVE bit(i, k, c) AS (
  SELECT i, 0, i FROM range(256) AS t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bit WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bit WHERE k = 8),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
each AS (SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS named, count(*) AS times FROM runs WHERE length(run) >= 7 GROUP BY ALL),
bytes AS (SELECT run, times, list_transform(range(strlen(named)), lambda i: ('0x' || hex(encode(named))[2 * i + 1:2 * i + 2])::BIGINT) AS b FROM each),
summed AS (SELECT run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS h FROM bytes, crc),
spelled AS (SELECT times, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM summed),
words AS (SELECT word, sum(times)::BIGINT AS n FROM spelled WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
cuts AS (SELECT word, n, i, substr(word, 1, (i - 1)::INT) || substr(word, (i + 1)::INT) AS rest FROM words, unnest(range(1, length(word) + 1)) AS u(i)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
ranked AS (SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, encode(other)) AS r FROM near),
formed AS (SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.m >= 10 * w.n THEN r.other END AS form, CASE WHEN r.m >= 10 * w.n THEN r.m END AS form_n
  FROM words w LEFT JOIN (SELECT * FROM ranked WHERE r = 1) r ON r.word = w.word),
chain(word, place, k) AS (SELECT word, word, 0 FROM formed UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN formed f ON f.word = c.place WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(place, k) AS root FROM chain GROUP BY word)
SELECT f.word, f.form, r.root, f.n, f.n_near::BIGINT AS n_near, f.form_n FROM formed f JOIN roots r USING (word)
"""
