"""Language identification by segmentation-marginalised unigrams (operator 7).

The pieces are those of a fixed public vocabulary that are letters only. Each language has a probability for each piece.
The probability of a word is the sum over all its segmentations into pieces, by the forward algorithm; that of a text is
the product over its words. Piece probabilities are fitted by expectation maximisation, whose expected counts also sum
over all segmentations. The fit reads `per_language` labelled documents of each of the MOST_LANGUAGES most frequent languages, those
with the smallest hashes, copies once; both bounds are parameters, and all else reads all documents.

Defined results: words are runs of letters (\\p{L}) of the lower-cased text; a null text or one without letters is `und` with score 0; letters
that no piece has get a small floor probability in each language; languages tie to the first by code point; without a
labelled document all is `und`; rows that share a doc_id are each judged; columns other than doc_id, text and, for
training, lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from manyview.llm.common import in_modest_batches, table

PER_LANGUAGE, MOST_LANGUAGES = 400, 200
ROUNDS = 3
FLOOR = 1e-7
UNKNOWN = "und"
CACHED_WORDS = 200_000
_LETTERS = regex.compile(r"\p{L}+")
_FACTOR = 0x9E3779B97F4A7C15


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall((text or "").lower())


def pieces_of(tokens: list[bytes]) -> list[str]:
    """The lower-cased letters-only strings among a vocabulary's tokens, sorted."""
    found = set()
    for token in tokens:
        try:
            piece = token.decode().strip().lower()
        except UnicodeDecodeError:
            continue
        if piece.isalpha():
            found.add(piece)
    return sorted(found)


def _codes(points: np.ndarray, length: int) -> list[np.ndarray]:
    """For each piece length up to `length`, a code of the characters that start at each position."""
    with np.errstate(over="ignore"):
        out, code = [], np.zeros(points.shape, np.uint64)
        for i in range(length):
            width = points.shape[1] - i
            code = code[:, :width] * np.uint64(_FACTOR) + points[:, i : i + width] + np.uint64(1)
            out.append(code)
    return out


def _points(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row for each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1).astype(np.uint64)


@dataclass
class Model:
    """codes: of the pieces, sorted; probabilities: of each piece in each language, in that order; longest: letters of a piece."""

    languages: list[str]
    codes: np.ndarray
    probabilities: np.ndarray
    longest: int

    def ids(self, points: np.ndarray) -> list[np.ndarray]:
        """Piece numbers of each length at each position; one past the last piece where there is none."""
        out = []
        for code in _codes(points, min(self.longest, points.shape[1])):
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            out.append(np.where(self.codes[at] == code, at, len(self.codes)))
        return out

    def forward(self, points: np.ndarray) -> np.ndarray:
        """Log probability of each word (words of one length) in each language."""
        n, size = points.shape
        ids = self.ids(points)
        alpha = [np.ones((n, len(self.languages)))]
        scale = np.zeros((n, len(self.languages)))
        for end in range(1, size + 1):
            total = 0.0
            for length in range(1, min(self.longest, end) + 1):
                chance = self.probabilities[ids[length - 1][:, end - length]]
                if length == 1:
                    chance = np.maximum(chance, FLOOR)
                total = total + alpha[-length] * chance
            alpha.append(total)
            if end % 12 == 0:  # each language by itself: what one gives to a very long word may be far below all others
                alpha = [a / total for a in alpha[-self.longest :]]
                scale += np.log(total)
        return np.log(alpha[-1]) + scale


def by_length(words: list[str], most: int = 4000) -> Iterator[list[int]]:
    """Positions of words of one length at a time."""
    if not words:
        return
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        step = max(1, most * 12 // max(1, int(sizes[group[0]])))
        for low in range(0, len(group), step):
            yield group[low : low + step].tolist()


def expected(model: Model, words: list[str], times: np.ndarray) -> np.ndarray:
    """How often each piece is expected over all segmentations, for a model of one language."""
    counts = np.zeros(len(model.codes) + 1)
    for group in by_length(words):
        points, weight = _points([words[i] for i in group]), times[group]
        ids, size = model.ids(points), points.shape[1]
        chance = [np.maximum(model.probabilities[i, 0], FLOOR) if k == 0 else model.probabilities[i, 0] for k, i in enumerate(ids)]
        ahead, behind = np.zeros((size + 1, len(group))), np.zeros((size + 1, len(group)))
        ahead[0] = behind[size] = 1
        for end in range(1, size + 1):
            for k in range(min(len(ids), end)):
                ahead[end] += ahead[end - k - 1] * chance[k][:, end - k - 1]
        for start in range(size - 1, -1, -1):
            for k in range(min(len(ids), size - start)):
                behind[start] += behind[start + k + 1] * chance[k][:, start]
        for k in range(len(ids)):
            for start in range(size - k):
                share = ahead[start] * chance[k][:, start] * behind[start + k + 1] / ahead[size]
                np.add.at(counts, ids[k][:, start], share * weight)
    return counts[:-1]


def fit_language(words: list[str], times: np.ndarray, codes: np.ndarray, longest: int, rounds: int = ROUNDS, smoothing: float = 0.1) -> np.ndarray:
    """Probabilities of the pieces from a language's words. Words over 60 letters, whose sums could underflow, go by parts."""
    cut = [(w[i : i + 60], t) for w, t in zip(words, times) for i in range(0, len(w), 60)]
    words, times = [w for w, _ in cut], np.array([t for _, t in cut], float)
    chances = np.full((len(codes) + 1, 1), 1 / max(1, len(codes)))
    chances[-1] = 0
    for _ in range(rounds):
        counts = expected(Model([""], codes, chances, longest), words, times) + smoothing
        chances[:-1, 0] = counts / counts.sum()
    return chances[:-1, 0]


def sampled(labelled: DataFrame, per_language: int, most_languages: int) -> DataFrame:
    """(lang, text) of at most per_language different documents of each of the most frequent languages.

    Counts of different documents set a threshold on hashes that about twice as many pass; only these are ranked, so that no task gets all
    documents of a language.
    """
    some = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    hashed = some.select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    counts = hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
    share = F.least(F.lit(1.0), (2 * per_language + 100) / F.col("n"))
    # At most most_languages rows:
    few = hashed.join(F.broadcast(counts.select("lang", (share * 2**30).cast("long").alias("below"))), "lang").where(F.pmod("h", F.lit(2**30)) < F.col("below"))
    once = few.groupBy("lang", "h").agg(F.first("text").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(2**30)), "h")
    return once.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_language).select("lang", "text")


def train(labelled: DataFrame, tokens: list[bytes], per_language: int = PER_LANGUAGE, most_languages: int = MOST_LANGUAGES) -> Model:
    """Fits the model to a sample of documents (doc_id, text, lang)."""
    spark = labelled.sparkSession
    pieces = pieces_of(tokens)
    longest = max(map(len, pieces), default=1)
    codes = np.array([int(_codes(_points([p]), len(p))[len(p) - 1][0, 0]) for p in pieces], np.uint64)
    codes.sort()
    sample = sampled(labelled, per_language, most_languages)
    shared = spark.sparkContext.broadcast(codes)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [(lang, word) for lang, text in zip(batch["lang"], batch["text"]) for word in words_of(text)]
            yield pd.DataFrame(parts, columns=["lang", "word"]).value_counts().rename("times").reset_index()

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        chances = fit_language(group["word"].tolist(), group["times"].to_numpy(), shared.value, longest)
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "chances": [chances]})

    counted = sample.mapInPandas(split, "lang string, word string, times long").groupBy("lang", "word").agg(F.sum("times").alias("times"))
    # A row for each of at most most_languages languages, of a length that the vocabulary fixes.
    fitted = sorted(counted.groupBy("lang").applyInPandas(fit, "lang string, chances array<double>").collect())
    table_ = np.zeros((len(codes) + 1, len(fitted)))
    for k, row in enumerate(fitted):
        table_[:-1, k] = row["chances"]
    return Model([row["lang"] for row in fitted], codes, table_, longest)


class Scorer:
    """Log probabilities of words, kept for the words seen last."""

    def __init__(self, model: Model):
        self.model, self.at = model, {}
        self.logs = np.zeros((1024, len(model.languages)))

    def learn(self, words: list[str]) -> None:
        new = list({w for w in words if w not in self.at})
        if len(self.at) + len(new) > CACHED_WORDS:
            self.at.clear()
            new = list(set(words))
        low = len(self.at)
        if low + len(new) > len(self.logs):
            self.logs = np.resize(self.logs, (max(2 * len(self.logs), low + len(new)), self.logs.shape[1]))
        for group in by_length(new):
            self.logs[[low + i for i in group]] = self.model.forward(_points([new[i] for i in group]))
        self.at.update(zip(new, range(low, low + len(new))))

    def judge(self, texts: list[str | None]) -> list[tuple[str, float]]:
        split = [words_of(text) for text in texts]
        if not self.model.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        self.learn([w for words in split for w in words])
        out = []
        for words in split:
            if not words:
                out.append((UNKNOWN, 0.0))
                continue
            total = self.logs[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))].sum(axis=0)
            best = int(total.argmax())
            out.append((self.model.languages[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """lang_pred and score of each row, after the columns `keep` (only doc_id if not given); score: the posterior of the
    language, each being as likely before. Kept columns named lang_pred or score are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in (keep or ["doc_id"]) if c not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for low in range(0, batch.num_rows, 250):
                part = batch.slice(low, 250)
                names, scores = zip(*scorer.judge(part.column(len(kept)).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*kept, "lang_pred", "score"])

    rows = in_modest_batches(docs).select(*kept, F.col("text").alias("judged_text"))
    schema = StructType([*rows.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from; a null doc_id is one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def vocabulary(path: str) -> list[bytes]:
    from manyview.llm.bpe import read_ranks

    return list(read_ranks(path))


def default_model(docs: DataFrame) -> Model:
    import public_tokenizers

    return train(docs.where(~held_out(F.col("doc_id"))), vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: the language of each, learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, default_model(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
