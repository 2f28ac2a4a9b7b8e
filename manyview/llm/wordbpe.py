"""BPE with word ends by speculation and verification (operator 12).

The longest token that fits is proposed again and again until a word is used up. Whether the proposal is what merging by rank
would give is decided for each two neighbours alone: merges inside two tokens come in the order of their ranks whatever
stands around them, so a whole word differs from the proposal only if some merge across the border of two proposed
tokens would come before a merge that one of the two still needs there. Such a merge joins a part that ends the left token
(its right spine) with one that starts the right token (its left spine), while both parts exist. All pairs of a batch are
checked together, in arrays; only words with a failing pair are merged exactly. Tokens that merging never gives are not
proposed. This holds for vocabularies in which a merged token has one rule and a higher rank than its parts; others are refused.

Defined results: a null text is the empty text, which has no tokens and decodes to the empty text; strings of special tokens
inside texts are those tokens, as in the library; repeated rows each give a row; columns other than the id and the text are
not read. Texts with code points that this Python's Unicode tables don't know are normalised and split by the library.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from manyview.llm.common import in_modest_batches, table

END = "\n"  # stands for the end of a word; no byte is written so
SUFFIX = "</w>"
NEVER = 1 << 40
LAST_OF_FIRST_PLANE = 0xFFFF
SHORT, CACHED_LETTERS, CACHED_WORDS, CACHED_PAIRS = 40, 64, 400_000, 2_000_000


def byte_letters() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself if it can be seen, else the next one free from 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(hidden)) for b in range(256)]


def ranges(kinds: tuple[str, ...], last: int) -> str:
    """The code points up to `last` whose category starts with one of `kinds`, as ranges for `re`."""
    points = [p for p in range(last + 1) if unicodedata.category(chr(p)).startswith(kinds)]
    starts = [p for i, p in enumerate(points) if not i or points[i - 1] != p - 1]
    ends = [p for i, p in enumerate(points) if i + 1 == len(points) or points[i + 1] != p + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends))


def unassigned(last: int) -> re.Pattern:
    """Code points that this Python's tables don't know."""
    return re.compile(f"[{ranges(('Cn',), last)}]")


def splitter(pattern: str, last: int) -> re.Pattern:
    """The splitting pattern for `re`, of texts with code points up to `last`: \\p{L}, \\p{N} and \\s written out."""
    inside = {"L": ranges(("L",), last), "N": ranges(("N",), last), "s": ranges(("Z",), last) + r"\t-\r\x85"}
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{inside['s']}{inside['L']}{inside['N']}]")
    for kind in "LN":
        out = out.replace(rf"[\p{{{kind}}}]", f"[{inside[kind]}]")
    return re.compile(out)


class Merges:
    """A vocabulary as numbers: what each token is made of, and what two tokens make."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        self.ids = {k.removesuffix(SUFFIX) + END if k.endswith(SUFFIX) else k: i for k, i in vocabulary.items()}
        size = 1 + max(vocabulary.values())
        self.size = size
        self.rank, self.parts = np.full(size, -1), np.full((size, 2), -1)
        self.made: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            left, right, whole = vocabulary[a], vocabulary[b], vocabulary[a.removesuffix(SUFFIX) + b]
            if self.rank[whole] >= 0 or max(self.rank[left], self.rank[right]) >= r:
                raise ValueError(f"token {whole} has two rules or comes before its parts")
            self.rank[whole], self.parts[whole] = r, (left, right)
            self.made[left, right] = (r, whole)
        keys = np.array([a * size + b for a, b in self.made], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array([r for r, _ in self.made.values()], np.int64)[order]
        self.right, self.right_until = self._spines(1)
        self.left, self.left_until = self._spines(0)
        self.proposed = {k: i for k, i in self.ids.items() if len(k) == 1 or self.exact(k) == [i]}
        self.starts = {k[:n] for k in self.proposed for n in range(1, len(k) + 1)}

    def _spines(self, side: int) -> tuple[np.ndarray, np.ndarray]:
        """By token and depth: the part of it at one end, and the rank of the merge that takes this part up."""
        now, until = np.arange(self.size), np.full(self.size, NEVER)
        parts, limits = [], []
        while (now >= 0).any():
            parts.append(now)
            limits.append(until)
            until = np.where(now >= 0, self.rank[now], -1)
            now = np.where(now >= 0, self.parts[now, side], -1)
        return np.stack(parts, 1), np.stack(limits, 1)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each two neighbours whether they stay as they are. Of equal ranks the merge further left comes first, so one in
        the left token keeps its place before the one across, and one in the right token does not."""
        good = np.ones(len(a), bool)
        for i in range(self.right.shape[1]):
            at = np.flatnonzero(good & (self.right[a, i] >= 0))
            for j in range(self.left.shape[1]):
                at = at[self.left[b[at], j] >= 0]
                if not len(at):
                    break
                key = self.right[a[at], i] * self.size + self.left[b[at], j]
                place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                rank = np.where(self.keys[place] == key, self.ranks[place], NEVER)
                good[at[(rank < self.right_until[a[at], i]) & (rank <= self.left_until[b[at], j])]] = False
        return good

    def letters(self, word: str) -> list[int]:
        """The tokens of a word's single bytes; the last has the word's end."""
        ids = self.ids
        return [ids[c] for c in word[:-2]] + [ids[word[-2:]]] if word.endswith(END) else [ids[c] for c in word]

    def exact(self, word: str) -> list[int]:
        """Merges the pair of the lowest rank, the leftmost of equals, until no pair has a rule."""
        tokens, made = self.letters(word), self.made
        if len(tokens) > SHORT:
            return self._by_heap(tokens)
        while len(tokens) > 1:
            rank, i = min((made.get(pair, (NEVER,))[0], i) for i, pair in enumerate(zip(tokens, tokens[1:])))
            if rank == NEVER:
                break
            tokens[i : i + 2] = [made[tokens[i], tokens[i + 1]][1]]
        return tokens

    def _by_heap(self, tokens: list[int]) -> list[int]:
        made, n = self.made, len(tokens)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(made[pair][0], i, *pair) for i, pair in enumerate(zip(tokens, tokens[1:])) if pair in made]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or tokens[i] != a or tokens[j] != b:  # one of the two has changed since
                continue
            tokens[i], tokens[j], after[i] = made[a, b][1], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (rule := made.get((tokens[x], tokens[y]))):
                    heapq.heappush(heap, (rule[0], x, tokens[x], tokens[y]))
        return [t for t in tokens if t >= 0]

    def proposal(self, word: str) -> list[int]:
        """The longest token that fits, again and again; empty if that leaves the word's end alone or finds none."""
        out, i, n = [], 0, len(word)
        starts, proposed = self.starts, self.proposed
        while i < n:
            j, best, end = i + 1, None, i
            while j <= n and (part := word[i:j]) in starts:
                if j != n - 1 and (token := proposed.get(part)) is not None:
                    best, end = token, j
                j += 1
            if best is None:
                return []
            out.append(best)
            i = end
        return out


class Codec:
    """Encodes and decodes as the library does with a vocabulary file. Ids are packed as little-endian 32-bit integers."""

    def __init__(self, content: str):
        spec = json.loads(content)
        self.merges = Merges(spec["model"]["vocab"], [tuple(x) for x in spec["model"]["merges"]])
        self.library = Tokenizer.from_str(content)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.tokens = {i: k for k, i in (spec["model"]["vocab"] | self.special).items()}
        split = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        # `re` is slow in classes that reach beyond the first plane, so most texts have patterns of their own.
        self.split, self.unknown = ([f(*x, last) for last in (LAST_OF_FIRST_PLANE, sys.maxunicode)] for f, x in ((splitter, (split,)), (unassigned, ())))
        self.beyond, self.spaces = re.compile("[\U00010000-\U0010ffff]"), re.compile(r"[^\S\x1c-\x1f]+")
        self.written = {i: c for i, c in enumerate(byte_letters())}
        self.words: dict[str, bytes] = {}
        self.pairs, self.verdicts = np.zeros(0, np.int64), np.zeros(0, bool)
        self.failed = self.seen = 0

    def split_text(self, text: str) -> list[str]:
        """The words of a text, and special tokens as they are."""
        out = []
        for i, part in enumerate(self.cut.split(text)) if "<|" in text else [(0, text)]:
            if i % 2:
                out.append(part)
                continue
            far = 0 if part.isascii() or not self.beyond.search(part) else 1
            if not part.isascii() and self.unknown[far].search(part):
                back = {c: b for b, c in self.written.items()}
                found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                out += [bytes(back[c] for c in w).decode("utf-8") for w, _ in found]
            else:
                plain = part if part.isascii() else unicodedata.normalize("NFC", part)
                out += self.split[far].findall(self.spaces.sub(" ", plain).replace("Σ", "σ").lower())
        return out

    def _verified(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """compatible() of the pairs, each pair once; verdicts are kept for later batches."""
        keys, place = np.unique(a * self.merges.size + b, return_inverse=True)
        at = np.searchsorted(self.pairs, keys)
        known = at < len(self.pairs)
        known[known] = self.pairs[at[known]] == keys[known]
        good = np.zeros(len(keys), bool)
        good[known] = self.verdicts[at[known]]
        fresh = keys[~known]
        good[~known] = self.merges.compatible(fresh // self.merges.size, fresh % self.merges.size)
        if len(self.pairs) + len(fresh) <= CACHED_PAIRS:
            both = np.concatenate([self.pairs, fresh])
            order = np.argsort(both, kind="stable")
            self.pairs, self.verdicts = both[order], np.concatenate([self.verdicts, good[~known]])[order]
        return good[place]

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """The packed ids of each word: proposals of all of them, one check of all neighbours, exact merges where it fails."""
        merges, words = self.merges, list(words)
        spelled = [w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.written) + END for w in words]
        proposals = [merges.proposal(w) for w in spelled]
        sizes = np.array([len(p) for p in proposals], np.int64)
        flat = np.fromiter((t for p in proposals for t in p), np.int64, sizes.sum())
        owner = np.repeat(np.arange(len(words)), sizes)
        inner = owner[1:] == owner[:-1]
        failed = sizes == 0
        failed[owner[1:][inner][~self._verified(flat[:-1][inner], flat[1:][inner])]] = True
        self.seen, self.failed = self.seen + len(words), self.failed + int(failed.sum())
        for i in np.flatnonzero(failed):
            proposals[i] = merges.exact(spelled[i])
        return {w: np.array(p, "<i4").tobytes() for w, p in zip(words, proposals)}

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        split = [self.split_text(t) for t in texts]
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        fresh = set().union(*split).difference(self.words)
        of = {k: i.to_bytes(4, "little") for k, i in self.special.items()}
        found = self.encode_words(fresh.difference(of)) | of
        self.words |= {w: ids for w, ids in found.items() if len(w) <= CACHED_LETTERS}
        lookup = self.words | found if any(len(w) > CACHED_LETTERS for w in fresh) else self.words
        return [b"".join(map(lookup.__getitem__, words)) for words in split]

    def decode(self, ids: bytes) -> str:
        """The tokens with a space between; the file has no decoder of its own."""
        return " ".join(map(self.tokens.__getitem__, memoryview(ids).cast("i")))


_OF_WORKER: dict[int, Codec] = {}


def encode_decode(docs: DataFrame, content: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the id, token_ids (array of int) and decoded (the text that they stand for).

    content: a vocabulary file's text, of fixed size, which is broadcast; each Python worker builds its tables once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shared.value)
        if key not in _OF_WORKER:
            _OF_WORKER[key] = Codec(shared.value)
        codec = _OF_WORKER[key]
        for batch in batches:
            ids = codec.encode_batch(batch.column(1).to_pylist())
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(map(codec.decode, ids), pa.string())], ["id", "token_ids", "decoded"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = in_modest_batches(docs).select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, token_ids array<int>, decoded string").withColumnRenamed("id", id_column)


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: how many tokens, and digests of the ids and of the decoded text."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        coded = encode_decode(table(spark, sf_dir, "documents"), file.read())
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
