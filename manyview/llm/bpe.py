"""Byte-level BPE encoding and decoding as a monoid tree reduction (operator 1).

A text is halved until a part is short. Parts are encoded by themselves and joined upwards. At each join only a window
around the boundary is encoded again, and it grows until what lies outside it is proved to be stable:

* Words (matches of the splitting pattern). A match ends where it did before if it and the two characters that a
  contraction looks ahead to lie inside the left part. Scanning starts at the first match for which that doesn't hold
  and stops at the first match end that the right part has too: the pattern never looks back, so from there on both
  scans agree.
* Tokens of a long word. Let t1..tn be tokens such that each neighbouring pair, encoded alone, gives back that pair. Up
  to the first merge across a boundary, the merges inside two neighbours come in the same order in the whole as in
  the pair alone, so a first merge across it in the whole would also happen in the pair. Hence t1..tn is the encoding
  of the whole. A window is wide enough as soon as both of its outer seams are such pairs.

Defined results: a null text is the empty text; an empty text has no tokens; repeated rows each give a row; columns other
than the id and the text are not read.
"""

from __future__ import annotations

import base64
import heapq
import re
import sys
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyview.llm.common import in_modest_batches, table

NONE = 1 << 60
LEAF_CHARS = 16_384
LEAF_BYTES = 24
SHORT = 64
CACHED_WORDS, CACHED_PAIRS = 300_000, 100_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _classes() -> tuple[str, str, str]:
    """Letters, numbers and white space as ranges for `re`, whose own classes differ from the Unicode ones."""
    found: dict[str, list[list[int]]] = {"L": [], "N": []}
    for point in range(sys.maxunicode + 1):
        if (runs := found.get(unicodedata.category(chr(point))[0])) is not None:
            if runs and runs[-1][1] == point - 1:
                runs[-1][1] = point
            else:
                runs.append([point, point])
    letters, numbers = ("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in found[k]) for k in "LN")
    return letters, numbers, r"\t-\r \x85\xa0  -     　"


def compiled(pattern: str) -> re.Pattern:
    """The splitting pattern for `re`: \\p{L}, \\p{N} and \\s written out."""
    letters, numbers, spaces = _classes()
    inside = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]")
    inside = inside.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    return re.compile(inside.replace(r"\S", f"[^{spaces}]").replace(r"\s", f"[{spaces}]"))


class Codec:
    """Encodes and decodes by a table of ranks. Ids are packed: little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.packed = {token: rank.to_bytes(4, "little") for token, rank in ranks.items()}
        self.split = compiled(pattern)
        self.words: dict[str, bytes] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}

    # --- one word -------------------------------------------------------------------------------------------------

    def merged(self, word: bytes) -> list[bytes]:
        """Merges the pair of the lowest rank, the leftmost of equals, until no pair has a rank."""
        if len(word) > SHORT:
            return self._merged_by_heap(word)
        rank, parts = self.ranks.get, [word[i : i + 1] for i in range(len(word))]
        scores = [rank(a + b, NONE) for a, b in zip(parts, parts[1:])]
        while scores and (least := min(scores)) != NONE:
            i = scores.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = rank(parts[i - 1] + parts[i], NONE)
            if i < len(scores):
                scores[i] = rank(parts[i] + parts[i + 1], NONE)
        return parts

    def _merged_by_heap(self, word: bytes) -> list[bytes]:
        n, rank = len(word), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(word[i : i + 2], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if j <= i or j >= n or end[j] != stop:  # one of the two has changed since
                continue
            end[i], end[j] = stop, -1
            if stop < n:
                before[stop] = i
                if (r := rank(word[i : end[stop]], NONE)) != NONE:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := rank(word[h:stop], NONE)) != NONE:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(word[i : end[i]])
            i = end[i]
        return out

    def stable(self, left: bytes, right: bytes) -> bool:
        """Whether the two tokens, encoded together, stay the two tokens."""
        if (known := self.pairs.get((left, right))) is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return known

    def joined(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The encoding of both parts' bytes, from their encodings."""
        width = 1
        while True:
            a, b = max(len(left) - width, 0), min(width, len(right))
            window = self.merged(b"".join(left[a:] + right[:b]))
            if (not a or self.stable(left[a - 1], window[0])) and (b == len(right) or self.stable(window[-1], right[b])):
                return left[:a] + window + right[b:]
            width *= 2

    def tree(self, word: bytes) -> list[bytes]:
        if len(word) <= LEAF_BYTES:
            return self.merged(word)
        half = len(word) // 2
        return self.joined(self.tree(word[:half]), self.tree(word[half:]))

    def word(self, word: str) -> bytes:
        """The packed ids of one match of the splitting pattern; a word that has a rank itself is one token."""
        if (out := self.words.get(word)) is None:
            raw = word.encode("utf-8", "surrogatepass")
            out = self.packed.get(raw)
            if out is None:
                packed = self.packed
                out = b"".join([packed[t] for t in self.tree(raw)])
            if len(word) <= LEAF_BYTES:
                if len(self.words) >= CACHED_WORDS:
                    self.words.clear()
                self.words[word] = out
        return out

    # --- a text ---------------------------------------------------------------------------------------------------

    def _leaf(self, text: str) -> tuple[list[str], bytes]:
        found, known = self.split.findall(text), self.words.get
        return found, b"".join([known(w) or self.word(w) for w in found])

    def encode(self, text: str) -> bytes:
        if len(text) <= LEAF_CHARS:
            return self._leaf(text)[1]
        return self._span(text, 0, len(text))[1]

    def _span(self, text: str, low: int, high: int) -> tuple[list[int], bytes]:
        """Where the words of text[low:high] end, and their packed ids."""
        if high - low <= LEAF_CHARS:
            found, ids = self._leaf(text[low:high])
            return list(accumulate(map(len, found), initial=low))[1:], ids
        middle = (low + high) // 2
        (ends, ids), (more, other) = self._span(text, low, middle), self._span(text, middle, high)
        keep = len(ends)
        while keep and (ends[keep - 1] >= middle or (ends[keep - 2] if keep > 1 else low) + 3 > middle):
            keep -= 1
        start = ends[keep - 1] if keep else low
        dropped = sum(len(self.word(text[a:b])) for a, b in zip([start, *ends[keep:]], ends[keep:]))
        at, window, fresh, skip = start, [], [], 0
        while at < high:
            at, before = self.split.match(text, at, high).end(), at
            window.append(self.word(text[before:at]))
            fresh.append(at)
            if at >= middle and (at == middle or more[skip := bisect_left(more, at)] == at):
                break
        skip = 0 if at == middle else skip + 1
        gone = sum(len(self.word(text[a:b])) for a, b in zip([middle, *more[:skip]], more[:skip]))
        return ends[:keep] + fresh + more[skip:], b"".join([ids[: len(ids) - dropped], *window, other[gone:]])

    def decode(self, ids: bytes) -> bytes:
        """The bytes of packed ids: halves are decoded and concatenated."""
        if len(ids) <= 1 << 18:
            return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))
        half = len(ids) // 8 * 4
        return self.decode(ids[:half]) + self.decode(ids[half:])


_OF_WORKER: dict[str, Codec] = {}


def _codec(name: str, ranks: dict[bytes, int], pattern: str) -> Codec:
    """One codec, with its cache of words, for all tasks of a Python worker."""
    if name not in _OF_WORKER:
        _OF_WORKER[name] = Codec(ranks, pattern)
    return _OF_WORKER[name]


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the id, n_tokens, token_ids (packed ids) and decoded (the bytes that they stand for).

    vocabulary is the path of a rank file; the driver reads it and broadcasts the table, whose size the file fixes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocabulary, shared.value, pattern)
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                ids = [codec.encode(text) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(codec.decode, ids), pa.binary())],
                    ["id", "n_tokens", "token_ids", "decoded"],
                )

    kind = docs.schema[id_column].dataType.simpleString()
    rows = in_modest_batches(docs).select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, token_ids binary, decoded binary").withColumnRenamed("id", id_column)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: how many tokens, and digests of the ids and of the decoded bytes."""
    import public_tokenizers

    coded = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
