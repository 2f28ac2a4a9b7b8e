"""Cross-tokenizer alignment by pieces, blocks and shuffled counts (operator 13).

Tokens of both vocabularies have their ends summed to byte offsets; the offsets where both end cut them into groups, and all tokens
of a group are linked.

This is done for pieces of texts, each different piece of a block once. A piece begins with a space that follows a character other
than white space. Both vocabularies cut there whatever stands around: the splitting pattern of the byte-level one never takes such
a space with what is before it, and no piece of the other has a space behind another character. So a document's tokens, groups and
links are those of its pieces in order. For the same reason a few pieces are tokenized in one call; where they don't end at a cut,
or don't give back their bytes, each is tokenized by itself.

Tasks number the pieces of up to BLOCK_CHARS characters of texts as a block. First pass: what a document has by itself, how many of
the block's documents hold each id pair linked, and the pieces' tokens go to a table bucketed by block. Spark sums the counts by id
pair over all blocks, finds the highest of each A id, and joins them with the id pairs of each block. Second pass, by block: each
piece's links take their counts, each document its pieces. Links are never rows: only the id pairs of blocks are, and only they and
their counts are shuffled. The table of counts is sent to all tasks if it has MOST_SENT rows at most, else it is joined by
shuffling. Each step is written, so that lost executors cost a step's tasks, and the result is read from a table.

Defined results: null and empty texts, and those that a vocabulary can't give back (such as with the second one's own sign for
a space), have no tokens; each row is a document of its own, also where rows share a doc_id or repeat; an empty table gives no
rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from manyview.llm.common import in_modest_batches, scratch, table
from manyview.llm.wordbpe import byte_letters

#: Of texts in a block, whose pieces one task holds. Pieces that are aligned at once, and tokenized in one call; id pairs in a row.
BLOCK_CHARS, PIECES_AT_ONCE, PIECES_JOINED, PAIRS_AT_ONCE = 8_000_000, 10_000, 50, 50_000
#: Rows of counts that are broadcast, of 24 bytes each.
MOST_SENT = 1_000_000
SPACE = "▁"
LOW = (1 << 32) - 1
_UNEVEN = re.compile(r"\s |\A | \Z")


def pieces_of(text: str) -> list[str]:
    """The pieces of " " + text, each without the space that it begins with."""
    parts = text.split(" ")
    if not _UNEVEN.search(text):
        return parts
    out = [parts[0]]
    for i, part in enumerate(parts[1:], 1):
        if out[-1] and not out[-1][-1].isspace() and (part or i + 1 < len(parts)):
            out.append(part)
        else:
            out[-1] += " " + part
    return out


class Vocabulary:
    """encode gives the ids of " " + text for each text; tokens are the bytes of each id."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], tokens: list[bytes]):
        self.encode, self.tokens = encode, pa.array(tokens, pa.large_binary())
        self.sizes = np.array([len(x) for x in tokens], np.int64)


def vocabulary_first(content: str) -> Vocabulary:
    """A byte-level vocabulary file's text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are parallel
    from tokenizers import Tokenizer

    library, ids = Tokenizer.from_str(content), json.loads(content)["model"]["vocab"]
    library.encode_special_tokens = True
    letters, tokens = {c: b for b, c in enumerate(byte_letters())}, [b""] * (1 + max(ids.values()))
    for token, i in ids.items():
        tokens[i] = bytes(letters[c] for c in token) if letters.keys() >= set(token) else token.encode()
    return Vocabulary(lambda texts: [e.ids for e in library.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], tokens)


def vocabulary_second(path: str) -> Vocabulary:
    """A piece model, which adds the space."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    names = enumerate(model.id_to_piece(list(range(model.get_piece_size()))))
    tokens = [bytes([int(x[3:5], 16)]) if model.is_byte(i) else x.replace(SPACE, " ").encode() for i, x in names]
    return Vocabulary(lambda texts: model.encode(texts, num_threads=1), tokens)


def _joined(pieces: list[str]) -> Iterator[str]:
    """Pieces in texts of a few. One that ends with white space would hide the next one's start, so it is the last."""
    low = 0
    for i, piece in enumerate(pieces, 1):
        if i - low >= PIECES_JOINED or not piece or piece[-1].isspace() or i == len(pieces):
            yield " ".join(pieces[low:i])
            low = i


def _flat(ids: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(ids), np.int32)


def _joined_bytes(texts: pa.Array) -> pa.Buffer:
    """All texts of an array without offset, one behind another."""
    return texts.buffers()[2].slice(0, np.frombuffer(texts.buffers()[1], np.int64)[len(texts)]) if len(texts) else pa.py_buffer(b"")


def _cuts(sizes: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """From both sides' sizes of tokens in bytes: the offsets where tokens of both end, and each side's number of tokens up to them."""
    ends = [np.cumsum(x) for x in sizes]
    at = [np.zeros(1 + max([int(e[-1]) for e in ends if len(e)], default=0), bool) for _ in ends]
    for e, marks in zip(ends, at):
        marks[e] = True
    both = at[0] & at[1]
    return np.flatnonzero(both), [1 + np.flatnonzero(both[e]) for e in ends]


def _steps(upto: np.ndarray) -> np.ndarray:
    return np.diff(upto, prepend=0)


def aligned(pieces: list[str], both: tuple[Vocabulary, Vocabulary]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """How many groups each piece has (0: it has no tokens); both sides' ids; both sides' number of ids in each group."""
    raw = [b" " + p.encode() for p in pieces]
    ids = [_flat(v.encode(list(_joined(pieces)))) for v in both]
    stops, whole = np.cumsum([len(x) for x in raw]), pa.py_buffer(b"".join(raw))
    sound = np.ones(len(pieces), bool)
    cuts, upto = _cuts([v.sizes[x] for v, x in zip(both, ids)])
    if not (np.isin(stops, cuts, assume_unique=True).all() and all(_joined_bytes(v.tokens.take(pa.array(x))).equals(whole) for v, x in zip(both, ids))):
        each = [v.encode(pieces) for v in both]
        for k, x in enumerate(raw):
            sound[k] = all(b"".join(v.tokens.take(pa.array(s[k], pa.int32())).to_pylist()) == x for v, s in zip(both, each))
        ids = [_flat([x for x, there in zip(s, sound) if there]) for s in each]
        stops = np.cumsum([len(x) for x, there in zip(raw, sound) if there], dtype=np.int64)
        cuts, upto = _cuts([v.sizes[x] for v, x in zip(both, ids)])
    groups = np.zeros(len(pieces), np.int32)
    groups[sound] = _steps(1 + np.searchsorted(cuts, stops))
    return groups, ids, [_steps(x).astype(np.int32) for x in upto]


def _group_texts(groups: np.ndarray, ids: list[np.ndarray], sizes: list[np.ndarray], names: pa.Array) -> pa.Array:
    """Of each piece, its groups as text, each with a ; behind. names: of each id its digits, then followed by , and | and ;"""
    (na, nb), each = sizes, len(names) // 3
    ends = np.cumsum(na), np.cumsum(nb)
    words = np.empty(len(ids[0]) + len(ids[1]), np.int32)
    for side, (before, last) in enumerate(((ends[1] - nb, 1), (ends[0], 2))):
        marked = ids[side].copy()
        marked[ends[side] - 1] += last * each
        words[np.arange(len(marked)) + np.repeat(before, sizes[side])] = marked
    texts = names.take(pa.array(words))
    tokens = np.concatenate([[0], ends[0] + ends[1]])[np.concatenate([[0], np.cumsum(groups)])]
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[tokens] if len(texts) else np.zeros(len(groups) + 1, np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(groups), [None, pa.py_buffer(offsets.tobytes()), _joined_bytes(texts)])


def _names(tokens: int) -> pa.Array:
    return pa.array([f"{i}{mark}".encode() for mark in ",|;" for i in range(tokens)], pa.large_binary())


def links(groups: np.ndarray, ids: list[np.ndarray], sizes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different id pairs of each group, as numbers a << 32 | b, and how often each is linked there; up to where a piece has them."""
    each, starts, here = [], [], []
    for side, n in zip(ids, sizes):
        found, times = np.unique(np.repeat(np.arange(len(n)) << 32, n) | side, return_counts=True)
        here.append(np.bincount(found >> 32, minlength=len(n)))
        starts.append(np.cumsum(here[-1]) - here[-1])
        each.append((found & LOW, times))
    count = here[0] * here[1]
    upto = np.cumsum(count)
    group = np.repeat(np.arange(len(count)), count)
    k = np.arange(len(group)) - (upto - count)[group]
    i, j = starts[0][group] + k // here[1][group], starts[1][group] + k % here[1][group]
    (a, a_times), (b, b_times) = each
    return a[i] << 32 | b[j], a_times[i] * b_times[j], np.concatenate([[0], upto])[np.cumsum(groups)]


def _places(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different id pairs in the order in which they come first, and the place of each pair among them."""
    found = pa.array(np.concatenate([np.zeros(0, np.int64), *codes])).dictionary_encode()
    return np.asarray(found.dictionary), np.asarray(found.indices)


def _sums(values: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Of each run of values its sum; upto: where each ends, from 0."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], upto])])


def _spots(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _documents_with(pairs: int, place: np.ndarray, upto: np.ndarray, documents: list[np.ndarray]) -> np.ndarray:
    """How many documents hold each pair. place, upto: of the pieces' links; documents: the numbers of their pieces."""
    held, seen = np.zeros(pairs, np.int64), np.zeros(pairs, np.int64)
    starts, sizes = np.concatenate([[0], upto[:-1]]), _steps(upto)
    for numbers in documents:
        own = np.unique(numbers)
        there = place[_spots(starts[own], sizes[own])]
        order = np.arange(len(there))
        seen[there] = order
        held[there[seen[there] == order]] += 1
    return held


SUMS, PIECES = ["n_a", "n_b", "n_groups", "n_links"], ["a", "b", "a_sizes", "b_sizes", "groups"]
_OF_WORKER: dict[tuple[int, str], tuple] = {}


def _of_worker(content: str, path: str) -> tuple[tuple[Vocabulary, Vocabulary], pa.Array]:
    """Both vocabularies and the names of their ids, once for all tasks of a Python worker."""
    key = hash(content), path
    if key not in _OF_WORKER:
        both = vocabulary_first(content), vocabulary_second(path)
        _OF_WORKER[key] = both, _names(max(len(v.tokens) for v in both))
    return _OF_WORKER[key]


def first_pass(docs: DataFrame, first: str, second: str, id_column: str, text_column: str) -> DataFrame:
    """Rows of three kinds, each with a block. Documents: the id, SUMS, groups_sha256, numbers of their pieces in order. Pieces, in
    parts: PIECES. Pairs, in parts: codes, and how many of the block's documents hold each."""
    sent = docs.sparkSession.sparkContext.broadcast(first)

    def rows(n: int, block: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), *(columns.get(f.name, pa.nulls(n, f.type)) for f in shape)], ["block", *shape.names])

    def one(values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))

    def digest(texts: pa.Array, numbers: np.ndarray) -> str:
        out = hashlib.sha256()
        for low in range(0, len(numbers), PIECES_AT_ONCE):
            part = _joined_bytes(texts.take(pa.array(numbers[low : low + PIECES_AT_ONCE])))
            out.update(part.slice(0, part.size - (low + PIECES_AT_ONCE >= len(numbers))))  # no ; behind the last
        return out.hexdigest()

    def ended(block: int, known: dict[str, int], ids: list, documents: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        both, names = _of_worker(sent.value, second)
        pieces, texts, codes, upto, sums, at = list(known), [], [], [np.zeros(0, np.int64)], {c: [np.zeros(0, np.int64)] for c in SUMS}, 0
        for low in range(0, len(pieces), PIECES_AT_ONCE):
            groups, tokens, sizes = aligned(pieces[low : low + PIECES_AT_ONCE], both)
            yield rows(1, block, part=pa.array([low], pa.int32()), **{c: one(x) for c, x in zip(PIECES, [*tokens, *sizes, groups])})
            texts.append(_group_texts(groups, tokens, sizes, names))
            code, _, ends = links(groups, tokens, sizes)
            codes.append(code)
            upto.append(at + ends)
            at += len(code)
            n_a, n_b = (x.astype(np.int64) for x in sizes)
            for c, x in zip(SUMS, (n_a, n_b, np.ones(len(n_a), np.int64), n_a * n_b)):
                sums[c].append(_sums(x, np.cumsum(groups)))
        texts, upto = pa.concat_arrays(texts) if texts else pa.array([], pa.large_binary()), np.concatenate(upto)
        sums = {c: np.concatenate(x) for c, x in sums.items()}
        found, place = _places(codes)
        del codes
        sound = [len(d) > 0 and bool(sums["n_groups"][d].all()) for d in documents]
        held = _documents_with(len(found), place, upto, [d for d, there in zip(documents, sound) if there])
        for low in range(0, len(found), PAIRS_AT_ONCE):
            yield rows(1, block, part=pa.array([low], pa.int32()), codes=one(found[low : low + PAIRS_AT_ONCE]), held=one(held[low : low + PAIRS_AT_ONCE]))
        for low in range(0, len(documents), 500):
            some, there = documents[low : low + 500], sound[low : low + 500]
            own = {c: pa.array([int(x[d].sum()) if s else 0 for d, s in zip(some, there)], pa.int64()) for c, x in sums.items()}
            own["groups_sha256"] = pa.array([digest(texts, d) if s else "" for d, s in zip(some, there)], pa.string())
            numbers = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, some)]), pa.int32()), pa.array(np.concatenate(some)))
            yield rows(len(some), block, doc_id=pa.array(ids[low : low + 500], shape.field("doc_id").type), numbers=numbers, **own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, chars, known, ids, documents = TaskContext.get().partitionId() << 32, 0, {}, [], []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                documents.append(np.array([known.setdefault(p, len(known)) for p in pieces_of(text)] if text else [], np.int32))
                ids.append(doc_id)
                chars += len(text)
                if chars >= BLOCK_CHARS:
                    yield from ended(block, known, ids, documents)
                    block, chars, known, ids, documents = block + 1, 0, {}, [], []
        if documents:
            yield from ended(block, known, ids, documents)

    kind = docs.schema[id_column].dataType
    shape = pa.schema([
        ("doc_id", to_arrow_schema(StructType([StructField("x", kind)]))[0].type), *((c, pa.int64()) for c in SUMS), ("groups_sha256", pa.string()), ("numbers", pa.list_(pa.int32())),
        ("part", pa.int32()), *((c, pa.list_(pa.int32())) for c in PIECES), ("codes", pa.list_(pa.int64())), ("held", pa.list_(pa.int64())),
    ])
    source = in_modest_batches(docs).select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    fields = [f"doc_id {kind.simpleString()}", *(f"{c} long" for c in SUMS), "groups_sha256 string, numbers array<int>, part int", *(f"{c} array<int>" for c in PIECES), "codes array<long>, held array<long>"]
    return source.mapInArrow(run, ", ".join(["block long", *fields]))


def _values(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten())


def _second_pass(kept: pa.Table, judged: pa.Table) -> pa.Table:
    """A block's documents with all their columns. kept: its documents and pieces; judged: (place, docs, best) of its pairs."""
    docs, parts = kept.filter(pc.is_null(kept["part"])), kept.filter(pc.is_valid(kept["part"])).sort_by("part")
    judged = judged.sort_by("place")
    codes, weights, upto, at = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for k in range(parts.num_rows):
        a, b, a_sizes, b_sizes, groups = (_values(parts[c].slice(k, 1)) for c in PIECES)
        code, times, ends = links(groups, [a, b], [a_sizes, b_sizes])
        codes.append(code)
        weights.append(times)
        upto.append(at + ends)
        at += len(code)
    (_, place), weights, upto = _places(codes), np.concatenate(weights), np.concatenate(upto)
    numbers, there = _values(docs["numbers"]), np.asarray(docs["n_groups"]) > 0
    ends = np.cumsum(np.asarray(pc.list_value_length(docs["numbers"])))
    more = {}
    for name, of in (("n_best", "best"), ("count_sum", "docs")):
        each = _sums(np.asarray(judged[of])[place] * weights, upto)
        more[name] = np.where(there, _sums(each[numbers], ends), 0)
    return pa.table({c: docs[c] for c in ["doc_id", *SUMS]} | more | {"groups_sha256": docs["groups_sha256"]})


def align(docs: DataFrame, first: str, second: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of docs: the id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    first: the text of a byte-level vocabulary file; second: the path of a piece model that every executor has.
    """
    spark = docs.sparkSession
    path = scratch(spark, "align")
    name = f"align_{path[-32:]}"
    chars = docs.agg(F.sum(F.length(text_column))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * chars // BLOCK_CHARS))  # seldom two blocks in one

    def written(df: DataFrame, what: str) -> DataFrame:
        df.write.parquet(f"{path}-{what}")
        return spark.read.parquet(f"{path}-{what}")

    try:
        first_pass(docs, first, second, id_column, text_column).write.bucketBy(buckets, "block").option("path", f"{path}-blocks").format("parquet").saveAsTable(name)
        blocks = spark.table(name)
        pairs = blocks.where("codes is not null").select("block", "part", F.posexplode(F.arrays_zip("codes", "held")).alias("at", "p"))
        pairs = pairs.select("block", (F.col("part") + F.col("at")).alias("place"), F.col("p.codes").alias("code"), F.col("p.held").alias("held"))
        counts = written(pairs.groupBy("code").agg(F.sum("held").alias("docs")), "counts").withColumn("a", F.shiftright("code", 32))
        best = counts.groupBy("a").agg(F.max("docs").alias("most"))  # not more rows than the vocabulary has
        judged = counts.join(F.broadcast(best), "a").select("code", "docs", (F.col("docs") == F.col("most")).cast("long").alias("best"))
        judged = F.broadcast(judged) if counts.count() <= MOST_SENT else judged
        values = pairs.select("block", "place", "code").join(judged, "code").select(F.col("block").alias("of"), "place", "docs", "best")
        kept = blocks.where("codes is null").select("block", "doc_id", *SUMS, "groups_sha256", "numbers", "part", *PIECES)
        shape = ", ".join([f"doc_id {docs.schema[id_column].dataType.simpleString()}", *(f"{c} long" for c in [*SUMS, "n_best", "count_sum"]), "groups_sha256 string"])
        return written(kept.groupBy("block").cogroup(values.groupBy("of")).applyInArrow(_second_pass, shape), "result").withColumnRenamed("doc_id", id_column)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: tokens, groups and links of two public vocabularies."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return align(table(spark, sf_dir, "documents"), file.read(), public_tokenizers.path("piece_bpe_32k.model"))
