"""Document fingerprints by quartile bucket digests (operator 6).

All byte triplets of a text's UTF-8 bytes are hashed into 256 buckets and counted. The digest holds the length on a
logarithmic scale, two ratios of the counts' quartiles, and for each bucket the quartile that its count falls in, two bits
each. Digests are compared by a score that adds the distance in length, the distances of the ratios, and for each bucket
how many quartiles it is apart, with three for opposite ends counting six. Likeness is one less the sum's share of FAR, which
texts without anything in common reach, and 0 beyond.

Neighbours. The query also compares each document with the next by descending doc_id (the last with the first). The
documents are dealt once into ranges of doc_id and sorted; each range streams past a function that holds one row, and gives
the texts of its first and last row beside its results. The last row of each range then meets the first of the next one:
two texts for each range, and only the numbers of the ranges come to the driver, which has a task for each anyway.

Defined results: a null text is the empty text; texts of under three bytes have no triplets, and their digest is that of their
length and bytes; rows with a null doc_id take no part in `with_next`; rows that share a doc_id follow each other by text, and one
row alone is its own next; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyview.llm.common import cut, in_modest_batches, table

BUCKETS = 256
STEP = 1.5
LENGTHS = 128
RATIOS = 16
#: Of the difference: length steps and ratios are cut off at these, buckets at six each.
MOST_LENGTH, MOST_RATIO = 24, 2 * (RATIOS - 1)
MOST = MOST_LENGTH + 2 * MOST_RATIO + 6 * BUCKETS
FAR = 400


def digest(raw: bytes) -> str:
    """Hex of: length, ratios, and 256 buckets of two bits; digests of equal bytes are equal."""
    size = min(LENGTHS - 1, round(math.log(len(raw) + 1) / math.log(STEP)))
    if len(raw) < 3:
        return f"{size:02x}{'00'}{raw.ljust(2, bytes(1)).hex()}{'00' * (BUCKETS // 4 - 2)}"
    x = np.frombuffer(raw, np.uint8).astype(np.uint32)
    with np.errstate(over="ignore"):
        mixed = (x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)) * np.uint32(2654435761)
    counts = np.bincount(mixed >> np.uint32(24), minlength=BUCKETS)
    q1, q2, q3 = np.partition(counts, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1])[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    ratios = [int(q * (RATIOS - 1) // q3) if q3 else 0 for q in (q1, q2)]
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    return f"{size:02x}{ratios[0]:x}{ratios[1]:x}{packed.astype(np.uint8).tobytes().hex()}"


def _apart() -> np.ndarray:
    """The difference of two packed bytes, each of four buckets."""
    two = np.array([[abs(a - b) if abs(a - b) < 3 else 6 for b in range(4)] for a in range(4)], np.int16)
    byte = np.arange(256)
    parts = [(byte >> shift) & 3 for shift in (0, 2, 4, 6)]
    return sum(two[p[:, None], p[None, :]] for p in parts)


APART = _apart()


def difference(a: str, b: str) -> int:
    """From 0 to MOST; 0 for equal digests."""
    length = min(MOST_LENGTH, abs(int(a[:2], 16) - int(b[:2], 16)))
    ratios = 2 * (abs(int(a[2], 16) - int(b[2], 16)) + abs(int(a[3], 16) - int(b[3], 16)))
    x, y = (np.frombuffer(bytes.fromhex(d[4:]), np.uint8) for d in (a, b))
    return length + ratios + int(APART[x, y].sum())


def likeness(a: str, b: str) -> float:
    """From 0 to 1: 1 for equal digests, 0 from a difference of FAR on, which texts without anything in common reach."""
    return max(0.0, 1 - difference(a, b) / FAR)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digest((x or "").encode("utf-8", "surrogatepass")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint string")


def edited(text: str, following: str) -> str:
    """text with its last third replaced by as much of the beginning of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def with_next(docs: DataFrame, make: Callable[[int, str, str], tuple], schema: pa.Schema, ddl: str) -> DataFrame:
    """make(doc_id, text, text of the next document by descending doc_id) of each document."""
    docs = in_modest_batches(docs).where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ends = {"part": pa.int32(), "end": pa.string(), "end_id": pa.int64(), "end_text": pa.string()}
    fields = pa.schema([*schema, *ends.items()])
    nothing, no_end = (None,) * len(schema), (None,) * len(ends)

    def batch_of(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        for batch in batches:
            out = []
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                if held is None:
                    out.append((*nothing, part, "first", doc, text))
                else:
                    out.append((*make(*held, text), *no_end))
                held = (doc, text)
            if out:
                yield batch_of(out, fields)
        if held is not None:
            yield batch_of([(*nothing, part, "last", *held)], fields)

    # Ranges are numbered in their order. By doc_id alone, as the values that ranges are drawn from come to the driver.
    dealt = docs.repartitionByRange(F.col("doc_id").desc()).sortWithinPartitions(F.col("doc_id").desc(), "text")
    made = cut(dealt.mapInArrow(run, f"{ddl}, part int, end string, end_id long, end_text string"))
    parts = sorted(r["part"] for r in made.where("end = 'first'").select("part").collect())
    following = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int")
    last = made.where("end = 'last'").join(F.broadcast(following), "part").select("next_part", "end_id", "end_text")
    first = made.where("end = 'first'").select(F.col("part").alias("next_part"), F.col("end_text").alias("next_text"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch_of([make(*row) for row in zip(*(c.to_pylist() for c in batch.columns))], schema)

    closed = last.join(first.hint("shuffle_hash"), "next_part").select("end_id", "end_text", "next_text").mapInArrow(close, ddl)
    return made.where("end is null").select(*schema.names).unionByName(closed)


def _compared(doc: int, text: str, following: str) -> tuple:
    changed = edited(text, following).encode("utf-8", "surrogatepass")
    own, other, after = digest(text.encode("utf-8", "surrogatepass")), digest(changed), digest(following.encode("utf-8", "surrogatepass"))
    return doc, len(text), hashlib.sha256(changed).hexdigest(), own, other, likeness(own, other), likeness(own, after)


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: the fingerprint, that of the edited text, and the likeness to it and to the next document."""
    fields = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}
    ddl = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(table(spark, sf_dir, "documents"), _compared, pa.schema(fields), ddl)


OP6_SQL = f"""
WITH ordered AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS own, row_number() OVER (ORDER BY doc_id DESC, coalesce(text, '')) AS nth, count(*) OVER () AS n
  FROM documents WHERE doc_id IS NOT NULL),
pair AS (
  SELECT a.doc_id, a.nth, b.nth AS next_nth, a.own,
    substr(a.own, 1, length(a.own) - length(a.own) // 3) || substr(b.own, 1, length(a.own) // 3) AS changed
  FROM ordered a JOIN ordered b ON b.nth = a.nth % a.n + 1),
texts AS (SELECT nth, 0 AS kind, encode(own) AS raw FROM pair UNION ALL SELECT nth, 1, encode(changed) FROM pair),
bytes AS (
  SELECT nth, kind, octet_length(raw) AS size, hex(raw) AS hexed,
    list_transform(regexp_extract_all(hex(raw), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS x
  FROM texts),
triplets AS (
  SELECT nth, kind, unnest(x[1:size - 2]) AS a, unnest(x[2:size - 1]) AS b, unnest(x[3:size]) AS c FROM bytes WHERE size >= 3),
counted AS (
  SELECT nth, kind, (((a + b * 256 + c * 65536) * 2654435761) % 4294967296) // 16777216 AS bucket, count(*) AS times FROM triplets GROUP BY ALL),
filled AS (
  SELECT b.nth, b.kind, bucket, coalesce(times, 0) AS times
  FROM (SELECT nth, kind, unnest(range({BUCKETS})) AS bucket FROM bytes WHERE size >= 3) b LEFT JOIN counted USING (nth, kind, bucket)),
quartiles AS (
  SELECT nth, kind, list_sort(list(times)) AS s FROM filled GROUP BY ALL),
coded AS (
  SELECT nth, kind, bucket, (times > s[{BUCKETS // 4}])::INT + (times > s[{BUCKETS // 2}])::INT + (times > s[{3 * BUCKETS // 4}])::INT AS code, s
  FROM filled JOIN quartiles USING (nth, kind)),
packed AS (SELECT nth, kind, bucket // 4 AS byte, sum(code << (2 * (bucket % 4))) AS value FROM coded GROUP BY ALL),
bodies AS (SELECT nth, kind, string_agg(printf('%02x', value::INT), '' ORDER BY byte) AS body FROM packed GROUP BY ALL),
ratio AS (
  SELECT nth, kind, CASE WHEN s[{3 * BUCKETS // 4}] > 0 THEN printf('%x%x', (s[{BUCKETS // 4}] * {RATIOS - 1} // s[{3 * BUCKETS // 4}])::INT,
    (s[{BUCKETS // 2}] * {RATIOS - 1} // s[{3 * BUCKETS // 4}])::INT) ELSE '00' END AS ratios FROM quartiles),
prints AS (
  SELECT nth, kind, printf('%02x', least({LENGTHS - 1}, round(ln(size + 1) / ln({STEP}::DOUBLE)))::INT) ||
    CASE WHEN size < 3 THEN '00' || rpad(lower(hexed), 4, '0') || repeat('00', {BUCKETS // 4 - 2}) ELSE ratios || body END AS fp
  FROM bytes LEFT JOIN bodies USING (nth, kind) LEFT JOIN ratio USING (nth, kind)),
pairs AS (
  SELECT o.nth, 'edited' AS what, o.fp AS a, c.fp AS b FROM prints o JOIN prints c ON o.nth = c.nth AND o.kind = 0 AND c.kind = 1
  UNION ALL SELECT d.nth, 'next', o.fp, x.fp FROM pair d JOIN prints o ON o.nth = d.nth AND o.kind = 0 JOIN prints x ON x.nth = d.next_nth AND x.kind = 0),
apart AS (
  SELECT nth, what, a, b, abs((CAST('0x' || substr(a, 5 + 2 * (i // 4), 2) AS INT) >> (2 * (i % 4)) & 3) - (CAST('0x' || substr(b, 5 + 2 * (i // 4), 2) AS INT) >> (2 * (i % 4)) & 3)) AS d
  FROM (SELECT *, CAST(unnest(range({BUCKETS})) AS INT) AS i FROM pairs)),
scores AS (
  SELECT nth, what, greatest(0, 1 - (sum(CASE WHEN d < 3 THEN d ELSE 6 END) + least({MOST_LENGTH}, abs(CAST('0x' || a[1:2] AS INT) - CAST('0x' || b[1:2] AS INT)))
    + 2 * (abs(CAST('0x' || a[3] AS INT) - CAST('0x' || b[3] AS INT)) + abs(CAST('0x' || a[4] AS INT) - CAST('0x' || b[4] AS INT))))::DOUBLE / {FAR}) AS near
  FROM apart GROUP BY nth, what, a, b)
SELECT doc_id, length(own) AS n_chars, sha256(changed) AS edited_sha256, f.fp AS fingerprint, g.fp AS edited_fingerprint,
  CAST(e.near AS DOUBLE) AS near_edited, CAST(x.near AS DOUBLE) AS near_next
FROM pair d JOIN prints f ON f.nth = d.nth AND f.kind = 0 JOIN prints g ON g.nth = d.nth AND g.kind = 1
  JOIN scores e ON e.nth = d.nth AND e.what = 'edited' JOIN scores x ON x.nth = d.nth AND x.what = 'next'
"""
