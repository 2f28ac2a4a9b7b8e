"""Chat formatting over a prefix tree (operator 8).

Template. A conversation is `<s>` and its turns: `[INST] text [/INST]` of a user, `<<SYS>>text<</SYS>>` of a system,
`text</s>` of an assistant, `<role name>text</role>` of any other. Texts have a backslash before each backslash, `<` and `[`
(names also before `>`), so no control string can arise inside a text, and reading back is exact.

Tree. Conversations that share initial turns are merged: a node is a turn after the same turns before. Nodes are laid out
depth-first in a pack, each once. A node has the offset of its tokens in the pack, the position id of its first token
(positions count along the path, so siblings start at the same one), and the intervals of the pack that its tokens may
attend to: those of its ancestors, and its own up to each token. Tokens are code points here; the offsets and intervals
hold for any finer unit after the same counting. The loss mask covers assistant texts.

Packs. Conversations are sorted by the hashes of their turns, which is the depth-first order of the whole tree, over ranges of rows.
A pack is a run of that order with the same first turn, of at most `PACK` conversations. A longer run is cut in its second half,
where the conversations beside the cut share the least text; only those shared turns are there again in the next pack. A
pack's number is the conv_id of its first conversation. Where ranges begin is drawn from a sample, so packs may differ
from run to run; what is read back does not.

Defined results: turns go by turn number, then role and text, null first; null roles and texts are empty; repeated rows are
repeated turns; rows with a null conv_id take no part; an empty table gives no nodes; other columns are not read. One
conversation, as one document, has to fit into a task's memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyview.llm.common import in_modest_batches, table

PACK = 64
BEGIN = "<s>"
MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("", "</s>")}
OTHER = ("<role ", ">", "</role>")
_ESCAPED, _ESCAPES = re.compile(r"\\(.)", re.S), re.compile(r"([\\<\[])")
_NAMES = re.compile(r"([\\<\[>])")


def escape(text: str) -> str:
    return _ESCAPES.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def piece(role: str, text: str) -> tuple[str, int, int]:
    """A turn's formatted text, and where the turn's own text lies in it."""
    before, after = MARKS.get(role) or (OTHER[0] + _NAMES.sub(r"\\\1", role) + OTHER[1], OTHER[2])
    inside = escape(text)
    return before + inside + after, len(before), len(before) + len(inside)


#: Up to the first control string that no backslash escapes.
_TEXT = r"((?:[^\\<\[]|\\.)*)"
_TURN = re.compile(
    rf"\[INST\] {_TEXT} \[/INST\]|<<SYS>>{_TEXT}<</SYS>>|<role ((?:[^\\>]|\\.)*)>{_TEXT}</role>|{_TEXT}</s>",
    re.S,
)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    at, out = len(BEGIN), []
    if not formatted.startswith(BEGIN):
        raise ValueError("a formatted conversation begins with " + BEGIN)
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        user, system, name, other, assistant = found.groups()
        if user is not None:
            out.append(("user", unescape(user)))
        elif system is not None:
            out.append(("system", unescape(system)))
        elif name is not None:
            out.append((unescape(name), unescape(other)))
        else:
            out.append(("assistant", unescape(assistant)))
        at = found.end()
    return out


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) with turns in order, from rows (conv_id, turn, role, text)."""
    each = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    return each.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


NODES = "pack long, node int, parent int, start long, length int, position long, visible array<struct<low:long,high:long>>, text string, loss_low int, loss_high int, ends array<long>"
_SPAN = pa.struct([("low", pa.int64()), ("high", pa.int64())])
_SCHEMA = pa.schema({"pack": pa.int64(), "node": pa.int32(), "parent": pa.int32(), "start": pa.int64(), "length": pa.int32(), "position": pa.int64(), "visible": pa.list_(_SPAN), "text": pa.string(), "loss_low": pa.int32(), "loss_high": pa.int32(), "ends": pa.list_(pa.int64())})


def lay_out(pack: int, members: list[tuple[int, list[tuple[str, str]]]]) -> list[tuple]:
    """The nodes of a pack, depth-first; members: (conv_id, turns)."""
    texts, losses, children, ends = [BEGIN], [(0, 0)], [{}], [[]]
    for conv, turns in members:
        at = 0
        for role, text in turns:
            nxt = children[at].get((role, text))
            if nxt is None:
                formatted, low, high = piece(role, text)
                nxt = children[at][role, text] = len(texts)
                texts.append(formatted)
                losses.append((low, high) if role == "assistant" else (0, 0))
                children.append({})
                ends.append([])
            at = nxt
        ends[at].append(conv)
    out, start, stack = [], 0, [(0, -1, 0, [])]
    while stack:
        at, parent, position, above = stack.pop()
        size, node = len(texts[at]), len(out)
        joins = above and above[-1][1] == start
        visible = [*above[:-1], (above[-1][0], start + size)] if joins else [*above, (start, start + size)]
        out.append((pack, node, parent, start, size, position, [{"low": a, "high": b} for a, b in visible], texts[at], *losses[at], ends[at]))
        start += size
        stack += [(child, node, position + size, visible) for child in reversed(children[at].values())]
    return out


def shared(x: list[tuple[str, str]], y: list[tuple[str, str]]) -> int:
    """The characters of the turns that two conversations begin with in common, and one for each turn."""
    total = 0
    for one, other in zip(x, y):
        if one != other:
            break
        total += 1 + len(one[1])
    return total


def cut_at(members: list[tuple[int, list[tuple[str, str]]]]) -> int:
    """How many of the members go into a pack: half of them at least, not all; the last place where neighbours share the least."""
    places = range((len(members) + 1) // 2, len(members))
    return min(places, key=lambda at: (shared(members[at - 1][1], members[at][1]), -at))


def format_chats(turns: DataFrame, pack: int = PACK) -> DataFrame:
    """The nodes of all packs: a row for each node, with the ids of the conversations that end at it."""
    whole = conversations(in_modest_batches(turns)).withColumn("path", F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"])))
    dealt = whole.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", "turns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, out = [], []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)
            out.clear()
            return batch

        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                for conv, said in zip(*(c.to_pylist() for c in batch.slice(low, 200).columns)):
                    said = [(t["role"], t["text"]) for t in said]
                    if members and members[-1][1][0] != said[0]:
                        out += lay_out(members[0][0], members)
                        members = []
                    members.append((conv, said))
                    if len(members) > pack:
                        at = cut_at(members)
                        out += lay_out(members[0][0], members[:at])
                        members = members[at:]
                if len(out) > 2000:
                    yield flush()
        if members:
            out += lay_out(members[0][0], members)
        if out:
            yield flush()

    return dealt.mapInArrow(run, NODES)


def read_packs(nodes: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss, turns) of each conversation, read from the nodes alone: what its last node may attend to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []

        def read() -> None:
            text = "".join(x[2] for x in held)
            masked = [(start + a, start + b) for start, _, _, a, b, _ in held if b > a]
            for _, visible, _, _, _, ends in held:
                if ends:
                    formatted = "".join(text[v["low"] : v["high"]] for v in visible)
                    spans = [m for m in masked if any(v["low"] <= m[0] and m[1] <= v["high"] for v in visible)]
                    turns = [{"role": r, "text": t} for r, t in read_back(formatted)]
                    out.extend((conv, formatted, unescape("".join(text[a:b] for a, b in spans)), turns) for conv in ends)
            held.clear()

        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["conv_id", "formatted", "loss", "turns"])
            out.clear()
            return batch

        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                for key, *row in zip(*(c.to_pylist() for c in batch.slice(low, 500).columns)):
                    if key != now:
                        read()
                    now = key
                    held.append(tuple(row))
                if len(out) > 200:
                    yield flush()
        read()
        if out:
            yield flush()

    ordered = nodes.repartition("pack").sortWithinPartitions("pack", "node").select("pack", "start", "visible", "text", "loss_low", "loss_high", "ends")
    return ordered.mapInArrow(run, "conv_id long, formatted string, loss string, turns array<struct<role:string,text:string>>")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts are control strings: digests of what is read back from the packs."""
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_packs(format_chats(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


#: A turn's formatted length is that of its text, of a backslash for each backslash, < and [ in it, and of its marks.
OP8_SQL = r"""
WITH turns AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS x(turn, role)),
sized AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\<\[]', '', 'g')) AS inside,
    CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 15 WHEN 'assistant' THEN 4
      ELSE 14 + length(role) + length(regexp_replace(role, '[^\\<\[>]', '', 'g')) END AS marks
  FROM turns),
whole AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, CAST(3 + sum(inside + marks) AS BIGINT) AS formatted_chars
  FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM whole
"""
