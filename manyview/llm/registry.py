"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from manyview.llm import aligntok, bpe, chat, fingerprint, langid, license, linededup, minhash, mixing, pii, spelling, topk, wordbpe

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": bpe.op1_bpe,
    "op2_topk": topk.op2_topk,
    "op3_minhash": minhash.op3_minhash,
    "op4_line_dedup": linededup.op4_line_dedup,
    "op5_license": license.op5_license,
    "op6_fingerprint": fingerprint.op6_fingerprint,
    "op7_langid": langid.op7_langid,
    "op8_chat": chat.op8_chat,
    "op9_pii": pii.op9_pii,
    "op10_mixing": mixing.op10_mixing,
    "op11_spelling": spelling.op11_spelling,
    "op12_word_bpe": wordbpe.op12_word_bpe,
    "op13_align": aligntok.op13_align,
}

SQL: dict[str, str] = {
    "op2_topk": topk.OP2_SQL,
    "op3_minhash": minhash.OP3_SQL,
    "op4_line_dedup": linededup.OP4_SQL,
    "op5_license": license.OP5_SQL,
    "op6_fingerprint": fingerprint.OP6_SQL,
    "op8_chat": chat.OP8_SQL,
    "op11_spelling": spelling.OP11_SQL,
}
