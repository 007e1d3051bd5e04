"""Queries of the training-data operators, and their SQL."""

from __future__ import annotations

from . import bytebpe, chat, decontaminate, html, langid, lexical, neardup, packing, pii, quality, substrings, vectorcodes, warc

QUERIES = {
    "op1_neardup": neardup.op1_neardup,
    "op2_html": html.op2_html,
    "op3_warc": warc.op3_warc,
    "op4_pii": pii.op4_pii,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_packing": packing.op6_packing,
    "op7_chat": chat.op7_chat,
    "op8_quality": quality.op8_quality,
    "op9_substrings": substrings.op9_substrings,
    "op10_langid": langid.op10_langid,
    "op11_vectorcodes": vectorcodes.op11_vectorcodes,
    "op12_lexical": lexical.op12_lexical,
    "op13_bytebpe": bytebpe.op13_bytebpe,
}
ORACLE = {
    "op1_neardup": neardup.OP1_SQL,
    "op3_warc": warc.OP3_SQL,
    "op5_decontaminate": decontaminate.OP5_SQL,
    "op7_chat": chat.OP7_SQL,
    "op9_substrings": substrings.OP9_SQL,
    "op11_vectorcodes": vectorcodes.OP11_SQL,
    "op12_lexical": lexical.OP12_SQL,
}
