"""The registered queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, chat, decontaminate, langid, mainhtml, minhash, mixing, quality, spelling, substring, suffixdedup, topk, turntrie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_preferences": chat.op2_preferences,
    "op3_minhash": minhash.op3_minhash,
    "op4_html": mainhtml.op4_html,
    "op5_topk": topk.op5_topk,
    "op6_suffix": suffixdedup.op6_suffix,
    "op7_substring": substring.op7_substring,
    "op8_langid": langid.op8_langid,
    "op9_quality": quality.op9_quality,
    "op10_bpe": bpe.op10_bpe,
    "op11_turntrie": turntrie.op11_turntrie,
    "op12_mixing": mixing.op12_mixing,
    "op13_spelling": spelling.op13_spelling,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op2_preferences": chat.OP2_SQL,
    "op3_minhash": minhash.OP3_SQL,
    "op5_topk": topk.OP5_SQL,
    "op7_substring": substring.OP7_SQL,
    "op11_turntrie": turntrie.OP11_SQL,
    "op12_mixing": mixing.OP12_SQL,
    "op13_spelling": spelling.OP13_SQL,
}
