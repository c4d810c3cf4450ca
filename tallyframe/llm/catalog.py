"""The training-data queries and their SQL."""

from __future__ import annotations

from . import bpe, chat, jaccard, langid, line_dedup, lm, packing, quality_net, quality_rules, webp

QUERIES = {
    "op1_chat": chat.op1_chat,
    "op2_lm": lm.op2_lm,
    "op3_bpe": bpe.op3_bpe,
    "op4_lines": line_dedup.op4_lines,
    "op5_webp": webp.op5_webp,
    "op6_rules": quality_rules.op6_rules,
    "op7_packing": packing.op7_packing,
    "op8_language": langid.op8_language,
    "op9_quality": quality_net.op9_quality,
    "op10_jaccard": jaccard.op10_jaccard,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat": chat.OP1_SQL,
    "op6_rules": quality_rules.OP6_SQL,
    "op10_jaccard": jaccard.OP10_SQL,
}
