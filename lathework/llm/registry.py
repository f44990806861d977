"""The subpackage's registered queries and oracles."""

from __future__ import annotations

from lathework.llm import bpe, digest, html, langid, linedup, mixing, quality_cnn, rules, shard, simhash, toxicity, turns

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_line_dedup": linedup.op2_line_dedup,
    "op3_mixing": mixing.op3_mixing,
    "op4_bpe": bpe.op4_bpe,
    "op5_html": html.op5_html,
    "op6_language_id": langid.op6_language_id,
    "op7_quality_cnn": quality_cnn.op7_quality_cnn,
    "op8_fingerprints": digest.op8_fingerprints,
    "op9_sharding": shard.op9_sharding,
    "op10_quality_rules": rules.op10_quality_rules,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_conversation_repair": turns.op12_conversation_repair,
}

ORACLES: dict[str, str] = {
    "op2_line_dedup": linedup.OP2_SQL,
    "op12_conversation_repair": turns.OP12_SQL,
}
