"""The queries of this package and their SQL."""

from __future__ import annotations

from loomgraph.llm import decontaminate, langid, linededup, mixing, neardup, pii, quality, recompress, secrets, suffixes

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_minhash_dedup": neardup.op3_minhash_dedup,
    "op4_language_id": langid.op4_language_id,
    "op5_suffix_dedup": suffixes.op5_suffix_dedup,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_substring_dedup": recompress.op8_substring_dedup,
    "op9_line_dedup": linededup.op9_line_dedup,
    "op10_pii": pii.op10_pii,
}
SQL = {
    "op3_minhash_dedup": neardup.OP3_SQL,
    "op6_mix_sources": mixing.OP6_SQL,
    "op7_decontaminate": decontaminate.OP7_SQL,
    "op9_line_dedup": linededup.OP9_SQL,
    "op8_substring_dedup": recompress.OP8_SQL,
}
