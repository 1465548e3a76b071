"""The subpackage's registered queries and their SQL, as the driver runs them."""

from __future__ import annotations

from glyphmill.llm import decontamination, language, mixing, near_dedup, quality, secrets, sharding, substring_dedup, topk, toxicity

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1,
    "op2_quality": quality.op2,
    "op3_sharding": sharding.op3,
    "op4_decontamination": decontamination.op4,
    "op5_toxicity": toxicity.op5,
    "op6_topk": topk.op6,
    "op7_mixing": mixing.op7,
    "op8_language": language.op8,
    "op9_secrets": secrets.op9,
    "op10_near_dedup": near_dedup.op10,
}
#: The other operators draw by seeded tables or learn; tests hold them against brute force and held-out rows.
ORACLES = {
    "op1_substring_dedup": substring_dedup.SQL,
    "op4_decontamination": decontamination.SQL,
    "op6_topk": topk.SQL,
    "op7_mixing": mixing.SQL,
    "op10_near_dedup": near_dedup.SQL,
}
