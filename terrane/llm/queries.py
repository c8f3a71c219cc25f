"""Queries of this subpackage and their SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from terrane.llm import decontamination, extraction, language, mixing, quality, secrets, sharding, simhash, substrings, toxicity

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_quality": quality.op2_quality,
    "op3_simhash": simhash.op3_simhash,
    "op4_language": language.op4_language,
    "op5_extraction": extraction.op5_extraction,
    "op6_secrets": secrets.op6_secrets,
    "op7_sharding": sharding.op7_sharding,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_substrings": substrings.op9_substrings,
    "op10_toxicity": toxicity.op10_toxicity,
}

SQL = {
    "op1_mixing": mixing.OP1_SQL,
    "op6_secrets": secrets.OP6_SQL,
    "op7_sharding": sharding.OP7_SQL,
    "op8_decontamination": decontamination.OP8_SQL,
    "op9_substrings": substrings.OP9_SQL,
}
