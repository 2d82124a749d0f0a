"""Queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import decontaminate, html_extract, lm_scoring, quality_rules, secrets, sentencepiece, simhash, substring_dedup, suffix_dedup, warc

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_secrets": secrets.op3_secrets,
    "op4_sentencepiece": sentencepiece.op4_sentencepiece,
    "op5_warc": warc.op5_warc,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_lm_scoring": lm_scoring.op7_lm_scoring,
    "op8_html_extract": html_extract.op8_html_extract,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_quality_rules": quality_rules.op10_quality_rules,
}

ORACLE_SQL = {"op5_warc": warc.ORACLE_SQL, "op6_decontaminate": decontaminate.ORACLE_SQL, "op10_quality_rules": quality_rules.ORACLE_SQL}
