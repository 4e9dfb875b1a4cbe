"""Registered queries of the training-data operators and the SQL each is compared with."""

from __future__ import annotations

import corpus_pipeline
from vectorloom.llm import chat_format, decontaminate, language_id, license_scan, pii, quality_classifier, quality_rules, sentencepiece_fst, simhash, substring_dedup

QUERIES = {
    "op1_license_scan": license_scan.query,
    "op2_language_id": language_id.query,
    "op3_substring_dedup": substring_dedup.query,
    "op4_quality_classifier": quality_classifier.query,
    "op5_pii": pii.query,
    "op6_simhash": simhash.query,
    "op7_chat_format": chat_format.query,
    "op8_decontaminate": decontaminate.query,
    "op9_sentencepiece": sentencepiece_fst.query,
    "op10_quality_rules": quality_rules.query,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {"op1_license_scan": license_scan.SQL, "op7_chat_format": chat_format.SQL}
