"""Queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronospan.llm import chat, decontam, fim, langid, licenses, linededup, ngramjoin, packing, phrases, pii, quality_fm, quality_llr, simhash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_decontamination": decontam.op2_decontamination,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_quality_classifier": quality_fm.op4_quality_classifier,
    "op5_language_id": langid.op5_language_id,
    "op6_line_dedup": linededup.op6_line_dedup,
    "op7_ngram_jaccard": ngramjoin.op7_ngram_jaccard,
    "op8_chat_format": chat.op8_chat_format,
    "op9_quality_rules": quality_llr.op9_quality_rules,
    "op10_pii": pii.op10_pii,
    "op11_fill_in_middle": fim.op11_fill_in_middle,
    "op12_simhash_dedup": simhash.op12_simhash_dedup,
    "op13_phrases": phrases.op13_phrases,
}

#: Where SQL can express the query.
ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": decontam.OP2_SQL,
    "op7_ngram_jaccard": ngramjoin.OP7_SQL,
    "op8_chat_format": chat.OP8_SQL,
    "op11_fill_in_middle": fim.OP11_SQL,
    "op13_phrases": phrases.OP13_SQL,
}
