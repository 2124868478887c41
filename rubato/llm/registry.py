"""All queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import (
    byte_bpe,
    chat_format,
    html_extraction,
    mixing,
    ngram_join,
    periodic_runs,
    quality_classifier,
    quality_rules,
    sharding,
    simhash,
    token_files,
    whitening,
    winnowing,
)

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_chat_format": chat_format.op2_chat_format,
    "op3_byte_bpe": byte_bpe.op3_byte_bpe,
    "op4_mixing": mixing.op4_mixing,
    "op5_token_files": token_files.op5_token_files,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_winnowing": winnowing.op7_winnowing,
    "op8_html_extraction": html_extraction.op8_html_extraction,
    "op9_quality_classifier": quality_classifier.op9_quality_classifier,
    "op10_simhash": simhash.op10_simhash,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_ngram_join": ngram_join.op12_ngram_join,
    "op13_whitening": whitening.op13_whitening,
}

ORACLE_SQL: dict[str, str] = {**chat_format.ORACLE_SQL, **mixing.ORACLE_SQL}
