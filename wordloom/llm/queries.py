"""The queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from . import _sql, bpe, chat, decontamination, embedding_dedup, jaccard, language_id, lm_scoring, quality, secret_scan, suffix_dedup

QUERIES = {
    "op1_lm_scoring": lm_scoring.op1_lm_scoring,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_language_id": language_id.op5_language_id,
    "op6_byte_bpe": bpe.op6_byte_bpe,
    "op7_ngram_jaccard_join": jaccard.op7_ngram_jaccard_join,
    "op8_benchmark_decontamination": decontamination.op8_benchmark_decontamination,
    "op9_embedding_near_dedup": embedding_dedup.op9_embedding_near_dedup,
    "op10_secret_scan": secret_scan.op10_secret_scan,
}
ORACLES: dict[str, str] = {
    "op3_chat_formatting": chat.OP3_SQL,
    "op4_suffix_dedup": _sql.PASSAGES,
    "op7_ngram_jaccard_join": _sql.JACCARD,
    "op9_embedding_near_dedup": _sql.EMBEDDINGS,
}
