"""The queries of this subpackage and the SQL that DuckDB can run against them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, filter_audit, html_text, language_id, permutation_index, pii, repeated_spans, sentence_pieces, sharding, simhash, spelling_variants, token_files
from .common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": lambda s, d: language_id.op1_language_id(s, table(s, d, "documents")),
        "op10_html_text": lambda s, d: html_text.op10_html_text(s, table(s, d, "pages")),
        "op11_nearest_vectors": lambda s, d: permutation_index.op11_nearest_vectors(s, table(s, d, "embeddings")),
        "op12_filter_audit": filter_audit.op12_filter_audit,
        "op13_spelling_variants": lambda s, d: spelling_variants.op13_spelling_variants(s, table(s, d, "documents")),
        "op2_token_files": lambda s, d: token_files.op2_token_files(s, table(s, d, "documents")),
        "op3_exact_dedup": lambda s, d: exact_dedup.op3_exact_dedup(s, table(s, d, "documents")),
        "op4_pii": lambda s, d: pii.op4_pii(s, table(s, d, "documents")),
        "op5_simhash_near_dedup": lambda s, d: simhash.op5_simhash_near_dedup(s, table(s, d, "documents")),
        "op6_sharding": lambda s, d: sharding.op6_sharding(s, table(s, d, "documents")),
        "op7_sentencepiece": lambda s, d: sentence_pieces.op7_sentencepiece(s, table(s, d, "documents")),
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_repeated_spans": lambda s, d: repeated_spans.op9_repeated_spans(s, table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": exact_dedup.ORACLE, "op12_filter_audit": filter_audit.ORACLE, "op8_decontaminate": decontaminate.ORACLE}
