"""Queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, chat_format, decontaminate, embedding_dedup, html_extract, language_id, line_dedup, mixing, packing, simhash, token_counts, toxicity, vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixture_packing": packing.op1,
        "op2_line_dedup": line_dedup.op2,
        "op3_token_counts": token_counts.op3,
        "op4_toxicity": toxicity.op4,
        "op5_language_id": language_id.op5,
        "op6_simhash_near_dedup": simhash.op6,
        "op7_embedding_near_dedup": embedding_dedup.op7,
        "op8_perspective_rotation": chat_format.op8,
        "op9_html_extraction": html_extract.op9,
        "op10_benchmark_decontamination": decontaminate.op10,
        "op11_vector_codes": vector_codes.op11,
        "op12_tokenizer_alignment": alignment.op12,
        "op13_source_mix": mixing.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_perspective_rotation": chat_format.OP8_SQL, "op11_vector_codes": vector_codes.op11_sql(), "op13_source_mix": mixing.OP13_SQL}
