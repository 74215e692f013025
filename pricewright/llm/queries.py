"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import code_search, conversation_trie, language_id, leaderboard, near_dedup, packing, pieces, repeats, secret_scan, token_counts, toxicity, vector_dedup, vector_packing


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": packing.op1_packing,
        "op2_sentencepiece": pieces.op2_sentencepiece,
        "op3_token_counts": token_counts.op3_token_counts,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_suffix_dedup": repeats.op5_suffix_dedup,
        "op6_near_dedup": near_dedup.op6_near_dedup,
        "op7_language_id": language_id.op7_language_id,
        "op8_secret_scan": secret_scan.op8_secret_scan,
        "op9_vector_dedup": vector_dedup.op9_vector_dedup,
        "op10_code_search": code_search.op10_code_search,
        "op11_vector_packing": vector_packing.op11_vector_packing,
        "op12_leaderboard": leaderboard.op12_leaderboard,
        "op13_conversation_trie": conversation_trie.op13_conversation_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_near_dedup": near_dedup.ORACLE,
        "op8_secret_scan": secret_scan.oracle_op8(),
        "op10_code_search": code_search.ORACLE,
        "op12_leaderboard": leaderboard.ORACLE,
        "op13_conversation_trie": conversation_trie.ORACLE,
    }
