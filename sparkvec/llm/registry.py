"""Queries of the numbered operators and of the pipeline, with SQL where it can express them."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from sparkvec.llm import op01_hash_forest, op02_line_dedup, op03_quality, op04_token_files, op05_sentencepiece, op06_order_minhash, op07_mixing, op08_token_counts, op09_html, op10_voronoi_topk, op11_runs, op12_byte_bpe, op13_merkle, oracle


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_hash_forest": op01_hash_forest.query,
        "op2_line_dedup": op02_line_dedup.query,
        "op3_quality": op03_quality.query,
        "op4_token_files": op04_token_files.query,
        "op5_sentencepiece": op05_sentencepiece.query,
        "op6_order_minhash": op06_order_minhash.query,
        "op7_mixing": op07_mixing.query,
        "op8_token_counts": op08_token_counts.query,
        "op9_html": op09_html.query,
        "op10_voronoi_topk": op10_voronoi_topk.query,
        "op11_runs": op11_runs.query,
        "op12_byte_bpe": op12_byte_bpe.query,
        "op13_merkle": op13_merkle.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracle.ORACLES) | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
