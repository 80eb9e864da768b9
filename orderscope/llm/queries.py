"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderscope.llm import (
    conversation_repair,
    decontamination,
    embedding_dedup,
    language_model,
    lexical_search,
    line_dedup,
    mixing,
    quality,
    token_counts,
    token_file,
    toxicity,
)
from orderscope.llm.common import save, table, text_bytes
from orderscope.llm.sharding import shard_documents
from orderscope.llm.shingle_join import join_components

SHARDS = 40


def op1_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole, in shards of near equal bytes; digests of what was written."""
    placed = save(shard_documents(table(spark, sf_dir, "documents"), SHARDS), "sharded")
    return placed.select(
        "doc_id",
        (text_bytes(F.col("text")) + 16).alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_pigeonhole_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under 3-word shingles and a similarity of 0.9 or more."""
    return join_components(table(spark, sf_dir, "documents"), 3, 90)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_histogram_sort": op1_histogram_sort,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_whole_tokens": token_counts.op3_token_counts,
    "op4_pivot_index": embedding_dedup.op4_pivot_index,
    "op5_bit_planes": token_file.op5_bit_planes,
    "op6_raking": mixing.op6_raking,
    "op7_site_lines": line_dedup.op7_site_lines,
    "op8_pigeonhole_join": op8_pigeonhole_join,
    "op9_maxent": language_model.op9_maxent,
    "op10_winnowing": decontamination.op10_winnowing,
    "op11_run_length": conversation_repair.op11_run_length,
    "op12_best_position": lexical_search.op12_best_position,
    "op13_positive_unlabelled": quality.op13_positive_unlabelled,
}

ORACLE_SQL: dict[str, str] = {
    "op6_raking": mixing.oracle(),
    "op7_site_lines": line_dedup.oracle(),
    "op10_winnowing": decontamination.ORACLE,
    "op12_best_position": lexical_search.ORACLE,
}
