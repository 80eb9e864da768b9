"""Incremental landing of raw CSV drops with Structured Streaming.

The batch ingest (``sources.csv.ingest_csv_dir``) re-reads whole files; this is the
same typed read as a file-source stream: each new file dropped into a table's landing
folder is parsed with the registry schema and appended to that table's Parquet
dataset exactly once (the checkpoint records which files were taken). With the
``availableNow`` trigger it processes what has landed and stops, so it can run as a
scheduled job; the model then reads the Parquet tables as usual.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from orderscope.schemas import TABLES
from orderscope.sources.csv import MALFORMED, MULTI_LINE_TABLES, text_schema, typed_rows


def csv_stream(spark: SparkSession, landing_dir: str, table: str) -> DataFrame:
    """A streaming DataFrame over the CSV files dropped in ``landing_dir``. A row with a wrong
    number of fields, or a number that cannot be read, stops the stream: there is no later
    check of what it appended."""
    schema = T.StructType([*text_schema(TABLES[table]).fields, T.StructField(MALFORMED, T.StringType())])
    text = (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", table in MULTI_LINE_TABLES)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", MALFORMED)
        .option("columnPruning", False)
        .csv(landing_dir)
    )
    return typed_rows(text, table, fail=True)


def land_table(
    spark: SparkSession,
    landing_dir: str,
    out_dir: str,
    checkpoint_dir: str,
    table: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Start the append stream landing -> Parquet for one table."""
    writer = (
        csv_stream(spark, landing_dir, table)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint_dir)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start(out_dir)


def land_all(
    spark: SparkSession, landing_root: str, out_root: str, checkpoint_root: str
) -> dict[str, StreamingQuery]:
    """One stream per table: ``landing_root/<table>/*.csv`` -> ``out_root/<table>``."""
    return {
        name: land_table(
            spark,
            os.path.join(landing_root, name),
            os.path.join(out_root, name),
            os.path.join(checkpoint_root, name),
            name,
        )
        for name in TABLES
    }
