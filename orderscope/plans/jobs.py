"""Batch jobs: the file audit and the full build, as run by ``python -m orderscope``."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from orderscope.operators.quality import check_integrity, check_landed, dq_csv_audit, landing_report
from orderscope.plans.commerce import CommerceModel, ModelParams
from orderscope.session import write_concurrently
from orderscope.sources.csv import land_csv_dir, read_csv_dir
from orderscope.sources.sinks import write_csv, write_outputs
from orderscope.sources.tables import load_tables

DQ_REPORTS = (
    "dq_row_counts",
    "dq_orphan_items",
    "dq_orphan_orders",
    "dq_invalid_scores",
    "dq_duplicate_keys",
    "dq_join_keys",
    "dq_not_null",
)


def run_file_audit(spark: SparkSession, raw_dir: str, out_dir: str) -> str:
    """Audit every CSV file of ``raw_dir`` as it is (its own header, text columns): rows,
    columns, duplicate rows and NULLs per column, one long table keyed by file name. All files
    are one plan."""
    path = os.path.join(out_dir, "data_audit")
    audit = dq_csv_audit(*read_csv_dir(spark, raw_dir)).orderBy("table_name", "metric", "column_name")
    write_csv(audit, path, single_file=True)
    return path


def run_build(
    spark: SparkSession,
    raw_dir: str | None,
    landed_dir: str,
    out_dir: str,
    params: ModelParams | None = None,
    file_names: dict[str, str] | None = None,
    strict: bool = False,
) -> dict[str, str]:
    """Land the raw CSV files (when ``raw_dir`` is given; ``<table>.csv`` or the names in
    ``file_names``), check them, build the model once and write every report, the summary
    document and the payload tables. With ``strict`` the build stops before any report
    when a key is duplicated or missing, an item or order is orphaned, or a row or a number in a
    raw file cannot be read; these and unreadable timestamps are counted in
    ``quality/dq_unparsed`` in any case, from the landing writes themselves."""
    written: dict[str, str] = {}
    if raw_dir:
        landed = land_csv_dir(spark, raw_dir, landed_dir, file_names=file_names)
        path = os.path.join(out_dir, "quality", "dq_unparsed")
        write_csv(landing_report(spark, landed), path, single_file=True)
        written["quality/dq_unparsed"] = path
        if strict:
            check_landed(landed)
    tables = load_tables(spark, landed_dir)
    if strict:
        check_integrity(tables)
    model = CommerceModel(tables, params or ModelParams()).materialize()
    jobs = []
    for name in DQ_REPORTS:
        path = os.path.join(out_dir, "quality", name)
        jobs.append(lambda df=getattr(model, name)(), p=path: write_csv(df, p, single_file=True))
        written[f"quality/{name}"] = path
    write_concurrently(jobs)
    written.update(write_outputs(model, out_dir))
    return written
