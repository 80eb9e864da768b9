"""Load the landed (Parquet) tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderscope.schemas import TABLES, TS


def load_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One landed table, projected onto its registry schema (column order fixed).

    A timestamp landed as text that does not parse becomes NULL; any other value that does
    not fit its type fails the job (amounts are never dropped silently).
    """
    spec = TABLES[name]
    df = spark.read.parquet(os.path.join(root, name))
    return df.select(
        *[
            (F.col(f.name).try_cast(f.dataType) if f.dataType == TS else F.col(f.name).cast(f.dataType)).alias(f.name)
            for f in spec.schema.fields
        ]
    )


def load_tables(spark: SparkSession, root: str, names: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """Every landed table under ``root`` (``root/<table>``), or the ``names`` given."""
    return {name: load_table(spark, root, name) for name in (names or tuple(TABLES))}
