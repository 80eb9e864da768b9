"""Delay buckets: right-closed bins over whole days late.

With the default edges (0, 3, 7) the bins are  <=0, 1-3, 4-7, >=8.  An order whose
delay is unknown (no promised or no delivery date) gets its own ``unknown`` bucket
instead of falling into the last one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bucket edges and label wording of the published delay report.
DEFAULT_EDGES: tuple[int, ...] = (0, 3, 7)
ON_TIME_LABEL = "On time / early"
RANGE_LABEL = "{lo}-{hi} days late"
OPEN_LABEL = "{lo}+ days late"
UNKNOWN_LABEL = "unknown"


def bucket_labels(edges: tuple[int, ...] = DEFAULT_EDGES) -> list[str]:
    """Labels in bucket order, e.g. ['On time / early', '1-3 days late', '4-7 days late', '8+ days late']."""
    labels = [ON_TIME_LABEL]
    for lo, hi in zip(edges, edges[1:]):
        labels.append(RANGE_LABEL.format(lo=lo + 1, hi=hi))
    labels.append(OPEN_LABEL.format(lo=edges[-1] + 1))
    return labels


def unknown_order(edges: tuple[int, ...] = DEFAULT_EDGES) -> int:
    return len(edges) + 2


def bucket_order(delay_days: Column | str, edges: tuple[int, ...] = DEFAULT_EDGES) -> Column:
    """1-based bucket number (right-closed bins); unknown delay -> len(edges) + 2."""
    d = F.col(delay_days) if isinstance(delay_days, str) else delay_days
    expr = F.when(d.isNull(), F.lit(unknown_order(edges)))
    for i, edge in enumerate(edges, start=1):
        expr = expr.when(d <= F.lit(edge), F.lit(i))
    return expr.otherwise(F.lit(len(edges) + 1))


def bucket_label(order: Column | str, edges: tuple[int, ...] = DEFAULT_EDGES) -> Column:
    o = F.col(order) if isinstance(order, str) else order
    expr = F.when(o == F.lit(unknown_order(edges)), F.lit(UNKNOWN_LABEL))
    for i, label in enumerate(bucket_labels(edges), start=1):
        expr = expr.when(o == F.lit(i), F.lit(label))
    return expr


def bucket_table(spark: SparkSession, edges: tuple[int, ...] = DEFAULT_EDGES) -> DataFrame:
    """The fixed buckets as a tiny DataFrame (bucket_order, delay_bucket); len(edges)+1 rows."""
    schema = T.StructType([
        T.StructField("bucket_order", T.IntegerType(), False),
        T.StructField("delay_bucket", T.StringType(), False),
    ])
    rows = [(i, label) for i, label in enumerate(bucket_labels(edges), start=1)]
    return spark.createDataFrame(rows, schema)
