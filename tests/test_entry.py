"""The driver contract in __spark_entry__.py."""

from __future__ import annotations

import json

import __spark_entry__ as entry
from orderscope.plans.commerce import OPERATOR_NAMES


def test_entry_runs_on_smoke_data(spark):
    df = entry.entry(spark)
    assert df.columns == [
        "delay_bucket",
        "bucket_order",
        "orders",
        "average_review",
        "low_review_rate",
        "average_delivery_days",
    ]
    rows = df.collect()
    assert [r["bucket_order"] for r in rows] == [1, 2, 3, 4, 5]


def test_every_operator_registered_with_oracle():
    q = entry.queries()
    sql = entry.oracle_sql()
    own = set(OPERATOR_NAMES)
    assert own <= set(q)
    assert set(sql) & own == own - {"summary_document"}
    assert set(q) - own == {"dq_unparsed"} | set(entry.LLM_QUERIES)


def test_summary_document_on_test_tables(spark):
    doc = entry.queries()["summary_document"](spark, "/root/testdata/sf0.001").collect()
    assert len(doc) == 1
    assert json.loads(doc[0]["summary_json"])["kpis"]["orders_all_statuses"] > 0
