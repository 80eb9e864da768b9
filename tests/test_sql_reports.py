"""The SQL face: tables, model views and reports as temp views."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from orderscope.plans.commerce import MATERIALIZED
from orderscope.plans.sql_reports import MODEL_VIEWS, REPORT_VIEWS, register_views

from builders import SF_SMALL


@pytest.fixture(scope="module")
def model(spark):
    return entry.model_for(spark, SF_SMALL, MATERIALIZED)


def test_views_are_the_operators(spark, model):
    names = register_views(model)
    assert set(model.tables) | set(MODEL_VIEWS) | set(REPORT_VIEWS) == set(names)
    for view, name in (MODEL_VIEWS | REPORT_VIEWS).items():
        df = getattr(model, name)()
        assert spark.table(view).columns == df.columns
        assert spark.table(view).count() == df.count()


def test_sql_over_a_report(spark, model):
    register_views(model)
    got = spark.sql("SELECT sum(orders) AS n FROM r_state_performance").first()["n"]
    assert got == spark.sql("SELECT count(*) AS n FROM v_delivered_order_fact").first()["n"]
