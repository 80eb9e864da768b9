
from __future__ import annotations

import json
import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from builders import SF_CHECK
from orderscope.plans.commerce import MATERIALIZED


@pytest.fixture(scope="module")
def model(spark):
    return entry.model_for(spark, SF_CHECK, MATERIALIZED)


def test_order_totals_agree(model):
    kpi = model.kpi_extended().collect()[0]
    n = kpi["delivered_orders"]
    states = model.state_performance().collect()
    months = model.monthly_performance().collect()
    buckets = model.delay_impact().collect()
    assert sum(r["orders"] for r in states) == n
    assert sum(r["orders"] for r in months) == n
    assert sum(r["orders"] for r in buckets) == n
    assert model.delivered_fact().count() == n
    # facts of the adapted tables, agreed on by the model and its SQL
    assert n == 12706 and kpi["delivered_items"] == 51691 and kpi["orders_all_statuses"] == 15000
    assert [r["orders"] for r in sorted(buckets, key=lambda r: r["bucket_order"])] == [8848, 1220, 1620, 813, 205]


def test_money_totals_agree(model):
    kpi = model.kpi_extended().collect()[0]
    states = model.state_performance().collect()
    cats = model.category_performance().collect()
    months = model.monthly_performance().collect()
    gmv = kpi["merchandise_gmv_brl"]
    assert sum(r["merchandise_gmv_brl"] for r in states) == gmv
    assert sum(r["merchandise_gmv_brl"] for r in cats) == gmv
    assert sum(r["merchandise_gmv_brl"] for r in months) == gmv
    assert sum(r["freight_value_brl"] for r in states) == kpi["freight_value_brl"]
    assert sum(r["freight_value_brl"] for r in cats) == kpi["freight_value_brl"]
    # multi-category orders count once per category
    assert sum(r["orders"] for r in cats) >= kpi["delivered_orders"]


def test_shares_sum_to_one(model):
    for df, col in [
        (model.state_performance(), "gmv_share"),
        (model.category_performance(), "gmv_share"),
        (model.payment_mix(), "value_share"),
    ]:
        assert math.isclose(sum(r[col] for r in df.collect()), 1.0, rel_tol=1e-12)


def test_rates_recompose_from_buckets(model):
    kpi = model.kpi_extended().collect()[0]
    buckets = {r["bucket_order"]: r for r in model.delay_impact().collect()}
    late_orders = sum(buckets[b]["orders"] for b in (2, 3, 4))
    assert math.isclose(late_orders / kpi["delivered_orders"], kpi["late_delivery_rate"], rel_tol=1e-12)
    low = sum(r["orders"] * r["low_review_rate"] for r in buckets.values())
    assert math.isclose(low / kpi["delivered_orders"], kpi["low_review_rate"], rel_tol=1e-12)


def test_priority_sellers_are_scaled(model):
    sellers = model.seller_performance().collect()
    assert all(r["scale_flag"] for r in sellers if r["priority_flag"])
    risk = model.seller_risk_summary().collect()[0]
    assert risk["priority_sellers"] == sum(1 for r in sellers if r["priority_flag"]) == 22
    assert risk["scaled_sellers"] == sum(1 for r in sellers if r["scale_flag"])


def test_findings_recompute_from_reports(model):
    f = model.findings_summary().collect()[0]
    b = {r["bucket_order"]: r for r in model.delay_impact().collect()}
    assert math.isclose(f["late_delivery_review_gap"], b[1]["average_review"] - b[4]["average_review"])
    assert math.isclose(
        f["very_late_low_review_multiplier"], b[4]["low_review_rate"] / b[1]["low_review_rate"]
    )
    cats = sorted(model.category_performance().collect(), key=lambda r: (-r["merchandise_gmv_brl"], r["category"]))
    assert math.isclose(f["top_10_category_gmv_share"], sum(r["gmv_share"] for r in cats[:10]), rel_tol=1e-12)


def test_repeat_and_windows(model):
    rc = model.repeat_customers().collect()[0]
    assert (rc["repeat_customers"], rc["unique_customers"]) == (537, 12152)
    assert model.monthly_report().count() == 20
    assert model.state_report().count() == 14
    assert model.priority_categories().count() == 5


def test_summary_document_equals_the_checked_reports(model):
    doc = json.loads(model.summary_document().collect()[0]["summary_json"])

    def norm(v):
        return float(v) if isinstance(v, Decimal) else v

    kpi = model.kpi_extended().collect()[0].asDict()
    assert {k: norm(v) for k, v in kpi.items()} == {k: norm(v) for k, v in doc["kpis"].items()}

    f = model.findings_summary().collect()[0]
    for key in ("late_delivery_review_gap", "very_late_low_review_multiplier", "top_10_category_gmv_share"):
        assert doc["findings"][key] == f[key]

    cats = [r.asDict() for r in model.priority_categories(limit=8).collect()]
    assert [c["category"] for c in cats] == [c["category"] for c in doc["findings"]["priority_categories"]]

    states = [
        r.asDict()
        for r in model.state_performance()
        .where("orders >= 500")
        .orderBy(F.desc("freight_burden"), "customer_state")
        .limit(8)
        .collect()
    ]
    got_states = doc["findings"]["high_freight_states"]
    assert [s["customer_state"] for s in states] == [s["customer_state"] for s in got_states]
    assert [s["freight_burden"] for s in states] == [s["freight_burden"] for s in got_states]

    sellers = [r.asDict() for r in model.priority_sellers(limit=10).collect()]
    assert [s["seller_id"] for s in sellers] == [s["seller_id"] for s in doc["findings"]["priority_sellers"]]

    risk = model.seller_risk_summary().collect()[0].asDict()
    assert {k: norm(v) for k, v in risk.items()} == {k: norm(v) for k, v in doc["findings"]["seller_risk"].items()}


def test_quality_checks_find_the_adapted_faults(model):
    """Counts by the adapter's own rules, over the source rows."""
    rows = dict((r["table_name"], r["rows_loaded"]) for r in model.dq_row_counts().collect())
    orders = range(rows["orders"])
    no_customer = sum(k % 211 == 0 or k % 499 == 0 for k in orders)
    assert model.dq_orphan_orders().first()["orders_without_customers"] == no_customer
    nulls = {(r["table_name"], r["column_name"]): r["null_rows"] for r in model.dq_not_null().collect()}
    assert nulls["orders", "customer_id"] == sum(k % 499 == 0 for k in orders)
    assert nulls["order_items", "order_id"] > 0
    items = model.t("order_items")
    assert model.dq_orphan_items().first()["items_without_orders"] == items.where("order_id IS NULL OR order_id < 0").count()
    scores = range(rows["order_reviews"])
    assert model.dq_invalid_scores().first()["invalid_review_scores"] == sum(k % 113 == 0 or k % 127 == 0 for k in scores)
    dup = {(r["table_name"], r["key_columns"]): r["duplicate_keys"] for r in model.dq_duplicate_keys().collect()}
    assert dup["order_items", "order_id,order_item_id"] > 0
    assert dup["orders", "order_id"] == 0 and dup["orders", "customer_id"] == 1  # the NULL customers
    assert all(r["duplicate_keys"] == 0 for r in model.dq_join_keys().collect())
    audit = {(r["table_name"], r["metric"]): r["value"] for r in model.dq_file_audit().collect() if r["column_name"] is None}
    assert audit["geolocation", "duplicate_rows"] > 0


def test_flat_summary_has_the_document(model):
    doc = json.loads(model.summary_document().first()["summary_json"])
    flat = model.summary_rows().collect()
    lists = {}
    for r in flat:
        if r["rank"]:
            lists.setdefault((r["section"], r["rank"]), r["key"])
    for section, key in (("priority_categories", "category"), ("high_freight_states", "customer_state"), ("priority_sellers", "seller_id")):
        assert [lists[section, i + 1] for i in range(len(doc["findings"][section]))] == [str(x[key]) for x in doc["findings"][section]]


def test_seller_report_is_ranked_flags_first(model):
    rows = model.seller_report().collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    keys = [(not r["priority_flag"], -r["low_review_orders"], -r["orders"], r["seller_id"]) for r in rows]
    assert keys == sorted(keys) and rows[0]["priority_flag"] and not rows[-1]["priority_flag"]


def test_limits_of_zero(model):
    assert model.state_report(limit=0).count() == 0
    assert model.priority_sellers(limit=0).count() == 0
    assert model.priority_categories(limit=0).count() == 0
