"""Edge cases of the order model (FIXTURES.md section C)."""

from __future__ import annotations

import pytest

from builders import build_model, customer, item, order, payment, review, rows_by
from orderscope.plans.commerce import ModelParams


def fact_rows(model):
    return rows_by(model.order_fact(), "order_id")


# ------------------------------------------------------------------ latest review


def test_review_tie_larger_id_wins(spark):
    m = build_model(
        spark,
        orders=[order("o1")],
        reviews=[review("a", "o1", 5, "2018-01-06 00:00:00"), review("b", "o1", 1, "2018-01-06 00:00:00")],
    )
    assert rows_by(m.latest_review(), "order_id")["o1"]["review_score"] == 1


def test_review_null_answer_time_loses(spark):
    m = build_model(
        spark,
        orders=[order("o1")],
        reviews=[review("a", "o1", 1, None), review("b", "o1", 5, "2018-01-01 00:00:00")],
    )
    assert rows_by(m.latest_review(), "order_id")["o1"]["review_score"] == 5


def test_review_all_answer_times_null_larger_id_wins(spark):
    m = build_model(
        spark,
        orders=[order("o1")],
        reviews=[review("a", "o1", 4, None), review("b", "o1", 2, None)],
    )
    assert rows_by(m.latest_review(), "order_id")["o1"]["review_score"] == 2


def test_newest_review_with_null_score_is_kept(spark):
    m = build_model(
        spark,
        orders=[order("o1")],
        reviews=[review("a", "o1", 4, "2018-01-01 00:00:00"), review("b", "o1", None, "2018-01-02 00:00:00")],
    )
    row = fact_rows(m)["o1"]
    assert row["review_score"] is None
    assert row["low_review"] == 0


def test_order_without_review_in_low_rate_denominator_not_in_average(spark):
    m = build_model(
        spark,
        orders=[order("o1"), order("o2")],
        reviews=[review("a", "o1", 1)],
    )
    k = m.kpi_extended().collect()[0]
    assert k["average_review_score"] == 1.0
    assert k["low_review_rate"] == 0.5
    assert k["review_coverage"] == 0.5


# --------------------------------------------------------------------- lateness


def test_calendar_date_lateness(spark):
    m = build_model(
        spark,
        orders=[
            order("on_day", delivered="2018-01-10 23:59:59", estimated="2018-01-10 00:00:00"),
            order("next_day", delivered="2018-01-11 00:00:00", estimated="2018-01-10 00:00:00"),
        ],
    )
    f = fact_rows(m)
    assert (f["on_day"]["delay_days"], f["on_day"]["is_late"]) == (0, 0)
    assert (f["next_day"]["delay_days"], f["next_day"]["is_late"]) == (1, 1)


def test_delay_bucket_boundaries(spark):
    delays = [-1, 0, 1, 3, 4, 7, 8]
    orders = [
        order(f"d{d}", delivered=f"2018-01-{11 + d:02d} 12:00:00", estimated="2018-01-11 00:00:00")
        for d in delays
    ]
    m = build_model(spark, orders=orders)
    got = {r["bucket_order"]: r["orders"] for r in m.delay_impact().collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: 1}
    labels = [r["delay_bucket"] for r in m.delay_impact().orderBy("bucket_order").collect()]
    assert labels == ["On time / early", "1-3 days late", "4-7 days late", "8+ days late"]


def test_null_promised_date_is_unknown_not_very_late(spark):
    m = build_model(spark, orders=[order("o1", estimated=None), order("o2")])
    got = rows_by(m.delay_impact(), "delay_bucket")
    assert got["unknown"]["orders"] == 1
    assert got["8+ days late"]["orders"] == 0
    assert fact_rows(m)["o1"]["is_late"] == 0
    assert sum(r["orders"] for r in got.values()) == 2


def test_empty_bucket_has_zero_orders(spark):
    m = build_model(spark, orders=[order("o1")])
    got = rows_by(m.delay_impact(), "delay_bucket")
    assert len(got) == 4
    assert got["4-7 days late"]["orders"] == 0
    assert got["4-7 days late"]["average_review"] is None


def test_delivered_days_exact_and_hour_variant(spark):
    m = build_model(
        spark, orders=[order("o1", purchase="2018-01-01 00:00:00", delivered="2018-01-01 23:59:00")]
    )
    row = fact_rows(m)["o1"]
    assert row["delivered_days"] == pytest.approx(0.999305555, abs=1e-8)
    assert row["delivered_days_hours"] == 23 / 24


# --------------------------------------------------------------- delivered base


def test_all_prices_null_not_in_delivered_base(spark):
    m = build_model(
        spark,
        orders=[order("o1"), order("o2")],
        items=[item("o1", price=None, freight=None), item("o2")],
    )
    assert fact_rows(m)["o1"]["merchandise_gmv"] is None
    assert [r["order_id"] for r in m.delivered_fact().collect()] == ["o2"]


def test_orphans_counted_and_absent_from_fact(spark):
    m = build_model(
        spark,
        orders=[order("o1"), order("orphan", customer="nobody")],
        customers=[customer("c_o1", "u1")],
        items=[item("o1"), item("ghost")],
    )
    assert m.dq_orphan_orders().collect()[0]["orders_without_customers"] == 1
    assert m.dq_orphan_items().collect()[0]["items_without_orders"] == 1
    assert set(fact_rows(m)) == {"o1"}


def test_null_customer_keys_form_one_group(spark):
    m = build_model(
        spark,
        orders=[order("o1"), order("o2")],
        customers=[customer("c_o1", None, None), customer("c_o2", None, None)],
    )
    rc = m.repeat_customers().collect()[0]
    assert (rc["unique_customers"], rc["repeat_customers"]) == (1, 1)
    states = m.state_performance().collect()
    assert len(states) == 1 and states[0]["customer_state"] is None and states[0]["orders"] == 2


def test_zero_outlay_gives_null_burden(spark):
    m = build_model(spark, orders=[order("o1")], items=[item("o1", price="0.00", freight="0.00")])
    assert fact_rows(m)["o1"]["freight_burden"] is None
    assert m.state_performance().collect()[0]["freight_burden"] is None


def test_fact_does_not_fan_out(spark):
    m = build_model(
        spark,
        orders=[order("o1")],
        items=[item("o1", 1, price="10.00"), item("o1", 2, price="20.00"), item("o1", 3, price="30.00")],
        payments=[payment("o1", 1, value="50.00"), payment("o1", 2, value="13.00")],
        reviews=[review("a", "o1", 5, "2018-01-06 00:00:00"), review("b", "o1", 3, "2018-01-07 00:00:00")],
    )
    rows = m.order_fact().collect()
    assert len(rows) == 1
    r = rows[0]
    assert (str(r["merchandise_gmv"]), r["item_count"], str(r["customer_payment"]), r["review_score"]) == (
        "60.00", 3, "63.00", 3
    )


# ------------------------------------------------------------ categories/sellers


def test_category_fallbacks_are_unknown(spark):
    m = build_model(
        spark,
        orders=[order("o1")],
        items=[
            item("o1", 1, product="untranslated"),
            item("o1", 2, product="missing_product"),
            item("o1", 3, product="no_category"),
            item("o1", 4, product="p1"),
        ],
        products=[
            {"product_id": "p1", "product_category_name": "beleza"},
            {"product_id": "untranslated", "product_category_name": "novo"},
            {"product_id": "no_category", "product_category_name": None},
        ],
    )
    got = rows_by(m.order_category(), "category")
    assert set(got) == {"unknown", "health_beauty"}
    assert got["unknown"]["items"] == 3


def test_attribution_counts_order_once_per_category_and_seller(spark):
    m = build_model(
        spark,
        orders=[order("o1")],
        items=[
            item("o1", 1, product="p1", seller="s1"),
            item("o1", 2, product="p2", seller="s2"),
            item("o1", 3, product="p2", seller="s2"),
        ],
        products=[
            {"product_id": "p1", "product_category_name": "beleza"},
            {"product_id": "p2", "product_category_name": "casa"},
        ],
        sellers=[{"seller_id": "s1", "seller_state": "SP"}, {"seller_id": "s2", "seller_state": "RJ"}],
        translation=[
            {"product_category_name": "beleza", "product_category_name_english": "health_beauty"},
            {"product_category_name": "casa", "product_category_name_english": "housewares"},
        ],
    )
    cats = rows_by(m.category_performance(), "category")
    assert {k: v["orders"] for k, v in cats.items()} == {"health_beauty": 1, "housewares": 1}
    sellers = rows_by(m.seller_performance(), "seller_id")
    assert {k: v["orders"] for k, v in sellers.items()} == {"s1": 1, "s2": 1}
    assert sellers["s2"]["seller_state"] == "RJ"
    pairs = rows_by(m.order_seller(), "seller_id")
    assert pairs["s2"]["items"] == 2


def test_seller_at_benchmark_is_not_flagged(spark):
    # every order late: the seller's late rate equals the overall rate -> not a delay risk
    orders = [order(f"o{i}", delivered="2018-01-20 00:00:00") for i in range(3)]
    m = build_model(spark, ModelParams(min_seller_orders=1), orders=orders)
    s = m.seller_performance().collect()[0]
    assert s["late_delivery_rate"] == 1.0
    assert s["scale_flag"] is True
    assert s["delay_risk_flag"] is False and s["priority_flag"] is False


def test_thresholds_are_inclusive(spark):
    orders = [order(f"a{i}") for i in range(100)] + [order(f"b{i}") for i in range(99)]
    items = [item(f"a{i}", seller="s100") for i in range(100)] + [item(f"b{i}", seller="s99") for i in range(99)]
    customers = [customer(f"c_a{i}", f"ua{i}", "AA") for i in range(100)] + [
        customer(f"c_b{i}", f"ub{i}", "BB") for i in range(99)
    ]
    m = build_model(
        spark,
        ModelParams(min_state_orders=100),
        orders=orders,
        items=items,
        customers=customers,
        sellers=[{"seller_id": "s100", "seller_state": "AA"}, {"seller_id": "s99", "seller_state": "BB"}],
    )
    flags = {r["seller_id"]: r["scale_flag"] for r in m.seller_performance().collect()}
    assert flags == {"s100": True, "s99": False}
    assert [r["customer_state"] for r in m.state_report().collect()] == ["AA"]


def test_priority_categories_median_interpolates(spark):
    # four scaled categories (2 orders each) with GMV 2, 4, 6, 20: the interpolated median
    # is 5, so 6 and 20 qualify and 4 does not (a lower median of 4 would let it in)
    cats = {"k1": "1.00", "k2": "2.00", "k3": "3.00", "k10": "10.00"}
    orders, items, products, translation, reviews = [], [], [], [], []
    for c, price in cats.items():
        products.append({"product_id": f"p_{c}", "product_category_name": c})
        translation.append({"product_category_name": c, "product_category_name_english": c})
        for j in range(2):
            orders.append(order(f"o_{c}_{j}"))
            items.append(item(f"o_{c}_{j}", product=f"p_{c}", price=price))
            reviews.append(review(f"r_{c}_{j}", f"o_{c}_{j}", 1))
    # one well-reviewed order in an unscaled category lifts the overall average above 1
    orders.append(order("o_good"))
    items.append(item("o_good", product="p_good", price="0.50"))
    products.append({"product_id": "p_good", "product_category_name": "good"})
    translation.append({"product_category_name": "good", "product_category_name_english": "good"})
    reviews.append(review("r_good", "o_good", 5))
    m = build_model(
        spark,
        ModelParams(min_category_orders=2),
        orders=orders,
        items=items,
        products=products,
        translation=translation,
        reviews=reviews,
    )
    got = [r["category"] for r in m.priority_categories().collect()]
    assert got == ["k10", "k3"]


def test_findings_recompute_from_reports(spark):
    orders = [
        order("on1", delivered="2018-01-05 00:00:00"),
        order("on2", delivered="2018-01-05 00:00:00"),
        order("late", delivered="2018-01-25 00:00:00"),
    ]
    reviews = [review("a", "on1", 5), review("b", "on2", 1), review("c", "late", 1)]
    m = build_model(spark, orders=orders, reviews=reviews)
    f = m.findings_summary().collect()[0]
    assert f["late_delivery_review_gap"] == pytest.approx(3.0 - 1.0)
    assert f["very_late_low_review_multiplier"] == pytest.approx(1.0 / 0.5)
    assert f["top_10_category_gmv_share"] == pytest.approx(1.0)


def test_times_do_not_depend_on_the_session_zone(spark):
    # 00:45 on 1997-10-06 does not exist in Sao Paulo (DST gap); zone-less values must
    # still give wall-clock differences and labels
    m = build_model(
        spark,
        orders=[order("o1", purchase="1997-10-05 23:30:00", delivered="1997-10-06 00:45:10",
                      estimated="1997-10-06 00:00:00")],
    )
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        row = fact_rows(m)["o1"]
        k = m.kpi_extended().collect()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert row["delivered_seconds"] == 4510
    assert row["delivered_days_hours"] == 1 / 24
    assert row["purchase_month"] == "1997-10"
    assert (row["delay_days"], row["is_late"]) == (0, 0)
    assert k["purchase_date_min"] == "1997-10-05T23:30:00"
