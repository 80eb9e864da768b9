"""The batch jobs end to end on a tiny raw CSV folder."""

from __future__ import annotations

import os

import pytest

from orderscope.__main__ import main as cli_main
from orderscope.plans.jobs import run_build, run_file_audit
from orderscope.sources.sinks import read_manifest
from test_quality_io import CSV_PRODUCTS, CSV_REVIEWS

RAW = {
    "customers.csv": (
        "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\n"
        "c1,u1,1001,sao paulo,SP\nc2,u2,2002,rio,RJ\n"
    ),
    "orders.csv": (
        "order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,"
        "order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date\n"
        "o1,c1,delivered,2018-01-01 10:00:00,2018-01-01 11:00:00,2018-01-02 10:00:00,"
        "2018-01-05 10:00:00,2018-01-10 00:00:00\n"
        "o2,c2,delivered,2018-01-02 10:00:00,,,2018-01-20 10:00:00,2018-01-10 00:00:00\n"
    ),
    "order_items.csv": (
        "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\n"
        "o1,1,p1,s1,2018-01-03 00:00:00,10.00,1.50\no2,1,p2,s1,2018-01-03 00:00:00,20.00,2.50\n"
    ),
    "order_payments.csv": (
        "order_id,payment_sequential,payment_type,payment_installments,payment_value\n"
        "o1,1,credit_card,1,11.50\no2,1,boleto,1,22.50\n"
    ),
    "order_reviews.csv": CSV_REVIEWS,
    "products.csv": CSV_PRODUCTS,
    "sellers.csv": "seller_id,seller_zip_code_prefix,seller_city,seller_state\ns1,3003,curitiba,PR\n",
    "category_translation.csv": (
        "product_category_name,product_category_name_english\nbeleza,health_beauty\n"
    ),
    "geolocation.csv": (
        "geolocation_zip_code_prefix,geolocation_lat,geolocation_lng,geolocation_city,geolocation_state\n"
        "1001,-23.5,-46.6,sao paulo,SP\n1001,-23.5,-46.6,sao paulo,SP\n"
    ),
}


@pytest.fixture()
def raw_dir(tmp_dir):
    d = os.path.join(tmp_dir, "raw")
    os.makedirs(d)
    for name, text in RAW.items():
        with open(os.path.join(d, name), "w", encoding="utf-8") as fh:
            fh.write(text)
    return d


def _read(spark, path):
    return spark.read.option("header", True).csv(path)


def test_file_audit_sees_files_as_they_are(spark, raw_dir, tmp_dir):
    path = run_file_audit(spark, raw_dir, os.path.join(tmp_dir, "out"))
    got = {(r["table_name"], r["metric"], r["column_name"]): int(r["value"]) for r in _read(spark, path).collect()}
    assert got[("geolocation.csv", "rows", None)] == 2
    assert got[("geolocation.csv", "duplicate_rows", None)] == 1
    assert got[("products.csv", "column", "product_name_lenght")] == 3
    assert got[("products.csv", "nulls", "product_category_name")] == 1
    assert got[("orders.csv", "nulls", "order_approved_at")] == 1
    assert len({k[0] for k in got}) == 9


def test_build_lands_checks_and_writes_reports(spark, raw_dir, tmp_dir):
    out = os.path.join(tmp_dir, "out")
    written = run_build(spark, raw_dir, os.path.join(tmp_dir, "landed"), out)
    kpi = _read(spark, written["kpi_extended"]).collect()[0]
    assert kpi["delivered_orders"] == "2" and kpi["orders_all_statuses"] == "2"
    assert _read(spark, written["delay_impact"]).count() == 4
    orphans = _read(spark, written["quality/dq_orphan_items"]).collect()[0]
    assert orphans["items_without_orders"] == "0"
    states = {r["customer_state"] for r in _read(spark, written["state_performance"]).collect()}
    assert states == {"SP", "RJ"}


def test_cli_audit(spark, raw_dir, tmp_dir, capsys):
    cli_main(["audit", raw_dir, os.path.join(tmp_dir, "cli")])
    assert "data_audit" in capsys.readouterr().out


def test_cli_build_with_file_name_map(spark, raw_dir, tmp_dir, capsys):
    os.rename(os.path.join(raw_dir, "sellers.csv"), os.path.join(raw_dir, "vendors_export.csv"))
    out = os.path.join(tmp_dir, "cli_out")
    cli_main(["build", "--raw", raw_dir, "--strict", "--file", "sellers=vendors_export.csv",
              os.path.join(tmp_dir, "cli_landed"), out])
    printed = capsys.readouterr().out
    assert "seller_performance" in printed
    sellers = _read(spark, read_manifest(spark, out)["seller_performance"]).collect()
    assert [r["seller_state"] for r in sellers] == ["PR"]
