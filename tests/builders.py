"""Hand-made tables for edge-case tests (raw schemas, string ids)."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from orderscope.plans.commerce import CommerceModel, ModelParams
from orderscope.schemas import TABLES

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


def ts(text: str | None) -> datetime | None:
    return None if text is None else datetime.fromisoformat(text)


def money(text: str | None) -> Decimal | None:
    return None if text is None else Decimal(text)


def order(oid, status="delivered", purchase="2018-01-01 10:00:00",
          delivered="2018-01-05 10:00:00", estimated="2018-01-10 00:00:00", customer=None):
    return {
        "order_id": oid,
        "customer_id": customer or f"c_{oid}",
        "order_status": status,
        "order_purchase_timestamp": ts(purchase),
        "order_delivered_customer_date": ts(delivered),
        "order_estimated_delivery_date": ts(estimated),
    }


def customer(cid, unique="u", state="SP"):
    return {"customer_id": cid, "customer_unique_id": unique, "customer_state": state}


def item(oid, n=1, product="p1", seller="s1", price="10.00", freight="1.00"):
    return {
        "order_id": oid,
        "order_item_id": n,
        "product_id": product,
        "seller_id": seller,
        "price": money(price),
        "freight_value": money(freight),
    }


def payment(oid, seq=1, kind="credit_card", value="11.00"):
    return {"order_id": oid, "payment_sequential": seq, "payment_type": kind, "payment_value": money(value)}


def review(rid, oid, score, answered="2018-01-06 00:00:00"):
    return {"review_id": rid, "order_id": oid, "review_score": score, "review_answer_timestamp": ts(answered)}


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def frame(spark: SparkSession, table: str, rows: list[dict]) -> DataFrame:
    schema = _nullable(TABLES[table].schema)
    data = [tuple(r.get(f.name) for f in schema.fields) for r in rows]
    return spark.createDataFrame(data, schema)


def build_tables(
    spark: SparkSession,
    orders: list[dict],
    customers: list[dict] | None = None,
    items: list[dict] | None = None,
    payments: list[dict] | None = None,
    reviews: list[dict] | None = None,
    products: list[dict] | None = None,
    sellers: list[dict] | None = None,
    translation: list[dict] | None = None,
) -> dict[str, DataFrame]:
    if customers is None:
        customers = [customer(o["customer_id"], unique=f"u_{o['order_id']}") for o in orders]
    if items is None:
        items = [item(o["order_id"]) for o in orders]
    if products is None:
        products = [{"product_id": "p1", "product_category_name": "beleza"}]
    if sellers is None:
        sellers = [{"seller_id": "s1", "seller_state": "SP"}]
    if translation is None:
        translation = [{"product_category_name": "beleza", "product_category_name_english": "health_beauty"}]
    return {
        "orders": frame(spark, "orders", orders),
        "customers": frame(spark, "customers", customers),
        "order_items": frame(spark, "order_items", items),
        "order_payments": frame(spark, "order_payments", payments or []),
        "order_reviews": frame(spark, "order_reviews", reviews or []),
        "products": frame(spark, "products", products),
        "sellers": frame(spark, "sellers", sellers),
        "category_translation": frame(spark, "category_translation", translation),
    }


def build_model(spark: SparkSession, params: ModelParams | None = None, **kw) -> CommerceModel:
    return CommerceModel(build_tables(spark, **kw), params or ModelParams())


def rows_by(df: DataFrame, key: str) -> dict:
    return {r[key]: r for r in df.collect()}
