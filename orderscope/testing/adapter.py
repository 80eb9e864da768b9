"""Shape the driver's TPC-H-ish test tables into the nine commerce tables.

Used by ``__spark_entry__`` and the tests only; the library itself reads real data
through ``orderscope.sources``. Every expression is deterministic and independent of
the scale factor, so the same rules are written once more in DuckDB SQL
(``orderscope.testing.oracle``) for the independent check. Keys stay numeric (long).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderscope.session import scratch_path
from orderscope.sources.csv import read_csv_fields

SOURCE_TABLES = ("nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _null(dtype: str) -> Column:
    return F.lit(None).cast(dtype)


def read_source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def adapt_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The nine tables (lazy DataFrames) in the raw schemas' column order."""
    src = {name: read_source(spark, sf_dir, name) for name in SOURCE_TABLES}
    nation = src["nation"].select("n_nationkey", "n_name")
    o = src["orders"]
    key = F.col("o_orderkey")
    day = F.col("o_orderdate")

    orders = o.select(
        key.alias("order_id"),
        F.when(key % 499 != 0, key).alias("customer_id"),
        F.when((F.col("o_orderstatus") == F.lit("P")) & (key % 4 == 0), F.lit("shipped"))
        .otherwise(F.lit("delivered"))
        .alias("order_status"),
        F.timestamp_add("SECOND", key * 7919 % 86400, day).alias("order_purchase_timestamp"),
        _null("timestamp_ntz").alias("order_approved_at"),
        _null("timestamp_ntz").alias("order_delivered_carrier_date"),
        F.when(key % 37 == 0, _null("timestamp_ntz"))
        .otherwise(
            F.timestamp_add(
                "SECOND", key * 6151 % 86400, F.timestamp_add("DAY", F.lit(3) + key * 7 % 31, day)
            )
        )
        .alias("order_delivered_customer_date"),
        F.when(key % 61 != 0, F.timestamp_add("DAY", F.lit(24), day)).alias("order_estimated_delivery_date"),
    )

    cust_nation = src["customer"].select("c_custkey", "c_nationkey").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey"), "left"
    )
    customers = o.where(key % 211 != 0).select("o_orderkey", "o_custkey").join(
        cust_nation, F.col("o_custkey") == F.col("c_custkey"), "left"
    ).select(
        F.col("o_orderkey").alias("customer_id"),
        (F.col("o_custkey") * 100 + F.col("o_orderkey") % 97).alias("customer_unique_id"),
        _null("int").alias("customer_zip_code_prefix"),
        _null("string").alias("customer_city"),
        F.col("n_name").alias("customer_state"),
    )

    geolocation = src["customer"].select("c_nationkey").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey"), "inner"
    ).select(
        F.col("c_nationkey").alias("geolocation_zip_code_prefix"),
        _null("decimal(10,7)").alias("geolocation_lat"),
        _null("decimal(10,7)").alias("geolocation_lng"),
        _null("string").alias("geolocation_city"),
        F.col("n_name").alias("geolocation_state"),
    )

    price = F.col("l_extendedprice").cast("decimal(12,2)")
    line, number = F.col("l_orderkey"), F.col("l_linenumber")
    items = src["lineitem"].select(
        F.when((line % 401 == 0) & (number == 1), _null("long"))
        .when(line % 307 == 0, -line)
        .otherwise(line)
        .alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_shipdate").alias("shipping_limit_date"),
        F.when(line % 43 != 0, price).alias("price"),
        F.when(
            (line % 47 != 0) & ~((line % 53 == 0) & (number == 1)),
            (price * F.col("l_tax").cast("decimal(3,2)")).cast("decimal(12,2)"),
        ).alias("freight_value"),
    )

    first = o.select(
        key.alias("order_id"),
        F.lit(1).alias("payment_sequential"),
        F.lower("o_orderpriority").alias("payment_type"),
        F.lit(1).alias("payment_installments"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("payment_value"),
    )
    voucher = o.where(key % 20 == 0).select(
        key.alias("order_id"),
        F.lit(2).alias("payment_sequential"),
        F.lit("voucher").alias("payment_type"),
        F.lit(1).alias("payment_installments"),
        F.lit("10.50").cast("decimal(12,2)").alias("payment_value"),
    )
    payments = first.unionByName(voucher)

    ev = src["events"]
    eid = F.col("event_id")
    reviews = ev.select(
        eid.alias("review_id"),
        F.when(eid % 10 == 9, eid - 1).otherwise(eid).alias("order_id"),
        F.when(eid % 113 == 0, F.lit(0))
        .when(eid % 127 == 0, F.lit(6))
        .when(eid % 131 != 0, (F.lit(1) + F.floor("value") % 5).cast("int"))
        .alias("review_score"),
        _null("string").alias("review_comment_title"),
        _null("string").alias("review_comment_message"),
        F.col("ts").alias("review_creation_date"),
        F.when(eid % 100 == 9, _null("timestamp_ntz"))
        .otherwise(F.col("ts"))
        .alias("review_answer_timestamp"),
    )

    part = src["part"]
    products = part.select(
        F.col("p_partkey").alias("product_id"),
        F.when(F.col("p_partkey") % 53 == 0, _null("string"))
        .otherwise(F.col("p_brand"))
        .alias("product_category_name"),
        _null("int").alias("product_name_length"),
        _null("int").alias("product_description_length"),
        _null("int").alias("product_photos_qty"),
        _null("decimal(12,2)").alias("product_weight_g"),
        _null("decimal(12,2)").alias("product_length_cm"),
        _null("decimal(12,2)").alias("product_height_cm"),
        _null("decimal(12,2)").alias("product_width_cm"),
    )

    # Fixed value: the one brand left out of the translation table (a missing translation).
    untranslated = "Brand#7"
    translation = (
        part.select("p_brand")
        .where(F.col("p_brand") != F.lit(untranslated))
        .distinct()
        .select(
            F.col("p_brand").alias("product_category_name"),
            F.concat(F.lit("cat_"), F.lower("p_brand")).alias("product_category_name_english"),
        )
    )

    sellers = src["supplier"].select("s_suppkey", "s_nationkey").join(
        nation, F.col("s_nationkey") == F.col("n_nationkey"), "left"
    ).select(
        F.col("s_suppkey").alias("seller_id"),
        _null("int").alias("seller_zip_code_prefix"),
        _null("string").alias("seller_city"),
        F.col("n_name").alias("seller_state"),
    )

    return {
        "customers": customers,
        "geolocation": geolocation,
        "order_items": items,
        "order_payments": payments,
        "order_reviews": reviews,
        "orders": orders,
        "products": products,
        "sellers": sellers,
        "category_translation": translation,
    }


def adapted_raw_lines(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """CSV text (column ``value``, no header) of items, payments and reviews, one line for each
    line item, order and event, with what no file should hold: words, a comma for the decimal
    point, more digits than a column has, a third decimal, impossible times, missing and
    surplus fields; and, rightly, empty fields and quoted commas, quotes and newlines."""

    def line(*fields: Column) -> Column:
        return F.concat_ws(",", *fields)

    key, number = F.col("l_orderkey"), F.col("l_linenumber")
    price = F.when(key % 10 == 0, "abc").when(key % 10 == 1, "10,00").when(key % 10 == 2, "99999999999.00").when(key % 10 == 3, "").otherwise("12.50")
    freight = F.when(number == 2, "").when(number == 3, "1.005").otherwise("7")
    limit = F.when(key % 19 == 0, "not a date").when(key % 23 == 0, "").otherwise("2018-01-03 00:00:00")
    start = line(key.cast("string"), number.cast("string"), F.lit("p"), F.lit("s"), limit, price)
    items = read_source(spark, sf_dir, "lineitem").select(F.when(key % 17 == 0, start).otherwise(line(start, freight)).alias("value"))

    key = F.col("o_orderkey")
    value = F.when(key % 13 == 0, '"1,5"').otherwise(F.col("o_totalprice").cast("decimal(12,2)").cast("string"))
    parts = F.when(key % 29 == 0, "one").otherwise("1")
    start = line(key.cast("string"), F.lit("1"), F.lower("o_orderpriority"), parts, value)
    payments = read_source(spark, sf_dir, "orders").select(F.when(key % 11 == 0, line(start, F.lit("surplus"))).otherwise(start).alias("value"))

    key = F.col("event_id")
    score = F.when(key % 7 == 0, "five").otherwise("5")
    message = F.when(key % 3 == 0, '"one, ""two""\nand three"').otherwise("plain")
    answered = F.when(key % 5 == 0, "2018-13-01 00:00:00").otherwise("2018-01-02 10:00:00")
    start = line(key.cast("string"), key.cast("string"), score, F.lit(""), message)
    reviews = read_source(spark, sf_dir, "events").select(
        F.when(key % 31 == 0, start).otherwise(line(start, F.lit("2018-01-01 00:00:00"), answered)).alias("value")
    )
    return {"order_items": items, "order_payments": payments, "order_reviews": reviews}


def raw_fields(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """``adapted_raw_lines`` written as CSV files and read as the ingest reads them."""
    folder = scratch_path(spark, "raw-csv")
    fields = {}
    for name, lines in adapted_raw_lines(spark, sf_dir).items():
        lines.write.text(f"{folder}/{name}")
        fields[name] = read_csv_fields(spark, f"{folder}/{name}", name, header=False)
    return fields
