"""The order model: nine raw tables -> one row per order -> delivered-order fact.

Every function is DataFrame(s) -> DataFrame and stays lazy. Items, payments and
reviews are aggregated to the order grain *before* they meet the orders table, so
the star join can never fan out (items x payments x reviews), and every join below
is keyed by ``order_id`` (or by a small dimension key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderscope.functions import metrics as M
from orderscope.functions import timeutil as TU

UNKNOWN_CATEGORY = "unknown"
DELIVERED_STATUS = "delivered"
LOW_REVIEW_MAX = 2


DUPLICATE_KEY = "duplicate join key"


def unique_rows(df: DataFrame, key: str, name: str, partitions: int | None = None) -> DataFrame:
    """``df``, whose rows must differ in ``key``: a value held by two rows fails the query, with
    ``name`` and the value in its message, before it can multiply money in a join.

    Rows with a NULL key are left out: they join with nothing. The rows are grouped by the
    key, which is the exchange and the sort order that the join after it needs anyway. They
    move first: unique keys leave nothing to combine before the exchange, and sorting whole
    scan splits for it would spill. ``partitions`` is their number, if not Spark's.
    """
    others = [c for c in df.columns if c != key]
    row = F.any_value(F.struct(*others)) if others else F.any_value(F.lit(1))
    known = df.where(F.col(key).isNotNull())
    moved = known.repartition(partitions, key) if partitions else known.repartition(F.col(key))
    grouped = moved.groupBy(key).agg(F.count(F.lit(1)).alias("_held"), row.alias("_row"))
    message = F.concat(F.lit(f"{DUPLICATE_KEY} {name}.{key}="), F.col(key).cast("string"))
    single = F.when(F.col("_held") > F.lit(1), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return grouped.where(single).select(*[F.col(key) if c == key else F.col("_row").getField(c).alias(c) for c in df.columns])


def latest_review(reviews: DataFrame) -> DataFrame:
    """One review per order: the most recently answered; ties -> larger review_id.

    A NULL answer time loses to any real one (struct ordering puts NULL lowest), and the
    score of the winner is kept even when it is NULL. ``max_by`` is an ordinary
    aggregate, so it is combined map-side before the shuffle: an order with a huge
    number of reviews costs one row per map task, not one task holding them all.
    """
    return reviews.groupBy("order_id").agg(
        F.max_by("review_score", F.struct("review_answer_timestamp", "review_id")).alias(
            "review_score"
        )
    )


def product_category(products: DataFrame, translation: DataFrame) -> DataFrame:
    """product_id -> English category; 'unknown' when the name or its translation is missing.

    The join strategy is left to Catalyst/AQE: the translation table is a small
    dimension and is broadcast when its measured size is under the broadcast
    threshold, otherwise this is a sort-merge join.
    """
    names = translation.select("product_category_name", "product_category_name_english")
    return (
        unique_rows(products.select("product_id", "product_category_name"), "product_id", "products")
        .join(unique_rows(names, "product_category_name", "category_translation"), "product_category_name", "left")
        .select(
            "product_id",
            F.coalesce("product_category_name_english", F.lit(UNKNOWN_CATEGORY)).alias("category"),
        )
    )


def item_order(items: DataFrame) -> DataFrame:
    """Items per order: merchandise GMV (sum of price), freight, item and seller counts."""
    return items.groupBy("order_id").agg(
        M.money_sum("price").alias("merchandise_gmv"),
        M.money_sum("freight_value").alias("freight_value"),
        F.count(F.lit(1)).alias("item_count"),
        F.count_distinct("seller_id").alias("seller_count"),
    )


def item_order_from_pairs(pairs: DataFrame) -> DataFrame:
    """``item_order`` from the (order, seller) pre-aggregate (``order_seller_money``).

    Sums of the per-pair sums are the per-order sums (NULL only when every price is
    NULL), the item count is the sum of pair counts, and the distinct sellers are the
    pairs with a seller: the same numbers as ``item_order`` without aggregating the
    items a second time.
    """
    return pairs.groupBy("order_id").agg(
        M.money_sum("merchandise_gmv_brl").alias("merchandise_gmv"),
        M.money_sum("freight_value_brl").alias("freight_value"),
        F.sum("items").alias("item_count"),
        F.count("seller_id").alias("seller_count"),
    )


def payment_order(payments: DataFrame) -> DataFrame:
    """Customer payment per order."""
    return payments.groupBy("order_id").agg(M.money_sum("payment_value").alias("customer_payment"))


def order_payment_money(payments: DataFrame) -> DataFrame:
    """(order, payment type) records and value: what both the fact and the payment mix need of
    the payments, however many rows one order has."""
    return payments.groupBy("order_id", "payment_type").agg(
        F.count(F.lit(1)).alias("payment_records"), M.money_sum("payment_value").alias("payment_value")
    )


ORDER_FACT_COLUMNS = [
    "order_id",
    "customer_id",
    "customer_unique_id",
    "customer_zip_code_prefix",
    "customer_city",
    "customer_state",
    "order_status",
    "order_purchase_timestamp",
    "order_approved_at",
    "order_delivered_carrier_date",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
    "merchandise_gmv",
    "freight_value",
    "item_count",
    "seller_count",
    "customer_payment",
    "review_score",
    "delivered_seconds",
    "delivered_days",
    "delivered_days_hours",
    "delay_days",
    "is_late",
    "low_review",
    "customer_outlay",
    "freight_burden",
    "purchase_month",
]
# What outcome_columns() derives from the other columns of the fact.
OUTCOME_COLUMNS = (
    "delivered_seconds",
    "delivered_days",
    "delivered_days_hours",
    "delay_days",
    "is_late",
    "low_review",
    "customer_outlay",
    "freight_burden",
)


def order_fact(
    orders: DataFrame,
    customers: DataFrame,
    items: DataFrame,
    payments: DataFrame,
    reviews: DataFrame,
    low_review_max: int = LOW_REVIEW_MAX,
    item_orders: DataFrame | None = None,
    payment_money: DataFrame | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """One row per order (any status) with its customer, money, review and delivery outcome.

    ``item_orders`` may supply the per-order item aggregate (e.g. built from a stored
    (order, seller) pre-aggregate); by default it is ``item_order(items)``. ``payment_money`` may
    supply ``order_payment_money``; ``partitions`` is the number of buckets of these, which the
    orders meet without a further exchange.

    Orders without a customer row are dropped (inner join); ``dq_orphan_orders`` reports
    them, and ``dq_not_null`` those without an id. An order, an order's customer or a customer
    that occurs twice fails the query (``unique_rows``). Derived columns:
      delivered_seconds / delivered_days  exact elapsed time purchase -> delivery
      delivered_days_hours                whole hours / 24 (the SQL-dialect variant)
      delay_days                          delivery date - promised date, in calendar days
      is_late                             delivered on a later calendar date than promised
      low_review                          latest score <= 2; no review counts as 0
      customer_outlay / freight_burden    GMV + freight, and freight's share of it
    """
    o = orders.select(
        "order_id",
        "customer_id",
        "order_status",
        "order_purchase_timestamp",
        "order_approved_at",
        "order_delivered_carrier_date",
        "order_delivered_customer_date",
        "order_estimated_delivery_date",
    )
    c = customers.select(
        "customer_id", "customer_unique_id", "customer_zip_code_prefix", "customer_city", "customer_state"
    )
    known = unique_rows(c, "customer_id", "customers", partitions)
    both = unique_rows(o, "customer_id", "orders", partitions).join(known, "customer_id", "inner")
    rows = (
        unique_rows(both, "order_id", "orders", partitions)
        .join(item_orders if item_orders is not None else item_order(items), "order_id", "left")
        .join(payment_order(payments if payment_money is None else payment_money), "order_id", "left")
        .join(latest_review(reviews), "order_id", "left")
        .withColumn("purchase_month", TU.month_key(F.col("order_purchase_timestamp")))
    )
    return outcome_columns(rows, low_review_max)


def outcome_columns(rows: DataFrame, low_review_max: int = LOW_REVIEW_MAX) -> DataFrame:
    """The order fact from its rows without ``OUTCOME_COLUMNS``, which follow from the others:
    rows that move need not carry them."""
    purchased = F.col("order_purchase_timestamp")
    delivered = F.col("order_delivered_customer_date")
    promised = F.col("order_estimated_delivery_date")
    fact = (
        rows.withColumns(
            {
                "delivered_seconds": TU.seconds_between(purchased, delivered),
                "delivered_days_hours": TU.hours_between(purchased, delivered) / F.lit(24.0),
                "delay_days": TU.calendar_days_between(promised, delivered),
                "is_late": M.flag(F.to_date(delivered) > F.to_date(promised)),
                "low_review": M.flag(F.col("review_score") <= F.lit(low_review_max)),
                "customer_outlay": (F.col("merchandise_gmv") + F.col("freight_value")).cast(
                    M.MONEY_SUM_TYPE
                ),
            }
        )
        .withColumns(
            {
                "delivered_days": F.col("delivered_seconds") / F.lit(M.SECONDS_PER_DAY),
                "freight_burden": M.ratio("freight_value", "customer_outlay"),
            }
        )
    )
    return fact.select(*ORDER_FACT_COLUMNS)


def is_delivered() -> Column:
    """The delivered-base condition on order-fact columns."""
    return (
        (F.col("order_status") == F.lit(DELIVERED_STATUS))
        & F.col("order_delivered_customer_date").isNotNull()
        & F.col("merchandise_gmv").isNotNull()
    )


def delivered_fact(fact: DataFrame) -> DataFrame:
    """The delivered base: status delivered, a delivery time, and at least one priced item.

    Catalyst turns the GMV test into an inner join with the item aggregate and pushes
    the status / date tests into the orders scan.
    """
    return fact.where(is_delivered())


def order_outcomes(delivered: DataFrame) -> DataFrame:
    """The customer outcome of each delivered order (unique on order_id)."""
    return delivered.select("order_id", "is_late", "review_score", "low_review")


def _item_money() -> list:
    return [
        M.money_sum("price").alias("merchandise_gmv_brl"),
        M.money_sum("freight_value").alias("freight_value_brl"),
        F.count(F.lit(1)).alias("items"),
    ]


def category_items(items: DataFrame, categories: DataFrame) -> DataFrame:
    """The items' money with the category of their product."""
    detail = items.select("order_id", "product_id", "price", "freight_value").join(categories, "product_id", "left")
    return detail.select(
        "order_id", F.coalesce("category", F.lit(UNKNOWN_CATEGORY)).alias("category"), "price", "freight_value"
    )


def order_category_money(detail: DataFrame) -> DataFrame:
    """(order, category) money and item counts of ``category_items``."""
    return detail.groupBy("order_id", "category").agg(*_item_money())


def order_category(
    items: DataFrame,
    products: DataFrame,
    translation: DataFrame,
    delivered: DataFrame,
    categories: DataFrame | None = None,
    outcomes: DataFrame | None = None,
) -> DataFrame:
    """(order, category) money and item counts, with the order's outcome attached.

    Items are reduced to the (order, category) grain before meeting the outcomes, so
    each order's outcome counts once per category it contains. ``categories`` and ``outcomes``
    may supply a stored ``product_category`` and ``order_outcomes``.
    """
    detail = category_items(items, product_category(products, translation) if categories is None else categories)
    per_pair = order_category_money(detail)
    return per_pair.join(order_outcomes(delivered) if outcomes is None else outcomes, "order_id", "inner")


def order_seller_money(items: DataFrame) -> DataFrame:
    """(order, seller) money and item counts."""
    return items.groupBy("order_id", "seller_id").agg(*_item_money())


def order_seller_outcomes(pairs: DataFrame, delivered: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """(order, seller) money (``order_seller_money``) with the order's outcome attached
    (delivered orders only)."""
    return pairs.join(order_outcomes(delivered) if outcomes is None else outcomes, "order_id", "inner")


def order_seller(
    items: DataFrame,
    sellers: DataFrame,
    delivered: DataFrame,
    pairs: DataFrame | None = None,
    outcomes: DataFrame | None = None,
) -> DataFrame:
    """(order, seller) money with the order's outcome and the seller's state.

    ``pairs`` and ``outcomes`` may supply a stored ``order_seller_money`` and
    ``order_outcomes``; by default they are computed.
    """
    money = pairs if pairs is not None else order_seller_money(items)
    return (
        order_seller_outcomes(money, delivered, outcomes)
        .join(unique_rows(sellers.select("seller_id", "seller_state"), "seller_id", "sellers"), "seller_id", "left")
        .select(
            "order_id",
            "seller_id",
            "seller_state",
            "merchandise_gmv_brl",
            "freight_value_brl",
            "items",
            "is_late",
            "review_score",
            "low_review",
        )
    )


def customer_orders(delivered: DataFrame) -> DataFrame:
    """Delivered orders per customer (customer_unique_id, never the per-order customer_id)."""
    return delivered.groupBy("customer_unique_id").agg(F.count(F.lit(1)).alias("orders"))
