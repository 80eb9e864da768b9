"""Table registry: typed schemas, keys and NOT NULL columns of the nine raw tables.

The schemas are what the CSV ingest job enforces (columns are mapped by position,
so a misspelt header in a file is harmless). Keys and NOT NULL columns are not
storage constraints here; the data-quality jobs in ``operators.quality`` check them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)
COORD = T.DecimalType(10, 7)
TS = T.TimestampNTZType()


def _f(name: str, dtype: T.DataType, nullable: bool = True) -> T.StructField:
    return T.StructField(name, dtype, nullable)


@dataclass(frozen=True)
class TableSpec:
    name: str
    schema: T.StructType
    primary_key: tuple[str, ...] = ()
    not_null: tuple[str, ...] = ()
    # extra keys some join requires to be unique (one-to-one / many-to-one merges)
    unique_keys: tuple[tuple[str, ...], ...] = field(default_factory=tuple)

    @property
    def file_name(self) -> str:
        """Default raw file name, ``<table>.csv``; other layouts pass a name map to the ingest."""
        return f"{self.name}.csv"

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.schema.fields]

    def required_columns(self) -> tuple[str, ...]:
        """NOT NULL columns, including the primary key columns (a key implies NOT NULL)."""
        out: list[str] = []
        for c in (*self.primary_key, *self.not_null):
            if c not in out:
                out.append(c)
        return tuple(out)


CUSTOMERS = TableSpec(
    "customers",
    T.StructType([
        _f("customer_id", T.StringType(), False),
        _f("customer_unique_id", T.StringType(), False),
        _f("customer_zip_code_prefix", T.IntegerType()),
        _f("customer_city", T.StringType()),
        _f("customer_state", T.StringType()),
    ]),
    primary_key=("customer_id",),
    not_null=("customer_unique_id",),
)

GEOLOCATION = TableSpec(
    "geolocation",
    T.StructType([
        _f("geolocation_zip_code_prefix", T.IntegerType()),
        _f("geolocation_lat", COORD),
        _f("geolocation_lng", COORD),
        _f("geolocation_city", T.StringType()),
        _f("geolocation_state", T.StringType()),
    ]),
)

ORDER_ITEMS = TableSpec(
    "order_items",
    T.StructType([
        _f("order_id", T.StringType(), False),
        _f("order_item_id", T.IntegerType(), False),
        _f("product_id", T.StringType(), False),
        _f("seller_id", T.StringType(), False),
        _f("shipping_limit_date", TS),
        _f("price", MONEY),
        _f("freight_value", MONEY),
    ]),
    primary_key=("order_id", "order_item_id"),
    not_null=("order_id", "order_item_id", "product_id", "seller_id"),
)

ORDER_PAYMENTS = TableSpec(
    "order_payments",
    T.StructType([
        _f("order_id", T.StringType(), False),
        _f("payment_sequential", T.IntegerType(), False),
        _f("payment_type", T.StringType()),
        _f("payment_installments", T.IntegerType()),
        _f("payment_value", MONEY),
    ]),
    primary_key=("order_id", "payment_sequential"),
    not_null=("order_id", "payment_sequential"),
)

ORDER_REVIEWS = TableSpec(
    "order_reviews",
    T.StructType([
        _f("review_id", T.StringType(), False),
        _f("order_id", T.StringType(), False),
        _f("review_score", T.IntegerType()),
        _f("review_comment_title", T.StringType()),
        _f("review_comment_message", T.StringType()),
        _f("review_creation_date", TS),
        _f("review_answer_timestamp", TS),
    ]),
    not_null=("review_id", "order_id"),
)

ORDERS = TableSpec(
    "orders",
    T.StructType([
        _f("order_id", T.StringType(), False),
        _f("customer_id", T.StringType(), False),
        _f("order_status", T.StringType()),
        _f("order_purchase_timestamp", TS),
        _f("order_approved_at", TS),
        _f("order_delivered_carrier_date", TS),
        _f("order_delivered_customer_date", TS),
        _f("order_estimated_delivery_date", TS),
    ]),
    primary_key=("order_id",),
    not_null=("customer_id",),
    # orders -> customers is merged one-to-one, so customer_id must be unique too
    unique_keys=(("customer_id",),),
)

PRODUCTS = TableSpec(
    "products",
    T.StructType([
        _f("product_id", T.StringType(), False),
        _f("product_category_name", T.StringType()),
        _f("product_name_length", T.IntegerType()),
        _f("product_description_length", T.IntegerType()),
        _f("product_photos_qty", T.IntegerType()),
        _f("product_weight_g", MONEY),
        _f("product_length_cm", MONEY),
        _f("product_height_cm", MONEY),
        _f("product_width_cm", MONEY),
    ]),
    primary_key=("product_id",),
)

SELLERS = TableSpec(
    "sellers",
    T.StructType([
        _f("seller_id", T.StringType(), False),
        _f("seller_zip_code_prefix", T.IntegerType()),
        _f("seller_city", T.StringType()),
        _f("seller_state", T.StringType()),
    ]),
    primary_key=("seller_id",),
)

CATEGORY_TRANSLATION = TableSpec(
    "category_translation",
    T.StructType([
        _f("product_category_name", T.StringType(), False),
        _f("product_category_name_english", T.StringType()),
    ]),
    primary_key=("product_category_name",),
)

# Fixed order: the order in which the row-count report lists the tables.
TABLES: dict[str, TableSpec] = {
    t.name: t
    for t in (
        CUSTOMERS,
        GEOLOCATION,
        ORDER_ITEMS,
        ORDER_PAYMENTS,
        ORDER_REVIEWS,
        ORDERS,
        PRODUCTS,
        SELLERS,
        CATEGORY_TRANSLATION,
    )
}

TABLE_NAMES: tuple[str, ...] = tuple(TABLES)


def spec(name: str) -> TableSpec:
    return TABLES[name]
