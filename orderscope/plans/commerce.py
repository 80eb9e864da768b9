"""CommerceModel: the nine tables wired into the order model and every report.

Everything is lazy until a report is written. A field of text counts (``dq_unparsed``) takes the
raw files and is not part of the model. ``materialize()`` writes the order
fact and the (order, category) / (order, seller) attribution tables once as Parquet into
the shared checkpoint folder (``spark.checkpoint.dir``) and re-reads them: every later
report starts from those files instead of re-running the star join or the item-level
pipeline, lineage is cut, and a lost executor costs a re-read, not a recomputation.
Nothing here caches in executor memory or on local disk.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderscope.functions import buckets as B
from orderscope.operators import model, quality, reports
from orderscope.session import scratch_path, write_concurrently

REQUIRED_TABLES = (
    "customers",
    "order_items",
    "order_payments",
    "order_reviews",
    "orders",
    "products",
    "sellers",
    "category_translation",
)

# Intermediate tables materialize() writes once: groups in dependency order, the tables
# of one group as concurrent jobs.
MATERIALIZE_STEPS: tuple[tuple[str, ...], ...] = (
    ("order_seller_money", "order_payment_money", "product_category"),
    ("order_fact",),
    ("order_outcomes",),
    ("order_category", "order_seller"),
)
# Stored tables that later joins and groupings meet by one key: written in buckets of it, so
# those joins and groupings read them without an exchange. All hold one row for each (key,
# something of few values), so no bucket is much larger than another.
BUCKETED: dict[str, str] = {
    "order_seller_money": "order_id",
    "order_payment_money": "order_id",
    "order_outcomes": "order_id",
    "product_category": "product_id",
}
MOST_BUCKETS = 4_096
# The tables that sum raw rows by (BUCKETED key, something): raw table and aggregation.
SUMMED: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "order_seller_money": ("order_items", model.order_seller_money),
    "order_payment_money": ("order_payments", model.order_payment_money),
}
# A key with this many raw rows is combined before it moves, for at most so many keys.
HEAVY_ROWS = 100_000
MOST_HEAVY = 1_000
# Buckets become more, not larger, as the tables grow: what a task sorts and sums stays in memory.
ROWS_PER_BUCKET = 500_000
MATERIALIZED: tuple[str, ...] = tuple(n for step in MATERIALIZE_STEPS for n in step)


def _bucket_table(name: str, path: str) -> str:
    """The catalog name of a bucketed table: buckets are known to the catalog only."""
    return f"orderscope_{name}_{hashlib.md5(path.encode()).hexdigest()[:12]}"


@dataclass(frozen=True)
class RowCounts:
    """How many rows a table holds, and the keys that hold very many of them."""

    rows: int
    heavy: tuple


def _count_rows(rows: DataFrame, key: str) -> RowCounts:
    """At most ``MOST_HEAVY`` keys, those with the most rows, are heavy: any other holds under
    ``HEAVY_ROWS`` rows, or less than one row in ``MOST_HEAVY``."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    many = counts.where(F.col(key).isNotNull() & (F.col("n") >= F.lit(HEAVY_ROWS)))
    heavy = tuple(r[key] for r in many.orderBy(F.desc("n")).limit(MOST_HEAVY).collect())
    return RowCounts(rows.count(), heavy)


def _in_buckets(
    rows: DataFrame, aggregate: Callable[[DataFrame], DataFrame], key: str, heavy: tuple, buckets: int
) -> tuple[DataFrame, DataFrame]:
    """``aggregate(rows)``, which groups by ``key`` and more, put into buckets of ``key``: the
    light keys' rows, and those of heavy keys and of no key.

    Few rows share a light key, so combining them first saves nothing: they move to their bucket
    and are aggregated there, in one exchange. Only the others are combined before they move.
    """
    held = F.col(key).isNull() | F.col(key).isin(list(heavy))
    return (
        aggregate(rows.where(~held).repartition(buckets, key)),
        aggregate(rows.where(held)).repartition(buckets, key),
    )


def _write_stored(df: DataFrame, name: str, path: str, buckets: int, low_review_max: int) -> None:
    if name == "order_fact":
        moved = df.drop(*model.OUTCOME_COLUMNS).hint("rebalance", "purchase_month")
        rows = model.outcome_columns(moved, low_review_max)
        rows.write.mode("overwrite").partitionBy("purchase_month").parquet(path)
    elif name in BUCKETED:
        key = BUCKETED[name]
        put = df if name in SUMMED else df.repartition(buckets, key)
        rows = put.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
        rows.option("path", path).format("parquet").saveAsTable(_bucket_table(name, path))
    else:
        df.write.mode("overwrite").parquet(path)


def _read_stored(df: DataFrame, name: str, path: str) -> DataFrame:
    spark = df.sparkSession
    if name in BUCKETED:
        return spark.table(_bucket_table(name, path)).select(*df.columns)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


@dataclass
class ModelParams:
    """Thresholds and windows; the defaults are the published ones."""

    low_review_max: int = model.LOW_REVIEW_MAX
    delay_edges: tuple[int, ...] = B.DEFAULT_EDGES
    min_state_orders: int = reports.MIN_STATE_ORDERS
    min_category_orders: int = reports.MIN_CATEGORY_ORDERS
    min_seller_orders: int = reports.MIN_SELLER_ORDERS
    month_from: str = reports.MONTH_FROM
    month_to: str = reports.MONTH_TO


@dataclass
class CommerceModel:
    tables: dict[str, DataFrame]
    params: ModelParams = field(default_factory=ModelParams)
    # intermediate tables written by materialize(), read back from the shared folder
    stored: dict[str, DataFrame] = field(default_factory=dict)
    # rows and heavy orders of the raw tables, counted by materialize()
    counted: dict[str, RowCounts] = field(default_factory=dict)

    def __post_init__(self) -> None:
        missing = [t for t in REQUIRED_TABLES if t not in self.tables]
        if missing:
            raise ValueError(f"missing tables: {missing}")

    @property
    def spark(self) -> SparkSession:
        return self.tables["orders"].sparkSession

    def t(self, name: str) -> DataFrame:
        return self.tables[name]

    # ------------------------------------------------------------- model layer
    def latest_review(self) -> DataFrame:
        return model.latest_review(self.t("order_reviews"))

    def product_category(self) -> DataFrame:
        if "product_category" in self.stored:
            return self.stored["product_category"]
        return model.product_category(self.t("products"), self.t("category_translation"))

    def item_order(self) -> DataFrame:
        return model.item_order_from_pairs(self.order_seller_money())

    def payment_order(self) -> DataFrame:
        return model.payment_order(self.order_payment_money())

    def order_payment_money(self) -> DataFrame:
        """(order, payment type) records and value: the one aggregation of the payments."""
        if "order_payment_money" in self.stored:
            return self.stored["order_payment_money"]
        return model.order_payment_money(self.t("order_payments"))

    def order_outcomes(self) -> DataFrame:
        """The outcome of each delivered order, which money tables meet by order."""
        if "order_outcomes" in self.stored:
            return self.stored["order_outcomes"]
        return model.order_outcomes(self.delivered)

    def order_seller_money(self) -> DataFrame:
        """(order, seller) money of every order: the one aggregation of the item table."""
        if "order_seller_money" in self.stored:
            return self.stored["order_seller_money"]
        return model.order_seller_money(self.t("order_items"))

    @cached_property
    def fact(self) -> DataFrame:
        return model.order_fact(
            self.t("orders"),
            self.t("customers"),
            self.t("order_items"),
            self.t("order_payments"),
            self.t("order_reviews"),
            low_review_max=self.params.low_review_max,
            item_orders=model.item_order_from_pairs(self.order_seller_money()),
            payment_money=self.order_payment_money(),
            partitions=self._buckets() if "order_seller_money" in self.stored else None,
        )

    def order_fact(self) -> DataFrame:
        if "order_fact" in self.stored:
            return self.stored["order_fact"]
        return self.fact

    @property
    def delivered(self) -> DataFrame:
        """The delivered base; on a stored fact its filter is pushed into the Parquet scan."""
        return model.delivered_fact(self.order_fact())

    def delivered_fact(self) -> DataFrame:
        return self.delivered

    def order_category(self) -> DataFrame:
        if "order_category" in self.stored:
            return self.stored["order_category"]
        return model.order_category(
            self.t("order_items"),
            self.t("products"),
            self.t("category_translation"),
            self.delivered,
            self.product_category(),
            self.order_outcomes(),
        )

    def order_seller(self) -> DataFrame:
        if "order_seller" in self.stored:
            return self.stored["order_seller"]
        return model.order_seller(
            self.t("order_items"), self.t("sellers"), self.delivered, self.order_seller_money(), self.order_outcomes()
        )

    def seller_pairs(self) -> DataFrame:
        """(order, seller) rows with outcomes, without the seller's state."""
        if "order_seller" in self.stored:
            return self.stored["order_seller"].drop("seller_state")
        return model.order_seller_outcomes(self.order_seller_money(), self.delivered, self.order_outcomes())

    def customer_orders(self) -> DataFrame:
        return model.customer_orders(self.delivered)

    # ----------------------------------------------------------------- reports
    def kpi_summary(self) -> DataFrame:
        return reports.kpi_summary(self.delivered)

    def kpi_extended(self) -> DataFrame:
        return reports.kpi_extended(self.order_fact(), self.t("orders"))

    def delay_impact(self) -> DataFrame:
        return reports.delay_impact(self.delivered, self.params.delay_edges)

    def state_performance(self) -> DataFrame:
        return reports.state_performance(self.delivered)

    def state_report(self, limit: int | None = None) -> DataFrame:
        return reports.state_report(self.state_performance(), self.params.min_state_orders, limit)

    def category_performance(self) -> DataFrame:
        return reports.category_performance(self.order_category())

    def category_report(self) -> DataFrame:
        return reports.category_report(self.category_performance(), self.params.min_category_orders)

    def priority_categories(self, limit: int | None = None) -> DataFrame:
        return reports.priority_categories(
            self.category_performance(), self.delivered, self.params.min_category_orders, limit
        )

    def repeat_customers(self) -> DataFrame:
        return reports.repeat_customers(self.customer_orders())

    def monthly_performance(self) -> DataFrame:
        return reports.monthly_performance(self.delivered, self.params.month_from, self.params.month_to)

    def monthly_report(self) -> DataFrame:
        return reports.monthly_report(self.delivered, self.params.month_from, self.params.month_to)

    def payment_mix(self) -> DataFrame:
        return reports.payment_mix(self.order_payment_money(), self.order_outcomes())

    def seller_performance(self) -> DataFrame:
        return reports.seller_performance(
            self.seller_pairs(), self.t("sellers"), self.delivered, self.params.min_seller_orders
        )

    def priority_sellers(self, limit: int | None = None) -> DataFrame:
        return reports.priority_sellers(self.seller_performance(), limit)

    def seller_risk_summary(self) -> DataFrame:
        return reports.seller_risk_summary(self.seller_performance(), self.params.min_seller_orders)

    def findings_summary(self) -> DataFrame:
        return reports.findings_summary(
            self.delay_impact(), self.category_performance(), self.params.delay_edges
        )

    def _summary_inputs(self) -> tuple[DataFrame, ...]:
        categories = self.category_performance()
        return (
            self.kpi_extended(),
            reports.findings_summary(self.delay_impact(), categories, self.params.delay_edges),
            categories,
            self.state_performance(),
            self.seller_performance(),
            self.delivered,
            self.params.min_state_orders,
            self.params.min_category_orders,
            self.params.min_seller_orders,
        )

    def summary_document(self) -> DataFrame:
        """The nested {kpis, findings} document; nothing runs until it is used."""
        return reports.summary_document(*self._summary_inputs())

    def summary_rows(self) -> DataFrame:
        """The same content as (section, rank, key, metric, value) rows."""
        return reports.summary_rows(*self._summary_inputs())

    def seller_report(self) -> DataFrame:
        return reports.seller_report(self.seller_performance())

    # ------------------------------------------------------------ data quality
    def dq_row_counts(self) -> DataFrame:
        return quality.dq_row_counts(self.tables)

    def dq_orphan_items(self) -> DataFrame:
        return quality.dq_orphan_items(self.t("order_items"), self.t("orders"))

    def dq_orphan_orders(self) -> DataFrame:
        return quality.dq_orphan_orders(self.t("orders"), self.t("customers"))

    def dq_invalid_scores(self) -> DataFrame:
        return quality.dq_invalid_scores(self.t("order_reviews"))

    def dq_duplicate_keys(self) -> DataFrame:
        return quality.dq_duplicate_keys(self.tables)

    def dq_join_keys(self) -> DataFrame:
        return quality.dq_join_keys(self.tables)

    def dq_not_null(self) -> DataFrame:
        return quality.dq_not_null(self.tables)

    def dq_file_audit(self) -> DataFrame:
        return quality.dq_file_audit(self.tables)

    # ---------------------------------------------------------------- catalog
    def operators(self) -> dict[str, Callable[[], DataFrame]]:
        """Every operator by its query name."""
        return {name: getattr(self, name) for name in OPERATOR_NAMES}

    # ------------------------------------------------------------ materialise
    def materialize(
        self, path: str | None = None, names: tuple[str, ...] = MATERIALIZED
    ) -> CommerceModel:
        """Write the model's intermediate tables once and return a model whose reports
        read them back. Tables already stored are kept. A key that a join relies on and that
        several rows hold raises ``IntegrityError``, from the join itself (``model.unique_rows``):
        it would multiply money.

        ``order_seller_money`` is the single aggregation of the item table; the order fact
        (all statuses) takes its item totals from it and feeds every report -- the
        delivered base is a filter pushed into its scan; ``order_category`` and
        ``order_seller`` (built from the stored fact) feed the category and seller
        reports, which would otherwise each re-run the item-level pipeline. The fact is
        partitioned by purchase month, so a month window reads only its folders; a rebalance
        puts each month into few files and splits a month that holds very many rows. The
        folder is on
        shared storage and survives the loss of any executor.
        """
        base = path or scratch_path(self.spark, "model")
        current = self
        wanted = set(names) - set(self.stored)
        for step in MATERIALIZE_STEPS:
            group = [n for n in step if n in wanted]
            frames = {}
            for name in group:
                frames[name] = getattr(current, name)()
            paths = {name: f"{base.rstrip('/')}/{name}" for name in group}
            low = self.params.low_review_max
            if set(group) & {*BUCKETED, "order_category"}:
                current._count_tables()
            buckets = current._buckets()
            written = {name: current._written(name, df, buckets, base.rstrip("/")) for name, df in frames.items()}
            try:
                write_concurrently(
                    [lambda n=name, df=df: _write_stored(df, n, paths[n], buckets, low) for name, df in written.items()]
                )
            except PySparkException as failed:
                found = re.search(rf"{model.DUPLICATE_KEY} [^\n]*", str(failed))
                if found:
                    raise quality.IntegrityError(found.group(0)) from failed
                raise
            stored = {name: _read_stored(df, name, paths[name]) for name, df in frames.items()}
            current = CommerceModel(self.tables, self.params, {**current.stored, **stored}, current.counted)
        return current

    def _count_tables(self) -> None:
        """Count the tables that are summed by order, side by side and once."""
        tables = [t for t, _ in SUMMED.values() if t not in self.counted]

        def count(table: str) -> None:
            self.counted[table] = _count_rows(self.t(table), "order_id")

        write_concurrently([lambda t=t: count(t) for t in tables])

    def _buckets(self) -> int:
        """One number of buckets for all stored tables, so that they meet without an exchange."""
        rows = max((c.rows for c in self.counted.values()), default=0)
        least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return min(MOST_BUCKETS, max(least, -(-rows // ROWS_PER_BUCKET)))

    def _written(self, name: str, df: DataFrame, buckets: int, base: str) -> DataFrame:
        """The rows of ``df``, the stored table ``name``, by the way that moves the least of them."""
        if name in SUMMED:
            table, aggregate = SUMMED[name]
            few, many = _in_buckets(self.t(table), aggregate, "order_id", self.counted[table].heavy, buckets)
            return few.unionByName(many)
        if name == "order_category":
            detail = model.category_items(self.t("order_items"), self.product_category())
            heavy = self.counted["order_items"].heavy
            few, many = _in_buckets(
                detail.where(F.col("order_id").isNotNull()), model.order_category_money, "order_id", heavy, buckets
            )
            outcomes = self.order_outcomes()
            met = few.join(outcomes, "order_id", "inner")
            return met.unionByName(many.join(outcomes, "order_id", "inner")) if heavy else met
        if name == "order_seller":
            # as a file the sellers have a known size: if small, they go to the pairs, not the pairs to them
            sellers = self.t("sellers").select("seller_id", "seller_state")
            sellers.write.mode("overwrite").parquet(f"{base}/sellers")
            known = {**self.tables, "sellers": self.spark.read.schema(sellers.schema).parquet(f"{base}/sellers")}
            return CommerceModel(known, self.params, self.stored).order_seller()
        return df


# The stored tables that make a report cheap, by name; all other operators read the raw tables.
_FACT = ("order_seller_money", "order_payment_money", "order_fact")
STORED_FOR: dict[str, tuple[str, ...]] = {
    **dict.fromkeys(
        (
            "order_fact", "delivered_fact", "customer_orders", "kpi_summary", "kpi_extended", "delay_impact",
            "state_performance", "state_report", "repeat_customers", "monthly_performance", "monthly_report",
        ),
        _FACT,
    ),
    "payment_mix": (*_FACT, "order_outcomes"),
    **dict.fromkeys(
        ("order_category", "category_performance", "category_report", "priority_categories", "findings_summary"),
        (*_FACT, "product_category", "order_outcomes", "order_category"),
    ),
    **dict.fromkeys(
        ("order_seller", "seller_performance", "seller_report", "priority_sellers", "seller_risk_summary"),
        (*_FACT, "order_outcomes", "order_seller"),
    ),
    **dict.fromkeys(("summary_document", "summary_rows"), MATERIALIZED),
}

OPERATOR_NAMES: tuple[str, ...] = (
    # data quality
    "dq_row_counts",
    "dq_orphan_items",
    "dq_orphan_orders",
    "dq_invalid_scores",
    "dq_duplicate_keys",
    "dq_join_keys",
    "dq_not_null",
    "dq_file_audit",
    # model
    "latest_review",
    "product_category",
    "item_order",
    "payment_order",
    "order_fact",
    "delivered_fact",
    "order_category",
    "order_seller",
    "customer_orders",
    # reports
    "kpi_summary",
    "kpi_extended",
    "delay_impact",
    "state_performance",
    "state_report",
    "category_performance",
    "category_report",
    "priority_categories",
    "repeat_customers",
    "monthly_performance",
    "monthly_report",
    "payment_mix",
    "seller_performance",
    "seller_report",
    "priority_sellers",
    "seller_risk_summary",
    "findings_summary",
    "summary_rows",
    "summary_document",
)
