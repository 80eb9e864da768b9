"""Reports over the delivered-order fact.

``*_performance`` reports are exact (fractions, unrounded, every group); ``*_report``
reports are the SQL-style projections (threshold filter, percentages rounded half-up
to 2 decimals). Scalar benchmarks over the delivered base -- overall late rate,
overall low-review rate, overall average review -- are uncorrelated scalar subqueries
(``DataFrame.scalar()``): Spark computes the one value in its own small job and the
main plan compares against it, so there is no join, no cross product and no value
pulled through user code on the driver. Totals for shares, the category median and the
top-N rank are window aggregates over the grouped report rows (one per group).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderscope.functions import buckets as B
from orderscope.functions import metrics as M
from orderscope.functions import timeutil as TU
from orderscope.operators import model
from orderscope.operators.model import unique_rows
from orderscope.operators.ranking import ranked

# The published report thresholds and windows.
MIN_STATE_ORDERS = 500
MIN_CATEGORY_ORDERS = 500
MIN_SELLER_ORDERS = 100
MONTH_FROM = "2017-01"
MONTH_TO = "2018-08"
TOP_CATEGORIES_SHARE = 10
FINDINGS_TOP_CATEGORIES = 8
FINDINGS_TOP_STATES = 8
FINDINGS_TOP_SELLERS = 10


def _count() -> Column:
    return F.count(F.lit(1))


def _group_total(col: str) -> Column:
    """Total of ``col`` over all rows of an already grouped report (SUM(SUM(x)) OVER ()).

    Used only on grouped rows whose count is the number of groups of a small domain
    (states, categories, payment types), so the one window partition is tiny; the
    alternative, a scalar subquery, would scan the order-level data again for one number.
    """
    return F.sum(col).over(Window.partitionBy())


def _rank(*order: Column) -> Column:
    """Position in ``order`` from 1, over an already grouped report of a small domain."""
    return F.row_number().over(Window.orderBy(*order))


# ---------------------------------------------------------------------------- KPIs


def kpi_summary(delivered: DataFrame) -> DataFrame:
    """One row, nine headline metrics (SQL dialect: rates in percent, rounded)."""
    return delivered.agg(
        _count().alias("delivered_orders"),
        F.sum("item_count").alias("delivered_items"),
        M.money_sum("merchandise_gmv").alias("merchandise_gmv_brl"),
        M.money_sum("freight_value").alias("freight_value_brl"),
        M.round_half_up(M.exact_mean("merchandise_gmv")).alias("average_order_gmv_brl"),
        M.round_half_up(M.mean_days("delivered_seconds")).alias("average_delivery_days"),
        M.pct(M.rate("is_late")).alias("late_delivery_rate_pct"),
        M.round_half_up(F.avg("review_score")).alias("average_review_score"),
        M.pct(M.rate("low_review")).alias("low_review_rate_pct"),
    )


def repeat_customers(customer_orders: DataFrame) -> DataFrame:
    """Unique and repeat customers (>1 delivered order), repeat rate, share of orders from repeaters."""
    repeat = F.col("orders") > F.lit(1)
    return customer_orders.agg(
        _count().alias("unique_customers"),
        F.count_if(repeat).alias("repeat_customers"),
        M.rate(M.flag(repeat)).alias("repeat_customer_rate"),
        M.ratio(
            F.sum(F.when(repeat, F.col("orders")).otherwise(F.lit(0))), F.sum("orders")
        ).alias("orders_from_repeat_customers_rate"),
    )


def kpi_extended(fact: DataFrame, orders: DataFrame) -> DataFrame:
    """One row, seventeen metrics: the headline KPIs as exact fractions plus order
    coverage, repeat purchase and the purchase-date range.

    One pass over the order fact: rows are first combined per customer (every sum
    restricted to delivered orders with ``when``), then once more globally. All sums
    are exact integers or decimals, so re-aggregating them gives the same numbers as a
    direct average, and the per-customer order count yields the repeat metrics without
    a second job. A customer holding a third of all orders is combined map-side.
    ``orders_all_statuses`` counts the orders table: the fact has lost orders without a
    customer.
    """
    ok = model.is_delivered()

    def d(col: str) -> Column:
        return F.when(ok, F.col(col))

    per_customer = fact.groupBy("customer_unique_id").agg(
        F.count_if(ok).alias("n"),
        F.sum(d("item_count")).alias("items"),
        M.money_sum(d("merchandise_gmv")).alias("gmv"),
        M.money_sum(d("freight_value")).alias("freight"),
        F.sum(d("delivered_seconds")).alias("secs"),
        F.count(d("delivered_seconds")).alias("n_secs"),
        F.sum(d("is_late")).alias("late"),
        F.sum(d("review_score")).alias("score_sum"),
        F.count(d("review_score")).alias("n_scored"),
        F.sum(d("low_review")).alias("low"),
        F.min(d("order_purchase_timestamp")).alias("pmin"),
        F.max(d("order_purchase_timestamp")).alias("pmax"),
    )
    n = F.sum("n")
    return per_customer.agg(
        orders.agg(_count()).scalar().alias("orders_all_statuses"),
        n.alias("delivered_orders"),
        F.sum("items").alias("delivered_items"),
        M.money_sum("gmv").alias("merchandise_gmv_brl"),
        M.money_sum("freight").alias("freight_value_brl"),
        M.ratio(F.sum("gmv"), n).alias("average_order_gmv_brl"),
        (M.ratio(F.sum("secs"), F.sum("n_secs")) / F.lit(M.SECONDS_PER_DAY)).alias(
            "average_delivery_days"
        ),
        M.ratio(F.sum("late"), n).alias("late_delivery_rate"),
        M.ratio(F.sum("score_sum"), F.sum("n_scored")).alias("average_review_score"),
        M.ratio(F.sum("low"), n).alias("low_review_rate"),
        F.count_if(F.col("n") > F.lit(0)).alias("unique_customers"),
        F.count_if(F.col("n") > F.lit(1)).alias("repeat_customers"),
        M.ratio(F.count_if(F.col("n") > F.lit(1)), F.count_if(F.col("n") > F.lit(0))).alias(
            "repeat_customer_rate"
        ),
        M.ratio(F.sum(F.when(F.col("n") > F.lit(1), F.col("n"))), n).alias(
            "orders_from_repeat_customers_rate"
        ),
        M.ratio(F.sum("n_scored"), n).alias("review_coverage"),
        TU.iso_seconds(F.min("pmin")).alias("purchase_date_min"),
        TU.iso_seconds(F.max("pmax")).alias("purchase_date_max"),
    )


# ----------------------------------------------------------------- delay impact


def delay_impact(delivered: DataFrame, edges: tuple[int, ...] = B.DEFAULT_EDGES) -> DataFrame:
    """Orders and review outcome per delay bucket.

    Every fixed bucket is present (0 orders when empty); orders whose delay is unknown
    form an extra ``unknown`` bucket that appears only when such orders exist.
    """
    grouped = (
        delivered.withColumn("bucket_order", B.bucket_order("delay_days", edges))
        .groupBy("bucket_order")
        .agg(
            _count().alias("orders"),
            F.avg("review_score").alias("average_review"),
            M.rate("low_review").alias("low_review_rate"),
            M.mean_days("delivered_seconds").alias("average_delivery_days"),
        )
    )
    table = B.bucket_table(delivered.sparkSession, edges)
    joined = table.join(grouped, "bucket_order", "full")
    return joined.select(
        F.coalesce("delay_bucket", B.bucket_label("bucket_order", edges)).alias("delay_bucket"),
        "bucket_order",
        F.coalesce("orders", F.lit(0).cast("bigint")).alias("orders"),
        "average_review",
        "low_review_rate",
        "average_delivery_days",
    ).orderBy("bucket_order")


# ------------------------------------------------------------------------ states


def state_performance(delivered: DataFrame) -> DataFrame:
    """Per customer state: orders, money, service and review, freight burden, GMV share."""
    g = delivered.groupBy("customer_state").agg(
        _count().alias("orders"),
        M.money_sum("merchandise_gmv").alias("merchandise_gmv_brl"),
        M.money_sum("freight_value").alias("freight_value_brl"),
        F.avg("review_score").alias("average_review"),
        M.rate("is_late").alias("late_delivery_rate"),
        M.mean_days("delivered_seconds").alias("average_delivery_days"),
    )
    return g.withColumns(
        {
            "freight_burden": M.freight_burden("freight_value_brl", "merchandise_gmv_brl"),
            "gmv_share": M.share_of_total("merchandise_gmv_brl", _group_total("merchandise_gmv_brl")),
        }
    ).orderBy(F.desc("merchandise_gmv_brl"), "customer_state")


def state_report(
    states: DataFrame, min_orders: int = MIN_STATE_ORDERS, limit: int | None = None
) -> DataFrame:
    """States with at least ``min_orders`` delivered orders, highest freight burden first
    (``rank`` from 1)."""
    out = (
        states.where(F.col("orders") >= F.lit(min_orders))
        .withColumn("rank", _rank(F.desc("freight_burden"), F.asc("customer_state")))
        .orderBy("rank")
        .select(
            "rank",
            "customer_state",
            "orders",
            "merchandise_gmv_brl",
            M.pct("freight_burden").alias("freight_burden_pct"),
            M.pct("late_delivery_rate").alias("late_delivery_rate_pct"),
            M.round_half_up("average_review").alias("average_review"),
        )
    )
    return out.limit(limit) if limit is not None else out


# -------------------------------------------------------------------- categories


def category_performance(order_category: DataFrame) -> DataFrame:
    """Per category. An order counts once in every category it contains."""
    g = order_category.groupBy("category").agg(
        _count().alias("orders"),
        M.money_sum("merchandise_gmv_brl").alias("merchandise_gmv_brl"),
        M.money_sum("freight_value_brl").alias("freight_value_brl"),
        F.avg("review_score").alias("average_review"),
        M.rate("is_late").alias("late_delivery_rate"),
        M.rate("low_review").alias("low_review_rate"),
    )
    return g.withColumns(
        {
            "freight_burden": M.freight_burden("freight_value_brl", "merchandise_gmv_brl"),
            "gmv_share": M.share_of_total("merchandise_gmv_brl", _group_total("merchandise_gmv_brl")),
        }
    ).orderBy(F.desc("merchandise_gmv_brl"), "category")


def category_report(
    categories: DataFrame, min_orders: int = MIN_CATEGORY_ORDERS
) -> DataFrame:
    """Categories with at least ``min_orders`` orders, by GMV (``rank`` from 1)."""
    return (
        categories.where(F.col("orders") >= F.lit(min_orders))
        .withColumn("rank", _rank(F.desc("merchandise_gmv_brl"), F.asc("category")))
        .orderBy("rank")
        .select(
            "rank",
            "category",
            "orders",
            "merchandise_gmv_brl",
            M.round_half_up("average_review").alias("average_review"),
            M.pct("late_delivery_rate").alias("late_delivery_rate_pct"),
            M.pct("low_review_rate").alias("low_review_rate_pct"),
            M.pct("freight_burden").alias("freight_burden_pct"),
        )
    )


def priority_categories(
    categories: DataFrame,
    delivered: DataFrame,
    min_orders: int = MIN_CATEGORY_ORDERS,
    limit: int | None = None,
) -> DataFrame:
    """Scaled categories reviewed below the overall average whose GMV is at least the
    median GMV of scaled categories (an interpolated median)."""
    overall_review = delivered.select(F.avg("review_score")).scalar()
    gmv = F.col("merchandise_gmv_brl").cast("double")
    scaled = categories.where(F.col("orders") >= F.lit(min_orders))
    # an aggregate, combined before it meets in one place: counts of the distinct values
    median_gmv = scaled.select(F.median(gmv)).scalar()
    out = (
        scaled.where((F.col("average_review") < overall_review) & (gmv >= median_gmv))
        .orderBy(F.desc("merchandise_gmv_brl"), "category")
        .select("category", "orders", "merchandise_gmv_brl", "average_review", "late_delivery_rate")
    )
    return out.limit(limit) if limit is not None else out


# ------------------------------------------------------------------------ months


def _monthly(delivered: DataFrame) -> DataFrame:
    return delivered.groupBy("purchase_month").agg(
        _count().alias("orders"),
        M.money_sum("merchandise_gmv").alias("merchandise_gmv_brl"),
        M.exact_mean("merchandise_gmv").alias("average_order_gmv_brl"),
        M.rate("is_late").alias("late_delivery_rate"),
        F.avg("review_score").alias("average_review"),
    )


def monthly_performance(
    delivered: DataFrame, month_from: str = MONTH_FROM, month_to: str = MONTH_TO
) -> DataFrame:
    """Every purchase month, flagged ``complete_month`` inside [month_from, month_to]."""
    return (
        _monthly(delivered)
        .withColumn("complete_month", F.col("purchase_month").between(month_from, month_to))
        .orderBy("purchase_month")
    )


def monthly_report(
    delivered: DataFrame, month_from: str = MONTH_FROM, month_to: str = MONTH_TO
) -> DataFrame:
    """Complete months only (SQL-style projection).

    The window is applied twice on purpose: as a half-open timestamp range and on
    ``purchase_month``, by which a stored fact is partitioned (only its folders are read).
    """
    ts = F.col("order_purchase_timestamp")
    window = delivered.where(
        (ts >= F.lit(TU.month_start(month_from)).cast("timestamp_ntz"))
        & (ts < F.lit(TU.next_month_start(month_to)).cast("timestamp_ntz"))
        & F.col("purchase_month").between(month_from, month_to)
    )
    return (
        _monthly(window)
        .select(
            "purchase_month",
            "orders",
            "merchandise_gmv_brl",
            M.round_half_up("average_order_gmv_brl").alias("average_order_gmv_brl"),
            M.pct("late_delivery_rate").alias("late_delivery_rate_pct"),
            M.round_half_up("average_review").alias("average_review"),
        )
        .orderBy("purchase_month")
    )


# ---------------------------------------------------------------------- payments


def payment_mix(payments: DataFrame, delivered: DataFrame) -> DataFrame:
    """Payment records and value by type, over delivered orders only (semi join). ``payments``
    are rows or their (order, type) sums (``model.order_payment_money``)."""
    records = F.sum("payment_records") if "payment_records" in payments.columns else _count()
    g = (
        payments.join(delivered.select("order_id"), "order_id", "left_semi")
        .groupBy("payment_type")
        .agg(
            records.alias("payment_records"),
            M.money_sum("payment_value").alias("payment_value_brl"),
        )
    )
    return g.withColumn(
        "value_share", M.share_of_total("payment_value_brl", _group_total("payment_value_brl"))
    ).orderBy(
        F.desc("payment_value_brl"), "payment_type"
    )


# ----------------------------------------------------------------------- sellers


SELLER_COLUMNS = [
    "seller_id",
    "seller_state",
    "orders",
    "merchandise_gmv_brl",
    "freight_value_brl",
    "average_review",
    "late_delivery_rate",
    "low_review_rate",
    "low_review_orders",
    "freight_burden",
    "scale_flag",
    "delay_risk_flag",
    "review_risk_flag",
    "priority_flag",
]


def seller_performance(
    pairs: DataFrame,
    sellers: DataFrame,
    delivered: DataFrame,
    min_orders: int = MIN_SELLER_ORDERS,
) -> DataFrame:
    """Per seller over (order, seller) pairs with outcomes (``model.order_seller_outcomes``
    or a stored ``order_seller``), with risk flags against the overall rates.

    A seller is *scaled* with at least ``min_orders`` orders, a *delay* / *review* risk
    when its late / low-review rate is strictly above the overall delivered rate, and a
    *priority* when all three hold. Sellers are aggregated first and joined to their
    state afterwards (seller_id is the sellers key), so the join sees one row per seller.
    """
    g = pairs.groupBy("seller_id").agg(
        _count().alias("orders"),
        M.money_sum("merchandise_gmv_brl").alias("merchandise_gmv_brl"),
        M.money_sum("freight_value_brl").alias("freight_value_brl"),
        F.avg("review_score").alias("average_review"),
        M.rate("is_late").alias("late_delivery_rate"),
        M.rate("low_review").alias("low_review_rate"),
        F.sum("low_review").cast("bigint").alias("low_review_orders"),
    )
    # both benchmarks from one scan of the delivered base (one struct-valued subquery)
    overall = delivered.select(
        F.struct(M.rate("is_late").alias("late"), M.rate("low_review").alias("low"))
    ).scalar()
    overall_late, overall_low = overall.getField("late"), overall.getField("low")
    scale = F.col("orders") >= F.lit(min_orders)
    delay_risk = F.col("late_delivery_rate") > overall_late
    review_risk = F.col("low_review_rate") > overall_low
    return (
        g.join(unique_rows(sellers.select("seller_id", "seller_state"), "seller_id", "sellers"), "seller_id", "left")
        .withColumns(
            {
                "freight_burden": M.freight_burden("freight_value_brl", "merchandise_gmv_brl"),
                "scale_flag": scale,
                "delay_risk_flag": delay_risk,
                "review_risk_flag": review_risk,
            }
        )
        .withColumn("priority_flag", F.col("scale_flag") & F.col("delay_risk_flag") & F.col("review_risk_flag"))
        .select(*SELLER_COLUMNS)
    )


def seller_report(sellers_perf: DataFrame) -> DataFrame:
    """All sellers, flagged ones first, then by low-review orders and orders, with ``rank``.

    Sellers are unbounded and most share the same values, so neither a sort in one task nor
    a window by value ranks them: see ``ranking.ranked``, which writes the sorted rows once.
    """
    order = [F.desc("priority_flag"), F.desc("low_review_orders"), F.desc("orders"), F.asc("seller_id")]
    return ranked(sellers_perf, order).select("rank", *SELLER_COLUMNS).orderBy("rank")


def priority_sellers(sellers_perf: DataFrame, limit: int | None = None) -> DataFrame:
    """Flagged sellers, most low-review orders first."""
    out = (
        sellers_perf.where(F.col("priority_flag"))
        .orderBy(F.desc("low_review_orders"), F.desc("orders"), "seller_id")
        .select(
            "seller_id",
            "seller_state",
            "orders",
            "merchandise_gmv_brl",
            "average_review",
            "late_delivery_rate",
            "low_review_rate",
            "low_review_orders",
        )
    )
    return out.limit(limit) if limit is not None else out


def seller_risk_summary(sellers_perf: DataFrame, min_orders: int = MIN_SELLER_ORDERS) -> DataFrame:
    """One row: scaled and priority seller counts and the priority sellers' totals."""
    prio = F.col("priority_flag")
    return sellers_perf.agg(
        F.lit(min_orders).alias("minimum_orders"),
        F.count_if(F.col("scale_flag")).alias("scaled_sellers"),
        F.count_if(prio).alias("priority_sellers"),
        F.coalesce(F.sum(F.when(prio, F.col("orders"))), F.lit(0).cast("bigint")).alias(
            "priority_seller_orders"
        ),
        F.coalesce(F.sum(F.when(prio, F.col("low_review_orders"))), F.lit(0).cast("bigint")).alias(
            "priority_seller_low_review_orders"
        ),
        F.coalesce(
            M.money_sum(F.when(prio, F.col("merchandise_gmv_brl"))),
            F.lit(0).cast(M.MONEY_SUM_TYPE),
        ).alias("priority_seller_gmv_brl"),
    )


# ---------------------------------------------------------------------- findings


def findings_summary(
    delay: DataFrame,
    categories: DataFrame,
    edges: tuple[int, ...] = B.DEFAULT_EDGES,
    top_n: int = TOP_CATEGORIES_SHARE,
) -> DataFrame:
    """One row: review gap on-time vs most-late bucket, low-review multiplier of the
    most-late bucket over on-time, and the GMV share of the top-N categories."""
    first, last = 1, len(edges) + 1
    order = F.col("bucket_order")

    def at(bucket: int, col: str) -> Column:
        return F.max(F.when(order == F.lit(bucket), F.col(col)))

    # rank over the grouped category rows only (one row per category)
    rank = F.row_number().over(Window.orderBy(F.desc("merchandise_gmv_brl"), "category"))
    top_share = (
        categories.withColumn("_rank", rank)
        .agg(
            M.ratio(
                F.sum(F.when(F.col("_rank") <= F.lit(top_n), F.col("merchandise_gmv_brl"))),
                F.sum("merchandise_gmv_brl"),
            )
        )
        .scalar()
    )
    return delay.agg(
        (at(first, "average_review") - at(last, "average_review")).alias("late_delivery_review_gap"),
        M.ratio(at(last, "low_review_rate"), at(first, "low_review_rate")).alias(
            "very_late_low_review_multiplier"
        ),
    ).withColumn("top_10_category_gmv_share", top_share)


def _ranked_list(df: DataFrame, order: list[Column], cols: list[str], k: int) -> Column:
    """Scalar subquery: the first k rows of ``df`` in ``order`` as an ordered array of structs.

    Only k rows reach the collecting aggregate (TakeOrderedAndProject keeps k per task).
    """
    top = df.orderBy(*order).limit(k).withColumn("_rank", F.row_number().over(Window.orderBy(*order)))
    arr = F.sort_array(F.collect_list(F.struct("_rank", *cols)))
    return top.select(F.transform(arr, lambda s: s.dropFields("_rank"))).scalar()


KPI_DOCUMENT_FIELDS = [
    "orders_all_statuses",
    "delivered_orders",
    "delivered_items",
    "merchandise_gmv_brl",
    "freight_value_brl",
    "average_order_gmv_brl",
    "average_delivery_days",
    "late_delivery_rate",
    "average_review_score",
    "low_review_rate",
    "unique_customers",
    "repeat_customers",
    "repeat_customer_rate",
    "orders_from_repeat_customers_rate",
    "review_coverage",
    "purchase_date_min",
    "purchase_date_max",
]


def summary_rows(
    kpis: DataFrame,
    findings: DataFrame,
    categories: DataFrame,
    states: DataFrame,
    sellers_perf: DataFrame,
    delivered: DataFrame,
    min_state_orders: int = MIN_STATE_ORDERS,
    min_category_orders: int = MIN_CATEGORY_ORDERS,
    min_seller_orders: int = MIN_SELLER_ORDERS,
    top: tuple[int, int, int] = (FINDINGS_TOP_CATEGORIES, FINDINGS_TOP_STATES, FINDINGS_TOP_SELLERS),
) -> DataFrame:
    """The content of ``summary_document`` in flat form: (section, rank, key, metric, value).

    Lists have their order in ``rank`` (from 1); single values have rank 0 and no key. Dates
    are seconds since 1970. ``top`` are the lengths of the three lists.
    """

    def flat(df: DataFrame, section: str, key: Column, metrics: list[str]) -> DataFrame:
        values = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
        rank = F.col("rank") if "rank" in df.columns else F.lit(0)
        return df.select(
            F.lit(section).alias("section"), rank.cast("int").alias("rank"), key.cast("string").alias("key"), F.inline(values)
        )

    def first(df: DataFrame, n: int, *order: Column) -> DataFrame:
        return df.orderBy(*order).limit(n).withColumn("rank", _rank(*order))

    def seconds(c: str) -> Column:
        return F.unix_timestamp(F.to_timestamp(c, "yyyy-MM-dd'T'HH:mm:ss"))

    none = F.lit("")
    dated = kpis.withColumns({c: seconds(c) for c in ("purchase_date_min", "purchase_date_max")})
    risk = seller_risk_summary(sellers_perf, min_seller_orders)
    urgent = first(
        priority_categories(categories, delivered, min_category_orders), top[0], F.desc("merchandise_gmv_brl"), F.asc("category")
    )
    costly = first(
        states.where(F.col("orders") >= F.lit(min_state_orders)), top[1], F.desc("freight_burden"), F.asc("customer_state")
    )
    flagged = first(
        priority_sellers(sellers_perf), top[2], F.desc("low_review_orders"), F.desc("orders"), F.asc("seller_id")
    )
    frames = [
        flat(dated, "kpis", none, KPI_DOCUMENT_FIELDS),
        flat(findings, "findings", none, findings.columns),
        flat(risk, "seller_risk", none, risk.columns),
        flat(
            urgent,
            "priority_categories",
            F.col("category"),
            ["orders", "merchandise_gmv_brl", "average_review", "late_delivery_rate"],
        ),
        flat(
            costly,
            "high_freight_states",
            F.col("customer_state"),
            ["orders", "freight_burden", "late_delivery_rate", "average_review"],
        ),
        flat(
            flagged,
            "priority_sellers",
            F.col("seller_id"),
            ["orders", "merchandise_gmv_brl", "average_review", "late_delivery_rate", "low_review_rate", "low_review_orders"],
        ),
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def summary_document(
    kpis: DataFrame,
    findings: DataFrame,
    categories: DataFrame,
    states: DataFrame,
    sellers_perf: DataFrame,
    delivered: DataFrame,
    min_state_orders: int = MIN_STATE_ORDERS,
    min_category_orders: int = MIN_CATEGORY_ORDERS,
    min_seller_orders: int = MIN_SELLER_ORDERS,
) -> DataFrame:
    """One row: ``kpis`` and ``findings`` as nested structs, plus the same as JSON text.

    Everything nested is bounded (top 8 categories, top 8 states, top 10 sellers, one
    risk row); large tables are written separately as JSON-lines payloads.
    """
    kpi_struct = kpis.select(F.struct(*KPI_DOCUMENT_FIELDS)).scalar()
    prio_cats = _ranked_list(
        priority_categories(categories, delivered, min_category_orders),
        [F.desc("merchandise_gmv_brl"), F.asc("category")],
        ["category", "orders", "merchandise_gmv_brl", "average_review", "late_delivery_rate"],
        FINDINGS_TOP_CATEGORIES,
    )
    freight_states = _ranked_list(
        states.where(F.col("orders") >= F.lit(min_state_orders)),
        [F.desc("freight_burden"), F.asc("customer_state")],
        ["customer_state", "orders", "freight_burden", "late_delivery_rate", "average_review"],
        FINDINGS_TOP_STATES,
    )
    prio_sellers = _ranked_list(
        priority_sellers(sellers_perf),
        [F.desc("low_review_orders"), F.desc("orders"), F.asc("seller_id")],
        [
            "seller_id",
            "seller_state",
            "orders",
            "merchandise_gmv_brl",
            "average_review",
            "late_delivery_rate",
            "low_review_rate",
            "low_review_orders",
        ],
        FINDINGS_TOP_SELLERS,
    )
    risk = seller_risk_summary(sellers_perf, min_seller_orders)
    risk_struct = risk.select(F.struct(*risk.columns)).scalar()
    doc = findings.select(
        kpi_struct.alias("kpis"),
        F.struct(
            "late_delivery_review_gap",
            "very_late_low_review_multiplier",
            "top_10_category_gmv_share",
            prio_cats.alias("priority_categories"),
            freight_states.alias("high_freight_states"),
            risk_struct.alias("seller_risk"),
            prio_sellers.alias("priority_sellers"),
        ).alias("findings"),
    )
    return doc.withColumn(
        "summary_json",
        F.to_json(F.struct("kpis", "findings"), {"ignoreNullFields": "false"}),
    )
