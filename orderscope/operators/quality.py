"""Data-quality jobs: each returns a small result table instead of printing.

All of them are single aggregate passes (plus one anti/semi join for the orphan
checks), so they scale with the tables; none collects rows to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderscope.schemas import TABLES, TableSpec
from orderscope.sources.csv import MALFORMED, Landed, is_malformed, is_unparsed, number_pattern


AUDIT_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType(), False),
    T.StructField("metric", T.StringType(), False),
    T.StructField("column_name", T.StringType(), True),
    T.StructField("value", T.LongType(), True),
])


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _present(tables: dict[str, DataFrame]) -> list[tuple[str, DataFrame, TableSpec]]:
    return [(name, tables[name], spec) for name, spec in TABLES.items() if name in tables]


def _any_tables(tables: dict[str, DataFrame]) -> list[tuple[str, DataFrame, TableSpec | None]]:
    """Registry tables in registry order, then any other named frames (e.g. files)."""
    known = _present(tables)
    names = {n for n, _, _ in known}
    return known + [(n, df, None) for n, df in tables.items() if n not in names]


def dq_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rows_loaded) for every loaded table."""
    return _union(
        [
            df.agg(F.count(F.lit(1)).alias("rows_loaded")).select(
                F.lit(name).alias("table_name"), "rows_loaded"
            )
            for name, df, _ in _present(tables)
        ]
    )


def _orphans(child: DataFrame, parent: DataFrame, key: str, name: str) -> DataFrame:
    """Rows of ``child`` whose ``key`` has no row in ``parent``.

    A NULL key never matches, so those rows are counted directly and only non-NULL keys
    go through the anti join: NULLs (however many) never pile into one join partition.
    """
    keys = child.select(key)
    unmatched = (
        keys.where(F.col(key).isNotNull())
        .join(parent.select(key).where(F.col(key).isNotNull()), key, "left_anti")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    null_keys = keys.agg(F.count_if(F.col(key).isNull()).alias("n"))
    return unmatched.unionByName(null_keys).agg(F.sum("n").cast("bigint").alias(name))


def dq_orphan_items(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Items whose order does not exist; expected 0."""
    return _orphans(items, orders, "order_id", "items_without_orders")


def dq_orphan_orders(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders whose customer does not exist; expected 0."""
    return _orphans(orders, customers, "customer_id", "orders_without_customers")


def dq_invalid_scores(reviews: DataFrame, low: int = 1, high: int = 5) -> DataFrame:
    """Reviews scored outside [low, high]; a NULL score is not counted."""
    return reviews.agg(
        F.count_if(~F.col("review_score").between(low, high)).alias("invalid_review_scores")
    )


def _key_checks(spec: TableSpec) -> list[tuple[str, ...]]:
    keys: list[tuple[str, ...]] = []
    if spec.primary_key:
        keys.append(spec.primary_key)
    keys.extend(k for k in spec.unique_keys if k not in keys)
    return keys


def dq_duplicate_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, key_columns, duplicate_keys): key values held by more than one row.

    Covers every primary key and every key a join relies on being unique. All keys of a
    table are counted in one scan and one shuffle (grouping sets; ``grouping_id`` tells
    the sets apart even when key values are NULL). The count per key is combined
    map-side, so a key repeated in a third of the rows stays cheap.
    """
    frames = []
    for name, df, spec in _present(tables):
        keys = _key_checks(spec)
        if not keys:
            continue
        cols: list[str] = []
        for key in keys:
            cols.extend(c for c in key if c not in cols)
        counts = (
            df.groupingSets([list(k) for k in keys], *cols)
            .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid"))
        )
        # one global aggregate: a conditional count per key set, so every check has a
        # row (0 on an empty table); grouping_id sets bit (len(cols)-1-i) for every
        # column i not in the set
        duplicates = []
        for j, key in enumerate(keys):
            gid = sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in key)
            hit = (F.col("gid") == F.lit(gid)) & (F.col("n") > F.lit(1))
            duplicates.append(F.count_if(hit).alias(f"_k{j}"))
        entries = [
            F.struct(F.lit(",".join(key)).alias("key_columns"), F.col(f"_k{j}").alias("duplicate_keys"))
            for j, key in enumerate(keys)
        ]
        frames.append(
            counts.agg(*duplicates)
            .select(F.inline(F.array(*entries)))
            .select(F.lit(name).alias("table_name"), "key_columns", "duplicate_keys")
        )
    return _union(frames)


def _null_counts(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Long form (table_name, column_name, null_rows) from one aggregate pass."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return wide.unpivot([], columns, "column_name", "null_rows").select(
        F.lit(name).alias("table_name"), "column_name", "null_rows"
    )


def dq_not_null(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, null_rows) for every NOT NULL / key column; expected 0."""
    return _union(
        [
            _null_counts(df, name, list(spec.required_columns()))
            for name, df, spec in _present(tables)
            if spec.required_columns()
        ]
    )


# Keys that a join of the model relies on: a value held twice would multiply money.
JOIN_KEYS: tuple[tuple[str, str], ...] = (
    ("customers", "customer_id"),
    ("orders", "order_id"),
    ("orders", "customer_id"),
    ("products", "product_id"),
    ("sellers", "seller_id"),
    ("category_translation", "product_category_name"),
)


def dq_join_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, key_columns, duplicate_keys) for every key a join needs to be unique;
    expected 0. A NULL key joins with nothing and is not counted (``dq_not_null`` does)."""
    frames = []
    for name, key in JOIN_KEYS:
        if name in tables:
            counts = tables[name].where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
            frames.append(
                counts.agg(F.count_if(F.col("n") > F.lit(1)).alias("duplicate_keys")).select(
                    F.lit(name).alias("table_name"), F.lit(key).alias("key_columns"), "duplicate_keys"
                )
            )
    return _union(frames)


def dq_unparsed(fields: dict[str, DataFrame]) -> DataFrame:
    """(table_name, metric, column_name, unparsed_rows) of tables read as text
    (``sources.csv.read_csv_fields``).

    ``row``: rows with too few or too many fields, which are never typed (no column name);
    ``number`` and ``timestamp``: fields of the other rows whose text cannot be read. Expected
    0, but for timestamps, whose defined reading is NULL.
    """
    frames = []
    for name, df in fields.items():
        spec = TABLES[name]
        parsed = [f for f in spec.schema.fields if f.name in df.columns and not isinstance(f.dataType, T.StringType)]
        whole = F.col(MALFORMED).isNull() if MALFORMED in df.columns else F.lit(True)
        counts = {("number" if number_pattern(f.dataType) else "timestamp", f.name): whole & is_unparsed(F.col(f.name), f.dataType) for f in parsed}
        if MALFORMED in df.columns:
            counts = {("row", None): is_malformed(df)} | counts
        if not counts:
            continue
        found = df.agg(*[F.count_if(c).alias(f"n{i}") for i, c in enumerate(counts.values())])
        entries = [
            F.struct(F.lit(metric).alias("metric"), F.lit(column).cast("string").alias("column_name"), F.col(f"n{i}").alias("unparsed_rows"))
            for i, (metric, column) in enumerate(counts)
        ]
        frames.append(found.select(F.inline(F.array(*entries))).select(F.lit(name).alias("table_name"), "metric", "column_name", "unparsed_rows"))
    return _union(frames)


def _profile(rows: DataFrame, by: list[str], cells: list[Column]) -> DataFrame:
    """(``by``, mask, n, repeats): rows, and rows equal to an earlier one, by which of the cells
    are NULL, as a text of 0 and 1.

    One shuffle: equal rows are counted on a 128-bit digest of their cells and mask, combined
    before it; the digest stands for the row, as two of 10 ** 12 rows share one by chance
    with a probability under 10 ** -14.
    """
    mask = F.concat(F.lit(""), *[c.isNull().cast("int").cast("string") for c in cells]) if cells else F.lit("")
    digest = [F.xxhash64(*cells, F.col("mask")).alias("d1"), F.xxhash64(F.col("mask"), F.lit(1), *cells).alias("d2")]
    equal = rows.withColumn("mask", mask).select(*by, "mask", *digest).groupBy(*by, "mask", "d1", "d2").agg(F.count(F.lit(1)).alias("n"))
    return equal.groupBy(*by, "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("repeats"))


def _null_counts_of(profile: DataFrame, by: list[str]) -> DataFrame:
    """(``by``, position from 0, value): NULLs of each cell that has any."""
    places = F.expr("filter(sequence(0, length(mask) - 1), i -> substring(mask, i + 1, 1) = '1')")
    found = profile.where(F.col("mask").contains("1")).select(*by, "n", F.explode(places).alias("position"))
    return found.groupBy(*by, "position").agg(F.sum("n").cast("bigint").alias("value"))


def dq_csv_audit(files: DataFrame, rows: DataFrame) -> DataFrame:
    """``dq_file_audit`` of all CSV files of a folder (``sources.csv.read_csv_dir``) in one plan:
    file names as table_name. ``wide_rows``, where there are any, counts rows with a value
    beyond the file's own columns."""
    mask = F.array_join(F.transform("cells", lambda c: c.isNull().cast("int").cast("string")), "")
    digest = [F.xxhash64("cells", mask).alias("d1"), F.xxhash64(mask, F.lit(1), "cells").alias("d2")]
    equal = rows.select("file", mask.alias("mask"), *digest).groupBy("file", "mask", "d1", "d2").agg(F.count(F.lit(1)).alias("n"))
    profile = equal.groupBy("file", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("repeats"))
    own = profile.join(files.select("file", "names"), "file")
    beyond = F.substring("mask", F.size("names") + 1, F.length("mask")).contains("0")
    totals = own.groupBy("file").agg(F.sum("n").alias("rows"), F.sum("repeats").alias("repeats"), F.sum(F.when(beyond, F.col("n")).otherwise(0)).alias("wide"))
    whole = files.join(totals, "file", "left").select("file", "names", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("rows", "repeats", "wide")])

    def entry(metric: str, value: Column, column: Column | None = None) -> Column:
        name = F.lit(None).cast("string") if column is None else column
        return F.struct(F.lit(metric).alias("metric"), name.alias("column_name"), value.cast("bigint").alias("value"))

    columns = F.transform("names", lambda name, i: entry("column", i + 1, name))
    fixed = F.array(entry("rows", F.col("rows")), entry("duplicate_rows", F.col("repeats")), entry("columns", F.size("names")))
    wide = F.filter(F.array(entry("wide_rows", F.col("wide"))), lambda e: e["value"] > 0)
    per_file = whole.select(F.col("file").alias("table_name"), F.inline(F.concat(fixed, columns, wide)))
    nulls = _null_counts_of(own.withColumn("mask", F.expr("substring(mask, 1, size(names))")), ["file", "names"])
    nulls = nulls.select(F.col("file").alias("table_name"), F.lit("nulls").alias("metric"), F.col("names")[F.col("position")].alias("column_name"), "value")
    return per_file.unionByName(nulls)


def dq_file_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table, in long form (table_name, metric, column_name, value):

    ``rows``; ``columns`` (value = number of columns); ``column`` (one per column,
    value = 1-based position); ``duplicate_rows`` (rows identical to an earlier row,
    NULLs equal); ``nulls`` per column, only where some value is missing. Each table is
    scanned once. No tables give an empty result.
    """
    frames = []
    layout_rows: list[tuple[str, str, str | None, int]] = []
    present = _any_tables(tables)
    if not present:
        spark = SparkSession.getActiveSession()
        if spark is None:
            raise ValueError("no table to audit and no active session")
        return spark.createDataFrame([], AUDIT_SCHEMA)
    for name, df, _ in present:
        cols = df.columns
        layout_rows.append((name, "columns", None, len(cols)))
        layout_rows.extend((name, "column", c, i) for i, c in enumerate(cols, start=1))
        cells = df.toDF(*[f"cell{i}" for i in range(len(cols))])  # whatever the columns are called
        profile = _profile(cells, [], [F.col(c) for c in cells.columns])
        nulls = [
            F.coalesce(F.sum(F.when(F.substring("mask", i, 1) == "1", F.col("n"))), F.lit(0)).cast("bigint").alias(f"nulls{i}")
            for i in range(1, len(cols) + 1)
        ]
        totals = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("n", "repeats")]

        def entry(metric: str, column: str | None, value: str):
            return F.struct(F.lit(metric).alias("metric"), F.lit(column).cast("string").alias("column_name"), F.col(value).alias("value"))

        entries = [entry("rows", None, "n"), entry("duplicate_rows", None, "repeats")]
        entries += [entry("nulls", c, f"nulls{i}") for i, c in enumerate(cols, start=1)]
        frames.append(
            profile.agg(*totals, *nulls)
            .select(F.inline(F.array(*entries)))
            .where((F.col("metric") != F.lit("nulls")) | (F.col("value") > F.lit(0)))
            .select(F.lit(name).alias("table_name"), "metric", "column_name", "value")
        )
    frames.append(present[0][1].sparkSession.createDataFrame(layout_rows, AUDIT_SCHEMA))
    return _union(frames)


class IntegrityError(ValueError):
    """Raised by ``check_integrity`` when an expected-zero check is not zero."""


def integrity_violations(tables: dict[str, DataFrame], fields: dict[str, DataFrame] | None = None) -> DataFrame:
    """Every expected-zero check as (check, detail, violations), only the failing ones;
    with ``fields``, the raw tables as text, also the rows and numbers that cannot be read.

    Duplicate keys (the uniqueness the model's one-to-one / many-to-one joins rely on),
    NULLs in key / NOT NULL columns, orphan items and orders, invalid review scores.
    """
    frames = [
        dq_duplicate_keys(tables).select(
            F.lit("duplicate_keys").alias("check"),
            F.concat_ws(".", "table_name", "key_columns").alias("detail"),
            F.col("duplicate_keys").alias("violations"),
        ),
        dq_not_null(tables).select(
            F.lit("not_null").alias("check"),
            F.concat_ws(".", "table_name", "column_name").alias("detail"),
            F.col("null_rows").alias("violations"),
        ),
    ]
    if fields:
        frames.append(
            dq_unparsed(fields)
            .where("metric != 'timestamp'")
            .select(
                F.when(F.col("metric") == "row", "malformed").otherwise("unparsed").alias("check"),
                F.concat_ws(".", "table_name", "column_name").alias("detail"),
                F.col("unparsed_rows").alias("violations"),
            )
        )
    if "order_items" in tables and "orders" in tables:
        frames.append(
            dq_orphan_items(tables["order_items"], tables["orders"]).select(
                F.lit("orphan_items").alias("check"),
                F.lit("order_items.order_id").alias("detail"),
                F.col("items_without_orders").alias("violations"),
            )
        )
    if "orders" in tables and "customers" in tables:
        frames.append(
            dq_orphan_orders(tables["orders"], tables["customers"]).select(
                F.lit("orphan_orders").alias("check"),
                F.lit("orders.customer_id").alias("detail"),
                F.col("orders_without_customers").alias("violations"),
            )
        )
    if "order_reviews" in tables:
        frames.append(
            dq_invalid_scores(tables["order_reviews"]).select(
                F.lit("invalid_scores").alias("check"),
                F.lit("order_reviews.review_score").alias("detail"),
                F.col("invalid_review_scores").alias("violations"),
            )
        )
    return _union(frames).where(F.col("violations") > F.lit(0))


def _raise_failing(failing: list) -> None:
    if failing:
        lines = ", ".join(f"{r['check']} {r['detail']}={r['violations']}" for r in failing)
        raise IntegrityError(f"integrity checks failed: {lines}")


def check_landed(landed: list[Landed]) -> None:
    """Raise ``IntegrityError`` for what the landing write counted: rows that were rejected,
    numbers that could not be read, and NULLs of required columns."""
    failing = []
    for t in landed:
        numbers = {f.name for f in TABLES[t.table].schema.fields if number_pattern(f.dataType)}
        found = [("malformed", t.table, t.malformed)]
        found += [("unparsed", f"{t.table}.{c}", n) for c, n in t.unparsed.items() if c in numbers]
        found += [("not_null", f"{t.table}.{c}", n) for c, n in t.nulls.items()]
        failing += [{"check": c, "detail": d, "violations": n} for c, d, n in found if n]
    _raise_failing(failing)


def landing_report(spark: SparkSession, landed: list[Landed]) -> DataFrame:
    """``dq_unparsed`` of a landing, from the counts of its writes: a few rows for each table."""
    rows: list[tuple[str, str, str | None, int]] = []
    for t in landed:
        rows.append((t.table, "row", None, t.malformed))
        for f in TABLES[t.table].schema.fields:
            if f.name in t.unparsed:
                rows.append((t.table, "number" if number_pattern(f.dataType) else "timestamp", f.name, t.unparsed[f.name]))
    return spark.createDataFrame(rows, "table_name string, metric string, column_name string, unparsed_rows bigint")


def check_integrity(tables: dict[str, DataFrame], fields: dict[str, DataFrame] | None = None) -> None:
    """Raise ``IntegrityError`` listing every failing expected-zero check.

    The result has at most one row per check (a few dozen), so reading it on the
    driver is bounded regardless of the data size.
    """
    _raise_failing(integrity_violations(tables, fields).collect())


def check_join_keys(tables: dict[str, DataFrame]) -> None:
    """Raise ``IntegrityError`` where a key that a join relies on is held by several rows
    (one row for each key reaches the driver)."""
    failing = dq_join_keys(tables).where(F.col("duplicate_keys") > F.lit(0))
    _raise_failing(
        failing.select(
            F.lit("join_keys").alias("check"),
            F.concat_ws(".", "table_name", "key_columns").alias("detail"),
            F.col("duplicate_keys").alias("violations"),
        ).collect()
    )
