"""Typed CSV ingest of the raw files.

Columns are mapped by position onto the registry schema (``enforceSchema``), so a
misspelt header (``product_name_lenght``) is harmless. Quoted fields may hold commas,
doubled quotes and newlines; a file is read in one split only if some of its lines leave a
quote open (``open_quotes``). An empty field -- quoted or not -- reads as NULL; any other
text, including ``NA``, stays text. Every field is read as text and converted by rule: a
timestamp that does not parse becomes NULL; a number must match its column's form exactly,
so ``abc``, ``10,00``, a third decimal or too many digits are never read as some other
amount. Such a field is NULL in the typed row, which is kept. A row with too few or too many
fields cannot be mapped: it is never typed, its text is kept in ``rejected_rows``. All three
are counted by ``dq_unparsed``; strict builds stop on rows and numbers.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderscope.schemas import TABLES, TableSpec

# Column of text rows: the raw text of a row whose number of fields is wrong, else NULL.
MALFORMED = "_malformed"


def _spec(table: TableSpec | str) -> TableSpec:
    return TABLES[table] if isinstance(table, str) else table


def text_schema(spec: TableSpec) -> T.StructType:
    """The table's columns, all as text."""
    return T.StructType([T.StructField(c, T.StringType()) for c in spec.columns])


def number_pattern(dtype: T.DataType) -> str | None:
    """The form a number of this type must have in a file; None for text and timestamps."""
    if isinstance(dtype, T.DecimalType):
        whole = dtype.precision - dtype.scale
        # money has its scale at most; coordinates carry more digits than are kept
        decimals = f"{{1,{dtype.scale}}}" if dtype.scale <= 2 else "+"
        return rf"^[+-]?[0-9]{{1,{whole}}}([.][0-9]{decimals})?$"
    if isinstance(dtype, T.IntegralType):
        return r"^[+-]?[0-9]+$"
    return None


def typed_value(text: Column, dtype: T.DataType) -> Column:
    """A text field as its type; NULL where it cannot be read."""
    pattern = number_pattern(dtype)
    if pattern:
        return F.when(text.rlike(pattern), text.try_cast(dtype))
    if isinstance(dtype, T.TimestampNTZType):
        return text.try_cast(dtype)
    return text.cast(dtype)


def is_unparsed(text: Column, dtype: T.DataType) -> Column:
    """Whether a field holds text that cannot be read (empty is missing, not bad)."""
    return text.isNotNull() & (text != "") & typed_value(text, dtype).isNull()


def is_malformed(text: DataFrame) -> Column:
    """Whether a row's number of fields is wrong. Spark reads the raw text only together with
    a column of the file, so the first one takes part without deciding anything."""
    return F.col(MALFORMED).isNotNull() & (F.greatest(F.length(text.columns[0]), F.lit(-1)) > F.lit(-2))


def rejected_rows(text: DataFrame, table: TableSpec | str) -> DataFrame:
    """(table_name, record): the rows that are not typed, as they are in the file."""
    return text.where(is_malformed(text)).select(F.lit(_spec(table).name).alias("table_name"), F.col(MALFORMED).alias("record"))


def typed_rows(text: DataFrame, table: TableSpec | str, fail: bool = False) -> DataFrame:
    """Text rows in the table's types, without malformed rows. ``fail`` raises on the first
    malformed row and on the first number that cannot be read."""
    if MALFORMED in text.columns:
        if fail:
            wrong = F.raise_error(F.concat(F.lit(f"{_spec(table).name}: wrong number of fields: "), F.col(MALFORMED)))
            text = text.where(F.when(is_malformed(text), wrong.cast("boolean")).otherwise(F.lit(True)))
        else:
            text = text.where(~is_malformed(text))
    columns = []
    for f in _spec(table).schema.fields:
        value = typed_value(F.col(f.name), f.dataType)
        if fail and number_pattern(f.dataType):
            message = F.concat(F.lit(f"{f.name}: cannot read "), F.col(f.name))
            value = F.when(is_unparsed(F.col(f.name), f.dataType), F.raise_error(message)).otherwise(value)
        columns.append(value.cast(f.dataType).alias(f.name))
    return text.select(*columns)


def read_csv_table(
    spark: SparkSession,
    path: str,
    table: TableSpec | str,
    multi_line: bool | None = None,
) -> DataFrame:
    """Read one raw table (a file, a directory or a glob) with its fixed schema."""
    return typed_rows(read_csv_fields(spark, path, table, multi_line), table)


def open_quotes(lines: DataFrame) -> DataFrame:
    """(file, open_lines): the lines of text files (``spark.read.text``) that leave a quote
    open. A line inside which a quoted field begins or ends, but not both, has an odd number
    of quotes, doubled ones included; so a file without such lines has no quoted newline."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return lines.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count_if(quotes % 2 == 1).alias("open_lines"))


def _csv(
    spark: SparkSession, schema: T.StructType, path: str, multi_line: bool, header: bool, glob: str | None, file: str | None
) -> DataFrame:
    reader = spark.read.schema(schema).options(
        header=header, enforceSchema=True, quote='"', escape='"', multiLine=multi_line, mode="PERMISSIVE",
        encoding="UTF-8", columnNameOfCorruptRecord=MALFORMED, columnPruning=False,
    )
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).csv(path)
    return rows.select("*", F.col("_metadata.file_path").alias(file)) if file else rows


def read_text_rows(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    multi_line: bool | None = None,
    header: bool = True,
    glob: str | None = None,
    file: str | None = None,
) -> DataFrame:
    """CSV rows of a file, a directory or a glob; ``file`` names a column for their path. With
    ``multi_line`` None the files are looked through first, in parallel, and only those that
    leave a quote open at the end of a line lose their splits; their names are file metadata,
    which the driver lists anyway."""
    if multi_line is not None:
        return _csv(spark, schema, path, multi_line, header, glob, file)
    lines = spark.read.option("pathGlobFilter", glob).text(path) if glob else spark.read.text(path)
    odd = F.col("open_lines") > 0
    found = open_quotes(lines).groupBy(odd.alias("odd")).agg(F.collect_list(F.when(odd, F.col("file"))).alias("files"))
    files = {r["odd"]: r["files"] for r in found.collect()}  # two rows
    if True not in files:
        return _csv(spark, schema, path, False, header, glob, file)
    if False not in files:
        return _csv(spark, schema, path, True, header, glob, file)
    is_odd = F.col("_metadata.file_path").isin(files[True])  # pruned from the listing, not read
    plain, whole = (_csv(spark, schema, path, m, header, glob, file) for m in (False, True))
    return plain.where(~is_odd).union(whole.where(is_odd))


def read_csv_fields(
    spark: SparkSession, path: str, table: TableSpec | str, multi_line: bool | None = None, header: bool = True
) -> DataFrame:
    """One raw table with its own column names and every field as text, and ``_malformed``.

    ``multi_line`` says whether quoted fields hold newlines, which makes each file one split;
    None finds out (``read_text_rows``).
    """
    schema = T.StructType([*text_schema(_spec(table)).fields, T.StructField(MALFORMED, T.StringType())])
    return read_text_rows(spark, path, schema, multi_line, header)


# Only the reviews carry free text that can hold newlines: their files are looked through.
MULTI_LINE_TABLES = frozenset({"order_reviews"})


def read_raw_fields(
    spark: SparkSession,
    raw_dir: str,
    names: tuple[str, ...] | None = None,
    file_names: dict[str, str] | None = None,
) -> dict[str, DataFrame]:
    """The raw tables of ``raw_dir`` as text: ``<table>.csv`` each, or the names in
    ``file_names`` (table -> file name, for a folder laid out differently)."""
    files = file_names or {}
    return {
        name: read_csv_fields(
            spark,
            os.path.join(raw_dir, files.get(name, TABLES[name].file_name)),
            name,
            multi_line=None if name in MULTI_LINE_TABLES else False,
        )
        for name in (names or tuple(TABLES))
    }


def read_raw_dir(
    spark: SparkSession,
    raw_dir: str,
    names: tuple[str, ...] | None = None,
    file_names: dict[str, str] | None = None,
) -> dict[str, DataFrame]:
    """The raw tables of ``raw_dir`` in their types."""
    return {name: typed_rows(df, name) for name, df in read_raw_fields(spark, raw_dir, names, file_names).items()}


@dataclass(frozen=True)
class Landed:
    """What the write of one table counted by the way: rows, NULLs of its required columns, rows
    that were rejected, and fields that could not be read."""

    table: str
    rows: int
    nulls: dict[str, int]
    malformed: int
    unparsed: dict[str, int]


def _parsed_fields(spec: TableSpec) -> list[T.StructField]:
    return [f for f in spec.schema.fields if not isinstance(f.dataType, T.StringType)]


def land_csv_dir(
    spark: SparkSession,
    raw_dir: str,
    out_dir: str,
    names: tuple[str, ...] | None = None,
    file_names: dict[str, str] | None = None,
) -> list[Landed]:
    """Land raw CSV files of ``raw_dir`` as typed Parquet tables ``out_dir/<table>``; rejected
    rows go to ``out_dir/_rejected/<table>``. Counts are observed on the write itself, so no
    table is scanned a second time to check its required columns."""
    landed = []
    for name, text in read_raw_fields(spark, raw_dir, names, file_names).items():
        spec = TABLES[name]
        read, wrote = Observation(f"read {name}"), Observation(f"wrote {name}")
        fine = F.col(MALFORMED).isNull()
        bad = [F.count_if(fine & is_unparsed(F.col(f.name), f.dataType)).alias(f.name) for f in _parsed_fields(spec)]
        seen = text.observe(read, F.count_if(is_malformed(text)).alias(MALFORMED), *bad)
        typed = typed_rows(seen, spec)
        nulls = [F.count_if(F.col(c).isNull()).alias(c) for c in spec.required_columns()]
        typed.observe(wrote, F.count(F.lit(1)).alias("rows"), *nulls).write.mode("overwrite").parquet(os.path.join(out_dir, name))
        counted, unparsed = dict(wrote.get), dict(read.get)
        malformed = unparsed.pop(MALFORMED)
        if malformed:
            rejected_rows(text, spec).write.mode("overwrite").parquet(os.path.join(out_dir, "_rejected", name))
        landed.append(Landed(name, counted.pop("rows"), counted, malformed, unparsed))
    return landed


def ingest_csv_dir(
    spark: SparkSession,
    raw_dir: str,
    out_dir: str,
    names: tuple[str, ...] | None = None,
    file_names: dict[str, str] | None = None,
) -> list[str]:
    """``land_csv_dir``, returning the names of the tables."""
    return [t.table for t in land_csv_dir(spark, raw_dir, out_dir, names, file_names)]


# -- folders of any CSV files -------------------------------------------------------------

HEADERLESS = r'"(?:[^"]|"")*"'  # a quoted field, whose commas part nothing


def read_csv_dir(spark: SparkSession, raw_dir: str) -> tuple[DataFrame, DataFrame]:
    """(files, rows) of all ``*.csv`` files directly in ``raw_dir``, whatever their columns, in
    one plan however many files there are.

    ``files``: file, names (the header's, by position). ``rows``: file and ``cells``, the
    texts by position, one more than the widest header has; empty ones are NULL, nothing is inferred.
    Headers are the first rows of the scan that looks for quoted newlines. A header must not
    have a newline in a name. A file without any byte is no table and is left out.
    """
    lines = spark.read.option("pathGlobFilter", "*.csv").text(raw_dir)
    # in the split that begins a file, the line of the smallest id is its first one
    first = F.min_by("value", F.when(F.col("_metadata.file_block_start") == 0, F.col("id")))
    headers = lines.withColumn("id", F.monotonically_increasing_id()).groupBy(F.col("_metadata.file_path").alias("path")).agg(first.alias("header"))
    commas = F.regexp_replace("header", HEADERLESS, "")
    width = F.length(commas) - F.length(F.replace(commas, F.lit(","), F.lit(""))) + 1
    widest = headers.agg(F.max(width)).first()[0] or 1
    cells = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(widest)])
    parsed = F.from_csv("header", ", ".join(f"{c} string" for c in cells.names), {"quote": '"', "escape": '"'})
    names = F.slice(F.array(*[F.coalesce(parsed[f"c{i}"], F.lit("")) for i in range(widest)]), 1, width)
    # paths of file metadata are encoded as URLs
    name = F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B")))
    files = headers.select(name.alias("file"), names.alias("names"))
    one_more = cells.add("beyond", T.StringType())  # shows rows that are wider than any header
    rows = read_text_rows(spark, raw_dir, one_more, glob="*.csv", file="path")
    return files, rows.select(name.alias("file"), F.array(*one_more.names).alias("cells"))
