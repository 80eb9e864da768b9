"""Writers for the model's outputs.

Large outputs (order fact, seller table) are written as distributed datasets; small
reports may be written as one file (``single_file=True`` coalesces to one task, which
is only right for bounded results such as a per-state report). JSON never carries
NaN or infinities, at any depth: they are written as null, and null fields are kept.

The outputs of one build are published together: everything is written under a folder of
that build, and the manifest, which names the folder's document and tables, is written
last. A reader that goes through the manifest (``read_manifest``) never sees a mix of two
builds, nor a build that failed half way.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderscope.session import path_exists, remove_path, scratch_path, write_concurrently


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Headered CSV, no index column; empty strings and NULLs are both written empty."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def _has_float(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_has_float(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _has_float(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _has_float(dtype.keyType) or _has_float(dtype.valueType)
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def strict_value(value: Column, dtype: T.DataType) -> Column:
    """``value`` with every NaN and infinity in it NULL, at any depth of structs, arrays and map
    values. A map key cannot be NULL: an entry whose key is NaN or infinite is left out."""
    if not _has_float(dtype):
        return value
    if isinstance(dtype, T.StructType):
        fields = [strict_value(value.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: strict_value(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        kept = F.map_filter(value, lambda k, v: _key_is_strict(k, dtype.keyType))
        return F.transform_values(kept, lambda k, v: strict_value(v, dtype.valueType))
    finite = ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")).cast(dtype))
    return F.when(finite, value)


def _key_is_strict(key: Column, dtype: T.DataType) -> Column:
    return strict_value(key, dtype).eqNullSafe(key) if _has_float(dtype) else F.lit(True)


def strict_nulls(df: DataFrame) -> DataFrame:
    """Replace NaN and infinities by NULL, nested ones too (strict JSON has neither)."""
    return df.select(*[strict_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def write_json_lines(df: DataFrame, path: str, single_file: bool = False) -> None:
    """JSON lines, one object per row, every field present (null, never NaN)."""
    out = strict_nulls(df)
    out = out.coalesce(1) if single_file else out
    out.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_document(doc: DataFrame, path: str, column: str = "summary_json") -> None:
    """A one-row JSON document column written as a single text file."""
    doc.select(column).coalesce(1).write.mode("overwrite").text(path)


# Report name -> written as one small file?  (unbounded tables stay distributed)
OUTPUT_REPORTS: dict[str, bool] = {
    "order_fact": False,
    "delay_impact": True,
    "monthly_performance": True,
    "state_performance": True,
    "category_performance": True,
    "seller_performance": False,
    "payment_mix": True,
    "kpi_extended": True,
}

PAYLOAD_REPORTS = (
    "delay_impact",
    "monthly_performance",
    "state_performance",
    "category_performance",
    "seller_performance",
    "payment_mix",
)


MANIFEST = "manifest"


def read_manifest(spark: SparkSession, out_dir: str) -> dict[str, str]:
    """The paths of the newest published build: of the summary document, the payload tables and
    the reports, by name. Raises FileNotFoundError where nothing has been published."""
    path = os.path.join(out_dir, MANIFEST)
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    newest = spark.read.schema("build string, seq long, name string, path string").json(path)
    newest = newest.where(F.col("seq") == newest.select(F.max("seq")).scalar())
    return {r["name"]: os.path.join(out_dir, r["path"]) for r in newest.collect()}  # a row for each output


def _publish(spark: SparkSession, out_dir: str, build: str, names: list[str]) -> None:
    """Add the build to the manifest: one file, whose appearance is what publishes it."""
    path = os.path.join(out_dir, MANIFEST)
    seq = 0
    if path_exists(spark, path):
        seq = spark.read.schema("seq long").json(path).agg(F.max("seq")).first()[0] or 0
    rows = [(build, seq + 1, name, f"{build}/{name}") for name in names]
    entry = spark.createDataFrame(rows, "build string, seq long, name string, path string")
    entry.coalesce(1).write.mode("append").json(path)


def write_outputs(model, out_dir: str) -> dict[str, str]:
    """Write the model's published outputs as one build under ``out_dir``.

    CSV reports, the nested summary document (``analysis_summary``), and the payload
    tables as JSON lines (``payload/<report>``), in the folder ``build-<id>``, then the
    manifest. Each report runs once: its rows are written to the shared scratch folder,
    exported to both formats from there, and the scratch folder is removed. Earlier builds
    stay until ``remove_builds``. Returns the paths by name, as ``read_manifest`` does.
    ``model`` is a CommerceModel, ideally materialised.
    """
    spark = model.spark
    build = f"build-{uuid.uuid4().hex[:12]}"
    folder = os.path.join(out_dir, build)
    scratch = scratch_path(spark, "outputs")
    frames = {name: getattr(model, name)() for name in OUTPUT_REPORTS}
    paths = {name: f"{scratch}/{name}" for name in frames}
    written: dict[str, str] = {}
    try:
        write_concurrently([lambda df=df, p=paths[name]: df.write.parquet(p) for name, df in frames.items()])
        jobs = []
        for name, df in frames.items():
            rows = spark.read.schema(df.schema).parquet(paths[name])
            if OUTPUT_REPORTS[name]:  # small, and ordered
                rows = rows.coalesce(1)
            written[name] = os.path.join(folder, name)
            jobs.append(lambda df=rows, p=written[name]: write_csv(df, p))
            if name in PAYLOAD_REPORTS:
                written[f"payload/{name}"] = os.path.join(folder, "payload", name)
                jobs.append(lambda df=rows, p=written[f"payload/{name}"]: write_json_lines(df, p))
        written["analysis_summary"] = os.path.join(folder, "analysis_summary")
        jobs.append(lambda p=written["analysis_summary"]: write_document(model.summary_document(), p))
        write_concurrently(jobs)
        _publish(spark, out_dir, build, list(written))
    finally:
        remove_path(spark, scratch)
    return written


def remove_builds(spark: SparkSession, out_dir: str, keep: int = 2) -> list[str]:
    """Delete all but the newest ``keep`` published builds; readers of the manifest hold the
    newest one. Returns the names of the builds deleted."""
    path = os.path.join(out_dir, MANIFEST)
    if not path_exists(spark, path):
        return []
    rows = spark.read.schema("build string, seq long").json(path).distinct().orderBy(F.desc("seq")).collect()
    old = [r["build"] for r in rows[max(1, keep) :]]
    for build in old:
        remove_path(spark, os.path.join(out_dir, build))
    return old
