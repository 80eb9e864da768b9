"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from pathlib import Path
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import orderscope
from orderscope.session import app_id, remove_path, scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    This cuts the lineage with a table every executor can reach, so a lost executor
    costs a re-read and not a recomputation.
    """
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    saved = df.sparkSession.read.schema(df.schema).parquet(path)
    _SAVED[saved] = path
    return saved


_SAVED: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def free(*saved: DataFrame | None) -> None:
    """Delete what save() wrote for these frames: only where nothing will read it any more,
    which holds when all that was derived from them is itself saved."""
    for df in saved:
        path = _SAVED.pop(df, None) if df is not None else None
        if path:
            remove_path(df.sparkSession, path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package where PYTHONPATH does not name it already."""
    root = Path(orderscope.__file__).resolve().parent.parent
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(root) in on_path or app_id(spark) in _SHIPPED:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="orderscope-"), "orderscope.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((root / "orderscope").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(target)  # Spark serves it to the executors
    _SHIPPED.add(app_id(spark))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, as Spark reads it."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tidy(run):
    """A task's generator function that gives memory back when the task ends: Python workers are
    reused, and else keep what the largest of their tasks needed."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return wrapped


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(text, UPPER, LOWER)


def text_bytes(text: Column) -> Column:
    """UTF-8 length, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def hash62(*cols: Column) -> Column:
    """A 62-bit non-negative hash: differences of two never overflow a long."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 2)


def remainder(doc_id: Column, n: int = 5) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % F.lit(n)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
