"""Run a Spark query and its DuckDB oracle on the same tables and compare the results.

Columns are matched by name; rows are compared as an order-insensitive multiset,
exactly (Decimal, float, timestamp values as they come) and, for information, with
a relative float tolerance.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

def duckdb_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """A connection with every table of the folder as a view."""
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        files = f"{path}/*" if path.is_dir() else path
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{files}')")
    return con


def run_oracle(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return cols, cur.fetchall()


@dataclass
class Comparison:
    name: str
    spark_rows: int
    oracle_rows: int
    columns_match: bool
    exact: bool
    approx: bool
    detail: str = ""

    @property
    def ok(self) -> bool:
        return self.columns_match and self.exact


def _canon(rows: list[tuple], order: list[int]) -> list[tuple]:
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def _close(a: object, b: object) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)
    return a == b


def compare(name: str, df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> Comparison:
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    o_cols, o_rows = run_oracle(con, sql)
    if sorted(s_cols) != sorted(o_cols):
        return Comparison(
            name, len(s_rows), len(o_rows), False, False, False,
            f"columns differ: spark-only {sorted(set(s_cols) - set(o_cols))}, "
            f"oracle-only {sorted(set(o_cols) - set(s_cols))}",
        )
    names = sorted(s_cols)
    a = _canon(s_rows, [s_cols.index(c) for c in names])
    b = _canon(o_rows, [o_cols.index(c) for c in names])
    exact = a == b
    approx = len(a) == len(b) and all(
        all(_close(x, y) for x, y in zip(ra, rb)) for ra, rb in zip(a, b)
    )
    detail = ""
    if not exact:
        for ra, rb in zip(a, b):
            if ra != rb:
                diffs = [
                    f"{c}: {x!r} != {y!r}" for c, x, y in zip(names, ra, rb) if x != y
                ]
                detail = "; ".join(diffs[:4])
                break
        else:
            detail = f"row counts {len(a)} vs {len(b)}"
    return Comparison(name, len(s_rows), len(o_rows), True, exact, approx, detail)
