"""Every registered query against its independent DuckDB SQL on the smallest test tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from builders import SF_SMALL
from orderscope.testing.compare import compare, duckdb_connection

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb_connection(SF_SMALL)
    yield c
    c.close()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF_SMALL)
    result = compare(name, df, con, SQL[name])
    assert result.columns_match, result.detail
    assert result.spark_rows == result.oracle_rows
    assert result.exact, result.detail


def test_schemas_line_up_with_oracle_types(spark, con):
    """Spark and DuckDB agree on the type family of every compared column."""
    family = {
        "bigint": "int", "int": "int", "integer": "int", "smallint": "int", "tinyint": "int",
        "double": "float", "float": "float",
        "string": "str", "varchar": "str",
        "boolean": "bool",
        "timestamp_ntz": "ts", "timestamp": "ts",
    }

    def fam(t: str) -> str:
        t = t.lower()
        return "decimal" if t.startswith("decimal") else family.get(t, t)

    for name in ["order_fact", "kpi_extended", "seller_performance", "delay_impact", "dq_file_audit"]:
        df = entry.queries()[name](spark, SF_SMALL)
        s_types = {f.name: fam(f.dataType.simpleString()) for f in df.schema.fields}
        rel = con.sql(SQL[name])
        o_types = {c: fam(str(t)) for c, t in zip(rel.columns, rel.types)}
        assert s_types == o_types, name
