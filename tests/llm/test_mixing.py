from __future__ import annotations

from collections import defaultdict

import duckdb
import pytest
from llm_cases import SF_SMALL
from orderscope.llm import mixing
from orderscope.llm.mixing import EXPONENTS, mix_corpus, mix_documents, sample_mix, token_count
from orderscope.llm.queries import ORACLE_SQL, QUERIES
from pyspark.sql import functions as F


def test_given_marginals_are_met(spark):
    rows = [(i, "ab"[i % 3 == 0], "xyz"[i % 7 % 3], 1 + i % 5) for i in range(30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n long")
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.2, "y": 0.3, "z": 0.5}}
    dims = {"source": F.col("source"), "lang": F.col("lang")}
    got = mix_documents(docs, dims, F.col("n"), targets=targets).collect()
    expected, sampled = defaultdict(float), defaultdict(float)
    for r in got:
        for k in ("source", "lang"):
            expected[k, r[k]] += r["n"] * r["mix_probability"]
            sampled[k, r[k]] += r["n"] * r["mix_kept"]
    for k, shares in targets.items():
        total, drawn = sum(expected[k, v] for v in shares), sum(sampled[k, v] for v in shares)
        for v, share in shares.items():
            assert abs(expected[k, v] / total - share) < 1e-6
            assert abs(sampled[k, v] / drawn - share) < 0.03
    assert max(r["mix_probability"] for r in got) == 1.0


def test_awkward_rows(awkward, nothing):
    rows = mix_corpus(awkward).collect()
    assert len(rows) == 12
    by = {r["doc_id"]: r for r in rows}
    assert by[10]["mix_source"] == "(none)" and by[1]["mix_tokens"] == 0 and by[1]["mix_probability"] > 0
    assert all(0 < r["mix_probability"] <= 1 for r in rows)
    assert sample_mix(awkward).columns == awkward.columns
    assert sample_mix(nothing).count() == 0


def test_a_value_without_a_target_is_not_drawn(spark):
    docs = spark.createDataFrame([(1, "a", 5), (2, "b", 5), (3, None, 5)], "doc_id long, s string, n long")
    got = mix_documents(docs, {"s": F.col("s")}, F.col("n"), targets={"s": {"a": 1.0}}).collect()
    assert {r["doc_id"]: (r["mix_probability"], r["mix_kept"]) for r in got} == {1: (1.0, True), 2: (0.0, False), 3: (0.0, False)}


def test_marginals_are_met_with_hundreds_of_small_cells(spark):
    """20 sources x 4 languages x 5 topics: nearly all cells hold under 1 % of the tokens."""
    texts = ["word " * 20, "word " * 200, "word " * 600, "12345 " * 30, "license " * 30]
    rows = [
        (i, texts[h % 5], "abcd"[min(3, h // 7 % 9)], f"s{min(19, h // 64 % 50)}")
        for i, h in ((i, i * 2654435761 % (1 << 32) >> 4) for i in range(8_000))
    ]
    got = mix_corpus(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    cells = {(r["mix_source"], r["mix_lang"], r["mix_topic"]) for r in got}
    assert len(cells) > 300
    kept = sum(r["mix_tokens"] * r["mix_probability"] for r in got)
    for name, exponent in EXPONENTS.items():
        seen, expected = defaultdict(int), defaultdict(float)
        for r in got:
            seen[r[f"mix_{name}"]] += r["mix_tokens"]
            expected[r[f"mix_{name}"]] += r["mix_tokens"] * r["mix_probability"]
        whole = sum(n**exponent for n in seen.values())
        for value, n in seen.items():
            assert abs(expected[value] / kept / (n**exponent / whole) - 1) < 1e-4
    assert max(r["mix_probability"] for r in got) == 1.0


def test_token_count(spark):
    texts = [None, "", " ", "a", " a ", "a  b", "a \t\n b\x0b\x0cc\r", "\x01 \x01\x01 x", "ü é", "a" + " " * 1000 + "b", "\u00a0 x"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(token_count(F.col("t"))).collect()
    want = [len([w for w in __import__("re").split("[\x20\x09-\x0d]+", t or "") if w]) for t in texts]
    assert [r[0] for r in got] == want


@pytest.mark.parametrize("bad", [{"a": 2, "b": -1}, {"a": 0}, {"a": float("nan")}, {"a": float("inf"), "b": 1}, {}])
def test_bad_targets(spark, bad):
    docs = spark.createDataFrame([(1, "a", 5), (2, "b", 5)], "doc_id long, s string, n long")
    with pytest.raises(ValueError, match="target shares"):
        mix_documents(docs, {"s": F.col("s")}, F.col("n"), targets={"s": bad})


def test_targets_that_no_sample_meets(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a", "x", 5), (2, "b", "y", 5)], "doc_id long, s string, l string, n long")
    dims = {"s": F.col("s"), "l": F.col("l")}
    with pytest.raises(ValueError, match="no tokens"):
        mix_documents(docs, dims, F.col("n"), targets={"s": {"a": 1, "zz": 1}, "l": {"x": 1, "y": 1}})
    monkeypatch.setattr(mixing, "MOST_SWEEPS", 5)
    with pytest.raises(ValueError, match="converge"):  # source a is language x
        mix_documents(docs, dims, F.col("n"), targets={"s": {"a": 1, "b": 3}, "l": {"x": 3, "y": 1}})


def test_many_cells_by_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "ab"[i % 3 > 0], 1 + i % 4) for i in range(2_000)], "doc_id long, s string, n long")
    call = lambda: {tuple(r) for r in mix_documents(docs, {"s": F.col("s")}, F.col("n"), targets={"s": {"a": 1, "b": 1}}).collect()}
    broadcast = call()
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 0)
    assert call() == broadcast


def test_clashing_names(spark):
    docs = spark.createDataFrame([(i, f"w {i}", "en", "s", "x", "y", "z", "q") for i in range(9)], "doc_id long, text string, lang string, source string, mix_chance string, mix_id string, mix_salt string, mix_kept string")
    out = sample_mix(docs)
    assert out.columns == docs.columns
    assert {tuple(r)[4:] for r in out.collect()} == {("x", "y", "z", "q")}
    assert {"mix_chance", "mix_id", "mix_salt"} <= set(mix_corpus(docs).columns)


def test_query(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    rows = sorted(tuple(r) for r in QUERIES["op6_raking"](spark, SF_SMALL).collect())
    assert rows == sorted(con.execute(ORACLE_SQL["op6_raking"]).fetchall())
