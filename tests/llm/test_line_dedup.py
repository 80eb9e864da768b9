from __future__ import annotations

from collections import Counter, defaultdict

import duckdb
from llm_cases import SF_SMALL
from orderscope.llm import line_dedup
from orderscope.llm.line_dedup import drop_boilerplate, host_of, lines_of
from orderscope.llm.queries import ORACLE_SQL, QUERIES
from pyspark.sql import functions as F


def brute(pages, ratio, least):
    total, seen = Counter(h for h, _ in pages), defaultdict(Counter)
    for h, lines in pages:
        seen[h].update(set(lines))
    return [[x for x in lines if not (seen[h][x] >= least and seen[h][x] > ratio * total[h])] for h, lines in pages]


def test_against_brute_force(spark):
    pages = [
        (f"h{i % 4}" if i % 3 else "hot", [f"l{i * j % 11}" for j in range(i % 9)] + ["menu"] * (i % 5 > 0) + [f"own{i}"])
        for i in range(200)
    ]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, host string, body array<string>")
    got = drop_boilerplate(df, F.col("host"), F.col("body"), ratio=0.25, min_pages=3).orderBy("page_id").collect()
    assert [r["kept_lines"] for r in got] == brute(pages, 0.25, 3)


def test_small_hosts_lose_their_menus(spark):
    """Hosts of 1 to 12 pages, with a menu on all pages and a line on two of them."""
    pages = [(f"h{n}", ["menu", f"own{n}-{i}"] + ["twice"] * (i < 2)) for n in range(1, 13) for i in range(n)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, host string, body array<string>")
    got = drop_boilerplate(df, F.col("host"), F.col("body")).orderBy("page_id").collect()
    assert [r["kept_lines"] for r in got] == brute(pages, 0.2, 2)
    assert {r["site"] for r in got if "menu" in r["kept_lines"]} == {"h1"}
    assert {r["site"] for r in got if "twice" in r["kept_lines"]} == {"h1", "h10", "h11", "h12"}


def test_hosts_and_lines(spark):
    row = spark.createDataFrame(
        [("HTTPS://user@WWW.Example.org:8080/a?b#c", "<html><p>One  <b>two</b></p>\r\nthree<br/>four<div class='x'>five</div></html>")],
        "url string, html string",
    )
    got = row.select(host_of(F.col("url")).alias("h"), lines_of(F.col("html")).alias("l")).first()
    assert got["h"] == "www.example.org"
    assert got["l"] == ["One two", "three", "four", "five"]


def test_awkward_rows(awkward, nothing):
    lines = F.split("text", "\n")
    rows = drop_boilerplate(awkward, F.col("source"), lines).collect()
    assert len(rows) == 12
    by = {r["doc_id"]: r for r in rows}
    assert by[10]["site"] == "" and by[10]["site_pages"] == 1
    assert by[1]["lines"] == [] and by[1]["kept_lines"] == [] and by[1]["site_pages"] == 11
    assert drop_boilerplate(nothing, F.col("source"), lines).count() == 0


def test_clashing_names_and_shuffled_hosts(spark, monkeypatch):
    pages = [(f"h{i % 3}", ["menu", f"own{i}"], "user's") for i in range(30)]
    df = spark.createDataFrame(pages, "host string, body array<string>, boilerplate string")
    want = [[line] for _, (_, line), _ in pages]
    for bound in (line_dedup.BROADCAST_BYTES, 0):
        monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", bound)
        got = drop_boilerplate(df, F.col("host"), F.col("body")).collect()
        assert sorted(r["kept_lines"] for r in got) == sorted(want)
        assert {r["boilerplate"] for r in got} == {"user's"}


def test_query(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF_SMALL}/pages.parquet'")
    rows = sorted(tuple(r) for r in QUERIES["op7_site_lines"](spark, SF_SMALL).collect())
    assert rows == sorted(con.execute(ORACLE_SQL["op7_site_lines"]).fetchall())
    small = [r for r in rows if 2 <= r[2] <= 4]
    assert small and any(r[4] < r[3] for r in small)  # hosts of two to four pages lose lines too
