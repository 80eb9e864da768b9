from __future__ import annotations

import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from orderscope.llm import queries
from orderscope.llm.common import save
from orderscope.llm.queries import QUERIES
from orderscope.llm.sharding import histogram_sort, shard_documents

SF_SMALL = "/root/testdata/sf0.001"


def placed(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["shard"]].append(r)
    return out


def test_sizes_are_near_equal_and_slots_gapless(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 17 + 1).alias("b"))
    got = placed(histogram_sort(docs, 7, F.col("b"), [F.col("doc_id")], [F.col("doc_id")], tolerance=0.001))
    total = sum(r["b"] for rs in got.values() for r in rs)
    assert sorted(got) == list(range(7))
    for rs in got.values():
        assert abs(sum(r["b"] for r in rs) - total / 7) <= 2 * 0.001 * total / 7 + 17
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))


def test_a_group_stays_together_unless_it_is_large(spark):
    small = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 1000).alias("text"))
    hot = spark.range(3000, 4500).select(F.col("id").alias("doc_id"), F.lit("hot").alias("text"))
    docs = small.union(hot)
    rows = shard_documents(docs, 5, tolerance=0.02).collect()
    shards = defaultdict(set)
    size = defaultdict(int)
    for r in rows:
        shards[r["text"]].add(r["shard"])
        size[r["shard"]] += len(r["text"]) + 16
    assert len(rows) == 4500
    assert all(len(s) == 1 for t, s in shards.items() if t != "hot")
    assert len(shards["hot"]) > 1
    mean = sum(size.values()) / 5
    assert max(size.values()) - min(size.values()) < 0.05 * mean


def test_awkward_rows(awkward, nothing):
    rows = shard_documents(awkward, 4).collect()
    assert len(rows) == 12
    assert all(isinstance(r["slot"], int) and 0 <= r["shard"] < 4 for r in rows)
    assert shard_documents(nothing, 4).count() == 0
    one = shard_documents(awkward.where("doc_id = 4"), 4).collect()
    assert len(one) == 1 and one[0]["slot"] == 0


def test_rows_that_cannot_be_parted(spark):
    same = spark.createDataFrame([(1, "a")] * 10, "doc_id long, text string")
    got = placed(shard_documents(same, 3))
    assert sum(len(v) for v in got.values()) == 10
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in got.values())


def test_query(spark):
    rows = QUERIES["op1_histogram_sort"](spark, SF_SMALL).collect()
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}


def test_query_values(spark):
    """Sizes, hashes, gapless slots, and no group parted that is at most a quarter of a shard."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    rows = QUERIES["op1_histogram_sort"](spark, "/root/testdata/sf0.1").collect()
    assert len(rows) == len(text)
    slots, shards, size = defaultdict(list), defaultdict(set), defaultdict(int)
    for r in rows:
        t = text[r["doc_id"]]
        assert (r["size"], r["text_crc32"]) == (len(t) + 16, zlib.crc32(t))
        slots[r["shard"]].append(r["slot"])
        shards[t].add(r["shard"])
        size[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {t for t, s in shards.items() if len(s) > 1} == set()
    mean = sum(size.values()) / 40
    assert max(abs(s - mean) for s in size.values()) <= 0.25 * mean


def test_clashing_names(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "a", "b", "c") for i in range(50)], "doc_id long, text string, _hs_high string, _hs_group string, `x.y` string")
    out = shard_documents(docs, 3)
    assert out.columns == [*docs.columns, "shard", "slot"]
    assert {tuple(r)[2:5] for r in out.collect()} == {("a", "b", "c")}


def test_query_shards_whole_documents(spark, monkeypatch):
    """What the query reports is what shard_documents() wrote, texts included."""
    written = []
    monkeypatch.setattr(queries, "save", lambda df, name: written.append(save(df, name)) or written[-1], raising=False)
    rows = QUERIES["op1_histogram_sort"](spark, SF_SMALL).collect()
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    (out,) = written
    assert set(out.columns) == {*docs.columns, "shard", "slot"}
    assert sorted(out.select(*docs.columns).collect(), key=str) == sorted(docs.collect(), key=str)
    place = lambda rows: sorted((r["doc_id"], r["shard"], r["slot"]) for r in rows)
    assert place(rows) == place(out.collect())
