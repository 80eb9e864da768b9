from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from orderscope.llm.decontamination import decontaminate, drop_contaminated
from orderscope.llm.queries import QUERIES

SF_SMALL = "/root/testdata/sf0.001"

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def brute(docs, items, window=10):
    out = {}
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for item, itext in items:
            iw = words(itext)
            n = min(window, len(iw))
            if not n:
                continue
            windows = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)}
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit.update(range(p, p + n))
                    found.add(str(item))
        out[key] = (len(w), len(hit), sorted(found))
    return out


def result(df):
    return {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"])) for r in df.collect()}


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["a", "b", "c", "Dd", "é"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 9, 10, 11, 25])))) for i in range(12)]
    docs = []
    for d in range(60):
        parts = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        if d % 2:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(items)[1])
        docs.append((d, "-".join(parts)))
    got = decontaminate(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    assert result(got) == brute(docs, items)


def test_awkward_rows(spark, awkward, nothing):
    items = spark.createDataFrame(
        [(1, "fox jumps over THE lazy dog, again and again today"), (2, None), (3, "..."), (None, "no id here"), (1, "one")],
        "item_id long, text string",
    )
    rows = decontaminate(awkward, items).collect()
    assert len(rows) == awkward.count()
    by = {(r["doc_id"], r["n_words"]): r for r in rows}
    assert by[5, 13]["n_hit"] == 10 and by[5, 13]["items"] == ["1"]
    assert by[None, 3]["items"] == [""] and by[4, 1]["n_hit"] == 1 and by[1, 0]["contaminated"] is False
    kept = drop_contaminated(awkward, items)
    assert kept.columns == awkward.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 10, 2, 3, 7, 8, 9]
    assert decontaminate(nothing, items).count() == 0
    assert decontaminate(awkward, items.limit(0)).where("contaminated").count() == 0


def test_query_digest(spark):
    rows = QUERIES["op10_winnowing"](spark, SF_SMALL).collect()
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()
    want = brute([tuple(r) for r in docs], [tuple(r) for r in items])
    for r in rows:
        n, hit, found = want[r["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(found), hit > 0)
        assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    plan = decontaminate(docs, spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")).select(F.count("*"))
    assert "Python" not in plan._jdf.queryExecution().toString()


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven", "x", "y", "z")], "doc_id long, text string, _dc_id string, _dc_text string, _dc_hash string")
    other = spark.createDataFrame([(2, "a b c d e f g h i j k l m")], "item_id long, text string")
    kept = drop_contaminated(docs, other)
    assert kept.columns == docs.columns and [tuple(r)[2:] for r in kept.collect()] == [("x", "y", "z")]
    assert drop_contaminated(docs, docs.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_items_too_large_to_broadcast(spark, monkeypatch):
    from orderscope.llm import decontamination

    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(40))) for i in range(30)], "doc_id long, text string")
    items = docs.where("doc_id % 3 = 0").withColumnRenamed("doc_id", "item_id")
    call = lambda: {(r["doc_id"], r["n_hit"], tuple(r["items"])) for r in decontamination.decontaminate(docs, items).collect()}
    found = call()
    assert sum(n == 40 for _, n, _ in found) == 10
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 100)
    assert call() == found
