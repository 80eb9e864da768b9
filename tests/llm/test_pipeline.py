from __future__ import annotations

import random

import __spark_entry__ as entry
import corpus_pipeline
from orderscope.llm.common import save

SF_SMALL = "/root/testdata/sf0.001"


def test_stages_and_registration():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    names = entry.queries()
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert names["pipeline"] is corpus_pipeline.run
    assert set(entry.oracle_sql()) <= set(names)


def test_planted_cases(spark, tmp_path):
    """Each stage finds what was planted for it and leaves clean documents alone."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("bdfgklmnprst", k=3)) + rng.choice("aeiou")
    prose = lambda n=120: " ".join(word() for _ in range(n))
    texts = [prose() for _ in range(200)]
    toxic = list(range(200, 260))
    texts += [f"{prose(30)} you idiot {prose(20)} scum {prose(30)}" for _ in toxic]
    passage = prose(30)
    leaked = list(range(260, 270))
    texts += [f"{prose(50)} {passage} {prose(50)}" for _ in leaked]
    base = texts[0].split()
    copies = list(range(270, 290))
    texts += [" ".join(base)] * 5 + [" ".join([*base[:60], f"e{i}", *base[61:]]) for i in range(15)]
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    d = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, prose(30))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    labels = [(i, 1, int(i in toxic)) for i in range(0, 260, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    now = spark.read.parquet(f"{d}/documents.parquet")
    columns, left, gone = now.columns, set(range(len(docs))), {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        now = save(stage(spark, now, d), "t")
        assert now.columns == columns
        ids = [r["doc_id"] for r in now.select("doc_id").collect()]
        assert len(ids) == len(set(ids))
        gone[name], left = left - set(ids), set(ids)
    assert gone == {"toxicity": set(toxic), "near_duplicates": set(copies), "decontamination": set(leaked)}


def test_run(spark):
    out = corpus_pipeline.run(spark, SF_SMALL)
    rows = out.collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    assert 0 < len(rows) < len(docs)
    assert all(docs[r["doc_id"]]["text"] == r["text"] and 0 <= r["shard"] < 40 for r in rows)


def test_awkward_rows(spark, awkward, nothing, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    for start in (awkward, nothing):
        now = save(start, "awkward")
        for _, stage in corpus_pipeline.STAGES:
            now = save(stage(spark, now, d), "awkward")
        assert set(start.columns) <= set(now.columns)
