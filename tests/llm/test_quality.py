from __future__ import annotations

import zlib

import numpy as np
import pytest
from llm_cases import LONG
from orderscope.llm import quality as Q
from orderscope.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    rows = QUERIES["op13_positive_unlabelled"](spark, SF).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    return rows, labels


def test_held_out_accuracy(scored):
    rows, labels = scored
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in rows)
    good = [r["predicted"] for r in held if labels[r["doc_id"]] == 1]
    bad = [r["predicted"] for r in held if labels[r["doc_id"]] == 0]
    assert len(bad) > 100
    assert np.mean(good) > 0.99
    assert np.mean(bad) < 0.03
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert len(rows) == 10_000


def test_prior_is_estimated_without_bad_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    share = labels.agg({"quality": "avg"}).first()[0]
    only_good = labels.where("quality = 1")
    blocks = Q.describe_documents(docs, Q.trusted_ids(only_good))
    base, n, good = Q._standard(blocks)
    assert (n, good) == (10_000, Q.trusted_ids(only_good).count())
    assert abs(Q.estimate_prior(blocks, base, n, good) - share) < 0.03


def test_bad_risk_is_not_negative():
    """Without the correction, a flexible model is pushed below zero risk on bad rows."""
    z = np.linspace(-30, 30, 7)
    assert np.allclose(Q._loss(z) - Q._loss(-z), -z)  # what makes the unbiased risk convex
    assert np.isfinite(Q._loss(np.array([-1e4, 1e4]))).all()


def test_describe_in_chunks(monkeypatch):
    text = "One two two three.\n| a | b |\nONE!! ### " * 500 + "ünï"
    whole = Q.describe(text)
    monkeypatch.setattr(Q, "CHUNK_BYTES", 64)
    assert np.allclose(whole, Q.describe(text), atol=1e-6)
    assert Q.describe(None).tolist() == Q.describe("").tolist()
    assert np.isfinite(Q.describe("\x00\ud800 \n")).all()


def test_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame(
        [(5, 1, "x"), (6, 1, "x"), (6, 0, "x"), (9, 1, "x"), (None, 1, "x"), (4, None, "x"), (777, 1, "x")], "doc_id long, quality int, text string"
    )
    wide = awkward.withColumn("quality_score", awkward.doc_id).withColumn("good", awkward.doc_id)
    out = Q.classify(wide, labels)
    rows = out.collect()
    assert len(rows) == awkward.count()
    assert out.columns.count("quality_score") == 1
    assert "good" in out.columns
    assert all(0 <= r["quality_score"] <= 1 for r in rows)
    empty = {r["quality_score"] for r in rows if not r["text"]}
    assert len(empty) == 1
    assert len({r["quality_score"] for r in rows if r["doc_id"] in (5, 6)}) == 1
    assert any(r["text"] == LONG for r in rows)
    assert Q.classify(nothing, labels).count() == 0
    untaught = Q.classify(awkward, labels.where("false"))
    assert {r["quality_score"] for r in untaught.collect()} == {0.5}


def test_trusted_rows(spark):
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(3, 0), (None, 1)], "doc_id long, quality int")
    found = {r["doc_id"] for r in Q.trusted_ids(labels).collect()}
    assert found == {i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2 and i != 3}
