from __future__ import annotations

import zlib
from collections import Counter

import numpy as np

from orderscope.llm.language_model import score_texts, train
from orderscope.llm.queries import QUERIES

SF_SMALL = "/root/testdata/sf0.001"


def tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


def base(text, counts, n, v):
    return sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(text))


def test_query_base_and_gain(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    rows = {r["doc_id"]: r for r in QUERIES["op9_maxent"](spark, SF_SMALL).collect()}
    counts = Counter()
    held = {d["doc_id"]: zlib.crc32(str(d["doc_id"]).encode()) % 5 == 1 for d in docs}
    for d in docs:
        if not held[d["doc_id"]]:
            counts.update(tokens(d["text"]))
    n, v = sum(counts.values()), len(counts)
    for d in docs:
        r, w = rows[d["doc_id"]], tokens(d["text"])
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[d["doc_id"]], len(w), n)
        assert r["n_known"] == sum(x in counts for x in w)
        assert abs(r["base_score"] - base(d["text"], counts, n, v)) < 1e-6 * len(w)
    out = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)  # better on texts never seen


def test_words_outside_the_head_are_joined(spark, monkeypatch):
    from orderscope.llm import language_model

    docs = spark.createDataFrame([(1, "a b c a b a"), (2, "a zz"), (3, None)], "doc_id long, text string")
    whole = score_texts(docs, *train(docs, updates=1)).orderBy("doc_id").collect()
    monkeypatch.setattr(language_model, "HEAD", 1)
    cut = score_texts(docs, *train(docs, updates=1)).orderBy("doc_id").collect()
    for x, y in zip(whole, cut, strict=True):
        assert x["lm_known"] == y["lm_known"]
        assert abs(x["lm_score"] - y["lm_score"]) < 1e-9 and abs(x["lm_base"] - y["lm_base"]) < 1e-9


def test_probabilities_sum_to_one(spark):
    """After any context: the known words and one unseen word for each class."""
    from orderscope.llm import language_model as lm

    docs = spark.createDataFrame([(1, "a b c a b a the cat"), (2, "a cat the b")], "doc_id long, text string")
    model, counts = train(docs)
    known = ["a", "b", "c", "the", "cat"]
    texts = spark.createDataFrame([(i, f"a b {w}") for i, w in enumerate(known)] + [(9, "a b")], "doc_id long, text string")
    score = {r["doc_id"]: r["lm_score"] for r in score_texts(texts, model, counts).collect()}
    unseen = (0.5 / 10**model.log_mass).tolist()
    tail = {w: s for w, s in zip(known, (score[i] for i in range(5)), strict=True)}
    assert len(unseen) == lm.CLASSES and all(np.isfinite(s) and s < 0 for s in tail.values())
    rows = [np.array([f[2]]) for f in lm.features(next(iter(lm.tokenized(lm.pa.array(["a b x"])))))]
    p = np.exp(lm._class_logits(rows, model.bias, model.weights, slice(0, 1)))[0]
    p /= p.sum()
    word_mass = np.zeros(lm.CLASSES)
    t = next(iter(lm.tokenized(lm.pa.array([" ".join(known)]))))
    n = dict(zip(model.head.tolist(), model.head_count.tolist(), strict=True))
    for h, g in zip(t.hashes, t.groups, strict=True):  # the known words and the end
        word_mass[model.class_of[g]] += (n[int(h)] + 0.5) / 10 ** model.log_mass[model.class_of[g]]
    assert abs((p * (word_mass + np.array(unseen))).sum() - 1) < 1e-6


def test_awkward_rows(awkward, nothing):
    model, counts = train(awkward, updates=1)
    scored = score_texts(awkward, model, counts)
    rows = scored.collect()
    assert len(rows) == 12 and scored.columns[: len(awkward.columns)] == awkward.columns
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["lm_tokens"] == by[2]["lm_tokens"] == by[3]["lm_tokens"] == 1
    assert by[1]["lm_score"] == by[2]["lm_score"] and all(np.isfinite(r["lm_score"]) for r in rows)
    assert score_texts(nothing, model, counts).count() == 0
    blank, none = train(nothing, updates=1)
    assert all(np.isfinite(r["lm_score"]) for r in score_texts(awkward, blank, none).collect())
