from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from llm_cases import LONG, SF_SMALL
from orderscope.llm import lexical_search as S
from orderscope.llm.queries import ORACLE_SQL, QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def slow(docs, items, top=50):
    """The contract, document by document."""
    counted = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    held = [c for _, c in counted if c]
    n_docs, length = len(held), sum(sum(c.values()) for c in held)
    df = Counter(t for c in held for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for doc, c in counted:
            n = sum(c.values())
            score = 0
            for t in set(TERM.findall((text or "").translate(LOWER))):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 100 - 50 + (50 * n * n_docs) // length
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                scores.append((-score, doc is not None, doc or 0, doc))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def found(spark, docs, items, top=50):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in S.search(d, i, top).collect()), key=str)


def some_docs(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(1, 60)))) for i in range(n)]
    docs += [(1000 + i, docs[3][1]) for i in range(80)]  # more ties than places
    items = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(1, 30)))) for i in range(12)]
    return docs, items


@pytest.mark.parametrize("top", [1, 7, 50])
def test_against_brute_force(spark, top):
    docs, items = some_docs(1, 500)
    assert found(spark, docs, items, top) == slow(docs, items, top)


def test_many_small_blocks_and_turns(spark, monkeypatch):
    docs, items = some_docs(2, 300)
    monkeypatch.setattr(S, "ITEM_BYTES", 300)  # several turns
    assert found(spark, docs, items, 5) == slow(docs, items, 5)


def test_stops_early_and_keeps_ties():
    """Reading ends before the lists do, and no document of the k-th score is missing."""
    rng = np.random.default_rng(0)
    n, terms = 20_000, 6
    ends = np.arange(n + 1) * terms
    ids = np.tile(np.arange(terms), n)
    counts = rng.zipf(1.6, n * terms).clip(1, 50)
    block = S.Block(np.full(n, 100), ends, ids, counts, np.arange(1, terms + 1) * 700, n, 100 * n)
    score = block.impact.reshape(n, terms).sum(1)
    docs, scores, read = block.best(np.arange(terms), 10)
    kth = np.sort(score)[-10]
    assert sorted(docs) == np.flatnonzero(score >= kth).tolist()
    assert (scores == score[docs]).all()
    assert read < n * terms / 4
    assert (block.slot == -1).all()


def test_best_positions_are_deeper_than_last_read():
    """Direct look-ups carry the best position of a list beyond what was read of it."""
    n = 1_000
    ends = np.arange(n + 1) * 2
    counts = np.empty(2 * n, np.int64)
    counts[0::2] = np.arange(n, 0, -1)  # both lists in the same order, the second one flat at its end
    counts[1::2] = np.where(np.arange(n) < 10, 900, 1)
    block = S.Block(np.full(n, 100), ends, np.tile([0, 1], n), counts, np.array([1000, 1000]), n, 100 * n)
    docs, _, read = block.best(np.array([0, 1]), 10)
    assert sorted(docs) == list(range(10))
    assert read <= 2 * S.FIRST_READ


def test_lengths_beyond_64_bits():
    big = np.array([1 << 40, 5], np.int64)
    assert S.length_factor(big, 1 << 30, 1 << 50).tolist() == [50 + 50 * int(x) * (1 << 30) // (1 << 50) for x in big]


def test_awkward_rows(spark, awkward, nothing):
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    items = [(1, "The quick FOX"), (1, "The quick FOX"), (2, None), (3, ""), (4, "of w17 w23 end"), (None, "one id"), (5, "ünïcode テスト")]
    wide = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, rank string")
    result = S.search(awkward, wide)
    assert result.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in result.collect()), key=str) == slow(docs, items)
    assert S.search(nothing, wide).count() == 0
    assert S.search(awkward, wide.where("false")).count() == 0
    assert LONG.startswith("w0")


def test_query(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_SMALL}/{name}.parquet'")
    rows = sorted(tuple(r) for r in QUERIES["op12_best_position"](spark, SF_SMALL).collect())
    assert rows == sorted(con.execute(ORACLE_SQL["op12_best_position"]).fetchall())
    docs, items = (con.execute(f"SELECT * FROM {t}").fetchall() for t in ("(SELECT doc_id, text FROM documents)", "benchmark"))
    assert sorted(rows, key=str) == slow(docs, items)
