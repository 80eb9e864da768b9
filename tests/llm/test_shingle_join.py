from __future__ import annotations

import random

import numpy as np
import pytest
from llm_cases import SF_SMALL
from orderscope.llm import shingle_join
from orderscope.llm.queries import QUERIES
from orderscope.llm.shingle_join import allot, join_components, keep_one_of_each, shingle_set, signatures


def brute(docs, k, percent):
    sets = {d: set(shingle_set(t, k).tolist()) for d, t in docs}
    ids = sorted(sets)
    group = {d: d for d in ids}
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                i = len(sets[a] & sets[b])
                if 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                    low, high = sorted((group[a], group[b]))
                    group = {d: low if g == high else g for d, g in group.items()}
    return {d: (len(sets[d]), group[d]) for d in ids}


def family(seed, texts=70):
    """Texts from 0 to 400 words, with chains of edits: neighbours link, ends don't."""
    rng = random.Random(seed)
    out = []
    while len(out) < texts:
        words = [f"v{rng.randrange(3000)}" for _ in range(rng.choice([0, 1, 2, 5, 12, 40, 120, 400]))]
        for _ in range(rng.randrange(1, 7)):
            out.append((len(out), " ".join(words)))
            for _ in range(max(1, len(words) // 90)):
                if words:
                    words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return out


@pytest.mark.parametrize("k,percent,widen,count", [(3, 90, None, None), (5, 80, None, 10**9), (3, 90, 3, None), (2, 80, 2, None)])
def test_against_brute_force(spark, k, percent, widen, count):
    docs = family(k * percent)
    got = join_components(spark.createDataFrame(docs, "doc_id long, text string"), k, percent, widen=widen, set_count=count)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute(docs, k, percent)


def test_a_band_is_allotted_enough_segments():
    for largest in (10, 19, 200, 5000):
        for percent in (80, 90):
            for count in (100, 10**6, 10**10):
                plan = allot(largest, percent, count)
                bound = (100 - percent) * 2 * largest // (100 + percent)
                if bound == 0:
                    assert plan is None
                    continue
                slots, widened, spare = plan
                assert slots - spare == bound + 1 and 2 * widened <= slots
    assert allot(5000, 80, 10**10)[1] > 0  # very many sets: deletions pay


def test_linked_sets_two_bands_apart():
    """93 and 186 tokens, bands 63-93 and 141-210: the smaller set is half of the larger one."""
    for seed in range(40):
        words = [f"s{seed}w{i}" for i in range(186)]
        few, many = (signatures(shingle_set(" ".join(x), 1), 50, 1000) for x in (words[:93], words))
        assert set((few >> 1).tolist()) & set((many >> 1).tolist())


def test_low_similarity_against_brute_force(spark):
    words = [f"w{i}" for i in range(400)]
    docs = [(n, " ".join(words[:n])) for n in (20, 45, 93, 186, 371, 400)]
    got = join_components(spark.createDataFrame(docs, "doc_id long, text string"), 1, 50)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute(docs, 1, 50)


def test_one_large_group_of_near_copies(spark):
    words = [f"c{i}" for i in range(300)]
    docs = [(i, " ".join([*words[:150], f"e{i}", *words[151:]])) for i in range(400)]
    got = join_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), 3, 90)
    assert {r["component_id"] for r in got.collect()} == {0}


def test_awkward_rows(awkward, nothing):
    rows = join_components(awkward, 3, 90).collect()
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert len(rows) == 12
    assert by[1] == by[2][:1] + (1,) == (0, 1) and by[3] == (0, 3) and by[4] == (1, 4)
    assert by[5][1] == by[6][1] == 5 and by[8][1] == 7 and by[None] == (1, None)
    assert join_components(nothing, 3, 90).count() == 0
    kept = keep_one_of_each(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 10, 2, 3, 4, 5, 7, 9, None]
    assert keep_one_of_each(nothing).count() == 0


def test_repeated_rows_are_verified_once(spark, monkeypatch):
    """200 repeats of each of two linked texts: one pair, each set sent once."""
    words = [f"c{i}" for i in range(200)]
    docs = [(1, " ".join(words))] * 200 + [(2, " ".join([*words[:100], "edit", *words[101:]]))] * 200
    seen = []
    tested = shingle_join._in_blocks

    def spy(pairs, payload, test, result):
        seen.append((pairs.count(), payload.groupBy("id").count().agg({"count": "max"}).first()[0]))
        return tested(pairs, payload, test, result)

    monkeypatch.setattr(shingle_join, "_in_blocks", spy)
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    got = join_components(df, 3, 90)
    assert {(r["doc_id"], r["component_id"]) for r in got.collect()} == {(1, 1), (2, 1)}
    assert seen[:2] == [(1, 1), (1, 1)]  # sketches, whole sets
    assert all(n == 0 for n, _ in seen[2:])  # and nothing is left
    assert keep_one_of_each(df).count() == 1


def test_every_linked_pair_shares_a_signature():
    """Pairs at the threshold, of all sizes: a shared signature, and one of the two not a guest."""
    rng = np.random.default_rng(1)
    for turn in range(300):
        percent, widen = [(80, None), (90, None), (60, None), (80, 3)][turn % 4]
        a = np.unique(rng.integers(0, 1 << 63, int(np.exp(rng.uniform(0.1, 7))), dtype=np.uint64))
        common = a[rng.permutation(len(a))[: len(a) - int(rng.integers(0, len(a) // 4 + 1))]]
        most = 100 * len(common) // percent - len(a)  # new tokens that keep the similarity
        if most < 0:
            continue
        b = np.unique(np.concatenate([common, rng.integers(0, 1 << 63, most, dtype=np.uint64)]))
        if not len(b):
            continue
        x, y = ({int(v) >> 1: int(v) & 1 for v in signatures(s, percent, 50_000, widen)} for s in (a, b))
        if len(np.setxor1d(a, b)):
            assert any(x[s] + y[s] < 2 for s in x.keys() & y.keys())


def test_query_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = QUERIES["op8_pigeonhole_join"](spark, SF_SMALL)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute(docs, 3, 90)


def test_clashing_names(spark):
    words = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, words, "x", "y", "z"), (2, words, "x", "y", "z")], "doc_id long, text string, _jk_id string, _jk_text string, _jk_hash string")
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, words, "x", "y", "z")]
