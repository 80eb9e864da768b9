from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from llm_cases import SF_SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from orderscope.llm import conversation_repair as C
from orderscope.llm.queries import QUERIES

LEGAL = re.compile(r"(s?(ua)+)?")


def slow_repair(symbols: list[tuple[str, str]]) -> tuple[int, str]:
    """(cost, audit) by trying all edits of (role initial, fault) rows, with up to two
    inserted rows before each and behind the last."""
    options = []
    for role, fault in symbols:
        row = [("D", 2, "")]
        if fault not in ("blank", "duplicate"):
            extra = 5 if fault == "truncated" else 0
            row += [("K", extra, role or "-"), ("R", 1 + extra, "u"), ("R", 1 + extra, "a")]
        options.append([("I" * n + c, 5 * n + cost, new + out) for n in (0, 1) for new in map("".join, itertools.product("ua", repeat=n)) for c, cost, out in row])
    options.append([("I" * n, 5 * n, "".join(new)) for n in (0, 1, 2) for new in itertools.product("ua", repeat=n)])
    best = None
    for choice in itertools.product(*options):
        if LEGAL.fullmatch("".join(out for *_, out in choice)):
            found = (sum(c for _, c, _ in choice), "".join(a for a, *_ in choice))
            best = found if best is None else min(best, found)
    return best


def slow(rows: list[tuple]) -> dict:
    """The contract, row by row, by a table over (row, state)."""
    blank_text = re.compile(r"[^\x20\x09-\x0D]")
    conversations = defaultdict(list)
    for conv, turn, role, text in rows:
        held = conversations[conv]
        name = {k: " " if v is None else v for k, v in (("c", conv), ("t", turn), ("r", role), ("x", text))}
        way = zlib.crc32(f"{name['c']}:{name['t']}".encode()) % 20
        role, text = name["r"], name["x"]
        if way == 0:
            continue
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        role = "user" if way == 4 else role
        held += [(turn is not None, turn or 0, role, hashlib.md5(text.encode()).hexdigest(), text)] * (2 if way == 3 else 1)
    out = {}
    for conv, held in conversations.items():
        held.sort()
        seen, faults = set(), []
        for _, _, role, _, text in held:
            marks = blank_text.findall(text)
            fault = "blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
        best = {0: (0, "")}  # state -> (cost, audit); inserting never pays, see test_inserts
        for (_, _, role, _, _), fault in zip(held, faults, strict=True):
            after = {}
            for q, (cost, audit) in best.items():
                moves = [("D", 2, q)]
                if fault not in ("blank", "duplicate"):
                    extra = 5 if fault == "truncated" else 0
                    kept = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role[:1], q))
                    moves += [("K", extra, kept)] if kept else []
                    moves.append(("R", 1 + extra, 3 if q == 2 else 2))
                for c, more, to in moves:
                    found = (cost + more, audit + c)
                    after[to] = min(after.get(to, found), found)
            best = after
        cost, audit = min(v for q, v in best.items() if q in (0, 3))
        lines, q = [], 0
        for (_, _, role, _, text), c in zip(held, audit, strict=True):
            if c == "R":
                role = "assistant" if lines and lines[-1].startswith("u") else "user"
            if c != "D":
                lines.append(f"{role}:{text}")
        turns = {t for known, t, *_ in held if known}
        initials = [r[2][:1] for r in held]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


FAULTS = ("", "truncated", "blank", "duplicate")


def cheapest(symbols):
    return C.cheapest(C.collapse((C.symbol(r, f == "blank", f == "duplicate", f != "truncated"), 1) for r, f in symbols))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["s", "u", "a", "x", ""]), st.sampled_from(FAULTS)), max_size=4))
def test_cheapest_edits(symbols):
    assert cheapest(symbols) == slow_repair(symbols)


def test_inserts(monkeypatch):
    """At the contract's costs nothing is inserted; where inserting is cheap it is."""
    rng = random.Random(5)
    for _ in range(300):
        symbols = [(rng.choice("suax"), rng.choice(FAULTS)) for _ in range(rng.randrange(30))]
        assert "I" not in cheapest(symbols)[1]
    caches = (C.inserts, C.power, C._block, C.cheapest)
    monkeypatch.setattr(C, "INSERT", 1)
    try:
        for f in caches:
            f.cache_clear()
        assert cheapest([("u", ""), ("u", "")]) == (1, "KR")
        assert cheapest([("u", "")]) == (1, "KI")
        assert cheapest([("a", ""), ("s", "")])[0] == 2
    finally:
        monkeypatch.undo()
        for f in caches:
            f.cache_clear()


def test_long_runs():
    """Powers and halves give what single rows give."""
    rng = random.Random(3)
    for _ in range(20):
        runs = [(rng.randrange(9), rng.choice([1, 2, 3, 70, 513])) for _ in range(6)]
        cost, audit = C.cheapest(C.collapse(runs))
        v = C.ending()
        ahead = [v]
        for sym, n in reversed(runs):
            for _ in range(n):
                v = C.apply(C.power(sym, 0), v)
                ahead.append(v)
        assert cost == v[0]
        ahead.pop()
        q, out = 0, []
        for sym, n in runs:
            for _ in range(n):
                letters, q = C._one(sym, q, ahead.pop())
                out.append(letters)
        assert audit == "".join(out) + C.trailing(q)


def as_rows(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r["conv_id"]: tuple(r[n] for n in names) for r in df.collect()}


def damaged(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    return as_rows(C.repaired_digest(C.repair(C.damage(df), df)))


def some_rows(seed, conversations, length):
    rng = random.Random(seed)
    texts = ["Hello.", "Yes!", "no end", "  ", "", "a b. c", "Why?\n", None, "x" * 5000 + ".", "ü. "]
    roles = ["user", "assistant", "system", "assistant", "user", "tool", "", None]
    out = []
    for conv in [None, *range(conversations)]:
        for turn in range(rng.randrange(length)):
            t = rng.choice([turn, turn, turn, turn * 2, None])
            text = rng.choice(texts)
            text = f"{text} {rng.randrange(9)}." if text and rng.random() < 0.5 else text
            row = (conv, t, rng.choice(roles[:2] if rng.random() < 0.7 else roles), text)
            out += [row] * rng.choice([1, 1, 1, 2])
    return out


def test_small_conversations(spark):
    rows = some_rows(1, 60, 14)
    assert damaged(spark, rows) == slow(rows)


def test_large_conversations(spark, monkeypatch):
    """All conversations in pieces, of few rows, over several tasks."""
    monkeypatch.setattr(C, "LARGE_ROWS", 4)
    rows = some_rows(2, 12, 120)
    expected = slow(rows)
    assert damaged(spark, rows) == expected
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = C.repair(C.damage(df), df)
    lines = defaultdict(list)
    for r in C.repaired_rows(done).orderBy("key", "part", "chunk", "place").collect():
        lines[r["key"]].append(f"{r['role']}:{r['text']}")
    for r in done.conversations.collect():
        found = hashlib.sha256("\n".join(lines[r["key"]]).encode()).hexdigest()
        assert found == expected[r["conv_id"]][-1]


def test_one_conversation_of_many_rows(spark):
    """Longer than LARGE_ROWS and in several pieces, beside small ones."""
    rows = [(1, i, "user" if i % 3 else "assistant", f"text {i % 4000}" + ("." if i % 7 else "")) for i in range(9_000)]
    rows += some_rows(4, 5, 9)
    assert damaged(spark, rows) == slow(rows)


def test_awkward_rows(spark):
    schema = "conv_id long, turn long, role string, text string, key string, lines string, copies long, audit string, uid string"
    rows = [(1, None, None, None), (1, None, "user", "a."), (2, 0, "user", None), (2, 0, "user", None), (None, 5, "system", "s.")]
    rows += [(3, i, "user", "w " * 400_000 + ".") for i in range(2)]
    wide = spark.createDataFrame([(*r, "x", "x", 1, "x", "x") for r in rows], schema)
    found = as_rows(C.repaired_digest(C.repair(C.damage(wide), wide)))
    assert found == slow(rows)
    assert damaged(spark, []) == {}
    gone = [(4, 0, "user", "dropped?")]  # damage takes the only row away
    way = next(t for t in range(1000) if zlib.crc32(f"4:{t}".encode()) % 20 == 0)
    found = damaged(spark, [(4, way, "user", "x.")] + gone[:0])
    assert found == {4: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize("folder", [SF_SMALL, "/root/testdata/sf0.01"])
def test_query(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_rows(QUERIES["op11_run_length"](spark, folder)) == slow(rows)
