"""Conversation structure repair by run-length dynamic programming (operator 11).

A row of a conversation is one symbol: the kind of its role and its fault. Equal consecutive
symbols are one run. The cheapest edits are a shortest path through a four-state machine of
legal role orders, so a symbol is a 4 x 4 min-plus matrix and a run of n rows its n-th power,
put together from cached binary powers. Costs come from the last run to the first; the
choices are then unrolled from the first row to the last, halving the powers again.

A conversation up to LARGE_ROWS rows and LARGE_BYTES is repaired in one go by the task that
holds it. A longer one is cut into pieces of PIECE_UNITS that many tasks share: each piece
gives one matrix, the matrices of a conversation give the costs behind each piece, and the
pieces are unrolled side by side for every state they could be entered in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderscope.llm.common import save, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # costs; TRUNCATED is for a row left cut off
LARGE_ROWS = 1_000
LARGE_BYTES = 16 << 20
PIECE_UNITS = 2_000
CACHED_POWER = 12  # letters of longer blocks are put together anew
BLANK = r"[^\x20\x09-\x0D]"  # a text without such a character is blank
ENDED = r"[.!?][\x20\x09-\x0D]*\z"

# -- the machine --------------------------------------------------------------------------

# States: nothing yet, after the system row, after a user row, after an assistant row.
STATES, ACCEPTING = 4, (0, 3)
FAR = 1 << 60
_KINDS = "sua-"  # role kinds; "-" is any other role
MUST_DELETE = 8  # symbols: kind + 4 if truncated, or MUST_DELETE
Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


def symbol(role: str, blank: bool, repeated: bool, ended: bool) -> int:
    if blank or repeated:
        return MUST_DELETE
    return (_KINDS.index(role[0]) if role and role[0] in "sua" else 3) + (0 if ended else 4)


def _turn_to(state: int) -> int:
    """The state after the only role that may be written anew: user, or assistant after user."""
    return 3 if state == 2 else 2


def _kept(kind: int, state: int) -> int | None:
    if kind == 0:
        return 1 if state == 0 else None
    if kind == 1:
        return 2 if state != 2 else None
    return 3 if kind == 2 and state == 2 else None


def choices(sym: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what can be done with a row, letters in ASCII order."""
    out = [("D", DELETE, state)]
    if sym != MUST_DELETE:
        extra = TRUNCATED if sym >= 4 else 0
        after = _kept(sym % 4, state)
        if after is not None:
            out.append(("K", KEEP + extra, after))
        out.append(("R", REROLE + extra, _turn_to(state)))
    return out


def times(a: Matrix, b: Matrix) -> Matrix:
    n = range(STATES)
    return tuple(tuple(min(FAR, *(a[i][k] + b[k][j] for k in n)) for j in n) for i in n)


def apply(a: Matrix, v: Vector) -> Vector:
    v0, v1, v2, v3 = v
    return tuple([min(r[0] + v0, r[1] + v1, r[2] + v2, r[3] + v3) for r in a])


@lru_cache(maxsize=None)
def inserts() -> Matrix:
    """Costs from state to state by inserted rows alone."""
    rows = []
    for q in range(STATES):
        cost, at, row = 0, q, [FAR] * STATES
        while row[at] == FAR:
            row[at] = cost
            cost, at = cost + INSERT, _turn_to(at)
        rows.append(tuple(row))
    return tuple(rows)


@lru_cache(maxsize=None)
def power(sym: int, k: int) -> Matrix:
    """The matrix of 2 ** k rows of a symbol, each after any inserted rows."""
    if k:
        return times(power(sym, k - 1), power(sym, k - 1))
    step = [[FAR] * STATES for _ in range(STATES)]
    for q in range(STATES):
        for _, cost, after in choices(sym, q):
            step[q][after] = min(step[q][after], cost)
    return times(inserts(), tuple(map(tuple, step)))


def run_matrix(sym: int, n: int) -> Matrix:
    out, k = None, 0
    while n >> k:
        if n >> k & 1:
            out = power(sym, k) if out is None else times(out, power(sym, k))
        k += 1
    return out


def after_run(sym: int, n: int, v: Vector) -> Vector:
    """Costs before a run from the costs behind it."""
    k = 0
    while n >> k:
        if n >> k & 1:
            v = apply(power(sym, k), v)
        k += 1
    return v


def ending() -> Vector:
    """Costs behind the last row."""
    return apply(inserts(), tuple(0 if q in ACCEPTING else FAR for q in range(STATES)))


def _one(sym: int, q: int, behind: Vector) -> tuple[str, int]:
    """The ASCII-least cheapest letters for one row, and the state after it."""
    here = apply(power(sym, 0), behind)
    letters = ""
    while True:
        options = [(c, cost + behind[after], after) for c, cost, after in choices(sym, q)]
        options.append(("I", INSERT + here[_turn_to(q)], _turn_to(q)))
        c, _, after = min(o for o in options if o[1] == here[q])
        letters, q = letters + c, after
        if c != "I":
            return letters, q


@lru_cache(maxsize=1 << 14)
def _block(sym: int, k: int, q: int, behind: Vector) -> tuple[str, int]:
    """Letters of 2 ** k rows of a symbol. The costs behind matter up to a constant only."""
    if k == 0:
        return _one(sym, q, behind)
    first, q = _halves(sym, k - 1, q, apply(power(sym, k - 1), behind))
    second, q = _halves(sym, k - 1, q, behind)
    return first + second, q


def _halves(sym: int, k: int, q: int, behind: Vector) -> tuple[str, int]:
    least = min(behind)
    find = _block if k <= CACHED_POWER else _block.__wrapped__
    return find(sym, k, q, tuple([x - least for x in behind]))


def unroll(runs: list[tuple[int, int]], behind: Vector, q: int) -> tuple[str, int]:
    """Letters of the runs from state ``q`` on, with the costs behind them; and the last state."""
    ahead = [behind]
    for sym, n in reversed(runs):
        ahead.append(after_run(sym, n, ahead[-1]))
    ahead.pop()
    out = []
    for sym, n in runs:
        v = ahead.pop()
        blocks = [k for k in range(n.bit_length()) if n >> k & 1]
        behinds = []
        for k in blocks:
            behinds.append((k, v))
            v = apply(power(sym, k), v)
        for k, behind_block in reversed(behinds):
            letters, q = _halves(sym, k, q, behind_block)
            out.append(letters)
    return "".join(out), q


def trailing(q: int) -> str:
    """Inserted rows behind the last row."""
    out, v = "", ending()
    while q not in ACCEPTING or v[q]:
        out, q = out + "I", _turn_to(q)
    return out


def collapse(symbols: Iterable[tuple[int, int]]) -> tuple[tuple[int, int], ...]:
    """(symbol, count) with equal neighbours joined."""
    runs: list[list[int]] = []
    for sym, n in symbols:
        if n and runs and runs[-1][0] == sym:
            runs[-1][1] += n
        elif n:
            runs.append([sym, n])
    return tuple(map(tuple, runs))


@lru_cache(maxsize=1 << 14)
def cheapest(runs: tuple[tuple[int, int], ...]) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    v = ending()
    for sym, n in reversed(runs):
        v = after_run(sym, n, v)
    letters, q = unroll(runs, ending(), 0)
    return v[0], letters + trailing(q)


# -- rows ---------------------------------------------------------------------------------


def damage(rows: DataFrame) -> DataFrame:
    """Rows made faulty by crc32("conv_id:turn") % 20: 0 drops one, 1 empties its text, 2 takes
    its [.!?] away, 3 repeats it (column ``copies``), 4 makes its role user.

    Defined cases: nulls of any column count as one space in the key, the role and the text;
    a null turn stays null for the order; an empty table gives no rows.
    """
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    way = F.crc32(F.concat(text["conv_id"], F.lit(":"), text["turn"])) % F.lit(20)
    return (
        rows.select("conv_id", F.col("turn").cast("long").alias("turn"), text["role"].alias("role"), text["text"].alias("text"), way.alias("way"))
        .where("way != 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("way") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
            F.when(F.col("way") == 3, 2).otherwise(1).cast("long").alias("copies"),
        )
    )


def _key(conv_id: Column) -> Column:
    """A conversation's name: never null."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def _marked(rows: DataFrame) -> DataFrame:
    """What the operator needs of each row; nulls of role and text count as one space."""
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    one = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")}
    rows = rows.select(_key(F.col("conv_id")).alias("key"), F.col("turn").cast("long").alias("turn"), one["role"], one["text"], copies.alias("copies"))
    return rows.select(
        "key", "turn", "role", "text", "copies",
        F.md5("text").alias("digest"),
        (~F.col("text").rlike(BLANK)).alias("blank"),
        F.col("text").rlike(ENDED).alias("ended"),
    )


_ORDER = ("key", "turn", "role", "digest")  # ascending, nulls first
_PAIRS = ("su", "ua", "au")


class Facts:
    """Counts over rows of a conversation that come in order."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None  # role initials
        self.low = self.high = None  # turns

    def add(self, turn: int | None, role: str, sym: int, blank: bool, repeated: bool, copies: int) -> None:
        if blank:
            self.blank += copies
        else:
            self.duplicate += copies - (0 if repeated else 1)
            self.truncated += sym != MUST_DELETE and sym >= 4
        if self.last is None:
            self.first = role[:1]
        else:
            self.illegal += self.last + role[:1] not in _PAIRS
        self.illegal += copies - 1  # a row beside its copy
        self.last = role[:1]
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = (turn if self.low is None else self.low), turn

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


class _Small:
    """One conversation of the bounded path, row by row, then its repair."""

    def __init__(self):
        self.rows: list[tuple[int, int, str, str]] = []
        self.seen: set[tuple[str, str]] = set()
        self.facts = Facts()

    def add(self, turn, role, text, copies, digest, blank, ended) -> None:
        repeated = (role, digest) in self.seen
        self.seen.add((role, digest))
        sym = symbol(role, blank, repeated, ended)
        self.facts.add(turn, role, sym, blank, repeated, copies)
        self.rows.append((sym, copies, role, text))

    def repaired(self) -> tuple[int, str, list[tuple[str, str]]]:
        """(cost, audit, rows): copies of a row after the first must go."""
        cost, audit = cheapest(collapse(s for sym, n, _, _ in self.rows for s in ((sym, 1), (MUST_DELETE, n - 1))))
        out, at, q = [], iter([(r, t) for _, n, r, t in self.rows for r, t in ((r, t),) * n]), 0
        for letter in audit:
            role, text = ("", "") if letter == "I" else next(at)
            if letter == "D":
                continue
            if letter != "K":
                q = _turn_to(q)
                role = "user" if q == 2 else "assistant"
            else:
                q = _kept(_KINDS.index(role[0]), q)
            out.append((role, text))
        return cost, audit, out


_LINES = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_RESULT = "key string, " + ", ".join(f"{c} long" for c in _FACTS) + ", audit string, lines array<struct<role string, text string>>"
_BATCH_ROWS, _BATCH_CHARS = 1_000, 4 << 20


def _repair_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of sorted rows, one after the other."""
    done: list[tuple] = []
    held = chars = 0
    key, conv = None, None

    def finish():
        cost, audit, lines = conv.repaired()
        f = conv.facts
        done.append((key, f.gaps(), f.blank, f.duplicate, f.truncated, f.illegal, cost, audit, lines))
        return sum(len(t) for _, t in lines)

    def flush():
        columns = list(zip(*done, strict=True))
        arrays = [pa.array(columns[0], pa.string()), *[pa.array(c, pa.int64()) for c in columns[1:7]], pa.array(columns[7], pa.string())]
        lines = [{"role": r, "text": t} for c in columns[8] for r, t in c]
        ends = [0]
        for c in columns[8]:
            ends.append(ends[-1] + len(c))
        arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(lines, _LINES.value_type)))
        return pa.RecordBatch.from_arrays(arrays, names=["key", *_FACTS, "audit", "lines"])

    for batch in batches:
        names = ("key", "turn", "role", "text", "copies", "digest", "blank", "ended")
        for k, *row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if conv is None or k != key:
                if conv is not None:
                    chars += finish()
                    held += 1
                    if held >= _BATCH_ROWS or chars >= _BATCH_CHARS:
                        yield flush()
                        done, held, chars = [], 0, 0
                key, conv = k, _Small()
            conv.add(*row)
    if conv is not None:
        finish()
        yield flush()


# -- conversations in pieces --------------------------------------------------------------

_PIECE = (
    "key string, part int, chunk int, uids array<string>, symbols array<int>, copies array<long>, matrix array<long>, "
    "blank long, duplicate long, truncated long, illegal long, turns long, first string, last string, low long, high long"
)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted units as pieces of at most PIECE_UNITS, each with its matrix and counts."""
    part = TaskContext.get().partitionId()
    names = ["key", "turn", "role", "copies", "blank", "ended", "repeated", "uid"]
    columns = [c.split()[0] for c in _PIECE.split(", ")]
    key, chunk, units, facts = None, 0, [], Facts()

    def piece():
        runs = collapse(s for _, sym, n in units for s in ((sym, 1), (MUST_DELETE, n - 1)))
        whole = None
        for sym, n in runs:
            m = run_matrix(sym, n)
            whole = m if whole is None else times(whole, m)
        row = [key, part, chunk, [u for u, _, _ in units], [s for _, s, _ in units], [n for _, _, n in units], [x for r in whole for x in r]]
        row += [getattr(facts, c) for c in columns[len(row):]]
        types = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        types += [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()] * 2
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=columns)

    for batch in batches:
        for k, turn, role, copies, blank, ended, repeated, uid in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if units and (k != key or len(units) >= PIECE_UNITS):
                yield piece()
                chunk, units, facts = chunk + 1, [], Facts()
            key = k
            sym = symbol(role, blank, repeated, ended)
            facts.add(turn, role, sym, blank, repeated, copies)
            units.append((uid, sym, copies))
    if units:
        yield piece()


def _costs_behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each piece of a conversation the costs behind it, and whether it is the last one."""
    for batch in batches:
        for key, pieces in zip(batch.column("key").to_pylist(), batch.column("pieces").to_pylist(), strict=True):
            v, rows = ending(), []
            for i, p in enumerate(reversed(pieces)):
                rows.append({"key": key, "part": p["part"], "chunk": p["chunk"], "behind": list(v), "is_last": i == 0})
                m = p["matrix"]
                v = apply(tuple(tuple(m[j : j + STATES]) for j in range(0, len(m), STATES)), v)
            for r in rows:
                r["total"] = v[0]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("key", pa.string()), ("part", pa.int32()), ("chunk", pa.int32()), ("behind", pa.list_(pa.int64())), ("is_last", pa.bool_()), ("total", pa.int64())]))


def _unroll_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece unrolled from each of the states it could be entered in."""
    for batch in batches:
        audits, exits = [], []
        for symbols, copies, behind, is_last in zip(*(batch.column(c).to_pylist() for c in ("symbols", "copies", "behind", "is_last")), strict=True):
            runs = collapse(s for sym, n in zip(symbols, copies, strict=True) for s in ((sym, 1), (MUST_DELETE, n - 1)))
            found = [unroll(runs, tuple(behind), q) for q in range(STATES)]
            audits.append([a + (trailing(q) if is_last else "") for a, q in found])
            exits.append([q for _, q in found])
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("key", "part", "chunk")), pa.array(audits, pa.list_(pa.string())), pa.array(exits, pa.list_(pa.int32()))],
            names=["key", "part", "chunk", "audits", "exits"],
        )


def _entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each piece of a conversation is entered."""
    for batch in batches:
        for key, pieces in zip(batch.column("key").to_pylist(), batch.column("pieces").to_pylist(), strict=True):
            q, rows = 0, []
            for p in pieces:
                rows.append({"key": key, "part": p["part"], "chunk": p["chunk"], "state": q})
                q = p["exits"][q]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("key", pa.string()), ("part", pa.int32()), ("chunk", pa.int32()), ("state", pa.int32())]))


def _placed_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, part, chunk, place, uid, role) of what stays; role where it is written anew."""
    names = ("key", "part", "chunk", "uids", "symbols", "copies", "audit", "state")
    schema = pa.schema([("key", pa.string()), ("part", pa.int32()), ("chunk", pa.int32()), ("place", pa.int64()), ("uid", pa.string()), ("role", pa.string())])
    for batch in batches:
        for key, part, chunk, uids, symbols, copies, audit, q in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            rows, at = [], iter([(u, s) for u, s, n in zip(uids, symbols, copies, strict=True) for u, s in ((u, s),) * n])
            for place, letter in enumerate(audit):
                uid, sym = (None, None) if letter == "I" else next(at)
                role = None
                if letter == "D":
                    continue
                if letter == "K":
                    q = _kept(sym % 4, q)
                else:
                    q = _turn_to(q)
                    role = "user" if q == 2 else "assistant"
                rows.append((key, part, chunk, place, uid, role))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 6, schema, strict=True)], schema=schema)


def _repair_large(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row for each conversation, repaired rows) of conversations of any length."""
    uid = F.md5(F.concat_ws("\n", "key", F.coalesce(F.col("turn").cast("string"), F.lit("")), "digest", "role"))
    units = save(
        rows.groupBy("key", "turn", "role", "digest")
        .agg(F.sum("copies").alias("copies"), F.first("blank").alias("blank"), F.first("ended").alias("ended"))
        .withColumn("uid", uid),
        "units",
    )
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    twice = units.groupBy("key", "role", "digest").agg(F.min(when).alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    units = units.join(twice, ["key", "role", "digest"], "left").withColumn("repeated", F.coalesce(when > F.col("earliest"), F.lit(False)))
    wanted = ["key", "turn", "role", "digest", "copies", "blank", "ended", "repeated", "uid"]
    units = save(units.select(*wanted), "units-marked")
    pieces = save(units.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).mapInArrow(_pieces, _PIECE), "pieces")
    place = ["key", "part", "chunk"]

    def by_conversation(df: DataFrame, *columns: str) -> DataFrame:
        # bounded: a conversation has a piece for every PIECE_UNITS and every partition at most
        return df.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("part", "chunk", *columns))).alias("pieces"))

    behind = save(
        by_conversation(pieces, "matrix").mapInArrow(_costs_behind, "key string, part int, chunk int, behind array<long>, is_last boolean, total long"),
        "costs",
    )
    unrolled = save(
        pieces.select(*place, "symbols", "copies")
        .join(behind, place)
        .mapInArrow(_unroll_pieces, "key string, part int, chunk int, audits array<string>, exits array<int>"),
        "unrolled",
    )
    state = save(by_conversation(unrolled, "exits").mapInArrow(_entered, "key string, part int, chunk int, state int"), "entered")
    chosen = unrolled.join(state, place).select(*place, "state", F.expr("audits[state]").alias("audit"))
    chosen = save(chosen, "chosen")

    # counts of pieces, and what lies between two of them
    counts = ["blank", "duplicate", "truncated", "illegal", "turns"]
    whole = by_conversation(pieces, *counts, "first", "last", "low", "high").withColumn("known", F.expr("filter(pieces, p -> p.low is not null)"))
    joints = "aggregate(sequence(1, size({0}) - 1), 0L, (n, i) -> n + if({1}, 1, 0))"
    pair = "concat(pieces[i - 1].last, pieces[i].first) not in ('su', 'ua', 'au')"
    illegal = F.when(F.size("pieces") > 1, F.expr(joints.format("pieces", pair))).otherwise(0)
    shared = F.when(F.size("known") > 1, F.expr(joints.format("known", "known[i - 1].high = known[i].low"))).otherwise(0)

    def total(c: str) -> Column:
        return F.expr(f"aggregate(pieces, 0L, (n, p) -> n + p.{c})")

    span = F.expr("known[size(known) - 1].high - known[0].low + 1")
    facts = whole.select(
        "key",
        F.when(F.size("known") > 0, span - (total("turns") - shared)).otherwise(0).cast("long").alias("gaps"),
        *[total(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        (total("illegal") + illegal).alias("illegal"),
    )
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "chunk", "audit"))), lambda p: p["audit"]), "")
    audit = chosen.groupBy("key").agg(text.alias("audit"))
    cost = behind.where("is_last").select("key", F.col("total").alias("cost"))
    result = facts.join(cost, "key").join(audit, "key").select("key", *_FACTS, "audit")

    lines = pieces.select(*place, "uids", "symbols", "copies").join(chosen, place)
    lines = lines.mapInArrow(_placed_lines, "key string, part int, chunk int, place long, uid string, role string")
    texts = rows.select(uid.alias("uid"), F.col("role").alias("old"), "text").groupBy("uid").agg(F.first("old").alias("old"), F.first("text").alias("text"))
    lines = lines.join(texts, "uid", "left").select(*place, "place", F.coalesce("role", "old").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return result, save(lines, "lines")


class Repaired(NamedTuple):
    """``conversations``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    ``lines``, the repaired rows in order; null for a conversation beyond LARGE_ROWS or
    LARGE_BYTES, whose repaired rows are in ``large_lines`` (key, part, chunk, place, role,
    text; ``key`` is also a column of ``conversations``)."""

    conversations: DataFrame
    large_lines: DataFrame | None


def repair(rows: DataFrame, conv_ids: DataFrame | None = None) -> Repaired:
    """Conversations with the cheapest edits that make their role order legal.

    ``rows`` has conv_id, turn, role, text and, where rows repeat, copies. Rows are in order
    of turn, null turns first; rows of one turn in order of role and the md5 of their text.
    A row is blank, or else a duplicate (role and text of an earlier row), or else truncated;
    blank rows and duplicates go. Of equally cheap edits the ASCII-least letters win.

    Defined cases: null roles and texts count as one space; a null conv_id is a conversation;
    repeated rows are duplicates; a conversation of ``conv_ids`` without rows has zeros, an
    empty audit and no lines; an empty table gives no rows; other columns are not read.
    """
    found = (rows if conv_ids is None else conv_ids).select("conv_id").distinct().withColumn("key", _key(F.col("conv_id")))
    rows = save(_marked(rows), "rows")
    size = rows.groupBy("key").agg(F.sum("copies").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    large = save(size.where((F.col("n") > LARGE_ROWS) | (F.col("bytes") > LARGE_BYTES)).select("key"), "large")
    some = not large.isEmpty()
    small = rows.join(large, "key", "left_anti") if some else rows
    result = small.repartition("key").sortWithinPartitions(*_ORDER).mapInArrow(_repair_small, _RESULT)
    lines = None
    if some:
        facts, lines = _repair_large(save(rows.join(large, "key", "left_semi"), "large-rows"))
        result = result.unionByName(facts, allowMissingColumns=True)
    missing = F.col("audit").isNull()
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in _FACTS]
    none = F.array().cast("array<struct<role string, text string>>")
    result = found.join(result, "key", "left").select(
        "conv_id", "key", *filled, F.coalesce("audit", F.lit("")).alias("audit"), F.when(missing, none).otherwise(F.col("lines")).alias("lines")
    )
    return Repaired(result, lines)


def repaired_rows(repaired: Repaired) -> DataFrame:
    """(key, part, chunk, place, role, text) of all repaired rows, in order of part, chunk and
    place within a conversation."""
    small = repaired.conversations.select("key", F.posexplode("lines").alias("place", "line")).select(
        "key", F.lit(0).alias("part"), F.lit(0).alias("chunk"), F.col("place").cast("long").alias("place"), "line.role", "line.text"
    )
    return small if repaired.large_lines is None else small.unionByName(repaired.large_lines)


def _stream_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of each conversation's newline-joined lines, which come in order."""
    key, state, out = None, None, []
    for batch in batches:
        for k, line in zip(batch.column("key").to_pylist(), batch.column("line").to_pylist(), strict=True):
            if state is None or k != key:
                if state is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(line.encode())
            else:
                state.update(b"\n")
                state.update(line.encode())
    if state is not None:
        out.append((key, state.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([h for _, h in out], pa.string())], names=["key", "sha"])


def repaired_digest(repaired: Repaired) -> DataFrame:
    """``conversations`` with repaired_sha256, of "role:text" lines joined by newlines.

    A sha256 is read from first byte to last, so the lines of one conversation pass through
    one task, one at a time; nothing else about a large conversation is bound to one task.
    """
    lines = F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"]))
    conversations = repaired.conversations.withColumn("repaired_sha256", F.sha2(F.array_join(lines, "\n"), 256)).drop("lines")
    if repaired.large_lines is None:
        return conversations
    ordered = repaired.large_lines.select("key", "part", "chunk", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    ordered = ordered.repartition("key").sortWithinPartitions("key", "part", "chunk", "place").select("key", "line")
    large = ordered.mapInArrow(_stream_hash, "key string, sha string")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return conversations.join(large, "key", "left").withColumn("repaired_sha256", F.coalesce("repaired_sha256", "sha", none)).drop("sha")


def op11_run_length(spark, sf_dir):
    """Query: every conversation, damaged by rule and repaired."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = repaired_digest(repair(damage(rows), rows))
    return done.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
