"""N-gram Jaccard join by universe partition and pigeonhole (operator 8).

Two sets with Jaccard similarity >= p/100 and sizes r, s differ in at most
H = (100 - p)(r + s) / (100 + p) tokens. For every size band the token universe is hashed
into segments. If no segment of two sets agreed, their difference would be at least one
token per plain segment and two per segment that is also indexed with its one-deletion
neighbourhood; a band's segments are allotted so that this sum exceeds H. So each linked
pair shares at least one signature (band, segment, subset hash), and everything that
shares one is verified over the whole sets.

Which segments are widened by deletions, and how many empty segments may stay unindexed,
is chosen for each band by a cost model (``allot``): index rows against the rows that
unrelated sets of the band are expected to meet.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from functools import cache
from math import erfc, exp, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderscope.llm.common import free, save, tidy, unused
from orderscope.llm.graph import components

BAND_RATIO = 1.1
GROUP_ROUNDS = 2
BLOCK_IDS, BLOCK_PAIRS = 128, 4_096  # ids of a chunk, about; pairs tested at once
SKETCH_WORDS = 8  # words of 64 parity bits of the smallest sketch
SKETCH_LOAD = 128  # tokens for each word of larger ones
SIGNATURE_MASK = np.uint64((1 << 48) - 1)
BROADCAST_ROWS = 1_000_000
BROADCAST_LOST = 4_000_000  # ids and text hashes of documents to drop, 16 bytes each
SLICE_ROWS = 512  # texts turned into sets at once
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64 constants)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The distinct 64-bit hashes, sorted, of the k-word shingles of a whole text.

    Words are maximal runs without space or \\t\\n\\v\\f\\r, A-Z lower-cased. Fewer than k words
    form one shingle; no words give the empty set.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    words = pd.util.hash_array(np.array(found, dtype=object), categorize=False)
    n = max(1, len(words) - k + 1)
    grams = np.full(n, _U(min(k, len(words))))
    with np.errstate(over="ignore"):
        for j in range(min(k, len(words))):
            grams = _mix(grams * _U(0x9E3779B97F4A7C15) + words[j : j + n])
    return np.unique(grams)


@cache
def band_starts() -> list[int]:
    out = [1]
    while out[-1] < 1 << 31:
        out.append(max(out[-1] + 1, int(out[-1] * BAND_RATIO)))
    return out


def _beyond(mean: float, spare: int) -> float:
    """Expected number beyond ``spare`` of a Poisson count."""
    if mean > 50:
        z = (spare - mean) / sqrt(mean)
        return sqrt(mean) * (exp(-z * z / 2) / sqrt(2 * pi) - z * erfc(z / sqrt(2)) / 2)
    chance, below = exp(-mean), 0.0
    for i in range(spare):
        below += chance * (spare - i)
        chance *= mean / (i + 1)
    return max(0.0, mean - spare + below)


@cache
def allot(largest: int, percent: int, set_count: int) -> tuple[int, int, int] | None:
    """(slots, widened segments, spare) of a band with sets of up to ``largest`` tokens.

    A slot has the same share of the universe; a plain segment is one slot, a widened one
    two. slots - spare = H + 1, where ``spare`` is how many empty plain segments a set
    need not index. An empty segment is the same for all sets of the band that have it
    empty, so enough are spared that hardly any is left to index, for the smallest guests
    of the band too. None where only equal sets can link.
    """
    bound = (100 - percent) * 2 * largest // (100 + percent)
    if bound == 0:
        return None
    met = set_count / 30_000  # unrelated sets expected to share a text passage with a given one, by count
    spares, spare = [0, 1, 2, 3, 4], 4
    while spare < bound:
        spare += max(2, spare // 4)
        spares.append(spare)
    best = None
    for spare in spares:
        slots = bound + 1 + spare
        load = largest / slots
        least = largest * percent / 100 / slots
        unindexed = _beyond(slots * exp(-least), spare) * exp(-least) * set_count / 10
        for widened in range(min(8, slots // 2) + 1):
            plain = slots - 2 * widened
            rows = plain + widened * (1 + 2 * load)
            chance = plain * exp(-load) + widened * (1 + 2 * load) * exp(-2 * load)
            cost = rows + met * chance + unindexed
            if best is None or cost < best[0]:
                best = (cost, slots, widened, spare)
    return best[1:]


def signatures(tokens: np.ndarray, percent: int, set_count: int, widen: int | None = None) -> np.ndarray:
    """The signatures of one set: in its own band, and as a guest in all bands of larger sets
    that can be similar enough. The lowest bit is set for a guest; guests of a band meet one
    another in bands of their own.

    A set of n tokens differs from any partner of a band by at most (100 - p)(n + largest) /
    (100 + p) tokens, so it uses one slot more than that (and the spare ones), the first ones
    of the band; a larger partner uses those too.
    """
    n = len(tokens)
    if n == 0:
        return np.empty(0, np.int64)
    starts = band_starts()
    band = bisect_right(starts, n) - 1
    out = []
    weight = _mix(tokens ^ _U(0xA5A5A5A5A5A5A5A5))
    with np.errstate(over="ignore"):
        for b in range(band, len(starts) - 1):
            if b > band and 100 * n < percent * starts[b]:
                break
            largest = starts[b + 1] - 1
            plan = allot(largest, percent, set_count)
            if plan is None:
                continue
            slots, widened, spare = plan
            if widen is not None:
                widened = min(widen, slots // 2)
            needed = (100 - percent) * (n + largest) // (100 + percent) + 1 + spare
            near_used = min(widened, (needed + 1) // 2)
            used = near_used + max(0, needed - 2 * near_used) if near_used == widened else near_used
            slot = ((tokens >> _U(20)) % _U(slots)).astype(np.int64)
            segment = np.where(slot < 2 * widened, slot // 2, slot - widened)
            held_in = np.flatnonzero(segment < used)
            order = held_in[np.argsort(segment[held_in], kind="stable")]
            held, first = np.unique(segment[order], return_index=True)
            total = np.zeros(used, np.uint64)
            if len(held):
                total[held] = np.add.reduceat(weight[order], first)
            keep = np.zeros(used, bool)
            keep[held] = True
            keep[:near_used] = True
            keep[np.flatnonzero(~keep)[spare:]] = True
            tag = _mix(np.arange(used, dtype=np.uint64) + (_U(b + 1) << _U(40)))
            near = np.flatnonzero(segment < near_used)  # one-deletion neighbourhoods
            found = np.concatenate([_mix(total[keep] + tag[keep]), _mix(total[segment[near]] - weight[near] + tag[segment[near]])])
            out.append((np.unique(found & SIGNATURE_MASK) << _U(1)) | _U(b > band))
    return np.concatenate(out).astype(np.int64) if out else np.empty(0, np.int64)


def parity_sketch(tokens: np.ndarray) -> np.ndarray:
    """Parity of the token count in each of 512 cells, or more for a large set: two sets
    differ in at least as many tokens as their sketches differ in bits. A sketch folds to
    half its size by xor of its halves."""
    words = SKETCH_WORDS
    while words * SKETCH_LOAD < len(tokens):
        words *= 2
    cells = np.bincount((tokens >> _U(16)).astype(np.int64) & (64 * words - 1), minlength=64 * words)
    return np.packbits((cells & 1).astype(np.uint8), bitorder="little").view(np.int64)


_INDEX = "doc_id {}, _rk long, set_key binary, n int, sigs array<long>, sketch array<long>"


def _index(docs: DataFrame, k: int, percent: int, set_count: int, widen: int | None) -> DataFrame:
    """For each document its set's key, size, signatures and sketch."""

    def run(batches):
        for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
            key, size, sigs, sketch = [], [], [], []
            for text in batch.column("text").to_pylist():
                tokens = shingle_set(text, k)
                size.append(len(tokens))
                key.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None)
                sigs.append(signatures(tokens, percent, set_count, widen))
                sketch.append(parity_sketch(tokens))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("_rk"),
                    pa.array(key, pa.binary()),
                    pa.array(size, pa.int32()),
                    pa.array(sigs, pa.list_(pa.int64())),
                    pa.array(sketch, pa.list_(pa.int64())),
                ],
                names=["doc_id", "_rk", "set_key", "n", "sigs", "sketch"],
            )

    rows = docs.select("doc_id", F.xxhash64("text").alias("_rk"), "text")
    return rows.mapInArrow(tidy(run), _INDEX.format(docs.schema["doc_id"].dataType.simpleString()))


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, tokens) of documents that carry an ``id``; rows of one id at most once a task."""

    def run(batches):
        done: set[int] = set()
        for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
            ids, tokens = [], []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                if i not in done:
                    done.add(i)
                    ids.append(i)
                    tokens.append(shingle_set(text.as_py(), k).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], names=["id", "tokens"])

    return docs.select("id", "text").mapInArrow(tidy(run), "id long, tokens array<long>")


def _buckets(batches):
    """Of rows sorted by (code, id): those of signatures held by several ids, one of them not a
    guest, with the first id.

    The first and last signature of a task may go on in its neighbours, so their rows are
    always returned, and their first id once more, marked ``edge``. Memory: one batch.
    """

    def out(code, node, center, edge):
        columns = [code >> 1, node, code & 1, center, edge]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["sig", "id", "guest", "center", "edge"])

    def one(code, center):
        return out(np.array([code]), np.array([center]), np.array([center]), np.array([True]))

    last = None  # (sig, first code, first id) of the run that may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        code, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("code", "id"))
        sig = code >> 1
        if last is None:
            yield one(code[0], node[0])
        start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        length = np.diff(np.r_[start, len(sig)])
        center = node[start].copy()
        wanted = (length > 1) & (code[start] & 1 == 0)
        wanted[[0, -1]] = True  # may go on from the batch before, or into the next
        first_code = code[start].copy()
        if last is not None and sig[0] == last[0]:
            center[0], first_code[0] = last[2], last[1]
        rows = np.repeat(wanted, length)
        yield out(code[rows], node[rows], np.repeat(center, length)[rows], np.zeros(int(rows.sum()), bool))
        last = (sig[-1], first_code[-1], center[-1])
    if last is not None:
        yield one(last[1], last[2])


def _may_link(percent: int) -> Column:
    """Whether sizes and folded sketches of rows x and y allow the similarity: never false for
    a link. Bit operations on plain columns only, so that a join evaluates it in compiled code."""
    bits = sum(F.bit_count(F.col(f"x.s{i}").bitwiseXOR(F.col(f"y.s{i}"))) for i in range(SKETCH_WORDS))
    return (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")) & (
        (100 + percent) * bits <= (100 - percent) * (F.col("x.n") + F.col("y.n"))
    )


# -- pairs in blocks ----------------------------------------------------------------------


def _in_blocks(pairs: DataFrame, payload: DataFrame, test, result: str) -> DataFrame:
    """The pairs (a, b) that pass ``test``, which needs the ``payload`` of both ids.

    Pairs meet in clusters, so payloads are not sent along with each pair. Ids whose pairs have
    the same smallest member are dealt into chunks of about BLOCK_IDS, and the pairs between
    two chunks are one block: a payload is sent once for every block that needs it, and a task
    holds the payloads of one block at a time.
    ``test`` takes lists of payload rows (dicts) for a and b and returns (kept, values).
    """
    ends = pairs.select(F.col("a").alias("id"), F.least("a", "b").alias("m")).union(pairs.select("b", F.least("a", "b")))
    least = ends.groupBy("id").agg(F.min("m").alias("m"))
    size = least.groupBy("m").agg(F.count(F.lit(1)).alias("n"))
    chunk = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK_IDS))
    place = save(least.join(size, "m").select("id", F.xxhash64("m", chunk).alias("chunk")), "chunks")
    chunk_a = place.select(F.col("id").alias("a"), F.col("chunk").alias("ca"))
    chunk_b = place.select(F.col("id").alias("b"), F.col("chunk").alias("cb"))
    block = F.xxhash64(F.least("ca", "cb"), F.greatest("ca", "cb")).alias("block")
    keyed = save(pairs.select("a", "b").join(chunk_a, "a").join(chunk_b, "b").select(block, "a", "b"), "blocks")
    needs = keyed.select("block", F.col("a").alias("id")).union(keyed.select("block", "b")).distinct()
    held = needs.join(payload, "id").select("block", F.lit(False).alias("is_pair"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), *[c for c in payload.columns if c != "id"])
    none = [F.lit(None).cast(payload.schema[c].dataType).alias(c) for c in payload.columns if c != "id"]
    rows = held.union(keyed.select("block", F.lit(True), "a", "b", *none))
    columns = [c for c in payload.columns if c != "id"]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())] + ([("apart", pa.float64())] if "apart" in result else []))

    def run(batches):
        block, held = None, {}
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            is_pair, a, b = (batch.column(c).to_pylist() for c in ("is_pair", "a", "b"))
            edges = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]).tolist() + [len(blocks)]
            for start, stop in zip(edges, edges[1:], strict=False):
                if blocks[start] != block:
                    block, held = blocks[start], {}
                first = start
                while first < stop and not is_pair[first]:
                    held.setdefault(a[first], tuple(_value(batch.column(c)[first]) for c in columns))
                    first += 1
                for at in range(first, stop, BLOCK_PAIRS):
                    left, right = a[at : min(stop, at + BLOCK_PAIRS)], b[at : min(stop, at + BLOCK_PAIRS)]
                    kept, values = test([held[i] for i in left], [held[i] for i in right])
                    found = [pa.array(np.array(side, np.int64)[kept]) for side in (left, right)]
                    yield pa.RecordBatch.from_arrays(found + ([pa.array(values[kept])] if "apart" in result else []), schema=schema)

    done = save(rows.repartition("block").sortWithinPartitions("block", "is_pair").mapInArrow(tidy(run), result), "tested")
    free(place, keyed)
    return done


def _value(cell):
    return cell.values.to_numpy() if isinstance(cell, pa.ListScalar) else cell.as_py()


def _still_possible(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and whole sketches allow the similarity, with ``apart``:
    the share of the tokens by which the sketches differ at least."""

    def test(x, y):
        n = np.array([r[0] + s[0] for r, s in zip(x, y, strict=True)], np.int64)
        bits = np.empty(len(x), np.int64)
        width = np.array([(len(r[1]), len(s[1])) for r, s in zip(x, y, strict=True)])
        for w, v in np.unique(width, axis=0):  # powers of two: few
            at = np.flatnonzero((width == (w, v)).all(1))
            m = min(w, v)
            fold = [np.bitwise_xor.reduce(np.stack([side[i][1] for i in at]).reshape(len(at), -1, m), axis=1) for side in (x, y)]
            bits[at] = np.bitwise_count((fold[0] ^ fold[1]).view(np.uint64)).sum(1)
        return (100 + percent) * bits <= (100 - percent) * n, bits / n

    return _in_blocks(pairs, facts.select("id", "n", "sketch"), test, "a long, b long, apart double")


def _verified(pairs: DataFrame, docs: DataFrame, index: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose whole sets reach the similarity."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = save(index.select("id", "doc_id", "_rk").join(ids, "id").withColumnRenamed("doc_id", "_d"), "wanted")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    text = docs.select(F.col("doc_id"), F.xxhash64("text").alias("_k"), "text").join(
        wanted, (F.col("_k") == F.col("_rk")) & F.col("doc_id").eqNullSafe(F.col("_d"))
    )
    sets = save(_sets(text, k), "sets")

    def test(x, y):
        common = np.array([len(np.intersect1d(r[0], s[0], assume_unique=True)) for r, s in zip(x, y, strict=True)], np.int64)
        both = np.array([len(r[0]) + len(s[0]) for r, s in zip(x, y, strict=True)], np.int64)
        return 100 * common >= percent * (both - common), common

    done = _in_blocks(pairs, sets, test, "a long, b long")
    free(sets)
    return done


def jaccard_groups(
    docs: DataFrame, k: int = 5, percent: int = 80, set_count: int | None = None, widen: int | None = None
) -> DataFrame:
    """One row per document: doc_id, _rk (text hash), n_shingles, group.

    Documents whose k-word shingle sets (64-bit hashes) have a Jaccard similarity of at
    least percent/100 are linked; ``group`` is equal for, and only for, documents joined by
    links, whether direct or through others. Copies are not expanded into pairs: a bucket
    of n sets gives n - 1 pairs with its first one, and only buckets whose sets are not all
    joined by those are looked at again, between the joined groups.

    Defined cases: null, empty and blank texts have no shingles, group null and no links;
    texts under k words are one shingle; null ids are kept; repeated rows are in one group;
    an empty table gives no rows; columns besides doc_id and text are not read.
    """
    count = docs.count() if set_count is None else set_count
    rough = 1 << max(0, count.bit_length() - 1)  # the cost model needs the magnitude only
    index = save(_index(docs, k, percent, rough, widen).withColumn("id", F.monotonically_increasing_id()), "shingles")

    copies = (
        index.where("set_key is not null")
        .groupBy("set_key")
        .agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("m"))
        .where("m > 1")
        .select("set_key", "node")
    )
    copies = save(index.select("id", "set_key").join(copies, "set_key").where("id != node").select("id", "node"), "copies")

    # counted before they are broadcast; beyond the bound the signatures move for it
    gone = F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies
    rows = index.select("id", "sigs").join(gone, "id", "left_anti").select(F.explode("sigs").alias("code"), "id")
    rows = rows.repartitionByRange("code", "id").sortWithinPartitions("code", "id")
    met = save(rows.mapInArrow(tidy(_buckets), "sig long, id long, guest long, center long, edge boolean"), "buckets")
    split = met.where("edge").select("sig", "center").distinct()  # two rows for each task
    joined = split.groupBy("sig").agg(F.min("center").alias("a"), F.max("center").alias("z")).where("a != z")
    # First each set with one other: the first one of most of its buckets. Pairs that this
    # leaves out are in buckets that stay open below, unless their groups got joined.
    star = (
        met.select(F.col("center").alias("a"), F.col("id").alias("b"))
        .union(split.join(joined, "sig").select("a", F.col("center").alias("b")))
        .where("a != b")
        .groupBy("a", "b")
        .count()
        .groupBy("b")
        .agg(F.max_by("a", F.struct("count", -F.col("a"))).alias("a"))
    )
    facts = index.select("id", "n", "sketch")
    star = _still_possible(save(star.select("a", "b"), "star"), facts, percent)
    links = _verified(star.select("a", "b"), docs, index, k, percent)
    labels = components(links, "a", "b")

    def members() -> tuple[DataFrame, DataFrame]:
        """The buckets' sets with their groups, and the buckets that still hold several groups,
        one of them with a set that is not a guest."""
        member = met.select("sig", "id", "guest").join(labels.withColumnRenamed("node", "id"), "id", "left")
        member = save(member.select("sig", "id", "guest", F.coalesce("root", "id").alias("root")), "members")
        mixed = member.groupBy("sig").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min("guest").alias("g"))
        return member, mixed.where("r0 != r1 and g = 0").select("sig")

    # Then groups: in each open bucket one set of each group, another one in every bucket, meets
    # one of a chosen group. A set near a large group tries many of its members this way,
    # before all that is left between the two is looked at.
    for turn in range(GROUP_ROUNDS):
        member, mixed = members()
        drawn = F.xxhash64("id", "sig", F.lit(turn))
        one = member.join(mixed, "sig").groupBy("sig", "root").agg(F.min_by("id", drawn).alias("id"), F.min("guest").alias("guest"))
        one = save(one, "drawn")
        chosen = one.groupBy("sig").agg(F.min_by(F.struct("root", "id"), F.struct("guest", drawn)).alias("c"))
        pairs = one.join(chosen, "sig").where(F.col("root") != F.col("c.root"))
        pairs = save(pairs.select(F.least("id", "c.id").alias("a"), F.greatest("id", "c.id").alias("b")).distinct(), "drawn-pairs")
        likely = _still_possible(pairs, facts, percent)
        free(member, one, pairs)
        if likely.isEmpty():
            break
        more = _verified(likely.select("a", "b"), docs, index, k, percent)
        free(likely)
        if more.isEmpty():
            break
        links = links.union(more)
        labels = components(links, "a", "b")

    # At last all pairs between different groups of a bucket, kept where size and sketch allow
    # the similarity.
    member, mixed = members()
    fold = [
        F.expr(f"aggregate(sequence({i}, size(sketch) - 1, {SKETCH_WORDS}), 0L, (a, j) -> a ^ sketch[j])").alias(f"s{i}")
        for i in range(SKETCH_WORDS)
    ]
    open_rows = save(member.join(mixed, "sig").distinct(), "open")
    folded = open_rows.select("id").distinct().join(facts, "id").select("id", "n", *fold)
    shown = save(open_rows.join(folded, "id"), "facts")
    free(met, member, open_rows)
    x, y = shown.alias("x"), shown.alias("y")
    apart = (F.col("x.id") < F.col("y.id")) & (F.col("x.root") != F.col("y.root")) & (F.col("x.guest") + F.col("y.guest") < 2)
    rest = x.join(y, (F.col("x.sig") == F.col("y.sig")) & apart & _may_link(percent)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    rest = save(rest.distinct(), "rest")
    possible = _still_possible(rest, facts, percent)
    free(shown, rest)
    # Groups need one link to become one: while that finds links, each tries its likeliest pair;
    # then whatever still lies between different groups is verified in full.
    rest, all_left = possible, False
    while True:
        root_a = labels.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        root_b = labels.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        between = (
            rest.select("a", "b", "apart")
            .join(root_a, "a", "left")
            .join(root_b, "b", "left")
            .select("a", "b", "apart", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb"))
        )
        between = save(between.where("ra != rb"), "between")
        free(rest)
        if between.isEmpty():
            break
        pick, rest = between.select("a", "b"), between
        if not all_left:
            best = F.min(F.struct("apart", "a", "b")).alias("p")
            pick = save(between.groupBy("ra").agg(best).union(between.groupBy("rb").agg(best)).select("p.a", "p.b").distinct(), "picked")
            rest = save(between.join(pick, ["a", "b"], "left_anti"), "rest")
            free(between)
        more = _verified(pick, docs, index, k, percent)
        found = more.count()
        if found:
            links = links.union(more)
            labels = components(links, "a", "b")
        if all_left:
            break
        all_left = found == 0
    of_copies = copies.join(labels, "node", "left").select("id", F.coalesce("root", "node").alias("root"))
    of_rest = labels.select(F.col("node").alias("id"), "root")
    group = save(of_rest.join(copies, "id", "left_anti").union(of_copies), "groups")
    return index.join(group, "id", "left").select(
        "doc_id",
        "_rk",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("set_key").isNotNull(), F.coalesce("root", "id")).alias("group"),
    )


def join_components(docs: DataFrame, k: int, percent: int, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the smallest doc_id of the group.

    Defined cases: as jaccard_groups(); a document without links, or without words, is its own
    component; a null id is smaller than none, and alone it is a null component.
    """
    rows = save(jaccard_groups(docs, k, percent, **options), "grouped")
    first = (
        rows.where("group is not null")
        .groupBy("group")
        .agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("m"))
        .where("m > 1")
        .select("group", "component_id")
    )
    return rows.join(first, "group", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one left of each group: the one with the smallest id (null ids
    last), then the smallest text hash; repeated rows leave one.

    Defined cases: texts without words stay, as does the row of a null id that is alone in its
    group; an empty table gives no rows; all columns are kept as they are, whatever their names.
    """
    rows = save(jaccard_groups(docs, k, percent), "grouped")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_rk")
    key, text_hash = unused(docs, "_jk_id"), unused(docs, "_jk_text")
    rank = unused(docs, "_jk_hash")
    best = rows.where("group is not null").groupBy("group").agg(F.min(order).alias("o"), F.count(F.lit(1)).alias("m"))
    best = best.where("m > 1").select("group", F.col("o.doc_id").alias(key), F.col("o._rk").alias(rank))

    def same(hashed: str) -> Column:
        return (F.col(rank) == F.col(hashed)) & F.col(key).eqNullSafe(F.col("doc_id"))

    in_group = rows.join(best, "group")
    lost = save(in_group.where(~same("_rk")).select(F.col("doc_id").alias(key), F.col("_rk").alias(rank)).distinct(), "lost")
    twice = in_group.where(same("_rk")).groupBy("doc_id", "_rk").count().where("count > 1")
    # texts stay where they are as long as the rows to drop are proven few
    lost = F.broadcast(lost) if lost.count() <= BROADCAST_LOST else lost
    hashed = docs.withColumn(text_hash, F.xxhash64("text"))
    kept = hashed.join(lost, same(text_hash), "left_anti")
    if not twice.isEmpty():
        again = save(twice.select(F.col("doc_id").alias(key), F.col("_rk").alias(rank)), "twice")
        again = F.broadcast(again) if again.count() <= BROADCAST_LOST else again
        kept = kept.join(again, same(text_hash), "left_anti").union(
            hashed.join(again, same(text_hash), "left_semi").dropDuplicates(["doc_id", text_hash])
        )
    return kept.drop(text_hash)
