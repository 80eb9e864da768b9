"""Embedding near-duplicates by a pivot-permutation index (operator 4).

Every vector is described by its nearest reference points (pivots), in order. Two vectors
are compared when they share enough of them: an inverted list for each pivot holds the
vectors that posted it, shared pivots are counted on bit sets, and candidates are verified
by cosine in double precision. Posting only the first ``near - shared + 1`` pivots of a
vector, in one global order, loses no pair that shares ``shared`` of them. The more pivots,
the fewer of them two vectors at the threshold share, so the number of nearest pivots is
widened until pairs made at the threshold are found.
"""

from __future__ import annotations

from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderscope.llm.common import save, table
from orderscope.llm.graph import components

THRESHOLD = 0.9
NEAR = 10  # pivots that describe a vector, at least
SHARED = 3  # of them that a candidate pair has in common
MAX_PIVOTS = 65_536  # the bound on the sample that the index is fitted on
APART = 0.8  # pivots have cosines below it with one another
RECALL = 0.97  # of pairs right at the threshold, for which the number of near pivots is widened
TRIALS = 1024  # such pairs
BLOCK = 256  # vectors of one list that are compared with one another at once


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of doubles from a list column, short vectors padded with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(column.offsets.to_numpy())
    if len(size) and (size == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(column), dim))
    out[np.arange(dim) < size[:, None]] = flat
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so tiny or huge components don't under- or overflow."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _sample(vectors: DataFrame, count: int, dim: int, seed: int) -> np.ndarray:
    """The unit vectors with the smallest hashes."""
    rows = vectors.select("v").orderBy(F.xxhash64("v", F.lit(seed))).limit(count).toArrow()
    return _unit(_matrix(rows.column("v").combine_chunks(), dim))


def _pivots(vectors: DataFrame, count: int, dim: int) -> np.ndarray:
    """At most MAX_PIVOTS vectors, the ones with the smallest hashes, no two of them closer
    than APART: pivots that crowd in one cluster would order its vectors by noise."""
    wanted = min(MAX_PIVOTS, max(64, int(8 * sqrt(count))))
    sample = _sample(vectors, wanted, dim, 17).astype(np.float32)
    kept = sample[:0]
    for at in range(0, len(sample), 512):
        part = sample[at : at + 512]
        part = part[(part @ kept.T < APART).all(axis=1)] if len(kept) else part
        close = part @ part.T >= APART
        alone = np.zeros(len(part), bool)
        for i in range(len(part)):
            alone[i] = not (close[i, :i] & alone[:i]).any()
        kept = np.concatenate([kept, part[alone]])
    return kept


def _nearest(unit: np.ndarray, pivots: np.ndarray, near: int) -> np.ndarray:
    """For each row the ``near`` closest pivots, in order."""
    close = unit.astype(np.float32) @ pivots.T
    top = np.argpartition(-close, near - 1, axis=1)[:, :near]
    order = np.argsort(-np.take_along_axis(close, top, axis=1), axis=1, kind="stable")
    return np.take_along_axis(top, order, axis=1).astype(np.int32)


def _widened(sample: np.ndarray, pivots: np.ndarray, near: int, shared: int, threshold: float) -> int:
    """The least number of near pivots, from ``near`` up, with which RECALL of the pairs at
    the threshold share ``shared`` of them. A pair is a row of ``sample`` (unit vectors) and
    that row turned towards another one, as far as the threshold allows."""
    if len(sample) < 2 or len(pivots) <= near or not 0 < threshold < 1:
        return near
    pick = np.arange(TRIALS)
    x = sample[pick % len(sample)]
    y = sample[(pick + 1 + pick // len(sample)) % len(sample)]
    y = y - (x * y).sum(axis=1, keepdims=True) * x
    length = np.linalg.norm(y, axis=1)
    x, y = x[length > 1e-6], y[length > 1e-6] / length[length > 1e-6, None]
    if not len(x):
        return near
    pair = np.stack([x, threshold * x + sqrt(1 - threshold**2) * y], axis=1)
    wide = near
    while wide < len(pivots):
        most = min(len(pivots), 2 * wide)
        need = []  # near pivots from which on a pair shares enough
        for at in range(0, len(pair), 64):
            part = pair[at : at + 64]
            found = _nearest(part.reshape(-1, part.shape[2]), pivots, most).reshape(len(part), 2, most)
            for a, b in found:
                _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
                both = np.sort(np.maximum(i, j)) + 1
                need.append(both[shared - 1] if len(both) >= shared else most + 1)
        enough = int(np.quantile(need, RECALL, method="higher"))
        if enough <= most:
            return max(near, enough)
        wide = most
    return len(pivots)


def _describe(vectors: DataFrame, pivots: np.ndarray, dim: int, near: int, posts: int) -> DataFrame:
    """(id, v, w, nearest: pivots by closeness, posted: those under which it is listed)."""
    near = min(near, len(pivots))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                nearest = _nearest(_unit(_matrix(part.column("v"), dim)), pivots, near)
                posted = np.sort(nearest, axis=1)[:, :posts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("v"), part.column("w"), pa.array(list(nearest), pa.list_(pa.int32())), pa.array(list(posted), pa.list_(pa.int32()))],
                    names=["id", "v", "w", "nearest", "posted"],
                )

    element = vectors.schema["v"].dataType.simpleString()
    return vectors.mapInArrow(run, f"id long, v {element}, w long, nearest array<int>, posted array<int>")


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index each of n nodes reaches over the edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(pivot: int, i: int, j: int, rows: pa.Table, dim: int, shared: int, threshold: float) -> pa.Table:
    """Links inside one list, or between two of its chunks: for each vector the weight of
    those it is linked to, and one of them it is joined with. A pair is looked at in the
    list of the smallest pivot that both have, and nowhere else."""
    rows = rows.combine_chunks()
    node = rows.column("id").to_numpy()
    order = np.argsort(node, kind="stable")
    rows, node = rows.take(pa.array(order)), node[order]
    chunk, weight = rows.column("chunk").to_numpy(), rows.column("w").to_numpy()
    own = _matrix(rows.column("nearest").combine_chunks(), len(rows.column("nearest")[0])).astype(np.int64)
    used, column = np.unique(own, return_inverse=True)
    words = (len(used) + 63) // 64
    bits = np.zeros((len(node), words), np.uint64)
    column = column.reshape(own.shape)
    for k in range(own.shape[1]):
        bits[np.arange(len(node)), column[:, k] // 64] |= np.uint64(1) << (column[:, k] % 64).astype(np.uint64)
    x = np.flatnonzero(chunk == i)
    y = np.flatnonzero(chunk == j)
    common = np.zeros((len(x), len(y)), np.uint16)
    for k in range(words):
        common += np.bitwise_count(bits[x, k][:, None] & bits[y, k][None, :])
    a, b = np.nonzero(common >= min(shared, own.shape[1]))
    a, b = x[a], y[b]
    if i == j:
        a, b = a[a < b], b[a < b]
    first = int(np.searchsorted(used, pivot))  # columns before it are smaller pivots
    below = np.zeros(words, np.uint64)
    below[: first // 64] = ~np.uint64(0)
    if first % 64:
        below[first // 64] = (np.uint64(1) << np.uint64(first % 64)) - np.uint64(1)
    alone = ~((bits[a] & bits[b] & below).any(axis=1))
    a, b = a[alone], b[alone]
    unit = _unit(_matrix(rows.column("v").combine_chunks(), dim))
    keep = np.zeros(len(a), bool)
    for at in range(0, len(a), 1 << 16):
        s = slice(at, at + (1 << 16))
        keep[s] = np.einsum("ij,ij->i", unit[a[s]], unit[b[s]]) >= threshold
    a, b = a[keep], b[keep]
    linked = np.bincount(a, weight[b], len(node)) + np.bincount(b, weight[a], len(node))
    label = _labels(len(node), a, b)
    hit = np.flatnonzero(linked)
    return pa.table({"id": node[hit], "links": linked[hit].astype(np.int64), "joined": node[label[hit]]})


def embedding_links(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    threshold: float = THRESHOLD,
    near: int = NEAR,
    shared: int = SHARED,
) -> DataFrame:
    """(id_column, n_links, component_id, kept), one row per vector.

    n_links counts other vectors linked directly, component_id is the smallest id reachable
    by links, kept marks the row that bears it. Equal vectors are compared once, as one of
    their number. All rows are indexed; only the pivots are a sample. ``near`` grows with the
    pivots, see _widened().

    Defined cases: vectors that are null, empty, all zero or hold null or non-finite
    components link with nothing and are kept; a vector shorter than the longest counts as
    padded with zeros; null ids are kept as rows but never name a component that has
    another id; repeated rows are vectors of their own; an empty table gives no rows; other
    columns are not read.
    """
    value = F.col("v")
    sound = (
        value.isNotNull()
        & (F.size(value) > 0)
        & F.coalesce(F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists(value, lambda x: x != 0), F.lit(False))
    )
    rows = vectors.select(F.col(id_column).alias("vec"), F.col(vector_column).alias("v"))
    rows = save(rows.withColumn("sound", sound).withColumn("row", F.monotonically_increasing_id()), "vectors")
    classes = rows.where("sound").groupBy("v").agg(F.min("row").alias("id"), F.count(F.lit(1)).alias("w"))
    classes = save(classes.select("id", "v", "w"), "classes")
    count, dim = classes.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    member = rows.select("vec", "row", "v", "sound").join(
        classes.select("v", "id", "w"), "v", "left"
    )  # equal rows of v meet; the classes side has each v once
    member = save(member.select("vec", "row", "id", "w"), "members")
    if count:
        pivots = _pivots(classes, count, dim)
        near = _widened(_sample(classes, TRIALS, dim, 18), pivots, near, shared, threshold)
        described = save(_describe(classes, pivots, dim, near, max(1, near - shared + 1)), "described")
        posts = described.select("id", "v", "w", "nearest", F.explode("posted").alias("pivot"))
        sizes = described.select(F.explode("posted").alias("pivot")).groupBy("pivot").count()
        sizes = save(sizes.select("pivot", F.ceil(F.col("count") / BLOCK).cast("int").alias("chunks")), "lists")
        # A long list is cut into chunks, and each pair of chunks is a group of its own.
        chunk = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
        blocks = (
            posts.join(F.broadcast(sizes), "pivot")  # one row for each pivot
            .withColumn("chunk", chunk)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .withColumn("i", F.least("chunk", "other"))
            .withColumn("j", F.greatest("chunk", "other"))
            .select("pivot", "i", "j", "chunk", "id", "v", "w", "nearest")
        )

        def compare(key, rows):
            pivot, i, j = (k.as_py() for k in key)
            return _compare(pivot, i, j, rows, dim, shared, threshold)

        found = blocks.groupBy("pivot", "i", "j").applyInArrow(compare, "id long, links long, joined long")
        found = save(found, "links")
        links = found.groupBy("id").agg(F.sum("links").alias("links"))
        groups = components(found, "id", "joined").withColumnsRenamed({"node": "id", "root": "group"})
        member = member.join(links, "id", "left").join(groups, "id", "left")
    else:
        member = member.withColumns({"links": F.lit(0).cast("long"), "group": F.lit(None).cast("long")})
    member = save(member.withColumn("group", F.coalesce("group", "id")), "grouped")
    first = (
        member.where("group is not null").groupBy("group").agg(F.min("vec").alias("low"), F.count(F.lit(1)).alias("n"))
    )
    first = first.where("n > 1").select("group", "low")
    return (
        member.join(first, "group", "left")
        .select(
            F.col("vec").alias(id_column),
            (F.coalesce("links", F.lit(0)) + F.coalesce("w", F.lit(1)) - 1).cast("long").alias("n_links"),
            F.coalesce("low", "vec").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.col("component_id").isNull()))
    )


def op4_pivot_index(spark, sf_dir):
    """Query: near-duplicates of all embeddings."""
    return embedding_links(table(spark, sf_dir, "embeddings"))
