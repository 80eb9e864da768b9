"""Sharding by histogram sort (operator 1).

The rows are ordered by (hash of the group columns, hash of the order columns). The
splitters between shards are found without sorting: exact byte counts below a set of
candidate key boundaries, summed over all partitions, show in which interval each
splitter lies; that interval gets new, closer candidates, until every splitter is within
the tolerance. Only then do the rows move, once.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderscope.llm.common import hash62, save, shuffle_partitions

KEY_BITS = 62
WHOLE = 0.25  # of a shard: a group up to this size is not parted
G, O, N = "_hs_group", "_hs_order", "_hs_size"  # noqa: E741


@dataclass
class _Search:
    """Where one splitter must lie: keys in [lo, hi) of ``level``, ``below`` bytes before."""

    target: int
    level: str = G
    lo: int = 0
    hi: int = 1 << KEY_BITS
    below: int = 0
    group: int | None = None  # at level O: the group that is split
    found: tuple[int, int] | None = None  # rows with (group, order) below it come before


def _shift(width: int, probes: int) -> int:
    return max(0, ceil(log2(max(1, width) / probes)))


def _histogram(keys: DataFrame, active: list[_Search], probes: int) -> dict[int, list]:
    """Rows (bucket, bytes, first key, last key) of each interval, in key order."""
    intervals = sorted({(s.level, s.group, s.lo, s.hi) for s in active}, key=str)
    each = max(2, probes // len(intervals))
    interval, bucket = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, (level, group, lo, hi) in enumerate(intervals):
        inside = (F.col(level) >= lo) & (F.col(level) < hi)
        if level == O:
            inside = inside & (F.col(G) == group)
        interval = F.when(inside, F.lit(i)).otherwise(interval)
        bucket = F.when(inside, F.shiftright(F.col(level) - F.lit(lo), _shift(hi - lo, each))).otherwise(bucket)
    key = F.when(F.element_at(F.array([F.lit(x[0] == O) for x in intervals]), F.col("i") + 1), F.col(O)).otherwise(F.col(G))
    rows = (
        keys.select(G, O, N, interval.alias("i"), bucket.alias("b"))
        .where(F.col("i").isNotNull())
        .groupBy("i", "b")
        .agg(F.sum(N).alias("bytes"), F.min(key).alias("first"), F.max(key).alias("last"))
        .collect()  # at most `probes` rows and two for each splitter
    )
    out: dict[tuple, list] = {x: [] for x in intervals}
    for r in sorted(rows, key=lambda r: (r["i"], r["b"])):
        out[intervals[r["i"]]].append(r)
    return out


def find_splitters(
    keys: DataFrame, total: int, n_shards: int, tolerance: float, probes: int, whole: float = WHOLE
) -> list[tuple[int, int]]:
    """The n_shards - 1 splitters, ascending, each within tolerance * total / n_shards bytes.

    A boundary between two groups is taken where one is within the tolerance, or where the
    group that the splitter falls into is at most ``whole`` of a shard: its nearer end, so a
    shard misses its size by half of that at most. A larger group is split by its order
    key. Rows with the same group and order key cannot be parted; their splitter goes to
    the nearer end.
    """
    slack = tolerance * total / n_shards
    kept = whole * total / n_shards
    found = [_Search(target=total * i // n_shards) for i in range(1, n_shards)]
    while active := [s for s in found if s.found is None]:
        seen = _histogram(keys, active, probes)
        for s in active:
            cum = s.below
            for r in seen[(s.level, s.group, s.lo, s.hi)]:
                end = cum + r["bytes"]
                if end >= s.target:
                    break
                cum = end
            at = (lambda k, s=s: (k, 0)) if s.level == G else (lambda k, s=s: (s.group, k))
            near, gap = min(((at(r["first"]), s.target - cum), (at(r["last"] + 1), end - s.target)), key=lambda x: abs(x[1]))
            one = r["first"] == r["last"]
            if abs(gap) <= slack or (one and (s.level == O or r["bytes"] <= kept)):
                s.found = near
            elif one:
                s.level, s.group, s.lo, s.hi, s.below = O, r["first"], 0, 1 << KEY_BITS, cum
            else:
                s.lo, s.hi, s.below = r["first"], r["last"] + 1, cum
    return sorted(s.found for s in found)


def _shard(splitters: list[tuple[int, int]]) -> Column:
    """The number of splitters at or below a row's key, as a binary decision tree."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        g, o = splitters[mid]
        under = F.col(G) < g if o == 0 else (F.col(G) < g) | ((F.col(G) == g) & (F.col(O) < o))
        return F.when(under, tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(splitters))


def histogram_sort(
    df: DataFrame,
    n_shards: int,
    size: Column,
    group: list[Column],
    order: list[Column],
    tolerance: float = 0.005,
    probes: int = 4096,
) -> DataFrame:
    """``df`` with ``shard`` (0 to n_shards - 1, near equal sums of ``size``) and ``slot``.

    Slots count from 0 without gaps inside each shard, in key order. Rows of one group
    (equal ``group`` columns) are neighbours and share a shard, unless the group is larger
    than a quarter of a shard (WHOLE) and a splitter falls into it.

    Defined cases: a null size counts as 0, null group or order values are values like any
    other; repeated rows keep one slot each; fewer rows than shards leave shards empty; an
    empty table gives an empty result; columns of ``df`` named shard or slot are replaced,
    all others kept, whatever their names.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    spark = df.sparkSession
    own = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    held = {c: f"_hs_{i}" if c.startswith("_hs_") else c for i, c in enumerate(own)}  # own names in the way
    sort_keys = hash62(*group).alias(G), hash62(*order).alias(O), F.coalesce(size.cast("long"), F.lit(0)).alias(N)
    rows = df.select(*[F.col(f"`{c}`").alias(held[c]) for c in own], *sort_keys)
    keys = save(rows.select(G, O, N), "shard-keys")
    count, total = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum(N), F.lit(0))).first()
    splitters = find_splitters(keys, total, n_shards, tolerance, probes) if total else []
    if not splitters:
        splitters = [(1 << KEY_BITS, 0)] * (n_shards - 1)

    # A shard is too large for one task. Ranges of the group hash ("pieces", some for each
    # shuffle partition) are numbered on their own; a piece of very many rows, one group
    # mostly, is parted again by the order hash. At most parts / 2 pieces are that large.
    parts = shuffle_partitions(spark)
    per_piece = max(1, count // (4 * parts))
    bits = max(0, ceil(log2(max(1, count / per_piece))))
    high = F.shiftright(F.col(G), KEY_BITS - bits)
    large = keys.groupBy(high.alias("h")).count().where(F.col("count") > 8 * per_piece).collect()
    by_depth: dict[int, list[int]] = {}
    for r in large:
        by_depth.setdefault(ceil(log2(r["count"] / per_piece)), []).append(r["h"])
    low = F.lit(0).cast("long")
    for depth, pieces in by_depth.items():
        low = F.when(high.isin(pieces), F.shiftright(F.col(O), KEY_BITS - depth)).otherwise(low)
    place = {"shard": _shard(splitters), "_hs_high": high, "_hs_low": low}
    piece = list(place)
    before = Window.partitionBy("shard").orderBy("_hs_high", "_hs_low").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (  # some dozen rows for each shuffle partition, whatever the size of the input
        keys.withColumns(place)
        .groupBy(*piece)
        .agg(F.count(F.lit(1)).alias("_hs_rows"))
        .select(*piece, F.coalesce(F.sum("_hs_rows").over(before), F.lit(0)).alias("_hs_before"))
    )
    inside = Window.partitionBy(*piece).orderBy(G, O)
    return (
        rows.withColumns(place)
        .withColumn("slot", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), piece)
        .withColumn("slot", (F.col("slot") + F.col("_hs_before")).cast("long"))
        .select(*[F.col(f"`{held[c]}`").alias(c) for c in own], "shard", "slot")
    )


def shard_documents(docs: DataFrame, n_shards: int = 40, tolerance: float = 0.005) -> DataFrame:
    """Documents in shards of near equal bytes (UTF-8 text plus 16 for each row); equal texts are
    a group. Defined cases: as histogram_sort(); a null text has no bytes and is equal to
    other null ones."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(16)
    return histogram_sort(docs, n_shards, size, [F.col("text")], [F.col("doc_id")], tolerance)
