"""Benchmark decontamination by winnowing (operator 10).

Of every ``window - k + 1`` consecutive k-grams the smallest hash is kept, with its
position. A span of ``window`` words that a document shares with an item holds one such
run of k-grams in both, so both keep the same k-gram of it: joining the fingerprints
finds every shared span that long. Each hit is then extended on its diagonal (document
position minus item position) over the words themselves, so no false hit remains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderscope.llm.common import ascii_lower, save, unused

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
POSITION_BITS = 31  # of a packed fingerprint; the 32 bits above hold the hash
BROADCAST_ROWS = 1_000_000  # item fingerprints (16 bytes each) sent to every executor at most
BROADCAST_BYTES = 256 << 20  # characters of four bytes at most


def words(text: Column) -> Column:
    """Lower-cased words (runs of digits, letters and non-ASCII characters); none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _each(first: int, last: Column, body) -> Column:
    """body(i) for i from first to last; an empty array where last < first."""
    return F.when(last >= first, F.transform(F.sequence(F.lit(first), last), body)).otherwise(
        F.array().cast("array<long>")
    )


def _packed(hashes: Column, k: int) -> Column:
    """For each k-gram of hashed words: 32 bits of its hash, then its position from 1."""
    return _each(
        1,
        F.size(hashes) - (k - 1),
        lambda i: F.shiftleft(
            F.shiftrightunsigned(F.xxhash64(*[F.element_at(hashes, i + j) for j in range(k)]), 32),
            POSITION_BITS,
        ).bitwiseOR(i.cast("long")),
    )


def fingerprints(word_list: Column, window: int, k: int) -> Column:
    """The winnowed, packed fingerprints of a word array."""
    run = window - k + 1

    def winnow(packed: Column) -> Column:
        smallest = _each(
            1,
            F.size(packed) - (run - 1),
            lambda i: F.least(*[F.element_at(packed, i + j) for j in range(run)]) if run > 1 else F.element_at(packed, i),
        )
        return F.array_distinct(smallest)

    return _let(F.transform(word_list, lambda w: F.xxhash64(w)), lambda h: _let(_packed(h, k), winnow))


def _unpacked(df: DataFrame, packed: Column, position: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.explode(packed).alias("_p")).select(
        *keep,
        F.shiftright("_p", POSITION_BITS).alias("hash"),
        F.col("_p").bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int").alias(position),
    )


def _small(df: DataFrame) -> DataFrame:
    """Broadcast where the (saved) table is proven small, in rows and in bytes of all its words;
    else Spark joins by shuffle."""
    words = [F.size(c) + F.coalesce(F.length(F.array_join(c, "")), F.lit(0)) for c, t in df.dtypes if t == "array<string>"]
    size = F.lit(64) + sum(words, F.lit(0))
    n, most = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and 4 * most <= BROADCAST_BYTES else df


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, item_id: str = "item_id"
) -> DataFrame:
    """One row per document: doc_id, _rk, n_words, n_hit, items (sorted ids as strings), contaminated.

    A window is ``window`` consecutive words of an item, or a whole shorter item. Words of
    a document inside an occurrence of a window are hit; ``items`` are those with one.
    ``_rk`` is the hash of the text: (doc_id, _rk) tells rows apart for join_back().

    Defined cases: null or empty texts have no words and no hits; a null item id is listed
    as the empty string; repeated documents each keep their row, repeated items are listed
    once; an empty benchmark hits nothing; other columns of either table are not read.
    """
    doc = docs.select(F.col("doc_id"), F.xxhash64("text").alias("_rk"), words(F.col("text")).alias("words"))
    items = save(
        benchmark.select(
            F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("item_words")
        )
        .where(F.size("item_words") > 0)
        .distinct()
        .select(F.xxhash64("item", "item_words").alias("item_key"), "item", "item_words"),
        "items",
    )
    long_items = items.where(F.size("item_words") >= window)
    seeds = [
        _unpacked(doc, fingerprints(F.col("words"), window, k), "at", "doc_id", "_rk").join(
            _small(save(_unpacked(long_items, fingerprints(F.col("item_words"), window, k), "item_at", "item_key"), "item-prints")),
            "hash",
        )
    ]
    lengths = items.where(F.size("item_words") < window).select(F.size("item_words").alias("n")).distinct().collect()
    for (n,) in sorted(lengths):  # fewer than `window` lengths; whole items are looked up as n-grams
        short = items.where(F.size("item_words") == n)

        def grams(w: Column, n=n) -> Column:
            return _let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: _packed(h, n))

        seeds.append(
            _unpacked(doc, grams(F.col("words")), "at", "doc_id", "_rk").join(
                _small(save(_unpacked(short, grams(F.col("item_words")), "item_at", "item_key"), "item-grams")), "hash"
            )
        )
    found = seeds[0]
    for s in seeds[1:]:
        found = found.unionByName(s)
    found = save(
        found.groupBy("doc_id", "_rk").agg(
            F.collect_set(F.struct("item_key", (F.col("at") - F.col("item_at")).alias("diagonal"))).alias("hits")
        ),
        "hits",
    )

    pairs = (
        doc.alias("a")
        .join(found.alias("b"), same_row_columns("a", "b"))
        .select("a.doc_id", "a._rk", "words", F.explode("hits").alias("hit"))
        .select("doc_id", "_rk", "words", "hit.*")
        .join(_small(items), "item_key")
    )
    span = F.least(F.size("item_words"), F.lit(window))
    equal = F.transform(
        F.sequence(F.lit(0), F.size("item_words") - 1),
        lambda j: F.coalesce(F.get(F.col("words"), j + F.col("diagonal")) == F.get(F.col("item_words"), j), F.lit(False)),
    )
    starts = _let(
        equal,
        lambda e: F.filter(
            F.sequence(F.lit(1), F.size("item_words") - span + 1), lambda j: ~F.array_contains(F.slice(e, j, span), False)
        ),
    )
    covered = F.array_distinct(
        F.flatten(F.transform("starts", lambda j: F.sequence(j + F.col("diagonal"), j + F.col("diagonal") + F.col("span") - 1)))
    )
    hits = (
        pairs.select("doc_id", "_rk", "item", "diagonal", span.alias("span"), starts.alias("starts"))
        .where(F.size("starts") > 0)
        .select("doc_id", "_rk", "item", covered.alias("covered"))
        .groupBy("doc_id", "_rk")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).cast("long").alias("n_hit"),
            F.sort_array(F.collect_set("item")).alias("items"),
        )
    )
    every = doc.select("doc_id", "_rk", F.size("words").cast("long").alias("n_words")).alias("a")
    return (
        every.join(hits.alias("b"), same_row_columns("a", "b"), "left")
        .select(
            "a.doc_id",
            "a._rk",
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
        .withColumn("contaminated", F.col("n_hit") > 0)
    )


def same_row_columns(a: str, b: str) -> Column:
    """Rows of two tables with the same document id (null is an id) and text hash."""
    return (F.col(f"{a}._rk") == F.col(f"{b}._rk")) & F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """The documents without a hit, all columns as they are, whatever their names.

    Defined cases: as decontaminate(); texts without words stay; an empty table gives no rows.
    """
    key, found, text_hash = (unused(docs, c) for c in ("_dc_id", "_dc_hash", "_dc_text"))
    hit = decontaminate(docs, benchmark, window, k).where("contaminated")
    hit = save(hit.select(F.col("doc_id").alias(key), F.col("_rk").alias(found)).distinct(), "contaminated")
    same = (F.col(found) == F.col(text_hash)) & F.col(key).eqNullSafe(F.col("doc_id"))
    return docs.withColumn(text_hash, F.xxhash64("text")).join(hit, same, "left_anti").drop(text_hash)


def op10_winnowing(spark, sf_dir):
    """Query: the contract's digest of decontaminate() over documents and benchmark."""
    from orderscope.llm.common import table

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
spans AS (SELECT item, w, least(len(w), 10) AS n FROM i WHERE len(w) > 0),
item_windows AS (
  SELECT DISTINCT item, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win
  FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM spans)),
doc_windows AS (
  SELECT doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s
        FROM d, (SELECT DISTINCT n FROM spans) WHERE len(w) >= n)),
hits AS (SELECT doc_id, item, s, n FROM doc_windows JOIN item_windows USING (n, win)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
"""
