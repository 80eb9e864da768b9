"""Ranked lexical search by the Best Position Algorithm (operator 12).

Documents are indexed in blocks, each small enough for one task: for every term of the items
an impact list, its documents from the highest score for that term to the lowest. An item
reads its lists side by side. Every document met is looked up directly in all lists, which
also tells its positions there; the best position of a list is the end of the unbroken run of
positions seen, by reading or by look-up. No document that is still unseen can score more
than the sum of what stands next in each list, so reading stops as soon as that sum is
strictly below the k-th best score, which keeps every tie. The best of all blocks are then
ranked together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderscope.llm.common import save, table

TOP = 50
ITEM_BYTES = 16 << 20  # of item texts searched for at once; more items are searched in turns
SLICE_BYTES = 8 << 20  # of texts cut into terms at once
BLOCK_DOCS, BLOCK_POSTINGS = 1 << 16, 1 << 22  # of an index block, at most (but for one long document)
FIRST_READ = 64  # positions of each list in the first round; each round reads half as many more as before it
LIMIT64 = 1 << 63


def _term_bytes() -> bytes:
    """For bytes.translate(): A-Z lower-cased; digits, letters and all beyond ASCII stay."""
    out = bytearray(b" " * 0x80 + bytes(range(0x80, 0x100)))
    for c in b"0123456789abcdefghijklmnopqrstuvwxyz":
        out[c] = c
    for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        out[c] = c + 32
    return bytes(out)


_TERM_BYTES = _term_bytes()


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a whole text, in order."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


# -- documents as term counts -------------------------------------------------------------


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts) of every document: n is the number of all its terms; terms
    and counts are of those in ``vocabulary``."""
    width = max(1, len(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for batch in batches:
            texts = batch.column("text")
            at = 0
            while at < batch.num_rows:
                first, size, sizes, found = at, 0, [], []
                while at < batch.num_rows and (at == first or size < SLICE_BYTES):
                    terms = terms_of(texts[at].as_py())
                    size += 8 * len(terms)
                    sizes.append(len(terms))
                    ids = np.fromiter((get(t, -1) for t in terms), np.int64, len(terms))
                    found.append(ids[ids >= 0] + (at - first) * width)
                    at += 1
                codes, counts = np.unique(np.concatenate(found), return_counts=True)
                ends = np.searchsorted(codes, np.arange(len(sizes) + 1) * width).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, len(sizes)),
                        pa.array(sizes, pa.int64()),
                        pa.ListArray.from_arrays(ends, pa.array(codes % width, pa.int32())),
                        pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64())),
                    ],
                    names=["doc_id", "n", "terms", "counts"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n long, terms array<int>, counts array<long>")


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_factor(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    if len(n) and 50 * int(n.max()) * n_docs >= LIMIT64:
        return np.array([50 + 50 * int(x) * n_docs // n_terms for x in n], np.int64)
    return 50 + 50 * n * n_docs // max(1, n_terms)


# -- blocks -------------------------------------------------------------------------------


class Block:
    """An index of some documents: postings by document, and impact lists by term."""

    def __init__(self, n: np.ndarray, ends: np.ndarray, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        self.ends, self.terms = ends, terms
        doc = np.repeat(np.arange(len(n)), np.diff(ends))
        m = length_factor(n, n_docs, n_terms)[doc]
        self.impact = weights[terms] * (1_000_000_000 * counts // (1000 * counts + 20 * m))
        order = np.lexsort((-self.impact, terms))
        self.list_docs, self.list_impact = doc[order], self.impact[order]
        self.starts = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        self.position = np.empty(len(terms), np.int64)  # of each posting, in all lists
        self.position[order] = np.arange(len(terms))
        self.slot = np.full(len(weights), -1)  # of the current item's terms

    def _look_up(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of documents, and the places of their postings in all lists of the item."""
        first, size = self.ends[docs], self.ends[docs + 1] - self.ends[docs]
        begin = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(first - begin, size)
        hit = self.slot[self.terms[at]] >= 0
        return np.add.reduceat(np.where(hit, self.impact[at], 0), begin), at[hit]

    def best(self, terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, positions read) of all documents that score as much as the k-th
        best, or more; all met if they are fewer than k."""
        start, stop = self.starts[terms], self.starts[terms + 1]
        held = stop > start
        terms, start, stop = terms[held], start[held], stop[held]
        if not len(terms):
            return np.empty(0, np.int64), np.empty(0, np.int64), 0
        self.slot[terms] = np.arange(len(terms))
        base = np.cumsum(stop - start) - (stop - start)
        unseen = np.ones(int((stop - start).sum()), bool)
        best, ends = base.copy(), base + (stop - start)  # best: the first unseen position
        met = np.zeros(len(self.ends) - 1, bool)
        docs, scores = [], []
        kth, depth, step, read = -1, 0, FIRST_READ, 0
        while True:
            rows = [self.list_docs[a + depth : min(a + depth + step, b)] for a, b in zip(start, stop, strict=True) if a + depth < b]
            new = np.concatenate(rows) if rows else np.empty(0, np.int64)
            read += len(new)
            new = np.unique(new[~met[new]])
            if len(new):
                met[new] = True
                score, postings = self._look_up(new)
                s = self.slot[self.terms[postings]]
                unseen[base[s] + self.position[postings] - start[s]] = False
                docs.append(new)
                scores.append(score)
                found = np.concatenate(scores)
                if len(found) >= k:
                    kth = np.partition(found, len(found) - k)[len(found) - k]
            bound = 0
            for i in range(len(terms)):
                left = unseen[best[i] : ends[i]]
                gap = int(left.argmax()) if len(left) else 0
                best[i] = best[i] + gap if len(left) and left[gap] else ends[i]
                if best[i] < ends[i]:
                    bound += self.list_impact[start[i] + best[i] - base[i]]
            if bound < kth or (best == ends).all():
                break
            depth, step = depth + step, step + step // 2
        self.slot[terms] = -1
        if not docs:
            return np.empty(0, np.int64), np.empty(0, np.int64), read
        docs, scores = np.concatenate(docs), np.concatenate(scores)
        keep = (scores >= kth) & (scores > 0)
        return docs[keep], scores[keep], read


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, docs, postings = [], 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_DOCS // 8):
            part = batch.slice(at, BLOCK_DOCS // 8)
            size = len(part.column("terms").flatten())
            if held and (docs + part.num_rows > BLOCK_DOCS or postings + size > BLOCK_POSTINGS):
                yield pa.Table.from_batches(held)
                held, docs, postings = [], 0, 0
            held.append(part)
            docs, postings = docs + part.num_rows, postings + size
    if held:
        yield pa.Table.from_batches(held)


def search_blocks(counted: DataFrame, items: list[tuple[int, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item, doc_id, score): the best ``top`` of each index block for each item (number, terms)."""
    id_type = counted.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches):
            part = part.combine_chunks()
            ids, lists = part.column("doc_id").combine_chunks(), part.column("terms").combine_chunks()
            counts = part.column("counts").combine_chunks()
            ends = lists.offsets.to_numpy().astype(np.int64)
            block = Block(
                part.column("n").to_numpy(), ends - ends[0], lists.flatten().to_numpy(), counts.flatten().to_numpy(), weights, n_docs, n_terms
            )
            rank = np.empty(len(ids), np.int64)  # of the ids, for ties; null ids come first
            rank[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
            numbers, found, scores = [], [], []
            for number, terms in items:
                docs, score, _ = block.best(terms, top)
                order = np.lexsort((rank[docs], -score))[:top]
                numbers.append(np.full(len(order), number, np.int32))
                found.append(docs[order])
                scores.append(score[order])
            if numbers:
                chosen = pa.array(np.concatenate(found), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(numbers)), ids.take(chosen), pa.array(np.concatenate(scores))], names=["item", "doc_id", "score"])

    return counted.mapInArrow(run, f"item int, doc_id {id_type}, score long")


# -- search -------------------------------------------------------------------------------


def _search_turn(docs: DataFrame, items: DataFrame, top: int) -> DataFrame:
    """search() for items of bounded size, with their number."""
    texts = {r["item"]: sorted(set(terms_of(r["text"]))) for r in items.select("item", "text").collect()}  # ITEM_BYTES, about
    vocabulary = {t: i for i, t in enumerate(sorted({t for ts in texts.values() for t in ts}))}
    counted = save(count_terms(docs, vocabulary), "terms")
    whole = counted.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each item term
        df[r["term"]] = r["count"]
    weights = np.array([term_weight(whole["docs"], int(d)) for d in df], np.int64)
    wanted = []
    for number, ts in sorted(texts.items()):
        ids = np.array([vocabulary[t] for t in ts], np.int64)
        wanted.append((number, ids[weights[ids] > 0] if len(ids) else ids))
    found = search_blocks(counted, wanted, weights, whole["docs"], whole["terms"], top)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the ``top`` documents with the highest
    score above 0, equal scores by ascending doc_id.

    ``docs`` has doc_id and text, ``items`` item_id and text. Every document is scored on its
    whole text, or shown to lie below the k-th.

    Defined cases: null and empty texts have no terms and are not found, nor do such items find
    any; null ids are kept and come first among ties; repeated documents are ranked one after
    the other, equal items are searched once; an empty table gives no rows; other columns are
    not read.
    """
    items = items.select("item_id", "text").distinct().withColumn("item", F.monotonically_increasing_id())
    items = save(items, "items")
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()
    turns = max(1, math.ceil((size["bytes"] or 0) / ITEM_BYTES))
    out = None
    for turn in range(turns):
        part = items.where(F.pmod(F.xxhash64("item"), F.lit(turns)) == turn) if turns > 1 else items
        part = save(part.withColumn("item", F.row_number().over(Window.orderBy("item")).cast("int")), "turn")
        found = _search_turn(docs, part, top)
        out = found if out is None else out.unionByName(found)
    return out


def op12_best_position(spark, sf_dir):
    """Query: the 50 documents that rank highest for each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"
    )


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
c AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS docs, sum(len(t))::BIGINT AS terms FROM d),
i AS (SELECT row_number() OVER () AS item, item_id, list_distinct({_TERMS}) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT item, unnest(t) AS term FROM i),
p AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM p GROUP BY term), c),
s AS (
  SELECT item, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(t) * docs) // terms))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN d USING (r), c GROUP BY item, r),
k AS (
  SELECT item, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS rank
  FROM s JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k JOIN i USING (item) WHERE rank <= {TOP}
"""
