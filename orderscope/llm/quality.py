"""Quality classifier by positive-unlabelled learning (operator 13).

Only rows marked good are trusted; all documents of the corpus are the unlabelled side. With
the class prior p, the risk of a score g is

    p * E+[l(g)] + max(0, E[l(-g)] - p * E+[l(-g)]),        l(z) = log(1 + exp(-z))

where E+ is the mean over trusted rows and E that over the corpus. The second term stands
for the risk on bad documents and cannot be negative; where an estimate of it falls below
zero, the step goes back along it. The prior is estimated first: a plain classifier of
trusted rows against the corpus ranks both, and among the documents ranked highest, which
are nearly all good, the share of the corpus is p times the share of trusted rows.

A document is described by its shape: shares of character classes, shares of neighbouring
classes with runs collapsed, and how much its words and lines repeat. The descriptions are
written once, in blocks; every step is one pass over them, and one sum a task to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderscope.llm.common import remainder, save, table

# Character classes, in order: letters (and all beyond ASCII), capitals, digits, spaces, line
# ends, these marks, and any other character.
MARKS = (".", ",", "!?", ";:", "'\"()-", "|", "#", "*", "$%&@~^+=")
CLASSES = 16
SHAPES = CLASSES + CLASSES * CLASSES
FEATURES = SHAPES + 8
CHUNK_BYTES = 4 << 20  # of a text described at once
BLOCK_DOCS = 4_096
TASKS = 4_096  # at most, in a pass over the blocks: as many sums of 2 kB reach the driver
MAX_TRUSTED = 2_000_000  # trusted rows used, chosen by hash beyond it: 16 bytes each are broadcast
PRIOR_ROUNDS, ROUNDS, RATE, RIDGE = 20, 40, 0.1, 1e-3
BINS = 256  # of the ranks that the prior is read from
DOUBT = 0.1  # chance that the shares in the bins are off by more than the slack
REACH = 10.0  # standard deviations at most that a feature counts for
THRESHOLD = 0.7


def _class_table() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[:0x80] = CLASSES - 1
    for number, chars in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\r\n", *MARKS]):
        out[list(chars.encode())] = number
    return out


_CLASS = _class_table()


def describe(text: str | None) -> np.ndarray:
    """The features of a whole text, read in chunks that end between two words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(FEATURES, np.float32)
    if not raw:
        out[FEATURES - 1] = 1
        return out
    single, pairs = np.zeros(CLASSES), np.zeros(CLASSES * CLASSES)
    words = repeats = letters = 0
    seen: set[bytes] = set()
    before_class, before_word, at = None, None, 0
    while at < len(raw):
        stop = len(raw)
        if stop - at > CHUNK_BYTES:
            space = max(raw.rfind(b" ", at, at + CHUNK_BYTES), raw.rfind(b"\n", at, at + CHUNK_BYTES))
            stop = space + 1 if space > at else at + CHUNK_BYTES
        chunk = raw[at:stop]
        at = stop
        codes = _CLASS[np.frombuffer(chunk, np.uint8)]
        single += np.bincount(codes, minlength=CLASSES)
        first = np.flatnonzero(codes[1:] != codes[:-1]) + 1
        runs = codes[np.r_[0, first]].astype(np.int64)
        if before_class is not None and before_class != runs[0]:
            runs = np.r_[before_class, runs]
        before_class = runs[-1]
        pairs += np.bincount(runs[:-1] * CLASSES + runs[1:], minlength=CLASSES * CLASSES)
        found = chunk.split()
        if found:
            repeats += sum(map(bytes.__eq__, found, found[1:])) + (found[0] == before_word)
            before_word = found[-1]
            words += len(found)
            letters += sum(map(len, found))
            seen.update(found)
    lines = raw.split(b"\n")
    out[:CLASSES] = single / len(raw)
    out[CLASSES:SHAPES] = pairs / max(1.0, pairs.sum())
    if words:
        out[SHAPES : SHAPES + 4] = np.log1p(words) / 10, len(seen) / words, repeats / words, np.log1p(letters / words) / 3
    out[SHAPES + 4 : SHAPES + 7] = np.log1p(len(lines)) / 10, len(set(lines)) / len(lines), np.log1p(len(raw)) / 10
    return out


@dataclass(frozen=True)
class Model:
    """A linear score of standardised features; no weights where no row was trusted."""

    prior: float
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None  # the last one is the bias

    def rows(self, x: np.ndarray) -> np.ndarray:
        held = np.clip((x.astype(np.float64) - self.mean) / self.scale, -REACH, REACH)
        return np.c_[held, np.ones(len(held))]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return _sigmoid((self.rows(x) * self.weights).sum(1))  # row by row: equal texts, equal scores


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _loss(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, -z)


# -- descriptions -------------------------------------------------------------------------


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of rows marked good by all of their labels that may be learnt from: crc32(doc_id as
    text) mod 4 is not 2. At most about MAX_TRUSTED, chosen by hash."""
    ids = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = save(ids.where((F.col("quality") == 1) & (remainder(F.col("doc_id"), 4) != 2)).select("doc_id"), "trusted")
    n = ids.count()
    if n > MAX_TRUSTED:
        share = int((1 << 32) * MAX_TRUSTED / n)
        ids = ids.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 32) < share)
    return ids


def describe_documents(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """Blocks (n, x, good): the features of n documents as 16-bit floats, and which of them are
    trusted. ``trusted`` has distinct ids, few enough to be broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, good = [], []

        def block():
            data = np.stack(x).astype(np.float16).tobytes(), np.array(good, bool).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int32()), *(pa.array([d], pa.binary()) for d in data)], names=["n", "x", "good"])

        for batch in batches:
            for text, is_good in zip(batch.column("text"), batch.column("good").to_pylist(), strict=True):
                x.append(describe(text.as_py()))
                good.append(is_good)
                if len(x) == BLOCK_DOCS:
                    yield block()
                    x, good = [], []
        if x:
            yield block()

    marked = F.broadcast(trusted.select("doc_id", F.lit(True).alias("good")))
    rows = docs.select("doc_id", "text").join(marked, "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    return save(rows.mapInArrow(run, "n int, x binary, good binary"), "blocks")


def _sums(blocks: DataFrame, of_block) -> np.ndarray:
    """The sum over all blocks of ``of_block(x, good)``, a vector: each task sends one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for n, x, good in zip(*(batch.column(c) for c in ("n", "x", "good")), strict=True):
                features = np.frombuffer(x.as_py(), np.float16).reshape(n.as_py(), FEATURES)
                found = of_block(features, np.frombuffer(good.as_py(), bool))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["v"])

    found = blocks.coalesce(TASKS).mapInArrow(run, "v binary").collect()  # at most TASKS rows
    parts = [np.frombuffer(r["v"], "<f8") for r in found]
    return np.sum(parts, axis=0) if parts else np.zeros(0)


# -- learning -----------------------------------------------------------------------------


def _standard(blocks: DataFrame) -> tuple[Model, float, float]:
    """The model before learning, and the numbers of documents and of trusted ones."""

    def moments(x, good):
        x = x.astype(np.float64)
        return np.r_[len(x), good.sum(), x.sum(0), (x * x).sum(0)]

    total = _sums(blocks, moments)
    if not total.size:
        return Model(0.5, np.zeros(FEATURES), np.ones(FEATURES), None), 0, 0
    n, good, x, xx = total[0], total[1], total[2 : 2 + FEATURES], total[2 + FEATURES :]
    mean = x / n
    return Model(0.5, mean, np.sqrt(np.maximum(0, xx / n - mean**2)) + 1e-3, None), n, good


class _Steps:
    """Adam: steps of a size of their own for each weight."""

    def __init__(self, size: int):
        self.w, self.first, self.second, self.turn = np.zeros(size), 0.0, 0.0, 0

    def go(self, slope: np.ndarray) -> None:
        self.turn += 1
        self.first = 0.9 * self.first + 0.1 * slope
        self.second = 0.99 * self.second + 0.01 * slope * slope
        step = self.first / (1 - 0.9**self.turn) / (np.sqrt(self.second / (1 - 0.99**self.turn)) + 1e-8)
        self.w = self.w - RATE * step


def estimate_prior(blocks: DataFrame, base: Model, n: float, good: float) -> float:
    """The share of good documents in the corpus, from trusted and unlabelled rows alone.

    With thresholds on the rank, the share of the corpus above one is at least the prior times
    the share of trusted rows above it. The quotient is taken where it is lowest once the
    slack of both shares, by the DKW bound, is added.
    """
    steps = _Steps(FEATURES + 1)
    for _ in range(PRIOR_ROUNDS):
        w = steps.w

        def slope(x, is_good, w=w):
            rows = base.rows(x)
            g = rows @ w
            return np.r_[_sigmoid(-g[is_good]) @ rows[is_good], _sigmoid(g) @ rows]

        total = _sums(blocks, slope)
        steps.go(0.5 * total[FEATURES + 1 :] / n - 0.5 * total[: FEATURES + 1] / good + RIDGE * w)
    w = steps.w

    def ranks(x, is_good):
        held = np.minimum((_sigmoid(base.rows(x) @ w) * BINS).astype(int), BINS - 1)
        return np.r_[np.bincount(held[is_good], minlength=BINS), np.bincount(held, minlength=BINS)].astype(float)

    total = _sums(blocks, ranks)
    above_good = np.cumsum(total[:BINS][::-1]) / good
    above = np.cumsum(total[BINS:][::-1]) / n
    some = above_good > 0
    slack = sum(np.sqrt(np.log(4 / DOUBT) / (2 * k)) for k in (n, good))
    best = np.argmin((above[some] + slack) / above_good[some])
    return float(np.clip((above[some] / above_good[some])[best], 0.01, 0.99))


def train(docs: DataFrame, trusted: DataFrame, prior: float | None = None) -> Model:
    """The model of least non-negative risk; ``prior`` is estimated where it is not given."""
    blocks = describe_documents(docs, trusted)
    base, n, good = _standard(blocks)
    if not good:
        return base
    prior = estimate_prior(blocks, base, n, good) if prior is None else prior
    steps = _Steps(FEATURES + 1)
    for _ in range(ROUNDS):
        w = steps.w

        def parts(x, is_good, w=w):
            rows = base.rows(x)
            g = rows @ w
            of_good, g_good = rows[is_good], g[is_good]
            return np.r_[
                _loss(-g).sum(), _loss(-g_good).sum(), _sigmoid(g) @ rows, _sigmoid(g_good) @ of_good, _sigmoid(-g_good) @ of_good
            ]

        total = _sums(blocks, parts)
        corpus, as_bad, as_good = total[2:].reshape(3, -1)
        bad_risk = total[0] / n - prior * total[1] / good
        to_bad = corpus / n - prior * as_bad / good
        to_good = -prior * as_good / good
        steps.go((to_good + to_bad if bad_risk >= 0 else -to_bad) + RIDGE * w)
    return Model(prior, base.mean, base.scale, steps.w)


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``quality_score``, 0 to 1.

    Defined cases: null and empty texts are described as empty and get one score; repeated rows
    get equal scores; without trusted rows every score is 0.5; an empty table gives no rows; a
    column named quality_score is replaced.
    """

    def run(series: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in series:
            out = [np.empty(0)]
            for at in range(0, len(texts), BLOCK_DOCS):
                # through the same 16-bit floats as in learning
                x = np.stack([describe(t.as_py()) for t in texts.slice(at, BLOCK_DOCS)]).astype(np.float16)
                out.append(model.scores(x))
            yield pa.array(np.concatenate(out), pa.float64())

    scored = F.arrow_udf(run, "double", F.ArrowUDFType.SCALAR_ITER)
    return docs.drop("quality_score").withColumn("quality_score", scored(F.col("text")))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``quality_score``, learnt from the trusted rows of ``labels`` (doc_id,
    quality) and all of ``docs``; cases as in score_quality(). Ids without a document, null
    ids and null labels teach nothing."""
    return score_quality(docs, train(docs, trusted_ids(labels)))


def op13_positive_unlabelled(spark, sf_dir):
    """Query: every document scored as labels.quality marks it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, table(spark, sf_dir, "labels")).select(
        "doc_id",
        (remainder(F.col("doc_id"), 4) == 2).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
