"""Language-model scoring with a hashed maximum-entropy model (operator 9).

The softmax is factored by classes: P(word | context) = P(class | context) P(word | class).
P(class | context) is a maximum-entropy model over hashed features of the context: the word
before, the one before that (a skip feature), and both together. P(word | class) is the
word's smoothed share of its class. Words get classes from the company their short forms
and endings keep, over the whole training corpus.

Training is a few distributed passes: counts; the model's sufficient statistics; then
gradient updates, in each of which every task sums what the model expects over its texts
and the driver moves each weight by the log ratio of observed to expected counts. Every
pass reads all training texts. The driver and the tasks hold tables of fixed size: HEAD
words, GROUPS groups, ROWS x CLASSES weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderscope.llm.common import remainder, save, table
from orderscope.llm.token_units import text_slices

CLASSES = 24
HEAD = 1 << 18  # words whose counts every task holds; the others are joined by shuffle
SHORT, ENDINGS = 1024, 1024  # groups of short words, and of longer words by their ending
GROUPS = SHORT + ENDINGS + 1  # and the end of a text
COMPANY = 64  # hashed words before, by which groups are clustered
BEFORE, SKIP, PAIR = 4096, 4096, 8192  # hashed rows of the three feature templates
ROWS = BEFORE + SKIP + PAIR
UPDATES = 2
PRIOR_COUNT = 8.0  # of a feature, spread like the classes
STEP = 1 / 3  # features that fire at once: a step at which the likelihood can only rise
CHUNK = 1 << 15
END = b" "  # no word holds a space
_U = np.uint64
_START = _U(0x9E3779B97F4A7C15)


@dataclass
class Tokens:
    """The tokens of a slice of texts: ``code`` numbers the distinct words."""

    first: int
    offsets: np.ndarray
    code: np.ndarray
    hashes: np.ndarray  # of the distinct words, uint64
    groups: np.ndarray

    @property
    def texts(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def _hash(words: list[bytes]) -> np.ndarray:
    held = np.empty(len(words), dtype=object)
    held[:] = words
    return pd.util.hash_array(held, categorize=False)


def tokenized(texts: pa.Array):
    """Tokens of slices of whole texts: words between white space, A-Z lower-cased, then END."""
    for first, part in text_slices(texts):
        words: list[bytes] = []
        offsets = [0]
        for text in part.to_pylist():
            words += text.encode("utf-8", "surrogatepass").lower().split()
            words.append(END)
            offsets.append(len(words))
        coded = pa.array(words, pa.large_binary()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        hashes = _hash(distinct)
        endings = _hash([w[-3:] for w in distinct])
        size = np.fromiter(map(len, distinct), np.int64, len(distinct))
        groups = np.where(size <= 4, hashes % _U(SHORT), _U(SHORT) + endings % _U(ENDINGS)).astype(np.int32)
        groups[[i for i, w in enumerate(distinct) if w == END]] = GROUPS - 1
        yield Tokens(first, np.array(offsets), coded.indices.to_numpy(), hashes, groups)


def features(t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token the rows of its three features."""
    word = t.hashes[t.code]
    start = t.offsets[:-1]
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[start] = _START
    skip = np.empty_like(word)
    skip[1:] = before[:-1]
    skip[start] = _START
    with np.errstate(over="ignore"):
        pair = (before * _U(0xBF58476D1CE4E5B9)) ^ (skip * _U(0x94D049BB133111EB))
    pair ^= pair >> _U(29)
    return (
        (before % _U(BEFORE)).astype(np.int32),
        (_U(BEFORE) + (skip >> _U(7)) % _U(SKIP)).astype(np.int32),
        (_U(BEFORE + SKIP) + pair % _U(PAIR)).astype(np.int32),
    )


# -- counts -------------------------------------------------------------------------------


def _counts(docs: DataFrame) -> DataFrame:
    """(kind 0, word hash, group, count) for words, (kind 1, group * COMPANY + word before,
    null, count) for the company of groups; partial sums of each slice."""

    def run(batches):
        for batch in batches:
            for t in tokenized(batch.column("text")):
                count = np.bincount(t.code, minlength=len(t.hashes))
                word = t.hashes[t.code]
                before = np.r_[_START, word[:-1]]
                before[t.offsets[:-1]] = _START
                met = np.bincount(t.groups[t.code] * COMPANY + (before % _U(COMPANY)).astype(np.int64))
                seen = np.flatnonzero(met)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.r_[np.zeros(len(count), np.int8), np.ones(len(seen), np.int8)]),
                        pa.array(np.r_[t.hashes.view(np.int64), seen]),
                        pa.array(np.r_[t.groups, np.zeros(len(seen), np.int32)]),
                        pa.array(np.r_[count, met[seen]]),
                    ],
                    names=["kind", "key", "grp", "n"],
                )

    rows = docs.select("text").mapInArrow(run, "kind byte, key long, grp int, n long")
    return save(rows.groupBy("kind", "key", "grp").agg(F.sum("n").alias("n")), "word-counts")


def cluster(company: np.ndarray, mass: np.ndarray, classes: int) -> np.ndarray:
    """A class for each group: k-means on the square roots of its company's shares. The end
    of a text is a class of its own, the last."""
    shape = np.sqrt((company + 0.01) / (company + 0.01).sum(axis=1, keepdims=True))
    weight = mass[:-1] + 1e-3
    points = shape[:-1]
    centers = [points[int(np.argmax(weight))]]
    far = 2 - 2 * points @ centers[0]
    for _ in range(classes - 2):
        centers.append(points[int(np.argmax(far * weight))])
        far = np.minimum(far, 2 - 2 * points @ centers[-1])
    held = np.array(centers)
    for _ in range(20):
        own = np.argmax(points @ held.T, axis=1)
        for c in range(len(held)):
            if (own == c).any():
                mean = np.average(points[own == c], axis=0, weights=weight[own == c])
                held[c] = mean / np.linalg.norm(mean)
    return np.r_[own, classes - 1].astype(np.int32)


# -- the class model ----------------------------------------------------------------------


@dataclass
class Model:
    """Everything scoring needs but the counts of words outside the head."""

    class_of: np.ndarray  # by group
    bias: np.ndarray
    weights: np.ndarray  # ROWS x CLASSES
    log_mass: np.ndarray  # log10 of each class's smoothed count
    head: np.ndarray  # sorted word hashes
    head_count: np.ndarray
    tokens: int
    words: int


def _class_logits(rows, bias: np.ndarray, weights: np.ndarray, s: slice) -> np.ndarray:
    x = weights[rows[0][s]] + weights[rows[1][s]]
    x += weights[rows[2][s]]
    x += bias
    x -= x.max(axis=1, keepdims=True)
    return x


def _statistics(docs: DataFrame, class_of: np.ndarray, bias=None, weights=None) -> np.ndarray:
    """ROWS x CLASSES counts over all texts: of the classes that were observed, or, with a
    model, of those it expects (in units of 1/1024, so sums don't depend on their order)."""
    observed = weights is None
    scale = 1 if observed else 1024

    def run(batches):
        total = np.zeros((ROWS, CLASSES))
        for batch in batches:
            for t in tokenized(batch.column("text")):
                rows = features(t)
                if observed:
                    kind = class_of[t.groups][t.code]
                    for r in rows:
                        total += np.bincount(r.astype(np.int64) * CLASSES + kind, minlength=ROWS * CLASSES).reshape(ROWS, CLASSES)
                    continue
                for at in range(0, len(t.code), CHUNK):
                    s = slice(at, at + CHUNK)
                    p = np.exp(_class_logits(rows, bias, weights, s))
                    p /= p.sum(axis=1, keepdims=True)
                    for c, column in enumerate(np.ascontiguousarray(p.T)):
                        for r in rows:
                            total[:, c] += np.bincount(r[s], column, ROWS)
        seen = np.flatnonzero(total.any(axis=1))
        whole = np.rint(total[seen] * scale).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.astype(np.int32)), *(pa.array(np.ascontiguousarray(whole[:, c])) for c in range(CLASSES))],
            names=["row", *(f"c{c}" for c in range(CLASSES))],
        )

    columns = ", ".join(f"c{c} long" for c in range(CLASSES))
    summed = (
        docs.select("text")
        .mapInArrow(run, f"row int, {columns}")
        .groupBy("row")
        .agg(*(F.sum(f"c{c}").alias(f"c{c}") for c in range(CLASSES)))
        .toArrow()  # ROWS rows at most
    )
    out = np.zeros((ROWS, CLASSES))
    if summed.num_rows:
        row = summed.column("row").to_numpy()
        for c in range(CLASSES):
            out[row, c] = summed.column(f"c{c}").to_numpy()
    return out / scale


def head_threshold(words: DataFrame) -> int:
    """The least count with which at most HEAD words have it or more: from a histogram of the
    logarithms of counts, so no task ranks words."""
    step = F.floor(F.log2("n") * 8).cast("int")
    found = words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).collect()
    held, least = 0, 1 << 62
    for r in sorted(found, key=lambda r: -r["step"]):  # eight steps for each power of two
        held += r["words"]
        if held > HEAD:
            break
        least = r["least"]
    return least


def train(docs: DataFrame, updates: int = UPDATES) -> tuple[Model, DataFrame]:
    """The model of the texts of ``docs``, and the table (word, n) of all word counts."""
    counts = _counts(docs)
    words = counts.where("kind = 0").select(F.col("key").alias("word"), "grp", "n")
    by_group = words.groupBy("grp").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    mass, kinds = np.zeros(GROUPS), np.zeros(GROUPS)
    for r in by_group:
        mass[r["grp"]], kinds[r["grp"]] = r["n"], r["v"]
    company = np.zeros(GROUPS * COMPANY)
    for r in counts.where("kind = 1").select("key", "n").collect():  # GROUPS x COMPANY at most
        company[r["key"]] = r["n"]
    class_of = cluster(company.reshape(GROUPS, COMPANY), mass, CLASSES)
    smooth = np.bincount(class_of, mass + 0.5 * kinds, CLASSES) + 0.5  # the last half: words never seen
    share = np.bincount(class_of, mass, CLASSES) + 1.0
    share /= share.sum()

    observed = _statistics(docs, class_of)
    prior = PRIOR_COUNT * share
    bias = np.log(share).astype(np.float32)
    weights = STEP * np.log((observed + prior) / (observed.sum(axis=1, keepdims=True) * share + prior))
    weights = weights.astype(np.float32)
    for _ in range(updates):
        expected = _statistics(docs, class_of, bias, weights)
        weights = (weights + STEP * np.log((observed + prior) / (expected + prior))).astype(np.float32)

    top = words.where(F.col("n") >= head_threshold(words)).select("word", "n").toArrow()  # HEAD rows at most
    head = top.column("word").to_numpy().view(np.uint64)
    order = np.argsort(head)
    model = Model(
        class_of, bias, weights, np.log10(smooth), head[order], top.column("n").to_numpy()[order], int(mass.sum()), int(kinds.sum())
    )
    return model, words.select("word", "n")


def score_texts(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """``docs`` (without lm_ columns) with lm_tokens, lm_known, lm_base and lm_score.

    lm_score is the model's log10 probability of the text and its end, lm_base that of the
    smoothed word shares alone; lm_known counts tokens seen in training. Counts of words
    outside the head come by a join on the word; only distinct rare words of a text move.

    Defined cases: null and empty texts are an end alone; words never seen share the
    unseen mass of their class; repeated rows are scored alike; an empty table gives no
    rows; a model of no texts gives every class the same probability.
    """
    keep = [c for c in docs.columns if c not in ("lm_tokens", "lm_known", "lm_base", "lm_score")]

    def run(batches):
        last = max(0, len(model.head) - 1)
        for batch in batches:
            for t in tokenized(batch.column("text")):
                texts = len(t.offsets) - 1
                at = np.minimum(np.searchsorted(model.head, t.hashes), last)
                is_head = (model.head[at] == t.hashes) if len(model.head) else np.zeros(len(t.hashes), bool)
                log_count = np.where(is_head, np.log10(np.where(is_head, model.head_count[at] if len(model.head) else 0, 0) + 0.5), 0.0)
                kind = model.class_of[t.groups]
                rows = features(t)
                own = kind[t.code]
                gain = np.empty(len(t.code))
                for a in range(0, len(t.code), CHUNK):
                    s = slice(a, a + CHUNK)
                    x = _class_logits(rows, model.bias, model.weights, s)
                    gain[s] = x[np.arange(len(x)), own[s]] - np.log(np.exp(x).sum(axis=1))
                gain = gain / np.log(10) - model.log_mass[own]
                text = t.texts
                rare = ~is_head[t.code]
                key = text[rare] * np.int64(len(t.hashes)) + t.code[rare]
                pair, times = np.unique(key, return_counts=True)
                per_text = np.bincount(pair // len(t.hashes), minlength=texts)
                place = pa.array(np.r_[0, np.cumsum(per_text)].astype(np.int32))
                part = batch.slice(t.first, texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_lm_row"),
                        pa.array(np.diff(t.offsets)),
                        pa.array(np.bincount(text, is_head[t.code], texts).astype(np.int64)),
                        pa.array(np.bincount(text, log_count[t.code], texts)),
                        pa.array(np.bincount(text, gain, texts)),
                        pa.ListArray.from_arrays(place, pa.array(t.hashes[pair % len(t.hashes)].view(np.int64))),
                        pa.ListArray.from_arrays(place, pa.array(times.astype(np.int32))),
                    ],
                    names=["_lm_row", "tokens", "known", "counted", "gain", "rare", "times"],
                )

    numbered = docs.select(*keep).withColumn("_lm_row", F.monotonically_increasing_id())
    scored = numbered.select("_lm_row", "text").mapInArrow(
        run, "_lm_row long, tokens long, known long, counted double, gain double, rare array<long>, times array<int>"
    )
    scored = save(scored, "scored")
    rare = scored.select("_lm_row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select(
        "_lm_row", F.col("r.rare").alias("word"), F.col("r.times").alias("times")
    )
    c = F.coalesce(F.col("n"), F.lit(0))
    tail = (
        rare.join(counts, "word", "left")
        .groupBy("_lm_row")
        .agg(
            F.sum(F.col("times") * F.log10(c + 0.5)).alias("tail"),
            F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("tail_known"),
        )
    )
    whole = float(np.log10(model.tokens + 0.5 * (model.words + 1)))
    tail_sum = F.col("counted") + F.coalesce("tail", F.lit(0.0))
    result = scored.drop("rare", "times").join(tail, "_lm_row", "left").select(
        "_lm_row",
        F.col("tokens").alias("lm_tokens"),
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("lm_known"),
        (tail_sum - F.col("tokens") * whole).alias("lm_base"),
        (tail_sum + F.col("gain")).alias("lm_score"),
    )
    return numbered.join(result, "_lm_row").drop("_lm_row")


def learns_from(doc_id: Column) -> Column:
    return remainder(doc_id) != 1


def op9_maxent(spark, sf_dir):
    """Query: every document scored by the model of those it may learn from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counts = train(docs.where(learns_from(F.col("doc_id"))))
    scored = score_texts(docs, model, counts)
    return scored.select(
        "doc_id",
        (~learns_from(F.col("doc_id"))).alias("held_out"),
        F.col("lm_tokens").alias("n_tokens"),
        F.col("lm_known").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        F.col("lm_base").alias("base_score"),
        F.col("lm_score").alias("score"),
    )
