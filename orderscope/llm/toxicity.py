"""Toxicity by a weighted finite-state pattern grammar (operator 2).

A text is cut into clauses. In a clause, words become symbols (insult, threat, target,
negation, reported speech, other), and one transducer, composed of five small ones, reads
the symbols from left to right and emits the kind of each matched pattern: an insult that
is aimed at a target, a bare insult, a threat against a target, and either of them negated
or reported. A document is scored by its matched clauses through a logistic function.

Insult words and their weights come from labelled rows (log odds, over the whole labelled
part of the corpus), on top of a short seed list; so do the weights of the clause kinds.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass
from math import log2

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderscope.llm.common import remainder, save, table, tidy, unused

# Seed words of the grammar. Insults are extended and weighted by the labels.
INSULTS = "idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb imbecile bastard jerk".split()
THREATS = "kill hurt destroy beat shoot stab burn attack smash punch murder".split()
TARGETS = "you your yours yourself u they them he she him her this these those people everyone du dich euch ihr sie tu te toi vous usted ustedes ellos".split()
NEGATIONS = "not no never neither nor isn't aren't don't nicht kein keine nie pas jamais ne nunca jamás nadie".split()
REPORTS = "said says saying quoted quote called calls reported according wrote claimed alleged sagte sagt laut dit disait selon dijo dice según".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
SYMBOLS = 6
KINDS = ("aimed", "bare", "threat", "negated", "reported")
CLAUSE_END = re.compile(r"[.!?;:\n]")
MAX_LABELLED = 1_000_000  # labelled rows that the model is fitted to, chosen by hash beyond it
BROADCAST_LABELS = 2_000_000  # 16 bytes each
STEP = 4  # parts of one in which the calibration counts log weights
MARKS = ".!?;:\n"


# -- transducers --------------------------------------------------------------------------


@dataclass(frozen=True)
class Transducer:
    """A deterministic transducer: (state, symbol) -> (symbol out, next state)."""

    step: tuple[tuple[tuple[int, int], ...], ...]

    def then(self, other: Transducer) -> Transducer:
        """The composition: ``other`` reads what this one writes."""
        n = len(other.step)
        return Transducer(
            tuple(
                tuple(
                    (other.step[b][out][0], nxt * n + other.step[b][out][1])
                    for out, nxt in self.step[a]
                )
                for a in range(len(self.step))
                for b in range(n)
            )
        )


def _marker(reach: int, on: int, heard: int, mark: int, width: int) -> Transducer:
    """After ``on``, adds ``mark`` to each of the symbols up to ``heard`` for ``reach`` symbols
    (for good where reach is 0). Symbols are numbers below ``width``; marks are added to them."""
    states = reach + 1 if reach else 2
    rows = []
    for state in range(states):
        row = []
        for symbol in range(width):
            base = symbol % SYMBOLS
            live = state > 0
            out = symbol + mark if live and base in (INSULT, THREAT) and base <= heard else symbol
            after = (states - 1) if base == on else (state if live and not reach else max(0, state - 1))
            row.append((out, after))
        rows.append(tuple(row))
    return Transducer(tuple(rows))


def _matcher(width: int, target_reach: int) -> Transducer:
    """Writes 1 + kind at the symbol that completes a pattern, else 0.

    State: how many more symbols a seen target is in reach, and whether a threat is open.
    """
    rows = []
    for state in range(2 * (target_reach + 1)):
        near, threat = state // 2, state % 2
        row = []
        for symbol in range(width):
            base, mark = symbol % SYMBOLS, symbol // SYMBOLS
            kind = None
            open_threat = threat
            if base == INSULT:
                kind = "reported" if mark >= 2 else "negated" if mark else "aimed" if near else "bare"
            elif base == THREAT:
                if mark:
                    kind = "reported" if mark >= 2 else "negated"
                else:
                    open_threat = 1
            elif base == TARGET and threat:
                kind, open_threat = "threat", 0
            still = target_reach if base == TARGET else max(0, near - 1)
            row.append((1 + KINDS.index(kind) if kind else 0, 2 * still + open_threat))
        rows.append(tuple(row))
    return Transducer(tuple(rows))


def grammar(negation_reach: int = 3, target_reach: int = 6) -> Transducer:
    """negation, then reported speech, then the clause patterns, as one transducer.

    Symbols 0-5 are plain; +6 marks a negated, +12 a reported one.
    """
    negated = _marker(negation_reach, NEGATION, THREAT, SYMBOLS, SYMBOLS)
    reported = _marker(0, REPORT, THREAT, 2 * SYMBOLS, 2 * SYMBOLS)
    return negated.then(reported).then(_matcher(4 * SYMBOLS, target_reach))


# -- the lexicon --------------------------------------------------------------------------

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


@dataclass(frozen=True)
class Model:
    """What scoring needs: (text, is_stem, weight) of the lexicon, and the clause weights."""

    lexicon: tuple[tuple[str, bool, float], ...]
    bias: float
    weights: tuple[float, ...]


class Reader:
    """Counts the matched clauses of texts; built once for each task."""

    def __init__(self, lexicon):
        self.step = grammar().step
        self.whole = {w: (s, 1.0) for s, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}
        self.stems: dict[str, float] = {}
        self.find = ahocorasick.Automaton()
        for w in THREATS:
            self.find.add_word(w, 1)
        for text, is_stem, weight in lexicon:
            if is_stem:
                self.stems[text] = max(weight, self.stems.get(text, 0.0))
            else:
                self.whole[text] = (INSULT, weight)
            self.find.add_word(text, 1)
        self.find.make_automaton()
        self.sizes = sorted({len(s) for s in self.stems})

    def symbol(self, word: str) -> tuple[int, float]:
        hit = self.whole.get(word)
        if hit:
            return hit
        best = max((self.stems.get(word[:n], 0.0) for n in self.sizes if len(word) >= n), default=0.0)
        return (INSULT, best) if best else (OTHER, 0.0)

    def clauses(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the clauses that hold a lexicon match, each once."""
        out: list[tuple[int, int]] = []
        for at, _ in self.find.iter(text):
            if out and at < out[-1][1]:
                continue
            behind = out[-1][1] if out else 0  # looked through before, so long texts take time in proportion
            start = max(behind - (not out), *(text.rfind(c, behind, at) for c in MARKS)) + 1
            stop = CLAUSE_END.search(text, at)
            span = (start, stop.start() if stop else len(text))
            if not out or span != out[-1]:
                out.append(span)
        return out

    def __call__(self, text: str | None) -> list[tuple[str, float, str]]:
        """(kind, weight, clause) for each kind of pattern matched in a clause; the weights of
        matches of one kind add up, and count with their logarithm."""
        low = (text or "").lower()
        found = []
        for a, b in self.clauses(low):
            state, best = 0, {}
            threat = 0.0
            for word in _WORD.findall(low, a, b):
                symbol, weight = self.symbol(word)
                out, state = self.step[state][symbol]
                if symbol == THREAT:
                    threat = weight
                if out:
                    kind = KINDS[out - 1]
                    best[kind] = best.get(kind, 0.0) + (weight if symbol == INSULT else threat)
            found.extend((kind, log2(1 + w), low[a:b]) for kind, w in best.items())
        return found

    def features(self, text: str | None) -> np.ndarray:
        return features_of(self(text))


def features_of(found: list[tuple[str, float, str]]) -> np.ndarray:
    """The weight of each kind in a text: log2 of one and the sum over its clauses, so the first
    clauses count most, a plain one counts 1, and none is left out."""
    total = np.zeros(len(KINDS))
    for kind, weight, _ in found:
        total[KINDS.index(kind)] += weight
    return np.log2(1 + total)


# -- learning -----------------------------------------------------------------------------


def _word_counts(labelled: DataFrame) -> DataFrame:
    """(word, toxic, clean): documents of either label that hold the word."""

    def run(frames):
        for frame in frames:
            counts = {0: Counter(), 1: Counter()}
            for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
                counts[int(toxic)].update(set(_WORD.findall((text or "").lower())))
            words = list(counts[0].keys() | counts[1].keys())
            yield pd.DataFrame(
                {"word": words, "toxic": [counts[1][w] for w in words], "clean": [counts[0][w] for w in words]}
            )

    rows = labelled.mapInPandas(tidy(run), "word string, toxic long, clean long")
    return rows.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(labelled: DataFrame, min_documents: int = 3, min_contexts: int = 3, min_odds: float = 2.5) -> list[tuple[str, bool, float]]:
    """Words and stems that mark toxic texts, with their log odds; those of at most MAX_LABELLED
    rows, so few enough for the driver and the model.

    The evidence of a word (its log likelihood ratio against the share of toxic texts)
    must exceed what the best of all the words tested would show by chance. What counts is
    the number of different neighbourhoods (words before and after) it has in toxic texts:
    a word that only repeats with its sentence, in copies of one text, says nothing.
    """
    size = labelled.groupBy().agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    toxic, clean = size["t"] or 0, size["n"] - (size["t"] or 0)
    if not toxic or not clean:
        return [(w, False, 1.0) for w in INSULTS]
    counts = save(_word_counts(labelled), "toxic-words")

    share = toxic / (toxic + clean)
    tested = counts.where(F.col("toxic") + F.col("clean") >= min_documents).count()
    chance = float(np.log(max(2, tested)) + 3)

    def evidence(t: float, c: float) -> float:
        return sum(k * np.log(k / (t + c) / p) for k, p in ((t, share), (c, 1 - share)) if k)

    def odds(t: float, c: float) -> float:
        return float(np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1)))

    # Candidates: more toxic documents than min_odds asks for, on evidence beyond chance.
    rate = (F.col("toxic") + 0.5) / (toxic + 1.0) * (clean + 1.0) / (F.col("clean") + 0.5)
    likely = (F.col("toxic") >= min_documents) & (rate >= float(np.exp(min_odds)))
    parts = [
        F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (F.col("toxic") + F.col("clean")) / F.lit(float(p)))).otherwise(0.0)
        for k, p in (("toxic", share), ("clean", 1 - share))
    ]
    stems = counts.where(F.length("word") >= 5).withColumn(
        "stem", F.explode(F.expr("transform(sequence(4, least(6, length(word) - 1)), i -> substring(word, 1, i))"))
    )
    stems = stems.groupBy("stem").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count_if(F.col("toxic") > 0).alias("forms")
    )
    found = (
        counts.where(likely)
        .select("word", F.lit(False).alias("is_stem"), "toxic", "clean")
        .union(stems.where(likely & (F.col("forms") >= 3)).select(F.col("stem").alias("word"), F.lit(True), "toxic", "clean"))
        .withColumn("evidence", parts[0] + parts[1])
        .where(F.col("evidence") >= chance)
        .collect()  # words beyond chance in a bounded number of rows
    )
    clean_of = {(r["word"], r["is_stem"]): r["clean"] for r in found}
    whole = {w for w, s in clean_of if not s}
    stem = {w for w, s in clean_of if s}

    def contexts(frames):
        sizes = sorted({len(s) for s in stem})
        for frame in frames:
            out = set()
            for text in frame["text"]:
                words = ["", *_WORD.findall((text or "").lower()), ""]
                for i in range(1, len(words) - 1):
                    word = words[i]
                    hits = [(word, False)] if word in whole else []
                    hits += [(word[:n], True) for n in sizes if len(word) > n and word[:n] in stem]
                    if hits:
                        near = f"{words[i - 1]} {words[i + 1]}".encode("utf-8", "surrogatepass")
                        beside = int.from_bytes(hashlib.blake2b(near, digest_size=8).digest(), "big", signed=True)
                        out.update((w, s, beside) for w, s in hits)
            yield pd.DataFrame(list(out), columns=["word", "is_stem", "beside"])

    beside = (
        labelled.where("toxic = 1")
        .mapInPandas(tidy(contexts), "word string, is_stem boolean, beside long")
        .distinct()
        .groupBy("word", "is_stem")
        .count()
        .where(F.col("count") >= min_contexts)
        .collect()  # at most as many rows as candidates
    )
    kept = []
    for r in beside:
        key = (r["word"], r["is_stem"])
        t = min(r["count"], toxic)  # different neighbours stand for independent uses
        if evidence(t, clean_of[key]) >= chance and odds(t, clean_of[key]) >= min_odds:
            kept.append((*key, odds(t, clean_of[key])))
    strongest = max((w for *_, w in kept), default=1.0)
    kept = [(w, s, o / strongest) for w, s, o in kept]
    seen = {w for w, s, _ in kept if not s}
    kept += [(w, False, 1.0) for w in INSULTS if w not in seen]
    return sorted(kept, key=lambda x: (-x[2], x[0], x[1]))


# Weights of the clause kinds, and the bias, before any label is seen.
PRIOR = (3.5, 3.0, 3.5, 0.2, 0.2, -3.0)


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 3.0) -> np.ndarray:
    """Newton's method on weighted rows, drawn towards PRIOR; the last weight is the bias."""
    x = np.c_[x, np.ones(len(x))]
    prior = np.array(PRIOR)
    w = prior.copy()
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + penalty, x.T @ (n * (y - p)) - penalty @ (w - prior))
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(labelled: DataFrame) -> Model:
    """The model from labelled rows (text, toxic 0/1); null labels are left out.

    Counts cover every labelled row. Without rows of both labels the seed lists and fixed
    weights are used.
    """
    labelled = save(labelled.where("toxic is not null").select("text", F.col("toxic").cast("int").alias("toxic")), "labelled")
    lexicon = learn_lexicon(labelled)

    def counted(frames):
        reader = Reader(lexicon)
        for frame in frames:
            x = [np.round(STEP * reader.features(t)).astype(int) for t in frame["text"]]
            out = pd.DataFrame(x, columns=list(KINDS))
            out["toxic"] = frame["toxic"].to_numpy()
            yield out.groupby([*KINDS, "toxic"]).size().rename("n").reset_index()

    kinds = ", ".join(f"{k} int" for k in KINDS)
    rows = (  # logarithms in steps: few different rows, and at most as many as labelled ones
        labelled.mapInPandas(tidy(counted), f"{kinds}, toxic int, n long").groupBy(*KINDS, "toxic").agg(F.sum("n").alias("n")).collect()
    )
    y = np.array([r["toxic"] for r in rows], float)
    if len(set(y)) < 2:
        return Model(tuple(lexicon), PRIOR[-1], PRIOR[:-1])
    x = np.array([[r[k] / STEP for k in KINDS] for r in rows], float)
    w = _logistic(x, y, np.array([r["n"] for r in rows], float))
    return Model(tuple(lexicon), float(w[-1]), tuple(map(float, w[:-1])))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1), ``matches`` (matched clauses) and ``clauses``: the
    kind, weight and text of each match.

    Defined cases: null and empty texts match nothing and get the score of a text without
    matches; repeated rows get equal scores; an empty table gives no rows; columns named
    toxicity, matches or clauses are replaced.
    """
    keep = docs.drop("toxicity", "matches", "clauses")

    def run(texts):
        reader = Reader(model.lexicon)
        w = np.array(model.weights)
        for series in texts:
            score, clauses = [], []
            for text in series:
                found = reader(text)
                z = model.bias + float(features_of(found) @ w)
                score.append(1 / (1 + np.exp(-z)))
                clauses.append([{"kind": k, "weight": float(v), "text": t} for k, v, t in found])
            yield pd.DataFrame({"toxicity": np.array(score, float), "clauses": clauses})

    scored = F.pandas_udf(tidy(run), "toxicity double, clauses array<struct<kind: string, weight: double, text: string>>", F.PandasUDFType.SCALAR_ITER)
    return (
        keep.withColumn("_tox_found", scored(F.col("text")))
        .select(*keep.columns, "_tox_found.toxicity", F.size("_tox_found.clauses").alias("matches"), "_tox_found.clauses")
    )


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts of the rows the model may learn from: crc32(doc_id as text) mod 5 is not 0; of more
    than MAX_LABELLED labelled ids about as many, chosen by hash.

    Defined cases: several labels of one id count once, as toxic where any is; null ids and
    null labels teach nothing; ids without a document are left out; an empty table gives
    no rows.
    """
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    one = save(one, "labels")
    n = one.count()
    if n > MAX_LABELLED:
        one = one.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 32) < int((1 << 32) * MAX_LABELLED / n))
    if min(n, MAX_LABELLED) <= BROADCAST_LABELS:  # else the texts are joined by shuffle
        one = F.broadcast(one)
    return docs.select("doc_id", "text").where(remainder(F.col("doc_id")) != 0).join(one, "doc_id").select("text", "toxic")


def op2_toxicity(spark, sf_dir):
    """Query: every document scored as labels.toxic marks it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(labelled_rows(docs, table(spark, sf_dir, "labels")))
    return score_documents(docs, model).select(
        "doc_id",
        (remainder(F.col("doc_id")) == 0).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
        F.col("matches").cast("long").alias("n_clauses"),
    )


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents scored below the threshold, columns as they are, whatever their names.

    Defined cases: as score_documents(); without labels the seed lists decide.
    """
    model = train(labelled_rows(docs, labels))
    clash = {c: unused(docs, f"kept_{c}") for c in docs.columns if c.lower() in ("toxicity", "matches", "clauses")}
    scored = score_documents(docs.withColumnsRenamed(clash), model).where(F.col("toxicity") < threshold)
    return scored.select(*[F.col(clash.get(c, c)).alias(c) for c in docs.columns])
