from __future__ import annotations

import random
import time
import zlib

import pytest
from orderscope.llm import toxicity
from orderscope.llm.queries import QUERIES
from orderscope.llm.toxicity import KINDS, PRIOR, Model, Reader, learn_lexicon, reject_toxic, score_documents, train
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
PLAIN = Model((("idiot", False, 1.0), ("scum", False, 1.0), ("zork", True, 1.0)), PRIOR[-1], PRIOR[:-1])


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("You are an idiot.", ["aimed"]),
        ("What an idiot!", ["bare"]),
        ("They are not idiot, no.", ["negated"]),
        ("He said you are an idiot.", ["reported"]),
        ("I will kill you.", ["threat"]),
        ("Nobody will kill time. You know.", []),
        ("idiot. Fine words here. You scum", ["bare", "aimed"]),
        ("An idiotic zorkling is not in the list, but zorkling is a stem", ["bare"]),
        ("he said: fine; you idiot", ["aimed"]),
        ("", []),
        ("nothing to see", []),
    ],
)
def test_clause_patterns(text, kinds):
    found = Reader(PLAIN.lexicon)(text)
    assert sorted(k for k, _, _ in found) == sorted(kinds)


def test_reader_equals_a_scan_of_every_clause():
    """The index that skips clauses without a lexicon word changes nothing."""
    rng = random.Random(3)
    reader, slow = Reader(PLAIN.lexicon), Reader(PLAIN.lexicon)
    slow.clauses = lambda text: [(a, b) for a, b in spans(text)]

    def spans(text):
        at = 0
        for i, c in enumerate(text + "\n"):
            if c in ".!?;:\n":
                if at < i:
                    yield at, i
                at = i + 1

    words = ["you", "idiot", "scum", "zorks", "kill", "not", "said", "the", "a", "they"]
    for _ in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", ". ", "!", "\n"]) for _ in range(rng.randrange(40)))
        assert sorted(reader(text)) == sorted(slow(text))


def test_long_texts_take_time_in_proportion():
    """Clauses are found by looking through a text once, however many there are."""
    reader = Reader(PLAIN.lexicon)
    text = "you idiot, said nobody. plain words in a clause! " * 100_000  # 5 MB
    start = time.process_time()
    found = reader(text)
    assert time.process_time() - start < 8
    assert len(found) == 100_000
    once = "plain words and nothing of the list here. " * 100_000 + "you idiot"
    start = time.process_time()
    assert len(reader(once)) == 1
    assert time.process_time() - start < 2


def test_no_match_is_cut_off():
    """More insults, more clauses: more weight, without an end."""
    reader = Reader(PLAIN.lexicon)
    weights = [reader.features("you idiot. " * n)[0] for n in (1, 2, 10, 100, 10_000)]
    assert weights == sorted(set(weights)) and weights[0] == 1
    weights = [reader.features("you " + "idiot scum " * n).sum() for n in (1, 2, 10, 100)]
    assert weights == sorted(set(weights))


def test_the_whole_lexicon_is_kept(spark):
    """Strong and weak words beyond chance, all of them, by their odds."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("bcdefgh", k=8))
    weak = [f"weak{c}" for c in "bcdef"]
    texts = [(w, 1, 60) for w in weak] + [("aaargle", 1, 40)] + [(w, 0, 40) for w in weak]
    rows = [(f"{word()} {w} {word()}", toxic) for w, toxic, n in texts for _ in range(n)]
    rows += [(f"{word()} {word()}", 0) for _ in range(3000)]
    words = [w for w, _, _ in learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))]
    assert set(words) >= {"aaargle", *weak} and words.index("aaargle") < min(words.index(w) for w in weak)


def test_neighbours_are_told_apart_by_whole_words(spark):
    """Words that differ after many characters are different neighbourhoods."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows = [(f"averylongsharedprefix{i} grunk {word()[:0]}anotherlongprefix{i}", 1) for i in range(60)]
    rows += [(" ".join(word() for _ in range(6)), 0) for _ in range(400)]
    words = {w for w, _, _ in learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))}
    assert "grunk" in words


def test_bounded_labelled_rows(spark, monkeypatch):
    docs = spark.range(2_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("toxic"))
    whole = toxicity.labelled_rows(docs, labels).count()
    assert whole == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(2_000))
    monkeypatch.setattr(toxicity, "MAX_LABELLED", 500)
    assert 0.15 * whole < toxicity.labelled_rows(docs, labels).count() < 0.35 * whole


def test_lexicon_ignores_words_of_copied_sentences(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    rows = [(f"{word()} {word()} grunk {word()} {word()}", 1) for _ in range(60)]
    rows += [("the very same copied sentence with plonk inside", 1)] * 60
    rows += [(" ".join(word() for _ in range(6)), 0) for _ in range(400)]
    words = {w for w, _, _ in learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))}
    assert "grunk" in words and "plonk" not in words and "copied" not in words


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = QUERIES["op2_toxicity"](spark, SF).join(labels, "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows)
    assert right / len(rows) >= 0.95
    assert not [r for r in rows if r["predicted"] and not r["toxic"]]


def test_awkward_rows(spark, awkward, nothing):
    scored = score_documents(awkward, PLAIN)
    rows = scored.collect()
    assert len(rows) == 12 and all(0 <= r["toxicity"] < 0.5 for r in rows)
    assert {r["toxicity"] for r in rows if not (r["text"] or "").strip()} == {rows[0]["toxicity"]}
    assert scored.columns.count("toxicity") == 1
    assert score_documents(nothing, PLAIN).count() == 0
    no_labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert reject_toxic(awkward, no_labels).count() == 12
    one_kind = train(spark.createDataFrame([("a", 0), (None, 0)], "text string, toxic int"))
    assert one_kind.bias == PRIOR[-1] and len(one_kind.weights) == len(KINDS)
