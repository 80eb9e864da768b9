"""Token counts by a whole-token shortcut (operator 3).

For a BPE vocabulary with word ends, most pre-tokens are vocabulary strings. Offline, on the
driver, every such string is put through the library: those that come back as their own
single token are proven, and count 1 wherever they are a pre-token. Only other pre-tokens
are merged.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orderscope.llm.common import table, text_bytes
from orderscope.llm.token_units import PLAIN, Cache, byte_letters, split_units, text_slices

LIMIT = 2048
# The pre-token pattern of the vocabulary file, checked against the file when it is loaded.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def proven_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that, as a text, are one pre-token and one token."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    splits = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
    if splits != [PRETOKEN]:
        raise ValueError("the vocabulary's pre-token pattern is not the one this operator knows")
    tokenizer = Tokenizer.from_file(path)
    special = {t["content"] for t in spec["added_tokens"]}
    end = spec["model"]["end_of_word_suffix"]
    candidates = [t[: -len(end)] for t in spec["model"]["vocab"] if t.endswith(end) and t not in special]
    candidates = [t for t in candidates if t and t.isascii()]  # others are not text but mapped bytes
    found = tokenizer.encode_batch(candidates, add_special_tokens=False)
    return frozenset(
        t for t, e in zip(candidates, found, strict=True) if len(e.ids) == 1 and regex.findall(PRETOKEN, t) == [t] == [t.lower()]
    )


class Counter:
    """Counts the tokens of texts; one for each worker task.

    The pattern drops white space, so the units between spaces are independent.
    """

    def __init__(self, path: str, proven: frozenset[str]):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.proven = proven
        self.pattern = regex.compile(PRETOKEN)
        self.units, self.merged = Cache(), Cache()

    def _merge(self, pieces: list[str]) -> list[int]:
        return [len(self.model.tokenize(byte_letters(p))) for p in pieces]

    def _whole(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _count_units(self, new: list[str]) -> list[int]:
        pieces = {u: self.pattern.findall(u.lower()) for u in new if PLAIN.fullmatch(u) and "<|" not in u}
        proven = self.proven
        self.merged.fill({p for ps in pieces.values() for p in ps if p not in proven}, self._merge)
        odd = [u for u in new if u not in pieces]
        count = dict(zip(odd, self._whole(odd), strict=True))
        for u, ps in pieces.items():
            n = 0
            for p in ps:
                n += 1 if p in proven else self.merged[p]
            count[u] = n
        return [count[u] for u in new]

    def __call__(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for first, part in text_slices(texts):
            offsets, codes, units = split_units(part)
            self.units.fill(units, self._count_units)
            each = np.fromiter((self.units[u] for u in units), np.int64, len(units))
            out[first : first + len(part)] = np.add.reduceat(each[codes], offsets[:-1])
        return out


@lru_cache(maxsize=2)
def token_counter(path: str, proven: frozenset[str]) -> Counter:
    """The counter of this process: a reused worker keeps its vocabulary and its cache."""
    return Counter(path, proven)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``docs`` with n_tokens and over_limit, as the tokenizers library counts whole texts
    (no special tokens added; special strings inside a text are its default).

    Defined cases: null and empty texts have 0 tokens; repeated rows count alike; an empty
    table gives no rows; columns of these names are replaced.
    """
    path = path or vocabulary()
    proven = proven_tokens(path)

    def run(series):
        counter = token_counter(path, proven)
        for texts in series:
            yield pa.array(counter(texts), pa.int64())

    counted = F.arrow_udf(run, "long", F.ArrowUDFType.SCALAR_ITER)
    rows = docs.drop("n_tokens", "over_limit").withColumn("n_tokens", counted(F.col("text")))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)


def op3_token_counts(spark, sf_dir):
    """Query: token counts of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", text_bytes(F.col("text")).alias("n_bytes"), "n_tokens", "over_limit")
