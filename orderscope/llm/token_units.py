"""Texts as units that a tokenizer treats independently, each unit tokenized once.

Tokenizing word by word in Python costs more than the text is worth; a batch of texts is
split by Arrow, its distinct units are looked up in a bounded cache, and only units never
seen go to the tokenizer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

SLICE_BYTES = 8 << 20  # texts handled at once; a longer text is handled alone
CACHE_UNITS = 200_000  # in each of a cache's two generations

# Units of characters whose case, class and normal form the library and Python agree on.
PLAIN = regex.compile("[\\t\\n\\r -~\\xa1-\\u012f\\u0131-\\u017f]+")


def _byte_letters() -> dict[int, int]:
    """The letter of each byte in a byte-level vocabulary: printable Latin-1 stands for
    itself, the other bytes in order for the letters from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in own)
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


def byte_letters(text: str) -> str:
    """The text as a byte-level model reads it."""
    return text.encode().decode("latin-1").translate(_LETTERS)


class Cache(dict):
    """Results by unit, bounded: when full, what was not asked for since the last time goes."""

    def __init__(self):
        super().__init__()
        self.old: dict = {}

    def fill(self, units, compute) -> None:
        """Hold a result for each unit; ``compute`` gets those never seen, in a list."""
        if len(self) > CACHE_UNITS:
            self.old = dict(self)
            self.clear()
        missing, old = [], self.old
        for u in units:
            if u not in self:
                held = old.get(u)
                if held is None:
                    missing.append(u)
                else:
                    self[u] = held
        if missing:
            self.update(zip(missing, compute(missing), strict=True))


def text_slices(texts: pa.Array):
    """(first, array) slices of about SLICE_BYTES; null is the empty text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    first = total = 0
    for i, n in enumerate(size):
        if total and total + n > SLICE_BYTES:
            yield first, texts.slice(first, i - first)
            first, total = i, 0
        total += int(n)
    if first < len(texts):
        yield first, texts.slice(first)


def split_units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(offsets, codes, distinct units) of texts cut at every U+0020."""
    parts = pc.split_pattern(texts, " ")
    offsets = parts.offsets.to_numpy()
    coded = pc.dictionary_encode(parts.flatten())
    return offsets - offsets[0], coded.indices.to_numpy(), coded.dictionary.to_pylist()
