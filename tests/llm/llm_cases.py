"""Rows and folders shared by the tests of this folder."""

from __future__ import annotations

SF_SMALL = "/root/testdata/sf0.001"

# A document table with every awkward row: nulls, empty and blank texts, a very long text,
# repeated rows, and columns whose names clash with those the operators add.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "shard string, slot string, n_tokens string, size string, toxicity string, _p string, id string, w string, site string, lines string"
)


def rows(*pairs):
    return [(i, t, "en", "src", None, *["x"] * 10) for i, t in pairs]


LONG = " ".join(f"w{i % 9973} of" for i in range(60_000))
AWKWARD = rows(
    (1, None),
    (2, ""),
    (3, "  \n\t "),
    (4, "one"),
    (5, "the quick brown fox jumps over the lazy dog again and again today"),
    (5, "the quick brown fox jumps over the lazy dog again and again today"),
    (6, "the quick brown fox jumps over the lazy dog again and again today"),
    (7, LONG),
    (8, LONG + " end"),
    (None, "no id here"),
    (9, "Ünïcode テスト 😀 text"),
) + [(10, "no lang or source", None, None, None, *["x"] * 10)]
