"""Mixing sources to target weights by iterative proportional fitting (operator 6).

Token counts are summed for each cell (source, language, topic). Raking scales the cells
by one dimension after the other until the marginals are the targets; a document is then
kept with the probability that its cell's fitted share over its observed share asks for.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderscope.llm.common import free, save, table, unused

NONE = "(none)"  # the cell of rows without a value
SPACES = "\t\n\x0b\x0c\r"  # these and U+0020 part words
LEGAL = ("license", "licence", "copyright", "warranty")
BROADCAST_CELLS = 100_000
SALTS = 16  # parts of a cell's documents where cells are joined by shuffle
# Share of each dimension's values: tokens ** exponent, normalised. 1 keeps the corpus as it
# is, 0 makes all values equal.
EXPONENTS = {"source": 0.8, "lang": 0.9, "topic": 0.95}
RESIDUAL = 1e-10  # raking ends when no marginal is off by more, as a share of its target
MOST_SWEEPS = 100  # to targets that are given and must be met
TEMPERED_SWEEPS = 12  # at most to tempered targets: in a tiny corpus those may contradict one another


def _without(text: Column, parts) -> Column:
    return reduce(lambda t, part: F.replace(t, F.lit(part), F.lit("")), parts, text)


def token_count(text: Column) -> Column:
    """Words between spaces, by plain replacements: runs of spaces become one space, and there is
    a word more than there are spaces between words."""
    # U+0001 marks the spaces to squeeze; as a character of the text it is part of a word
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("\x01"), F.lit("x"))
    spaced = F.trim(reduce(lambda t, space: F.replace(t, F.lit(space), F.lit(" ")), SPACES, plain))
    squeezed = F.replace(F.replace(F.replace(spaced, F.lit(" "), F.lit(" \x01")), F.lit("\x01 "), F.lit("")), F.lit("\x01"), F.lit(""))
    spaces = F.octet_length(squeezed) - F.octet_length(F.replace(squeezed, F.lit(" "), F.lit("")))
    return F.when(squeezed == "", 0).otherwise(spaces + 1).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """A plain topic for corpora that carry none: legal, data, note, article or essay."""
    low = F.lower(F.coalesce(text, F.lit("")))
    digits = F.octet_length(low) - F.octet_length(_without(low, "0123456789"))
    return (
        F.when(reduce(lambda a, b: a | b, [low.contains(w) for w in LEGAL]), "legal")
        .when(digits * 20 > F.length(low), "data")
        .when(tokens < 100, "note")
        .when(tokens < 500, "article")
        .otherwise("essay")
    )


def unit_draw(doc_id: Column) -> Column:
    """A number in [0, 1) from the id alone: the first 52 bits of its md5."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rake(cells: DataFrame, targets: dict[str, DataFrame], weight: str, residual: float, most_sweeps: int) -> tuple[DataFrame, float]:
    """``cells`` with ``weight`` scaled to the target shares (column ``target``) of each
    dimension in turn, until no marginal is off by more than ``residual`` or ``most_sweeps``
    are over; and by how much a marginal was off at most before the last sweep. Targets may
    contradict the cells: a value's only cell may be another's only one.

    Each step is a partial sum over the cells and a join, and is written out: plans stay as
    short as one step, however many there are.
    """
    columns = cells.columns
    for i, (name, target) in enumerate(targets.items()):
        cells = cells.join(target.withColumnRenamed("target", f"_target{i}"), name)
    cells = save(cells.withColumn("_off", F.lit(0.0)), "raked")
    off = 0.0
    for _ in range(most_sweeps):
        for i, name in enumerate(targets):
            before, total = cells, cells.groupBy(name).agg(F.sum(weight).alias("_sum"))
            factor = F.coalesce(F.try_divide(f"_target{i}", "_sum"), F.lit(0.0))
            off_here = F.abs(factor - 1)
            cells = before.join(total, name).withColumns(
                {weight: F.col(weight) * factor, "_off": F.greatest("_off", off_here) if i else off_here}
            )
            cells = save(cells.drop("_sum"), "raked")
            free(before)
        off = cells.agg(F.max("_off")).first()[0] or 0.0
        if off <= residual:
            break
    return cells.select(columns), off


def tempered(cells: DataFrame, name: str, exponent: float) -> DataFrame:
    """(value, target): shares in proportion to tokens ** exponent."""
    sums = save(cells.groupBy(name).agg(F.pow(F.sum("tokens").cast("double"), F.lit(exponent)).alias("_t")), "sums")
    return save(sums.select(name, (F.col("_t") / sums.select(F.sum("_t")).scalar()).alias("target")), "targets")


def checked_targets(shares: dict[str, float]) -> dict[str, float]:
    """Shares that add up to 1. Raises ValueError for negative, non-finite or all-zero ones."""
    shares = {str(k): float(v) for k, v in shares.items()}
    if not all(math.isfinite(v) and v >= 0 for v in shares.values()) or not sum(shares.values()) > 0:
        raise ValueError(f"target shares must be finite, not negative, and not all zero: {shares}")
    whole = math.fsum(shares.values())
    return {k: v / whole for k, v in shares.items()}


def mix_documents(
    docs: DataFrame,
    dimensions: dict[str, Column],
    tokens: Column,
    exponents: dict[str, float] | None = None,
    targets: dict[str, dict[str, float]] | None = None,
    keep: list[str] | None = None,
    residual: float = RESIDUAL,
) -> DataFrame:
    """``docs`` with mix_tokens, one mix_<dimension> column each, mix_probability and mix_kept.

    Targets are shares by value (``targets[dimension]``), or tempered from the corpus by
    ``exponents``. Sampling keeps as much as it can without repeating a document: the cell
    most in demand has probability 1, so the expected marginals are the targets. The draw
    depends on doc_id alone, so it is repeatable and equal for repeated rows. ``keep`` names
    the columns of ``docs`` to return, by default all. Texts are parsed once: what is counted
    and what is returned are the same written rows.

    Defined cases: a null dimension value is the value "(none)"; texts without tokens add
    nothing to the marginals, and a cell of only such texts is kept whole; a value without
    a target share, or with one of 0, keeps none of its rows; a value with a share but no
    tokens raises ValueError, as do shares that are negative, not finite or all zero, or that
    cannot all be met; tempered targets that contradict one another, as in a handful of rows,
    are met as nearly as TEMPERED_SWEEPS get; an empty table gives no rows; columns of these names are replaced.
    """
    spark = docs.sparkSession
    names = {k: f"mix_{k}" for k in dimensions}
    added = {v: F.coalesce(dimensions[k].cast("string"), F.lit(NONE)) for k, v in names.items()}
    dims = list(names.values())
    held = docs.drop("mix_tokens", "mix_probability", "mix_kept", *dims)
    mix_id = unused(held, "mix_id")
    wanted = [c for c in (keep or held.columns) if c in held.columns]
    counted = docs.withColumn("mix_tokens", tokens).withColumns(added)
    rows = save(counted.select(*wanted, F.col("doc_id").alias(mix_id), "mix_tokens", *dims), "counted")
    cells = save(rows.where("mix_tokens > 0").groupBy(*dims).agg(F.sum("mix_tokens").alias("tokens")), "cells")
    goal, seen = {}, cells
    for k, column in names.items():
        if targets and k in targets:
            pairs = list(checked_targets(targets[k]).items())
            goal[column] = spark.createDataFrame(pairs, f"{column} string, target double")
            missing = goal[column].where("target > 0").join(cells.select(column).distinct(), column, "left_anti")
            if not cells.isEmpty() and not missing.isEmpty():
                raise ValueError(f"no tokens for a target of {k}: {missing.first()[0]}")
            seen = seen.join(goal[column].where("target > 0").select(column), column, "left_semi")
        else:
            goal[column] = tempered(cells, column, (exponents or EXPONENTS)[k])
    share = F.col("tokens").cast("double") / cells.select(F.sum("tokens")).scalar()
    start = save(seen.select(*dims, share.alias("_seen"), share.alias("_w")), "cells")
    fitted, off = rake(start, goal, "_w", residual, MOST_SWEEPS if targets else TEMPERED_SWEEPS)
    if targets and off > residual:
        raise ValueError(f"raking does not converge: a marginal is off by {off:.2g} of its target")
    fitted = save(fitted.withColumn("_ratio", F.col("_w") / F.col("_seen")), "fitted")
    top = fitted.select(F.max("_ratio")).scalar()
    chance = unused(rows, "mix_chance")
    known = cells.select(*dims).join(fitted, dims, "left")  # a value without a target has no chance
    ratio = F.when(F.col("_ratio").isNull(), 0.0).otherwise(F.round(F.least(F.lit(1.0), F.col("_ratio") / top), 9))
    known = known.select(*dims, ratio.alias(chance))
    known = save(known, "chances")
    if known.count() <= BROADCAST_CELLS:
        rows = rows.join(F.broadcast(known), dims, "left")
    else:  # by shuffle, with the documents of a cell dealt out
        salt = unused(rows, "mix_salt")
        known = known.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = rows.withColumn(salt, F.pmod(F.xxhash64(mix_id), F.lit(SALTS)).cast("int"))
        rows = dealt.join(known, [*dims, salt], "left").drop(salt)
    return (
        rows.withColumn("mix_probability", F.coalesce(chance, F.lit(1.0)))
        .withColumn("mix_kept", unit_draw(F.col(mix_id)) < F.col("mix_probability"))
        .drop(chance, mix_id)
    )


def mix_corpus(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """mix_documents() over source, language and topic with the production exponents."""
    dims = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(F.col("text"), F.col("mix_tokens"))}
    return mix_documents(docs, dims, token_count(F.col("text")), keep=keep)


def sample_mix(docs: DataFrame) -> DataFrame:
    """The documents that the mix keeps, columns as they are. A column of ``docs`` named as one
    that mix_documents() adds is kept too. Defined cases as there."""
    clash = {c: unused(docs, f"kept_{c}") for c in docs.columns if c.startswith("mix_")}
    mixed = mix_corpus(docs.withColumnsRenamed(clash)).where("mix_kept")
    return mixed.select(*[F.col(clash.get(c, c)).alias(c) for c in docs.columns])


def op6_raking(spark, sf_dir):
    """Query: every document with its cell, its probability and whether it is kept."""
    return mix_corpus(table(spark, sf_dir, "documents"), ["doc_id"]).select(
        "doc_id",
        F.col("mix_source").alias("source"),
        F.col("mix_lang").alias("lang"),
        F.col("mix_topic").alias("topic"),
        F.col("mix_tokens").alias("n_tokens"),
        F.round("mix_probability", 6).alias("probability"),
        F.col("mix_kept").alias("kept"),
    )


def oracle(docs: str = "documents") -> str:
    """DuckDB SQL of op6_raking; the sweeps are written out one after the other."""
    out = [
        f"""WITH raw AS (
  SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, coalesce(text, '') AS text,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM {docs}),
d AS (
  SELECT doc_id, source, lang, n_tokens, CASE
    WHEN regexp_matches(lower(text), '{'|'.join(LEGAL)}') THEN 'legal'
    WHEN length(regexp_replace(lower(text), '[^0-9]', '', 'g')) * 20 > length(lower(text)) THEN 'data'
    WHEN n_tokens < 100 THEN 'note' WHEN n_tokens < 500 THEN 'article' ELSE 'essay' END AS topic FROM raw),
c AS (SELECT source, lang, topic, sum(n_tokens) AS tokens FROM d WHERE n_tokens > 0 GROUP BY ALL),
k AS MATERIALIZED (SELECT source, lang, topic, tokens * 1.0::DOUBLE / sum(tokens) OVER () AS seen, seen AS w0 FROM c)"""
    ]
    for name, e in EXPONENTS.items():
        out.append(
            f"t_{name} AS (SELECT {name}, pow(sum(tokens)::DOUBLE, {e}) AS x, x / sum(x) OVER () AS target FROM c GROUP BY {name})"
        )
    last, n = "k", 0
    for _ in range(TEMPERED_SWEEPS):
        for name in EXPONENTS:
            n += 1
            out.append(
                f"k{n} AS MATERIALIZED (SELECT source, lang, topic, seen, w{n - 1} * target / sum(w{n - 1}) OVER "
                f"(PARTITION BY {name}) AS w{n} FROM {last} JOIN t_{name} USING ({name}))"
            )
            last = f"k{n}"
    out.append(
        f"""p AS (
  SELECT source, lang, topic, round(least(1.0, w{n} / seen / (SELECT max(w{n} / seen) FROM {last})), 9) AS chance FROM {last})"""
    )
    return (
        ",\n".join(out)
        + """
SELECT doc_id, d.source, d.lang, d.topic, n_tokens, round(coalesce(chance, 1.0), 6) AS probability,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0 < coalesce(chance, 1.0) AS kept
FROM d LEFT JOIN p USING (source, lang, topic)"""
    )
