"""From raw documents to training shards: five stages, each written before the next reads it.

Toxic documents go; one document of each near-duplicate group stays; documents that share a
benchmark passage go; the rest is sampled to the target mix of sources, languages and topics
and put into shards of near equal bytes. Every stage works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orderscope.llm.common import save, ship_package, table
from orderscope.llm.decontamination import drop_contaminated
from orderscope.llm.mixing import sample_mix
from orderscope.llm.sharding import shard_documents
from orderscope.llm.shingle_join import keep_one_of_each
from orderscope.llm.toxicity import reject_toxic

SHARDS = 40


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the pattern grammar scores 0.5 or more.

    Defined cases: null, empty and blank texts stay; null ids are kept and not learnt from;
    repeated rows go or stay together; without labels the seed lists decide; an empty table
    gives no rows; columns are kept as they are, whatever their names.
    """
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group under five-word shingles and a similarity of 0.8 or more: the
    one with the smallest id.

    Defined cases: texts without words stay, all of them; repeated rows leave one; a null id
    yields to any other; an empty table gives no rows; columns are kept as they are.
    """
    ship_package(spark)
    return keep_one_of_each(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that share ten consecutive words, or a whole shorter item, with a
    benchmark item.

    Defined cases: null and empty texts stay; repeated rows go or stay together; null items
    hit nothing; an empty table or benchmark changes nothing; columns are kept as they are.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in the target mix of sources, languages and topics.

    Defined cases: a null source or language is a value of its own; texts without words do not
    count for the mix, and stay where their cell has no others; repeated rows are drawn
    together; an empty table gives no rows; columns are kept as they are.
    """
    return sample_mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, with its shard and its place there.

    Defined cases: a null text counts as empty; equal texts share a shard unless they are over a
    quarter of one; repeated rows have a slot each; fewer rows than shards leave shards empty;
    an empty table gives no rows; columns named shard or slot are replaced.
    """
    return shard_documents(docs, SHARDS)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

ORACLE_SQL = None  # a trained score and a similarity join are not SQL: see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on all that the one before it kept; written between.

    Defined cases: those of the stages; an empty table runs through all of them.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
