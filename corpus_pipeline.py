"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next.

Quality rules and toxicity reject documents, the Jaccard join keeps one of each group of near copies, mixing repeats or
leaves out documents so that the sources' words stand as their weights, and packing lays all words into sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import mixing, neardup, packing, quality, toxicity
from marlstone.llm.words import free_prefix
from marlstone.plans.scratch import cut, free
from marlstone.sources.tables import table

# Every stage passes on whole rows, so the columns that its operator adds get a prefix that no column of ``docs`` has.


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the counts, or whose words lie mostly in boilerplate lines, go. The field learns from the labels' quality.

    Null and empty texts have no words and go; nulls elsewhere, ties and repeated rows make no difference to a row's verdict;
    very long texts are judged whole; an empty table stays empty; columns may have any names.
    """
    field = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    prefix = free_prefix("q_", docs.columns)
    return quality.judge(docs, field, prefix=prefix).filter(f"`{prefix}kept`").select(docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. The dictionaries learn from labelled documents that aren't held out.

    Null and empty texts score low and stay; a text's score hangs on nothing else, so repeated rows go or stay together; very
    long texts are scored whole; an empty table stays empty; columns may have any names.
    """
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    prefix = free_prefix("t_", docs.columns)
    return toxicity.score(docs, model, prefix=prefix).filter(f"`{prefix}predicted` = 0").select(docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share 0.8 of their five-word shingles, directly or through others, the least id stays.

    Null ids come last, then the least hash of the text decides; of repeated rows one stays. Texts without words (null, empty)
    are one group. Very long texts are compared whole. An empty table stays empty; columns may have any names.
    """
    return neardup.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times.

    A null source is a source of its own; texts without words are taken once; repeated rows count each; rows of one size are
    ordered by a hash of id and text; very long texts are counted whole; an empty table stays empty; columns may have any names.
    """
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies: sequence, its length, and the offset in it.

    Documents longer than a sequence are cut, none is dropped; one without words gives a line with nulls; copies of the mix
    are packed each; items of one length are ordered by a hash; null ids and sources stay null, null texts have no words; an empty table stays
    empty. Returns doc_id, source and these.
    """
    got = packing.pack(docs, keep=("doc_id", "source"))
    return got.select("doc_id", "source", *[F.col(f"p_{c}").alias(c) for c in ("piece", "start", "tokens", "bin", "capacity", "offset")])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: The trained field and dictionaries have no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, cut(stage(spark, docs, sf_dir), f"stage-{at}")
        free(before)
    return STAGES[-1][1](spark, docs, sf_dir)
