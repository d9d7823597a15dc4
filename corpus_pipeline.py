"""A corpus pipeline of five training-data operators: each stage works on what the one before kept.

Stages take (spark, docs, sf_dir) and return a DataFrame that is written as Parquet and read again. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapquarry.llm import common, op2_mixing, op5_decontaminate, op6_sharding, op9_toxicity, op10_minhash


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold, with their columns.

    A null text is empty and stays unless all labels are toxic; a null doc_id has no label and is scored like any other; rows
    that repeat are scored alike and stay or go together; no rows give no rows.
    """
    model = op9_toxicity.fit(docs.select("doc_id", "text"), common.table(spark, sf_dir, "labels"))
    return op9_toxicity.filtered(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: word shingles of five, similarity 0.8.

    The one with the least doc_id stays, nulls first. Unlike texts of one doc_id are judged each for itself; of equal rows one
    stays. Texts without words (null, empty, blank) are no copies and all stay; no rows give no rows.
    """
    return op10_minhash.deduplicated(docs, shingle=5, percent=80, halves=12)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark question.

    A null text has no words and stays; null ids stay null; rows that repeat are judged alike; no rows give no rows.
    """
    return op5_decontaminate.cleaned(docs, common.table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources weigh alike, in a global random order.

    A null source is a source; a null text has no bytes; null ids draw alike, as do rows that repeat an id. Columns named
    copy or shuffle_key are lost, since the operator replaces them; no rows give no rows.
    """
    return op2_mixing.mix_sources(docs).select(*[c for c in docs.columns if c not in ("copy", "shuffle_key")])


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shard that each belongs to: shard, depth, part, n_bytes.

    A null text has no bytes; null ids share a hash and are parted by running bytes; no rows give no rows.
    """
    return op6_sharding.shard(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]
#: SQL can express neither the classifier nor the fuzzy grouping; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
