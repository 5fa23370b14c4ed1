"""The corpus pipeline: a chain of stages over ``documents``, each written before the next reads it.

1. ``toxicity`` drops documents that the last model of the classifier chain rejects.
2. ``line_dedup`` removes passages of several lines that occurred earlier in the corpus; a document
   of which nothing but white space is left by this goes, as it holds only repeats.
3. ``near_dedup`` keeps one document of each class of near copies.
4. ``decontamination`` drops documents into which a benchmark item leaks.
5. ``mixing`` draws the sources to their target weights: a row per copy taken, with its shard.

Each function takes (spark, docs, sf_dir); all but the last return the columns of ``documents``.
Rows with null text pass the stages that have nothing to judge and are not drawn by the last one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellstat.llm import decontamination, line_dedup, mixing, near_dedup, toxicity
from dwellstat.llm.common import SPACES, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.filtered(docs, table(spark, sf_dir, "labels"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    before = "was_blank"
    while before in {c.lower() for c in docs.columns}:
        before += "_"
    out = line_dedup.without_passages(docs.withColumn(before, _blank("text")))
    return out.where(F.col(before) | ~_blank("text")).drop(before)


def _blank(column: str):
    """Whether nothing but white space is there; a null counts as blank."""
    return F.trim(F.coalesce(F.col(column), F.lit("")), F.lit(SPACES)) == ""


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.cleaned(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_passages),
    ("near_dedup", keep_one_of_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: A trained classifier decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each one's rows are written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
