"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellstat.session import scratch_path

#: Code points that separate words; everything else belongs to a word.
SPACES = " \t\n\x0b\x0c\r"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, which is evaluated once however often the body names it.

    A plain column would be repeated inside the body when Spark merges projections, and inside a
    lambda it would even run once per element.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text as an array, empty for null and for white space only."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return let(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_PATTERN)))


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder and read back, which also cuts the lineage."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_value(*modules: str) -> None:
    """Ship functions of these modules inside the task, so executors need no installed copy."""
    for name in modules:
        cloudpickle.register_pickle_by_value(sys.modules[name])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def packed(docs: DataFrame, **taken: Column) -> DataFrame:
    """The columns ``taken`` beside ``row``, which holds all of ``docs`` under names of its own.

    What an operator adds can then clash with no input column, whatever that is called.
    """
    fields = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)]
    return docs.select(F.struct(F.lit(True).alias("_"), *fields).alias("row"), *[value.alias(name) for name, value in taken.items()])


def unpacked(columns: list[str], **replaced: Column) -> list[Column]:
    """The columns that went into ``row``, for a select; those in ``replaced`` get a new value."""
    return [replaced.get(c, F.col(f"row._{i}")).alias(c) for i, c in enumerate(columns)]


def joined_on(left: DataFrame, right: DataFrame, keys: Iterable[str], how: str) -> DataFrame:
    """Equi-join in which null keys match each other; the right side's keys are dropped."""
    keys = list(keys)
    renamed = right.select(*[F.col(f"`{k}`").alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = None
    for k in keys:
        same = left[k].eqNullSafe(renamed[f"__r_{k}"])
        condition = same if condition is None else condition & same
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])
