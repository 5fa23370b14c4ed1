"""Stages that spread rows over tasks and evaluate once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly to three tasks a core, for costly work on each.

    A file is read in as many tasks as it has row groups, often a single one, however many rows that
    holds. Deal narrow rows, before the work makes them wide.
    """
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed exactly once per row.

    The optimizer merges neighbouring projections and copies filter conditions downwards, which
    repeats costly expressions such as JSON parsing once per use. A one-row generator stops that
    and stays narrow. Existing columns of the same name are replaced.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    made = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*rest, F.inline(F.array(made)))

