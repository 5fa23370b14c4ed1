"""Joins: lookups onto unique dimensions, semi and anti joins, task grids, run comparisons."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellstat.operators import ordering
from dwellstat.session import staged


def require_unique(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """Fails the job when a key repeats, so that a lookup can never multiply rows.

    The check is part of the plan (an aggregate on the key the join shuffles by anyway).
    """
    held = F.struct(*[c for c in df.columns if c not in keys])
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(held).alias("_row"))
    checked = counted.withColumn(
        "_row", F.when(F.col("_n") > 1, F.raise_error(F.lit(f"{what}: key repeats"))).otherwise(F.col("_row"))
    )
    return checked.select(*keys, "_row.*")


def lookup(facts: DataFrame, dimension: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join onto a dimension that is unique per key.

    The dimension side has a row per key, so a frequent or null key only makes the left side
    uneven, which adaptive execution splits at run time. Only columns that are used later are read
    from either side.
    """
    return facts.join(dimension, list(keys), "left")


def keep_matching(df: DataFrame, allowed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(allowed.select(*keys), list(keys), "left_semi")


def exclude(df: DataFrame, seen: DataFrame, *key_sets: Sequence[str]) -> DataFrame:
    """Drops rows that match ``seen`` on any of the key sets (each set is one anti join)."""
    for keys in key_sets:
        df = df.join(seen.select(*keys).filter(" and ".join(f"`{k}` is not null" for k in keys)), list(keys), "left_anti")
    return df


def task_grid(items: DataFrame, models: Sequence[str], replicates: int) -> DataFrame:
    """Every item with every model and replicate number: a row-local explode, no join."""
    return items.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models]))).withColumn(
        "replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))
    )


def pending(tasks: DataFrame, done: DataFrame, keys: Sequence[str], error: str | None = None) -> DataFrame:
    """Tasks not yet done; with an error column, failed tasks count as not done."""
    if error is not None:
        done = done.filter(F.length(F.coalesce(F.col(error), F.lit(""))) == 0)
    return exclude(tasks, done, keys)


def usable_rows(log: DataFrame, keys: Sequence[str], error: str, order: Sequence) -> DataFrame:
    """One row per key of an append log in which a failed key may have succeeded later."""
    failed = F.length(F.coalesce(F.col(error), F.lit(""))) > 0
    return ordering.keep_first(log, keys, [failed.cast("int"), *order])


def run_changes(before: DataFrame, after: DataFrame, key: str, score: str, room: str) -> DataFrame:
    """Items scored in both runs whose score changed."""
    a = before.filter(F.col(score).isNotNull()).select(key, F.col(score).alias("score_before"), F.col(room).alias("_ra"))
    b = after.filter(F.col(score).isNotNull()).select(key, F.col(score).alias("score_after"), F.col(room).alias("_rb"))
    joined = a.join(b, key).filter(F.col("score_before") != F.col("score_after"))
    return joined.select(
        key,
        F.coalesce("_ra", "_rb").alias(room),
        "score_before",
        "score_after",
        (F.col("score_after") - F.col("score_before")).alias("change"),
    )


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], time: str, since: str, first_before: bool = False) -> DataFrame:
    """Left join of each row with the newest ``right`` row of its key that begins at or before its time.

    ``right`` has the key columns, ``since`` and whatever is wanted; of rows with one key and
    beginning, the largest by the other columns counts. Rows without a key or time match nothing.
    With ``first_before``, times before a key's first beginning take that first row.

    A merge, not a join on ranges: distinct (key, time) points and beginnings are put in one order,
    cut into buckets of time, and the last beginning is carried within each bucket. What a bucket
    inherits comes from a table of one row per key and bucket. So neither a key nor a day with a
    third of all rows gets into one task: equal points are one row before the order is made, and the
    answers go back by an equi-join.
    """
    by = list(by)
    rest = [c for c in right.columns if c not in (*by, since)]
    value = F.struct(F.col(since).alias("_since"), *[F.col(c).alias(f"_v{i}") for i, c in enumerate(rest)])
    known = right.filter(F.col(since).isNotNull()).groupBy(*by, F.col(since).alias("_at")).agg(F.max(value).alias("_value"))
    known = staged(known.filter(_filled(by)), "as-of-known")
    points = left.filter(F.col(time).isNotNull() & _filled(by)).select(*by, F.col(time).alias("_at")).distinct()
    both = known.select(*by, "_at", "_value").unionByName(points.withColumn("_value", F.lit(None).cast(known.schema["_value"].dataType)).select(*by, "_at", "_value"))
    number = F.unix_timestamp("_at") if dict(both.dtypes)["_at"] in ("date", "timestamp") else F.col("_at")
    placed = staged(ordering.value_bucket(both.withColumn("_order", number), "_order"), "as-of-order")
    within = Window.partitionBy(*by, "_bucket").orderBy("_at", F.col("_value").isNull())
    carried = placed.withColumn("_found", F.last("_value", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    ends = placed.groupBy(*by, "_bucket").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_at"))).alias("_last"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    inherited = ends.select(*by, "_bucket", F.last("_last", ignorenulls=True).over(before).alias("_inherited"))
    answers = carried.filter(F.col("_value").isNull()).join(inherited, [*by, "_bucket"]).select(
        *by, F.col("_at").alias(time), F.coalesce("_found", "_inherited").alias("_value"))
    if first_before:
        first = known.groupBy(*by).agg(F.min_by("_value", "_at").alias("_first"))
        answers = answers.join(first, by, "left").select(*by, time, F.coalesce("_value", "_first").alias("_value"))
    answers = staged(answers.filter("_value is not null"), "as-of-answers")
    joined = left.join(answers, [*by, time], "left")
    return joined.select(*[F.col(c) for c in left.columns], F.col("_value._since").alias(since), *[F.col(f"_value._v{i}").alias(c) for i, c in enumerate(rest)])


def _filled(columns: Sequence[str]) -> Column:
    return functools.reduce(Column.__and__, [F.col(c).isNotNull() for c in columns], F.lit(True))
