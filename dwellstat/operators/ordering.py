"""Order-dependent operators that never put a whole group into one task.

A window over a group that holds a third of all rows is one task. The operators here cut each
group's order into buckets, add up the buckets (map-side combined), and only number or sum rows
inside a bucket. The bucket is any expression that does not decrease along the order: leading hex
digits for a seeded order, approximate quantiles for a value order, sampled cuts for a text order.
Approximate cuts only decide how even the buckets are, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellstat.functions import seeded
from dwellstat.session import staged

# row_number limits up to this size are pruned before the shuffle by the optimizer
GROUP_LIMIT = 1000
# cuts compared one by one in a row; more cuts are searched in blocks of this size
CUT_BLOCK = 32


def order_splits(df: DataFrame) -> int:
    """Buckets to cut an order into: as many as the session uses shuffle partitions, 8 at least."""
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def digest_digits(df: DataFrame) -> int:
    """Hex digits that give several times as many buckets as there are shuffle partitions."""
    return max(3, math.ceil(math.log(4 * order_splits(df), 16)))


def value_bucket(df: DataFrame, value: str, splits: int | None = None) -> DataFrame:
    """Adds ``_bucket``: the number of approximate quantile cuts below the value."""
    splits = splits or order_splits(df)
    cuts = df.agg(
        F.percentile_approx(value, F.array(*[F.lit(i / splits) for i in range(1, splits)]), max(2000, 4 * splits))
    ).scalar()
    return with_cuts_below(df, "_bucket", cuts, splits - 1, value)


def text_bucket(df: DataFrame, value: str, splits: int | None = None, per_split: int = 32) -> DataFrame:
    """Adds ``_bucket`` for text: cuts come from a fixed-size sample of the smallest digests."""
    splits = splits or order_splits(df)
    sample = df.select(value).orderBy(F.md5(F.col(value)), value).limit(splits * per_split)
    cuts = sample.agg(
        F.filter(F.array_sort(F.collect_set(value)), lambda v, i: i % per_split == per_split - 1)
    ).scalar()
    return with_cuts_below(df, "_bucket", cuts, splits, value)


def with_cuts_below(df: DataFrame, name: str, cuts: Column, most: int, value: str) -> DataFrame:
    """Adds how many of the sorted cuts (``most`` at the utmost) are below the value.

    A balanced CASE finds the block of cuts, a scan of that one block the place in it. A cut past
    the end of the array reads as null and counts as not below. The cuts are a column of their own
    first, so that the subquery behind them is planned and run once.
    """
    block = 1 if most <= CUT_BLOCK else CUT_BLOCK

    def search(lo: int, hi: int) -> Column:
        """Blocks whose last cut is below the value."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.get("_cuts", mid * block + block - 1) < F.col(value), search(mid + 1, hi)).otherwise(search(lo, mid))

    staged = df.withColumn("_cuts", cuts).withColumn(name, search(0, most // block) * block)
    if block > 1:
        rest = F.filter(F.slice("_cuts", F.col(name) + 1, F.lit(block)), lambda c: c < F.col(value))
        staged = staged.withColumn(name, F.col(name) + F.coalesce(F.size(rest), F.lit(0)))
    return staged.drop("_cuts")


def digest_bucket(df: DataFrame, key: str) -> DataFrame:
    """Adds ``_bucket`` from a seeded order key."""
    return df.withColumn("_bucket", seeded.hex_bucket(F.col(key), digest_digits(df)))


def one_bucket(df: DataFrame) -> DataFrame:
    """For orders with a small, fixed number of rows per group."""
    return df.withColumn("_bucket", F.lit(0))


def running_totals(
    bucketed: DataFrame,
    order: Sequence[str],
    amounts: dict[str, str],
    groups: Sequence[str] = (),
    group_totals: bool = False,
) -> DataFrame:
    """Adds inclusive running sums along ``order`` within ``groups``; drops ``_bucket``.

    ``amounts`` maps output names to the summed columns. With ``group_totals`` the sum over the
    whole group is added as ``<name>_all``. Order columns must make the order total. Rows whose
    group is null form a group like any other.
    """
    groups = list(groups)
    sums = bucketed.groupBy(*groups, "_bucket").agg(*[F.sum(c).alias(n) for n, c in amounts.items()])
    earlier = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    extra = [F.sum(n).over(whole).alias(f"{n}_all") for n in amounts] if group_totals else []
    offsets = sums.select(
        *groups, "_bucket", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before_{n}") for n in amounts], *extra
    )
    inside = Window.partitionBy(*groups, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = bucketed.withColumns({f"_in_{n}": F.sum(c).over(inside) for n, c in amounts.items()})
    keys = [*groups, "_bucket"]
    right = offsets.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *[c for c in offsets.columns if c not in keys])
    joined = summed.join(right, _null_safe(summed, right, keys)).drop(*[f"_of_{k}" for k in keys])
    out = joined.withColumns({n: F.col(f"_in_{n}") + F.col(f"_before_{n}") for n in amounts})
    return out.drop("_bucket", *[f"_in_{n}" for n in amounts], *[f"_before_{n}" for n in amounts])


def row_numbers(bucketed: DataFrame, order: Sequence[str], groups: Sequence[str] = (), name: str = "row_number") -> DataFrame:
    """Exact row numbers from 1 along ``order`` within ``groups``."""
    counted = bucketed.withColumn("_one", F.lit(1).cast("bigint"))
    return running_totals(counted, order, {name: "_one"}, groups).drop("_one")


def seeded_row_numbers(df: DataFrame, seed, keys: Sequence[str], groups: Sequence[str] = (), name: str = "row_number") -> DataFrame:
    """Row numbers in a reproducible shuffle of the key columns."""
    keyed = df.withColumn("_key", seeded.order_key(seed, *keys))
    return row_numbers(digest_bucket(keyed, "_key"), ["_key", *keys], groups, name).drop("_key")


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows of each group with their ``rank``.

    Up to ``GROUP_LIMIT`` rows, the surplus is dropped before the shuffle; beyond it a group is
    sorted in one task, with spilling, so callers with a seeded or single-column order use
    ``seeded_top`` or ``row_numbers``.
    """
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    return ranked.filter(F.col("rank") <= n)


def seeded_top(df: DataFrame, seed, keys: Sequence[str], groups: Sequence[str], n: int) -> DataFrame:
    """First ``n`` rows of each group in a seeded order, with ``rank``.

    Small ``n`` are cut before the shuffle, large ones numbered in buckets; the rows are the same.
    """
    if n > GROUP_LIMIT:
        return seeded_row_numbers(df, seed, keys, groups, "rank").filter(F.col("rank") <= n)
    keyed = df.withColumn("_key", seeded.order_key(seed, *keys))
    return top_per_group(keyed, groups, [F.col("_key"), *[F.col(k) for k in keys]], n).drop("_key")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the stated order."""
    return top_per_group(df, keys, order, 1).drop("rank")


def average_ranks(counts: DataFrame, value: str, n: str, groups: Sequence[str] = (), few_values: bool = False) -> DataFrame:
    """Average-tie rank of each distinct value, as distance from the group's mean rank.

    ``counts`` holds group, value and the number of rows ``n``. Ties share one row, so a value
    that fills a third of the table costs nothing extra.
    """
    per_value = counts.groupBy(*groups, value).agg(F.sum(n).alias("_n"))
    bucketed = one_bucket(per_value) if few_values else value_bucket(per_value, value)
    summed = running_totals(bucketed, [value], {"_upto": "_n"}, groups, group_totals=True)
    rank = F.col("_upto") - (F.col("_n") - 1) / 2.0
    return summed.select(*groups, value, (rank - (F.col("_upto_all") + 1) / 2.0).alias("centred_rank"))


def spearman(pairs: DataFrame, x: str, y: str, groups: Sequence[str] = (), few_values: bool = False) -> DataFrame:
    """Rank correlation per group with its row count; null where either side does not vary.

    Works on counts of distinct (x, y) pairs, and on rank distances from the known mean rank, so
    neither side is ever sorted within one task.
    """
    groups = list(groups)
    # read for the cuts, the sums and the rows of both sides
    cells = staged(
        pairs.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*groups, x, y)
        .agg(F.count(F.lit(1)).alias("_cells")), "score-cells"
    )
    rx = average_ranks(cells, x, "_cells", groups, few_values).withColumnRenamed("centred_rank", "_rx")
    ry = average_ranks(cells, y, "_cells", groups, few_values).withColumnRenamed("centred_rank", "_ry")
    ranked = cells.join(rx, [*groups, x]).join(ry, [*groups, y])
    w = F.col("_cells")
    sums = ranked.groupBy(*groups).agg(
        F.sum(w).alias("n"),
        F.sum(w * F.col("_rx") * F.col("_ry")).alias("_xy"),
        F.sum(w * F.col("_rx") * F.col("_rx")).alias("_xx"),
        F.sum(w * F.col("_ry") * F.col("_ry")).alias("_yy"),
    )
    rho = F.try_divide(F.col("_xy"), F.sqrt(F.col("_xx") * F.col("_yy")))
    return sums.select(*groups, "n", rho.alias("rho"))


def _coarse(x: Column) -> Column:
    """A whole number that does not decrease with x and grows by one in every three hundredths of its size."""
    size = F.floor(32 * F.least(F.ln(F.abs(x)), F.lit(800.0))) + 100_000
    return F.when(F.isnan(x), 1_000_000).when(x == 0, 0).when(x < 0, -size).otherwise(size).cast("bigint")


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Equality of ``keys`` with the columns ``_of_<key>`` on the right, nulls being equal."""
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(right[f"_of_{k}"])
    return same


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """Exact linearly interpolated quantiles per group: columns groups, ``prob``, ``quantile``.

    Spark's ``percentile`` gathers every distinct value of a group in one task. Here rows are counted
    per coarse step of the value first, which tasks add up before the shuffle; then only the rows of
    the steps that hold a wanted position are counted by value and cumulated in buckets.
    """
    groups = list(groups)
    rows = df.filter(F.col(value).isNotNull()).withColumn("_step", _coarse(F.col(value).cast("double")))
    steps = rows.groupBy(*groups, "_step").agg(F.count(F.lit(1)).alias("_n"))
    of_group = Window.partitionBy(*groups)
    upto = F.sum("_n").over(of_group.orderBy("_step").rowsBetween(Window.unboundedPreceding, 0))
    ranged = steps.withColumns({"_first": upto - F.col("_n"), "_last": F.sum("_n").over(of_group) - 1})
    wanted = F.array(
        *[
            F.struct(F.lit(float(p)).alias("prob"), side.cast("bigint").alias("pos"), (F.lit(float(p)) * F.col("_last")).alias("at"))
            for p in probs
            for side in (F.floor(F.lit(float(p)) * F.col("_last")), F.ceil(F.lit(float(p)) * F.col("_last")))
        ]
    )
    inside = F.filter(wanted, lambda w: (w["pos"] >= F.col("_first")) & (w["pos"] < F.col("_first") + F.col("_n")))
    # written, so that their small size is known when the rows are joined
    held = staged(ranged.withColumn("_wanted", inside).filter(F.size("_wanted") > 0).select(*groups, "_step", "_first", "_wanted"), "quantile-steps")
    keys = [*groups, "_step"]
    right = held.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_first")
    picked = rows.join(right, _null_safe(rows, right, keys)).drop(*[f"_of_{k}" for k in keys])
    counts = staged(picked.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")), "quantile-values")
    summed = running_totals(value_bucket(counts, value), [value], {"_in_step": "_n"}, keys)
    right = held.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_first", "_wanted")
    placed = summed.join(right, _null_safe(summed, right, keys))
    end = F.col("_first") + F.col("_in_step")
    hits = placed.select(*groups, value, F.explode(F.filter("_wanted", lambda w: (w["pos"] >= end - F.col("_n")) & (w["pos"] < end))).alias("w"))
    ends = hits.groupBy(*groups, F.col("w.prob").alias("prob"), F.col("w.at").alias("_at")).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi")
    )
    share = F.col("_at") - F.floor("_at")
    return ends.select(*groups, "prob", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * share).alias("quantile"))


def medians(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Exact median per group as column ``median``."""
    return exact_quantiles(df, value, [0.5], groups).select(*groups, F.col("quantile").alias("median"))
