"""Reproducible sampling, quotas, chunk plans and folds.

Every shuffle is the order of ``md5(seed|key)``: the same for any partitioning, any retry and any
engine. Limits are exact; nothing is drawn at random at run time.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dwellstat import reference_values as rv
from dwellstat.functions import seeded
from dwellstat.operators import ordering
from dwellstat.session import staged


# --- quantile bins ---------------------------------------------------------------------------


def bin_edges(df: DataFrame, value: str, bins: int) -> DataFrame:
    """The bins + 1 exact quantile edges as rows (``prob``, ``quantile``)."""
    return ordering.exact_quantiles(df, value, [i / bins for i in range(bins + 1)])


def quantile_bins(df: DataFrame, value: str, bins: int, name: str = "bin") -> DataFrame:
    """Adds the 1-based quantile bin: right-closed, lowest value included, equal edges merged.

    Binning the logarithm is up to the caller (edges are interpolated on the scale passed in).
    """
    edges = bin_edges(df, value, bins).agg(F.array_sort(F.collect_set("quantile"))).scalar()
    counted = ordering.with_cuts_below(df, "_below", edges, bins + 1, value)
    # the lowest edge is below every value but the lowest, the highest is below none
    number = F.greatest("_below", F.lit(1)).cast("bigint")
    return counted.withColumn(name, F.when(F.col(value).isNotNull(), number)).drop("_below")


def bin_table(spark: SparkSession, bins: int, end_tenths: int, bin_column: str = "bin") -> DataFrame:
    """One row per bin with its ``weight`` in tenths: 10, or ``end_tenths`` for the two at either end."""
    number = F.col("id") + 1
    outer = F.least(number, bins + 1 - number) <= 2
    return spark.range(bins).select(number.alias(bin_column), F.when(outer, end_tenths).otherwise(10).cast("bigint").alias("weight"))


def bin_quotas(weights: DataFrame, per_bin: int) -> DataFrame:
    """Adds the ``quota`` of each bin: ``per_bin`` times its weight, rounded half up."""
    return weights.withColumn("quota", F.expr(f"(weight * {per_bin} + 5) div 10"))


def _within_quota(ranked: DataFrame, quotas: DataFrame, bin_column: str) -> DataFrame:
    """Ranked rows up to their bin's quota; bins without one give nothing."""
    return ranked.join(quotas.select(bin_column, "quota"), bin_column).filter("rank <= quota").drop("rank", "quota")


def bin_sample(df: DataFrame, key: str, bin_column: str, quotas: DataFrame, largest: int, seed) -> DataFrame:
    """Seeded sample per bin; a bin smaller than its quota gives all its rows.

    ``quotas`` has a row per bin with its ``quota``, none of them above ``largest``.
    """
    return _within_quota(ordering.seeded_top(df, seed, [key], [bin_column], largest), quotas, bin_column)


# --- stratified samples ----------------------------------------------------------------------


def one_item_per_key(df: DataFrame, groups: Sequence[str], item: str, seed) -> DataFrame:
    """One seeded item per group, by an aggregate that combines before the shuffle."""
    pick = F.min(F.struct(seeded.order_key(seed, *groups, item).alias("k"), F.col(item).alias("v")))
    return df.groupBy(*groups).agg(pick.alias("_p")).select(*groups, F.col("_p.v").alias(item))


def stratified_sample(
    df: DataFrame, label: str, key: str, item: str, labels: Sequence[str], per_label: int, seed
) -> DataFrame:
    """Up to ``per_label`` keys per label, one item each."""
    singles = one_item_per_key(df.filter(F.col(label).isin(*labels)), [label, key], item, seed)
    return ordering.seeded_top(singles, seed, [key], [label], per_label).drop("rank")


def shortfalls(sample: DataFrame, label: str, labels: Sequence[str], minimum: int) -> DataFrame:
    """Labels whose sample is below the minimum, labels without any row included."""
    counts = [F.count_if(F.col(label) == name).alias(name) for name in labels]
    pairs = F.array(*[F.struct(F.lit(name).alias(label), F.col(name).alias("n")) for name in labels])
    return sample.agg(*counts).select(F.inline(pairs)).filter(F.col("n") < minimum)


def allocate(weights: DataFrame, total: int, bin_column: str, weight: str = "weight") -> DataFrame:
    """Splits ``total`` over bins by whole-number weights: each bin's whole share, then one more for
    the largest remainders, lower bins first. ``weights`` has one row per bin, a small table by nature.
    """
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shares = weights.withColumn("_all", F.sum(weight).over(everything)).withColumns(
        {"_base": F.expr(f"{total} * `{weight}` div _all"), "_rest": F.lit(total) * F.col(weight) % F.col("_all")})
    place = F.row_number().over(Window.orderBy(F.desc("_rest"), bin_column))
    spare = F.lit(total) - F.sum("_base").over(everything)
    return shares.select(bin_column, weight, (F.col("_base") + (place <= spare).cast("bigint")).alias("quota"))


def two_pass_sample(
    df: DataFrame, label: str, key: str, item: str, bin_column: str, per_label: int, quotas: DataFrame, seed
) -> DataFrame:
    """Per label: each bin's quota first, then leftovers of any bin until ``per_label`` is reached.

    Adds ``pass_no`` (1 or 2). ``quotas`` has a row per bin with its ``quota`` of ``per_label``. The
    first pass is as small as the quotas, so the second only has to look at ``per_label`` leftovers
    per label. The single items are written once, as both passes read them.
    """
    singles = staged(one_item_per_key(df.filter(F.col(bin_column).isNotNull()), [label, bin_column, key], item, seed), "singles")
    ranked = ordering.seeded_top(singles, seed, [key], [label, bin_column], per_label)
    first = _within_quota(ranked, quotas, bin_column).select(*singles.columns, F.lit(1).alias("pass_no"))
    drawn = first.select(*[F.col(c).alias(f"_drawn_{c}") for c in (label, bin_column, key)])
    same = F.lit(True)
    for c in (label, bin_column, key):
        same = same & singles[c].eqNullSafe(drawn[f"_drawn_{c}"])
    leftovers = singles.join(drawn, same, "left_anti")
    ranked = ordering.seeded_top(leftovers, f"{seed}-top-up", [key], [label], per_label)
    taken = first.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_taken"))
    second = (
        ranked.join(taken, ranked[label].eqNullSafe(taken["_label"]), "left")
        .drop("_label")
        .filter(F.col("rank") <= per_label - F.coalesce("_taken", F.lit(0)))
        .drop("rank", "_taken")
        .withColumn("pass_no", F.lit(2))
    )
    return first.unionByName(second)


def with_custom_rows(sample: DataFrame, custom: DataFrame) -> DataFrame:
    """Sampled rows plus hand-picked ones, columns the latter lack padded with null."""
    return sample.withColumn("source", F.lit("sampled")).unionByName(
        custom.withColumn("source", F.lit("custom")), allowMissingColumns=True
    )


def capped_sample(df: DataFrame, key: str, item: str, per_key: int, total: int, seed) -> DataFrame:
    """First ``per_key`` items of each key, keys in seeded order, until ``total`` rows."""
    if per_key > ordering.GROUP_LIMIT:
        numbered = ordering.row_numbers(ordering.text_bucket(df, item), [item], [key], "rank")
        capped = numbered.filter(F.col("rank") <= per_key).drop("rank")
    else:
        capped = ordering.top_per_group(df, [key], [F.col(item)], per_key).drop("rank")
    return capped.orderBy(seeded.order_key(seed, key), key, item).limit(total)


# --- coverage and quotas ---------------------------------------------------------------------


def coverage_prefix(df: DataFrame, key: str, item: str, label: str, labels: Sequence[str]) -> DataFrame:
    """Items of each key in item order, up to the one with which every label has been seen.

    The cut is the latest of the labels' first items. That is two aggregates, so a key with very
    many items is never sorted or scanned in one task.
    """
    firsts = df.filter(F.col(label).isin(*labels)).groupBy(key, label).agg(F.min(item).alias("_first"))
    cuts = firsts.groupBy(key).agg(
        F.when(F.count(F.lit(1)) == len(labels), F.max("_first")).alias("_cut")
    )
    joined = df.join(cuts, key, "left")
    return joined.filter(F.col("_cut").isNull() | (F.col(item) <= F.col("_cut"))).drop("_cut")


def quota_prefix(
    processed: DataFrame, key: str, label: str, labels: Sequence[str], target: int, max_calls: int, seed
) -> DataFrame:
    """Keys in seeded order until every label has ``target`` keys or ``max_calls`` items are used.

    ``processed`` holds the items that would be handled per key. Returns the kept keys with their
    position, item count and ``calls_allowed`` (smaller than the count only where the cap cuts in).
    """
    flags = {f"_has_{i}": F.max((F.col(label) == name).cast("bigint")) for i, name in enumerate(labels)}
    per_key = processed.groupBy(key).agg(
        F.count(F.lit(1)).alias("calls"), *[f.alias(n) for n, f in flags.items()], F.lit(1).cast("bigint").alias("_one")
    )
    keyed = per_key.withColumn("_key", seeded.order_key(seed, key))
    amounts = {"_calls_upto": "calls", "position": "_one", **{f"_upto{n}": n for n in flags}}
    summed = ordering.running_totals(ordering.digest_bucket(keyed, "_key"), ["_key", key], amounts)
    calls_before = F.col("_calls_upto") - F.col("calls")
    met = F.lit(True)
    for n in flags:
        met = met & (F.col(f"_upto{n}") - F.col(n) >= target)
    kept = summed.filter(~met & (calls_before < max_calls))
    return kept.select(
        key, "position", "calls", F.least(F.col("calls"), F.lit(max_calls) - calls_before).alias("calls_allowed")
    )


# --- rater order and frozen subsets ----------------------------------------------------------


def rater_order(subset: DataFrame, raters: Sequence[str], rater: str, item: str) -> DataFrame:
    """Every rater's own reproducible order over the subset (``position`` from 0).

    The panel is configuration; the result has one row per rater and item by definition.
    """
    grid = subset.withColumn(rater, F.explode(F.array(*[F.lit(r) for r in raters])))
    keyed = grid.withColumn("_key", seeded.order_key("rater", rater, item))
    numbered = ordering.row_numbers(ordering.digest_bucket(keyed, "_key"), ["_key", item], [rater], "position")
    return numbered.withColumn("position", F.col("position") - 1).drop("_key")


def next_unrated(order: DataFrame, ratings: DataFrame, rater: str, item: str) -> DataFrame:
    """Per rater: first unrated position (the total when done), how many are done, the total."""
    rated = ratings.select(rater, item).distinct().withColumn("_rated", F.lit(True))
    marked = order.join(rated, [rater, item], "left")
    open_position = F.min(F.when(F.col("_rated").isNull(), F.col("position")))
    return marked.groupBy(rater).agg(
        F.coalesce(open_position, F.count(F.lit(1))).alias("next_position"),
        F.count("_rated").alias("done_count"),
        F.count(F.lit(1)).alias("total"),
    )


def frozen_subset(manifest: DataFrame, label: str, key: str, labels: Sequence[str], per_label: int | None, seed) -> DataFrame:
    """Items drawn per label for rating; all items when ``per_label`` is None."""
    rows = manifest.filter(F.col(label).isin(*labels))
    if per_label is None:
        return manifest
    return ordering.seeded_top(rows, seed, [key], [label], per_label).drop("rank")


def freeze(spark: SparkSession, subset: DataFrame, path: str) -> DataFrame:
    """Writes the subset once; later calls read what the first one wrote, whatever they pass.

    Spark moves a write's files into place only when it ends well, so a folder with rows is whole.
    """
    stored = spark.read.schema(subset.schema)
    try:
        done = not stored.parquet(path).isEmpty()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        done = False
    if not done:
        subset.write.mode("overwrite").parquet(path)
    return stored.parquet(path)


# --- work planning ---------------------------------------------------------------------------


def rows_per_chunk(max_rows: int = rv.CHUNK_MAX_ROWS, max_bytes: int = rv.CHUNK_MAX_BYTES,
                   bytes_per_item: int = rv.CHUNK_BYTES_PER_ITEM) -> int:
    """Items after which a greedy chunk closes: at the row limit or at the byte limit."""
    return min(max_rows, math.ceil(max_bytes / bytes_per_item))


def chunk_plan(df: DataFrame, item: str, chunk_rows: int, prefix: str = "full_") -> DataFrame:
    """Stable chunk ids over the sorted items: the same items always give the same chunks."""
    numbered = ordering.row_numbers(ordering.text_bucket(df, item), [item], name="_rn")
    chunk = F.floor((F.col("_rn") - 1) / chunk_rows)
    return numbered.withColumn("chunk_id", F.format_string(f"{prefix}%03d", chunk)).drop("_rn")


def kfold(df: DataFrame, key: str, folds: int = 5, seed=42, name: str = "fold") -> DataFrame:
    """Fold 0..folds-1 per row from its key alone: no shuffle, near-balanced."""
    return df.withColumn(name, seeded.hashed_fold(seed, key, folds))


def balanced_kfold(df: DataFrame, key: str, folds: int = 5, seed=42, name: str = "fold") -> DataFrame:
    """Folds that differ in size by at most one row."""
    numbered = ordering.seeded_row_numbers(df, seed, [key], name="_rn")
    return numbered.withColumn(name, F.pmod(F.col("_rn") - 1, F.lit(folds)).cast("int")).drop("_rn")
