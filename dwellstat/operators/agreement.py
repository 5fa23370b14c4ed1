"""Consistency, agreement and bias of raters and models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellstat import reference_values as rv
from dwellstat.operators import ordering
from dwellstat.session import staged

#: Raters of one item that are paired in one task.
RATERS_PER_BLOCK = 256


def mean_scores(scores: DataFrame, by: Sequence[str], score: str = "score") -> DataFrame:
    return scores.groupBy(*by).agg(F.avg(score).alias("mean_score"))


def consistency(scores: DataFrame, by: Sequence[str] = ("model", "room_type"), item: str = "image_path",
                score: str = "score") -> DataFrame:
    """Replicate noise against real spread: mean of per-item sample deviations over the sample
    deviation of item means. Items with one replicate have no deviation and do not count in the mean."""
    per_item = scores.groupBy(*by, item).agg(F.stddev_samp(score).alias("_sd"), F.avg(score).alias("_mean"))
    table = per_item.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_images"),
        F.avg("_sd").alias("within_image_std"),
        F.stddev_samp("_mean").alias("between_image_std"),
    )
    between = F.nullif(F.col("between_image_std"), F.lit(0.0))
    return table.withColumn("ratio_within_over_between", F.try_divide("within_image_std", between))


def compression(scores: DataFrame, top_level: Column, by: Sequence[str] = ("model", "room_type"), score: str = "score") -> DataFrame:
    """Share of scores within one point of either end of the scale, and how much of it is used."""
    value = F.col(score)
    rated = scores.withColumn("_top", top_level.cast("double")).filter(value.isNotNull())
    ends = ((value <= 2.0) | (value >= F.col("_top") - 1)).cast("double")
    table = rated.groupBy(*by, "_top").agg(
        F.avg(ends).alias("share_in_extremes"), (F.max(value) - F.min(value)).alias("range_used")
    )
    span = F.col("_top") - 1
    squeezed = (F.col("share_in_extremes") < 0.05) | (F.col("range_used") < 0.6 * span)
    return table.select(*by, "share_in_extremes", "range_used", span.alias("scale_span"), squeezed.alias("compressed"))


def disagreement_rate(scores: DataFrame, label: str, judged: str, by: Sequence[str]) -> DataFrame:
    """Share of rows whose judged label differs from the label; a missing judgment differs."""
    differs = ~F.col(judged).eqNullSafe(F.col(label))
    return scores.groupBy(*by).agg(F.avg(differs.cast("double")).alias("disagreement_rate"))


def consensus(ratings: DataFrame, groups: dict[str, Sequence[str] | None], rater: str = "rater",
              item: str = "image_path", score: str = "score") -> DataFrame:
    """Mean score per reference and item: named rater groups (None = all) and each rater alone.

    A rater counts in every group that lists it. The group list is plan-time configuration, so
    membership is an array expression per row and no join.
    """
    labels = [F.when(F.lit(True) if members is None else F.col(rater).isin(*members), F.lit(name)) for name, members in groups.items()]
    named = ratings.withColumn("reference", F.explode(F.array_compact(F.array(*labels, F.col(rater).cast("string")))))
    return named.groupBy("reference", item).agg(F.avg(score).alias("human_score"))


def agreement(means: DataFrame, references: DataFrame, item: str = "image_path",
              by: Sequence[str] = ("model", "reference"), minimum: int = 3) -> DataFrame:
    """Rank correlation, mean absolute gap and bias of model means per reference (and room)."""
    joined = (
        means.join(references, item)
        .filter(F.col("mean_score").isNotNull() & F.col("human_score").isNotNull())
        .withColumn("gap", F.col("mean_score") - F.col("human_score"))
    )
    gaps = joined.groupBy(*by).agg(
        F.avg(F.abs("gap")).alias("mean_abs_dev"),
        F.avg("gap").alias("bias"),
        (100 * F.avg((F.abs("gap") > 1).cast("double"))).alias("pct_off_by_1"),
    )
    rho = ordering.spearman(joined, "mean_score", "human_score", by)
    return rho.join(gaps, list(by)).filter(F.col("n") >= minimum).withColumnRenamed("rho", "spearman")


def against_reference_model(means: DataFrame, reference: str, item: str = "image_path", room: str = "room_type") -> DataFrame:
    """Model means next to the reference model's mean of the same item."""
    ref = means.filter(F.col("model") == reference).select(item, F.col("mean_score").alias("reference_mean"))
    return (
        means.filter(F.col("model") != reference)
        .join(ref, item)
        .select("model", item, room, "mean_score", "reference_mean", (F.col("mean_score") - F.col("reference_mean")).alias("diff"))
    )


def wide(table: DataFrame, rows: str, columns: str, value: str, order: Sequence[str]) -> DataFrame:
    """Long table → matrix with the given column order."""
    return table.groupBy(rows).agg(*[F.avg(F.when(F.col(columns) == name, F.col(value))).alias(name) for name in order])


def rater_pairs(ratings: DataFrame, min_common: int = 10, rater: str = "rater", item: str = "image_path",
                score: str = "score", block: int = RATERS_PER_BLOCK) -> DataFrame:
    """Rank correlation of every rater pair over the items both rated, where they share enough.

    The result has one row per rater pair by definition. Pairs are counted per score combination
    straight after the join, so what is shuffled is as small as pairs times score levels squared.
    """
    # read for the block counts and for both sides of the join
    rated = staged(ratings.groupBy(item, rater).agg(F.avg(score).alias("_s")), "rated")
    pairs = _blocked_pairs(rated, rater, item, block)
    rho = ordering.spearman(pairs, "score_a", "score_b", ["rater_a", "rater_b"], few_values=True)
    return rho.filter(F.col("n") >= min_common).withColumnRenamed("n", "n_common")


def _blocked_pairs(rated: DataFrame, rater: str, item: str, block: int) -> DataFrame:
    """(item, rater_a, score_a, rater_b, score_b): the pairs of each item's raters, ``a`` below ``b``.

    An item's raters are dealt to blocks of about ``block``, and each unordered pair of blocks is a
    join key of its own, so an item that everybody rated spreads over as many tasks as it has pairs
    of blocks. A rater is sent to every pair of blocks that its own is part of. Raters of one block
    meet where it is paired with itself, those of two blocks in the pair of the two: once each.
    """
    sizes = rated.groupBy(item).agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("_blocks"))
    own = F.pmod(F.xxhash64(rater), F.col("_blocks"))
    dealt = (
        rated.join(sizes, item)
        .withColumns({"_own": own, "_other": F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1))})
        .withColumns({"_low": F.least("_own", "_other"), "_high": F.greatest("_own", "_other")})
    )
    keys = [item, "_low", "_high"]
    a = dealt.select(*keys, F.col("_own").alias("_own_a"), F.col(rater).alias("rater_a"), F.col("_s").alias("score_a"))
    b = dealt.select(*keys, F.col("_own").alias("_own_b"), F.col(rater).alias("rater_b"), F.col("_s").alias("score_b"))
    once = (F.col("_low") == F.col("_high")) | (F.col("_own_a") != F.col("_own_b"))
    return a.join(b, keys).filter(once & (F.col("rater_a") < F.col("rater_b"))).select(item, "rater_a", "score_a", "rater_b", "score_b")


def rater_summary(ratings: DataFrame, pairs: DataFrame, rater: str = "rater", item: str = "image_path") -> DataFrame:
    """Per rater: items rated, mean correlation with the others, and the outlier flag."""
    both = pairs.select(F.col("rater_a").alias(rater), "rho").unionByName(pairs.select(F.col("rater_b").alias(rater), "rho"))
    means = both.groupBy(rater).agg(F.avg("rho").alias("mean_rho_vs_others"))
    rated = ratings.groupBy(rater).agg(F.count_distinct(item).alias("n_rated"))
    table = rated.join(means, rater, "left")
    overall = means.agg(F.struct(F.avg("mean_rho_vs_others").alias("mean"), F.stddev_samp("mean_rho_vs_others").alias("sd"))).scalar()
    below = F.col("_overall.mean") - F.col("mean_rho_vs_others")
    far = (below > 0.2) | ((F.col("_overall.sd") > 0) & (below > 2 * F.col("_overall.sd")))
    return table.withColumn("_overall", overall).select(rater, "n_rated", "mean_rho_vs_others", F.coalesce(far, F.lit(False)).alias("outlier"))


def agreement_ceiling(pairs: DataFrame) -> DataFrame:
    """Mean pairwise correlation: no model can be expected to agree with raters more than that."""
    return pairs.agg(F.avg("rho").alias("ceiling"), F.count("rho").alias("pairs"))


def before_after(before: DataFrame, after: DataFrame, by: str, metrics: Sequence[str]) -> DataFrame:
    """Metrics of two runs side by side; negative ``abs_bias_delta`` is an improvement."""
    a = before.select(by, *[F.col(m).alias(f"{m}_before") for m in metrics])
    b = after.select(by, "n", *[F.col(m).alias(f"{m}_after") for m in metrics])
    joined = a.join(b, by)
    return joined.withColumn("abs_bias_delta", F.abs("bias_after") - F.abs("bias_before"))


def score_histogram(scores: DataFrame, by: Sequence[str], score: str, top_level: Column, width: float = 0.5) -> DataFrame:
    """Counts per fixed-width bin from 1 to the top level, the last bin closed on both sides."""
    value, top = F.col(score), top_level.cast("double")
    last = F.ceil((top - 1) / width) - 1
    index = F.least(F.floor((value - 1) / width), last)
    inside = scores.filter(value.isNotNull() & (value >= 1) & (value <= top))
    return (
        inside.groupBy(*by, index.cast("bigint").alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("bin_start", 1 + F.col("bin") * width)
    )


def level_summary(gaps: DataFrame, room: str = "room_type") -> DataFrame:
    """Levels, misses and spread per room with a total row (room ``all``)."""
    off = F.abs(F.col("mean_score") - F.col("human_score"))
    table = gaps.rollup(room).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("mean_score").alias("model_level"),
        F.avg("human_score").alias("human_level"),
        F.count_if(off > 1).alias("off_by_1"),
        F.count_if(off > 1.5).alias("off_by_1_5"),
        F.count_if(off > 2).alias("off_by_2"),
        F.avg((F.col("mean_score") >= 5.5).cast("double")).alias("share_high"),
        F.stddev_samp("mean_score").alias("score_std"),
        F.grouping(room).alias("_total"),
    )
    return table.withColumn(room, F.when(F.col("_total") == 1, F.lit("all")).otherwise(F.col(room))).drop("_total")


def score_range(scores: DataFrame, item: str = "image_path", score: str = "score") -> DataFrame:
    return scores.groupBy(item).agg(
        F.min(score).alias("score_min"), F.avg(score).alias("score_mean"), F.max(score).alias("score_max")
    )


def replicate_lists(scores: DataFrame, item: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """All answers per item in order of their replicate number, then of their fields."""
    entry = F.struct("replicate", *fields)
    return scores.groupBy(*item).agg(F.array_sort(F.collect_list(entry)).alias("answers"))


def replicate_summary(answers: DataFrame, item: Sequence[str], replicates: int) -> DataFrame:
    """Whether all replicates gave one level and none failed, with mean score and confidence."""
    ok = F.length(F.coalesce(F.col("error"), F.lit(""))) == 0
    level = F.when(ok, F.col("level"))
    table = answers.groupBy(*item).agg(
        F.count_if(ok).alias("n_ok"),
        F.min(level).alias("_lo"),
        F.max(level).alias("_hi"),
        F.avg(F.when(ok, F.col("score"))).alias("mean_score"),
        F.avg(F.when(ok, F.col("confidence"))).alias("mean_confidence"),
    )
    same = F.coalesce((F.col("n_ok") == replicates) & (F.col("_lo") == F.col("_hi")), F.lit(False))
    return table.withColumn("consistent", same).drop("_lo", "_hi")


def joined_names(df: DataFrame, by: str, name: str, alias: str) -> DataFrame:
    """Sorted distinct names per group as one text; repeats go before the list is built."""
    distinct = df.filter(F.col(name).isNotNull()).select(by, name).distinct()
    return distinct.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(name)), ", ").alias(alias))


def pick_model(agreement_table: DataFrame, consistency_table: DataFrame, costs: DataFrame, ceiling: DataFrame,
               slack: float = 0.05) -> DataFrame:
    """Models near the agreement ceiling, most consistent then cheapest first; the first is the pick."""
    top = agreement_table.agg(F.max("spearman")).scalar()
    limit = F.least(ceiling.agg(F.max("ceiling")).scalar(), top) - slack
    ratio = consistency_table.groupBy("model").agg(F.avg("ratio_within_over_between").alias("consistency_ratio"))
    near = agreement_table.filter(F.col("spearman") >= limit).select("model", "spearman")
    return (
        near.join(ratio, "model")
        .join(costs.select("model", "mean_cost_per_call_usd"), "model")
        .orderBy(F.asc_nulls_last("consistency_ratio"), F.asc_nulls_last("mean_cost_per_call_usd"), "model")
    )


def label_agreement(pairs: DataFrame, first: str, second: str) -> DataFrame:
    same = F.col(first).eqNullSafe(F.col(second))
    return pairs.agg(
        F.count_if(same).alias("agree"), F.count(F.lit(1)).alias("n"), F.avg(same.cast("double")).alias("agreement_rate")
    )


def confusion(pairs: DataFrame, label: str, truth: str, truths: Sequence) -> DataFrame:
    """Counts of label (rows) against truth (columns)."""
    return pairs.groupBy(label).agg(*[F.count_if(F.col(truth) == t).alias(f"truth_{t}") for t in truths])


def top_level_of(room: str | Column = "room_type", scale: dict[str, int] = rv.ROOM_TOP_LEVEL) -> Column:
    """Top level of a room's scale; the scale table is a parameter because scales differ by study."""
    room = room if isinstance(room, Column) else F.col(room)
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in scale.items() for v in pair]), room)

