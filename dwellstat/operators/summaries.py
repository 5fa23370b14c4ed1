"""Counts, costs and run book-keeping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellstat import reference_values as rv
from dwellstat.functions import checks
from dwellstat.operators import ordering


def frequency(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, null included."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def version_report(sales: DataFrame, version: str, price: str, matched: Column, early: Column) -> DataFrame:
    """Sales per lot version with the matched share, the mean price and how many predate the first."""
    return sales.groupBy(version).agg(
        F.count(F.lit(1)).alias("sales"),
        F.count_if(matched).alias("matched"),
        F.avg(F.coalesce(matched, F.lit(False)).cast("double")).alias("matched_share"),
        F.avg(price).alias("mean_price"),
        F.count_if(early).alias("predates_first"),
    )


def rating_progress(ratings: DataFrame, subset: DataFrame, rater: str = "rater", item: str = "image_path") -> DataFrame:
    """Items rated per rater and whether the whole subset is done."""
    size = subset.agg(F.count_distinct(item)).scalar()
    table = ratings.groupBy(rater).agg(F.count_distinct(item).alias("n_rated"))
    return table.withColumn("subset_size", size).withColumn("complete", F.col("n_rated") == F.col("subset_size"))


def keys_per_label(df: DataFrame, label: str, key: str, labels: Sequence[str]) -> DataFrame:
    """Distinct keys per label."""
    return df.filter(F.col(label).isin(*labels)).groupBy(label).agg(F.count_distinct(key).alias("n_keys"))


def batch_summary(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Answers, errors, tokens per answer and cost of each batch of parsed responses."""
    ok = checks.no_error("error")

    def per_answer(c: str) -> Column:
        return F.avg(F.when(ok, F.col(c)))

    return rows.groupBy(*by).agg(
        F.count_if(ok).alias("classified"),
        F.count_if(~ok).alias("errors"),
        per_answer("input_tokens").alias("input_per_image"),
        per_answer("output_tokens").alias("output_per_image"),
        per_answer("thinking_tokens").alias("thinking_per_image"),
        F.coalesce(F.sum(F.when(ok, F.col("cost_usd"))), F.lit(0.0)).alias("cost_usd"),
    )


def usage_stats(rows: DataFrame, by: Sequence[str], amount: str, invalid: Column) -> DataFrame:
    """Mean, exact median, min, max and invalid count of a usage figure."""
    stats = rows.groupBy(*by).agg(
        F.count(amount).alias("n"),
        F.avg(amount).alias("mean"),
        F.min(amount).alias("min"),
        F.max(amount).alias("max"),
        F.count_if(invalid).alias("invalid"),
    )
    return stats.join(ordering.medians(rows, amount, by), list(by), "left")


def scoring_cost(scores: DataFrame, labels: DataFrame, label: str, total_items: Column, rooms: Sequence[str] = rv.SCORED_ROOMS,
                 cost: str = "cost_usd", latency: str = "latency_s") -> DataFrame:
    """Mean cost and latency per call and the extrapolated cost of scoring the whole corpus."""
    share = labels.agg(F.avg(F.coalesce(F.col(label).isin(*rooms), F.lit(False)).cast("double"))).scalar()
    items = F.floor(total_items * share)
    table = scores.groupBy("model").agg(
        F.avg(cost).alias("mean_cost_per_call_usd"), F.avg(latency).alias("mean_latency_s")
    )
    full = F.col("mean_cost_per_call_usd") * F.col("est_scoreable_images")
    return table.withColumn("est_scoreable_images", items).withColumns(
        {"full_run_standard_usd": full, "full_run_batch_usd": full * rv.BATCH_DISCOUNT}
    )


def run_totals(rows: DataFrame, by: Sequence[str], gap: str, cost: str) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.sum(cost).alias("run_cost_usd"),
        F.count_if(F.abs(F.col(gap)) > 1).alias("off_by_1"),
        F.avg(F.abs(F.col(gap))).alias("mean_abs_gap"),
    )


def latest_ratings(log: DataFrame, keys: Sequence[str] = ("rater", "image_path"), stamp: str = "timestamp",
                   arrival: str | None = None, fields: Sequence[str] = ("score",)) -> DataFrame:
    """Last write per key by time, later arrival breaking ties; combines before the shuffle."""
    order = [F.col(stamp), *([F.col(arrival)] if arrival else []), *[F.col(f) for f in fields]]
    newest = F.max(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    base = 1 + bool(arrival)
    return log.groupBy(*keys).agg(newest.alias("_w")).select(
        *keys, F.col("_w.o0").alias(stamp), *[F.col(f"_w.o{base + i}").alias(f) for i, f in enumerate(fields)]
    )


def upsert_runs(manifest: DataFrame, entries: DataFrame, key: str = "timestamp") -> DataFrame:
    """Run manifest with new entries replacing old ones of the same time."""
    return manifest.join(entries.select(key), key, "left_anti").unionByName(entries)


def prune_runs(manifest: DataFrame, scores: DataFrame, key: str = "timestamp") -> DataFrame:
    """Manifest entries that still have scores."""
    return manifest.join(scores.select(key), key, "left_semi")


def latest_run(scores: DataFrame, key: str = "timestamp") -> DataFrame:
    """Scores of the newest run."""
    newest = scores.agg(F.max(key)).scalar()
    return scores.filter(F.col(key) == newest)
