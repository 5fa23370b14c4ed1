import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dwellstat.functions import checks
from dwellstat.operators import agreement, joins, photos, summaries


def scores(spark, rows):
    return spark.createDataFrame(rows, "model string, room_type string, image_path string, replicate int, score double")


def test_consistency(spark):
    rows = [("m", "k", "a", 1, 2.0), ("m", "k", "a", 2, 4.0), ("m", "k", "b", 1, 6.0), ("m", "k", "c", 1, None), ("m", "b", "a", 1, 3.0), ("m", "b", "z", 1, 3.0)]
    got = {r.room_type: r for r in agreement.consistency(scores(spark, rows)).collect()}
    assert got["k"].n_images == 3 and got["k"].within_image_std == pytest.approx(np.sqrt(2))
    assert got["k"].ratio_within_over_between == pytest.approx(np.sqrt(2) / np.std([3, 6], ddof=1))
    assert got["b"].between_image_std == 0.0 and got["b"].ratio_within_over_between is None


def test_compression(spark):
    rows = [("m", "kitchen", f"i{v}", 1, v) for v in (2.5, 3.0, 4.0)] + [("m", "bedroom", f"i{v}", 1, v) for v in (1.0, 4.5, 8.0)]
    got = {r.room_type: r for r in agreement.compression(scores(spark, rows), agreement.top_level_of()).collect()}
    assert got["kitchen"].compressed and got["kitchen"].scale_span == 6.0
    assert not got["bedroom"].compressed and got["bedroom"].share_in_extremes == pytest.approx(2 / 3)


def test_missing_judgment_counts_as_disagreement(spark):
    df = spark.createDataFrame([("m", "k", None), ("m", "k", "k"), ("m", "k", "b")], "model string, room string, judged string")
    assert agreement.disagreement_rate(df, "room", "judged", ["model"]).first().disagreement_rate == pytest.approx(2 / 3)


def rating_frame(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(1, 9, 30)
    rows = []
    for r, noise, n in (("a", 1, 30), ("b", 1, 30), ("c", 1, 30), ("odd", 30, 30), ("late", 1, 9)):
        rows += [(r, f"p{i}", int(np.clip(base[i] + (rng.integers(-noise, noise + 1) if r != "odd" else rng.integers(-8, 9)), 1, 8))) for i in range(n)]
    pdf = pd.DataFrame(rows, columns=["rater", "image_path", "score"])
    return pdf, spark.createDataFrame(pdf)


def test_rater_pairs_and_outlier(spark):
    pdf, df = rating_frame(spark)
    pairs = agreement.rater_pairs(df)
    got = {(r.rater_a, r.rater_b): r for r in pairs.collect()}
    wide = pdf.pivot(index="image_path", columns="rater", values="score")
    assert all("late" not in k for k in got) and len(got) == 6
    for (a, b), row in got.items():
        assert row.rho == pytest.approx(wide[a].rank().corr(wide[b].rank())) and row.n_common == 30
    summary = {r.rater: r for r in agreement.rater_summary(df, pairs).collect()}
    assert summary["odd"].outlier and not summary["a"].outlier
    assert summary["late"].mean_rho_vs_others is None and not summary["late"].outlier and summary["late"].n_rated == 9
    assert agreement.agreement_ceiling(pairs).first().ceiling == pytest.approx(np.mean([r.rho for r in got.values()]))


def test_consensus_and_agreement(spark):
    pdf, df = rating_frame(spark)
    refs = agreement.consensus(df, {"all": None, "pair": ("a", "b"), "nobody": ("x",)})
    got = refs.toPandas()
    assert set(got.reference) == {"all", "pair", "a", "b", "c", "odd", "late"}
    want = pdf.groupby("image_path").score.mean()
    assert np.allclose(got[got.reference == "all"].set_index("image_path").human_score.sort_index(), want.sort_index())
    means = df.filter("rater = 'a'").select(F.lit("m").alias("model"), "image_path", (F.col("score") + 1.5).alias("mean_score"))
    row = agreement.agreement(means, refs).filter("reference = 'a'").first()
    assert (row.n, row.bias, row.mean_abs_dev, row.pct_off_by_1) == (30, 1.5, 1.5, 100.0) and row.spearman == pytest.approx(1.0)
    assert agreement.agreement(means.limit(2), refs).count() == 0


def test_histogram_closes_last_bin(spark):
    df = spark.createDataFrame([("m", v) for v in (1.0, 1.49, 1.5, 7.5, 8.0, 9.0)], "model string, score double")
    got = {r.bin_start: r["count"] for r in agreement.score_histogram(df, ["model"], "score", F.lit(8)).collect()}
    assert got == {1.0: 2, 1.5: 1, 7.5: 2}


def test_run_changes(spark):
    a = spark.createDataFrame([("p", 3, "k"), ("q", None, "k"), ("r", 2, "k")], "image_path string, score int, room string")
    b = spark.createDataFrame([("p", 5, "k"), ("q", 1, "k"), ("r", 2, "k"), ("s", 1, "k")], "image_path string, score int, room string")
    assert [tuple(r) for r in joins.run_changes(a, b, "image_path", "score", "room").collect()] == [("p", "k", 3, 5, 2)]


def test_replicates(spark):
    df = spark.createDataFrame([("p", 1, 3, 3.0, .5, ""), ("p", 2, 3, 4.0, .7, None), ("q", 1, 3, 1.0, .5, ""), ("q", 2, 3, None, None, "timeout")],
                               "image_path string, replicate int, level int, score double, confidence double, error string")
    got = {r.image_path: r for r in agreement.replicate_summary(df, ["image_path"], 2).collect()}
    assert got["p"].consistent and got["p"].mean_score == 3.5 and not got["q"].consistent
    more = df.union(spark.createDataFrame([("p", 2, 3, 2.0, .7, None), ("p", 7, 3, 1.0, .7, None)], df.schema))
    lists = {r.image_path: r.answers for r in agreement.replicate_lists(more, ["image_path"], ["score"]).collect()}
    assert [(x.replicate, x.score) for x in lists["p"]] == [(1, 3.0), (2, 2.0), (2, 4.0), (7, 1.0)]


def test_photo_features_and_route(spark):
    df = spark.createDataFrame([(1, "kitchen", 3.0), (1, "kitchen", 5.0), (2, "bedroom", 1.0)], "zpid int, room string, score double")
    got = {r.zpid: r for r in photos.photo_features(df, "zpid", "room", "score").collect()}
    assert (got[1].kitchen_score, got[1].kitchen_mean, got[1].kitchen_count, got[1].bedroom_score, got[2].bedroom_count) == (5.0, 4.0, 2, None, 1)
    routed = spark.createDataFrame([("kitchen", "kitchen"), ("kitchen", "bedroom"), ("other", "kitchen"), ("kitchen", "other"), ("kitchen", None)], "l string, j string")
    assert [r.scored_room for r in photos.route(routed, "l", "j").collect()] == ["kitchen", "bedroom", "kitchen", None, "kitchen"]


def test_latest_rating_and_gap(spark):
    df = spark.createDataFrame([("a", "p", 3, 1, 1), ("a", "p", 5, 2, 1), ("a", "p", 4, 2, 2)], "rater string, image_path string, score int, timestamp int, arrival int")
    assert summaries.latest_ratings(df, arrival="arrival").first().score == 4
    gaps = spark.createDataFrame([(1.0,), (1.1,), (-1.2,), (None,)], "g double").select(checks.gap_label("g").alias("x"))
    assert [r.x for r in gaps.collect()] == ["ok", "high", "low", "n/a"]


def test_pick_model(spark):
    table = spark.createDataFrame([("x", .80), ("y", .78), ("z", .5)], "model string, spearman double")
    ratio = spark.createDataFrame([("x", .2), ("y", .1), ("z", .01)], "model string, ratio_within_over_between double")
    costs = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("z", .1)], "model string, mean_cost_per_call_usd double")
    ceiling = spark.createDataFrame([(.9,)], "ceiling double")
    assert [r.model for r in agreement.pick_model(table, ratio, costs, ceiling).collect()] == ["y", "x"]
