import pathlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dwellstat import session
from dwellstat.operators import ordering

RNG = np.random.default_rng(3)


def frame(spark, n=800, skew=True):
    """Two thirds in one group, many ties, one value that fills a third."""
    g = np.where(RNG.random(n) < 0.66, "hot", RNG.choice(list("abc"), n)) if skew else np.repeat("g", n)
    x = np.where(RNG.random(n) < 0.33, 5.0, RNG.integers(0, 40, n) / 4)
    y = np.round(x + RNG.normal(0, 3, n), 1)
    pdf = pd.DataFrame({"id": np.arange(n), "g": g, "x": x, "y": y})
    return pdf, spark.createDataFrame(pdf).repartition(7)


@pytest.mark.parametrize("splits", [4, 33, 200])
def test_row_numbers_and_totals(spark, splits):
    pdf, df = frame(spark)
    out = ordering.running_totals(ordering.value_bucket(df, "x", splits), ["x", "id"], {"upto": "y"}, ["g"], group_totals=True).toPandas()
    want = pdf.sort_values(["g", "x", "id"])
    want["upto"] = want.groupby("g")["y"].cumsum()
    got = out.set_index("id").sort_index()
    assert np.allclose(got["upto"], want.set_index("id").sort_index()["upto"])
    assert np.allclose(got["upto_all"], pdf.groupby("g")["y"].transform("sum"))


@pytest.mark.parametrize("splits", [5, 40, 100])
def test_text_order(spark, splits):
    pdf, df = frame(spark)
    named = df.withColumn("name", F.concat(F.lit("k"), F.col("id").cast("string")))
    out = ordering.row_numbers(ordering.text_bucket(named, "name", splits, per_split=4), ["name"]).toPandas()
    assert list(out.sort_values("row_number")["name"]) == sorted(f"k{i}" for i in pdf["id"])


def test_spearman_matches_ranks(spark):
    pdf, df = frame(spark)
    got = {r.g: (r.n, r.rho) for r in ordering.spearman(df, "x", "y", ["g"]).collect()}
    for g, part in pdf.groupby("g"):
        assert got[g][0] == len(part)
        assert got[g][1] == pytest.approx(part["x"].rank().corr(part["y"].rank()), abs=1e-12)


def test_spearman_without_variance_is_null(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", None, 1.0)], "g string, x double, y double")
    assert [tuple(r) for r in ordering.spearman(df, "x", "y", ["g"]).collect()] == [("a", 2, None)]


def test_exact_quantiles(spark):
    pdf, df = frame(spark)
    probs = [0.0, 0.1, 1 / 3, 0.5, 0.9, 1.0]
    got = {(r.g, r.prob): r.quantile for r in ordering.exact_quantiles(df, "y", probs, ["g"]).collect()}
    for g, part in pdf.groupby("g"):
        for p in probs:
            assert got[g, p] == pytest.approx(np.quantile(part["y"], p), abs=1e-9)


def test_seeded_order_ignores_partitioning(spark):
    _, df = frame(spark, 300)
    a, b = [{r.id: r.row_number for r in ordering.seeded_row_numbers(d, 9, ["id"], ["g"]).collect()} for d in (df, df.repartition(2, "x"))]
    assert a == b


def test_top_per_group_has_no_limit(spark):
    _, df = frame(spark, 100)
    assert ordering.top_per_group(df, ["g"], [F.col("id")], 2000).count() == 100
    assert ordering.seeded_top(df, 1, ["id"], ["g"], 2000).count() == 100


def test_quantiles_shuffle_only_rows_near_a_wanted_position(spark):
    values = [None, float("inf"), -1e-300, 0.0, -0.0, *[float(x) for x in np.random.default_rng(3).normal(0, 1e3, 5000)]]
    df = spark.createDataFrame([(i % 2 or None, v) for i, v in enumerate(values)], "g int, y double")
    got = {(r.g, r.prob): r.quantile for r in ordering.exact_quantiles(df, "y", [0.0, 0.1, 0.5], ["g"]).collect()}
    for g in (None, 1):
        mine = [v for i, v in enumerate(values) if (i % 2 or None) == g and v is not None]
        assert [got[g, p] for p in (0.0, 0.1, 0.5)] == pytest.approx(list(np.quantile(mine, [0.0, 0.1, 0.5])))
    near = max((p for p in pathlib.Path(session.shared_folder(spark), "dwellstat").glob("quantile-values-*")), key=lambda p: p.stat().st_mtime)
    assert spark.read.parquet(str(near)).count() < 1000
