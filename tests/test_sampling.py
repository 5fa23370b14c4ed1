from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dwellstat.operators import ordering, sampling

ROOMS = ("kitchen", "bathroom", "bedroom", "living_room")


def photo_frame(spark, listings=60, hot=300):
    """One listing holds most photos."""
    rng = np.random.default_rng(2)
    rows = [(f"images/{z}/{i:03d}.jpg", z, str(rng.choice([*ROOMS, "other"]))) for z in range(listings) for i in range(hot if z == 0 else int(rng.integers(1, 9)))]
    return pd.DataFrame(rows, columns=["image_path", "zpid", "label"])


def quotas_of(spark, quotas):
    return spark.createDataFrame(list(quotas.items()), "bin bigint, quota bigint")


def test_allocate_sums_and_weights(spark):
    for total, bins, tenths in [(38, 12, 17), (7, 12, 17), (100, 5, 30), (0, 4, 20)]:
        got = {r.bin: r.quota for r in sampling.allocate(sampling.bin_table(spark, bins, tenths), total, "bin").collect()}
        assert sum(got.values()) == total and sorted(got) == list(range(1, bins + 1))
        weight = {b: tenths if b in (1, 2, bins - 1, bins) else 10 for b in got}
        for b, n in got.items():  # never further than one from the exact share
            assert abs(n - total * weight[b] / sum(weight.values())) < 1
    assert got[1] >= got[3]


def test_bin_quotas(spark):
    got = {r.bin: r.quota for r in sampling.bin_quotas(sampling.bin_table(spark, 12, 20), 20).collect()}
    assert got == {b: 40 if b in (1, 2, 11, 12) else 20 for b in range(1, 13)}


def test_top_rows_do_not_depend_on_the_plan(spark):
    """Rows without a group count as a group, whether few or many rows are asked for."""
    df = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(10)], "k int, g string")
    few, many = (ordering.seeded_top(df, 1, ["k"], ["g"], n).collect() for n in (1000, 1001))
    assert sorted((r.k, r.rank) for r in few) == sorted((r.k, r.rank) for r in many) and len(few) == 10
    numbered = ordering.seeded_top(df, 1, ["k"], ["g"], 3).collect()
    assert sorted(r.k for r in numbered) == sorted(r.k for r in many if r.rank <= 3)


def test_capped_sample_has_no_limit_per_key(spark):
    df = spark.createDataFrame([("a", f"{i:05d}") for i in range(1500)] + [("b", "x")], "key string, item string")
    got = sampling.capped_sample(df, "key", "item", 1200, 5000, 7).collect()
    assert sorted(r.item for r in got if r.key == "a") == [f"{i:05d}" for i in range(1200)] and len(got) == 1201


@pytest.mark.parametrize("values", [np.random.default_rng(1).lognormal(5, 1, 500), np.repeat([1.0, 2.0, 3.0], [400, 50, 50])])
def test_quantile_bins_match_qcut(spark, values):
    df = sampling.quantile_bins(spark.createDataFrame(pd.DataFrame({"i": range(len(values)), "v": values})), "v", 12)
    got = df.toPandas().sort_values("i")["bin"].to_numpy()
    assert (got == pd.qcut(values, 12, labels=False, duplicates="drop") + 1).all()


def test_bin_sample_takes_all_of_a_small_bin(spark):
    df = spark.createDataFrame([(i, 1 if i < 3 else 2) for i in range(50)], "k int, bin int")
    got = sampling.bin_sample(df, "k", "bin", quotas_of(spark, {1: 5, 2: 7}), 7, 42)
    assert Counter(r.bin for r in got.collect()) == {1: 3, 2: 7}
    again = sampling.bin_sample(df.repartition(5), "k", "bin", quotas_of(spark, {1: 5, 2: 7}), 7, 42)
    assert {r.k for r in again.collect()} == {r.k for r in got.collect()}


def test_stratified_sample(spark):
    df = spark.createDataFrame(photo_frame(spark))
    got = sampling.stratified_sample(df, "label", "zpid", "image_path", ROOMS, 20, 42).toPandas()
    assert got.groupby("label").size().max() <= 20
    assert not got.duplicated(["label", "zpid"]).any()
    short = sampling.shortfalls(df.filter("label = 'kitchen'"), "label", ("kitchen", "attic"), 1).collect()
    assert [tuple(r) for r in short] == [("attic", 0)]


def test_two_pass_sample_tops_up(spark):
    rows = [("kitchen", z, f"p{z}-{i}", 1 if z < 2 else 2) for z in range(40) for i in range(3)]
    rows += [("bathroom", z, f"q{z}", 1) for z in range(4)]
    df = spark.createDataFrame(rows, "label string, zpid int, image_path string, bin int")
    got = sampling.two_pass_sample(df, "label", "zpid", "image_path", "bin", 10, quotas_of(spark, {1: 5, 2: 5}), 42).toPandas()
    kitchen = got[got.label == "kitchen"]
    assert len(kitchen) == 10 and kitchen.zpid.is_unique
    assert Counter(zip(kitchen.bin, kitchen.pass_no)) == {(1, 1): 2, (2, 1): 5, (2, 2): 3}
    assert len(got[got.label == "bathroom"]) == 4


def test_coverage_prefix(spark):
    pdf = photo_frame(spark)
    got = sampling.coverage_prefix(spark.createDataFrame(pdf).repartition(6), "zpid", "image_path", "label", ROOMS)
    want = set()
    for _, part in pdf.sort_values("image_path").groupby("zpid"):
        seen = set()
        for row in part.itertuples():
            if seen >= set(ROOMS):
                break
            want.add(row.image_path)
            seen.add(row.label)
    assert {r.image_path for r in got.collect()} == want


@pytest.mark.parametrize("target,cap", [(3, 10_000), (1000, 40), (1000, 10_000)])
def test_quota_prefix(spark, target, cap):
    pdf = photo_frame(spark, hot=20)
    df = spark.createDataFrame(pdf)
    got = {r.zpid: r for r in sampling.quota_prefix(df, "zpid", "label", ROOMS, target, cap, 42).collect()}
    order = [r.zpid for r in df.select("zpid").distinct().orderBy(F.md5(F.concat(F.lit("42|"), F.col("zpid").cast("string")))).collect()]
    used, seen, want = 0, {r: set() for r in ROOMS}, {}
    for z in order:
        if used >= cap or all(len(v) >= target for v in seen.values()):
            break
        part = pdf[pdf.zpid == z]
        want[z] = min(len(part), cap - used)
        used += len(part)
        for label in set(part.label) & set(ROOMS):
            seen[label].add(z)
    assert {z: r.calls_allowed for z, r in got.items()} == want
    assert sorted(r.position for r in got.values()) == list(range(1, len(want) + 1))


def test_capped_sample(spark):
    got = sampling.capped_sample(spark.createDataFrame(photo_frame(spark)), "zpid", "image_path", 6, 50, 7).toPandas()
    assert len(got) == 50 and got.groupby("zpid").size().max() <= 6


def test_chunk_plan_is_stable(spark):
    df = spark.createDataFrame(photo_frame(spark))
    plans = [{r.image_path: r.chunk_id for r in sampling.chunk_plan(d, "image_path", 50).collect()} for d in (df, df.repartition(9))]
    assert plans[0] == plans[1]
    for i, path in enumerate(sorted(plans[0])):
        assert plans[0][path] == f"full_{i // 50:03d}"
    assert sampling.rows_per_chunk() == 11_539


def test_folds(spark):
    df = spark.range(1000)
    hashed = Counter(r.fold for r in sampling.kfold(df, "id").collect())
    assert set(hashed) == set(range(5)) and min(hashed.values()) > 140
    assert set(Counter(r.fold for r in sampling.balanced_kfold(df, "id").collect()).values()) == {200}


def test_rater_order_and_freeze(spark, tmp_path):
    subset = spark.createDataFrame([(f"p{i}",) for i in range(12)], "image_path string")
    order = sampling.rater_order(subset, ["ann", "bo"], "rater", "image_path")
    lists = {}
    for r in order.orderBy("position").collect():
        lists.setdefault(r.rater, []).append(r.image_path)
    assert sorted(lists["ann"]) == sorted(lists["bo"]) and lists["ann"] != lists["bo"]
    done = spark.createDataFrame([("ann", lists["ann"][0]), ("ann", lists["ann"][2])] + [("bo", p) for p in lists["bo"]], "rater string, image_path string")
    state = {r.rater: tuple(r)[1:] for r in sampling.next_unrated(order, done, "rater", "image_path").collect()}
    assert state == {"ann": (1, 2, 12), "bo": (12, 12, 12)}
    path = str(tmp_path / "subset")
    sampling.freeze(spark, subset, path)
    assert sampling.freeze(spark, subset.limit(1), path).count() == 12


def test_custom_rows_are_padded(spark):
    a = spark.createDataFrame([("k", "1", 3)], "room string, zpid string, bin int")
    b = spark.createDataFrame([("k", "custom_x")], "room string, zpid string")
    assert [tuple(r) for r in sampling.with_custom_rows(a, b).collect()] == [("k", "1", 3, "sampled"), ("k", "custom_x", None, "custom")]
