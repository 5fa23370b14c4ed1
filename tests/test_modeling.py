import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dwellstat.operators import boosting, fits, modeling

SPEC = modeling.FeatureSpec(numeric=("size", "noise"), categorical=("hood",), groups={"home": ("size", "hood"), "junk": ("noise",)})


@pytest.fixture(scope="module")
def homes(spark):
    rng = np.random.default_rng(6)
    n = 400
    size, hood = rng.uniform(1, 3, n), rng.integers(0, 4, n)
    price = np.exp(10 + size + 0.3 * hood + rng.normal(0, 0.05, n))
    pdf = pd.DataFrame({"zpid": np.arange(n), "size": np.where(rng.random(n) < 0.05, np.nan, size), "noise": rng.normal(size=n),
                        "hood": [f"h{h}" for h in hood], "sold_price": np.where(np.arange(n) % 50 == 0, 0.0, price)})
    df = spark.createDataFrame(pdf)
    from dwellstat.functions import text
    return df.withColumn("size", text.finite_or_null("size"))


def trees():
    return boosting.Boosting(trees=6, depth=4, step=0.3, bins=32)


def test_cross_validation(spark, homes, tmp_path):
    learners = {"t": trees(), "line": modeling.linear()}
    run = lambda: modeling.cross_validate(homes, SPEC, "zpid", "sold_price", learners, folds=2, seeds=(1, 2), train_too=True, store=str(tmp_path))
    data, predictions = run()
    assert data.count() == 392
    metrics = {(r.learner, r.part): r for r in modeling.metric_summary(modeling.fold_metrics(predictions)).collect()}
    assert set(metrics) == {(l, p) for l in learners for p in ("train", "test")} and metrics["t", "test"].log_rmse_mean < 0.6
    assert modeling.missing_fits(data, SPEC, "zpid", learners, 2, (1, 2), str(tmp_path)) == 0
    again = run()[1]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, predictions.collect()))
    fitted = modeling.boosted(data, SPEC, "zpid", trees(), [(f, s) for f in (0, 1) for s in (1, 2)])
    gains = modeling.normalised_importance(fitted.gains("t")).toPandas()
    assert gains.importance.sum() == pytest.approx(1.0) and gains.feature.iloc[0] == "size"
    scrambled = {r.feature: r for r in modeling.permutation_importance(data, fitted, SPEC, "zpid", shuffles=1).collect()}
    assert scrambled["size"].d_log_rmse > scrambled["noise"].d_log_rmse and scrambled["size"].feature_group == "home"


def test_spark_trees(spark, homes):
    learner = {"s": modeling.spark_boosted_trees(trees=3, depth=3, step=0.3, max_bins=32)}
    data = modeling.training_table(homes, SPEC, "zpid", "sold_price", 2)
    fits = modeling.fit_folds(data, SPEC, learner, folds=2, seeds=(1,))
    gains = modeling.gain_importance(spark, fits, SPEC).toPandas()
    assert gains.importance.sum() == pytest.approx(1.0)
    scrambled = {r.feature: r for r in modeling.permutation_importance(data, fits[:1], SPEC, "zpid", shuffles=1).collect()}
    assert scrambled["size"].d_log_rmse > scrambled["noise"].d_log_rmse


def test_store_goes_by_content(spark, homes, tmp_path):
    line = {"line": modeling.linear(0.0)}
    missing = lambda df, learners=line, spec=SPEC, seeds=(1, 2): modeling.missing_fits(
        modeling.training_table(df, spec, "zpid", "sold_price", 2), spec, "zpid", learners, 2, seeds, str(tmp_path))
    assert missing(homes) == 4
    modeling.predictions_of(modeling.training_table(homes, SPEC, "zpid", "sold_price", 2), SPEC, "zpid", line, 2, (1, 2), str(tmp_path))
    assert missing(homes) == 0 and missing(homes.repartition(7)) == 0 and missing(homes, seeds=(1, 2, 3)) == 2
    assert missing(homes, {"renamed": modeling.linear(0.0)}) == 0
    assert missing(homes, {"line": modeling.linear(0.1)}) == 4
    assert missing(homes, spec=SPEC.without("noise")) == 4
    assert missing(homes.where("zpid <> 7")) == 4 and missing(homes.unionByName(homes.where("zpid = 7"))) == 4


def test_fits_run_side_by_side_and_failures_stop_them(spark):
    import threading
    barrier = threading.Barrier(3, timeout=60)
    assert fits.run_jobs(spark, [lambda i=i: (barrier.wait(), i)[1] for i in range(3)], 3) == [0, 1, 2]
    begun = []

    def job(i):
        begun.append(i)
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        fits.run_jobs(spark, [lambda i=i: job(i) for i in range(5)], 1)
    assert begun == [0]


def test_missing_values_go_where_they_gain(spark):
    """Missing sizes are dear here, so they belong with the large ones."""
    rows = [(i, float(i % 10) if i % 4 else None, 0.0 if i % 4 and i % 10 < 5 else 5.0) for i in range(400)]
    df = spark.createDataFrame([(i, x, 1.0, y + (i % 3) / 100, i // 20 % 2) for i, x, y in rows], "k long, x double, price double, y_log double, fold int")
    fitted = boosting.fit(df, "k", ["x"], [], [(0, 1), (1, 1)], boosting.Boosting(trees=1, depth=1, step=1.0, row_share=1.0))
    tree = fitted.trees[0][0]
    assert tree.feature[1] == 0 and not tree.missing_left[1]
    got = {r.k: r.pred_log for r in fitted.predictions("t").collect()}
    assert len(got) == 400 and all(abs(got[i] - y) < 0.1 for i, _, y in rows)


def test_codes_never_trained_on_and_empty_rows(spark):
    rows = [(i, "ab"[i % 2] if i < 40 else "z", 1.0, float(i % 2), 0 if i >= 40 else 1 + i % 2) for i in range(50)] + [(99, None, None, None, 1)]
    df = spark.createDataFrame(rows, "k long, c string, price double, y_log double, fold int")
    fitted = boosting.fit(df, "k", [], ["c"], [(0, 1)], boosting.Boosting(trees=2, depth=2, step=1.0, row_share=1.0))
    assert fitted.predictions("t").count() == 10 and fitted.predictions("t", train_too=True).count() == 51
    assert {round(r.pred_log, 6) for r in fitted.predictions("t", train_too=True).where("k < 40").collect()} == {0.0, 1.0}


def test_shuffled_copy_is_a_permutation(spark, homes):
    mixed = modeling.shuffled_copy(homes.select("zpid", "noise"), "zpid", ["noise"], 3).toPandas()
    assert np.allclose(sorted(mixed.noise), sorted(mixed.shuffled_noise)) and (mixed.noise != mixed.shuffled_noise).mean() > 0.9


def test_spec_without():
    assert SPEC.without("size", "hood").names == ["noise"]


def test_leaf_medians_are_exact_and_few_rows_leave_the_tasks(spark, monkeypatch):
    """Lower medians whatever the sign, ties and spread of the residuals; leaves beyond the limit take more passes."""
    rng = np.random.default_rng(2)
    y = np.concatenate([rng.normal(size=301), np.repeat([0.25, -0.0, 0.0], 100), rng.normal(size=300) * 1e-9, 1 + rng.random(400) / 1e6])
    leaf = np.arange(len(y)) % 3
    df = spark.createDataFrame([(int(i), float(leaf[i]), 1.0, float(v), 1) for i, v in enumerate(y)], "k long, x double, price double, y_log double, fold int").repartition(4)
    for most in (5, 50_000):
        monkeypatch.setattr(boosting, "LEAF_VALUES", most)
        plans = boosting.bin_plans(df, ["x"], [], [0], 8)
        state = boosting.binned(df, "k", ["x"], [], plans).selectExpr("*", "X'' AS pred")
        tree = boosting.Tree.blank(2)
        tree.feature[[1, 3]], tree.cut[[1, 3]] = 0, (1, 2)
        level = boosting._Level([(0, 1)], [0], 1, boosting.Boosting(row_share=1.0), [[]], [tree], 0, [0.0])
        got = {node: value for _, node, value in boosting._leaf_values(state, level)}
        assert got == {node: np.sort(y[leaf == i])[(sum(leaf == i) - 1) // 2] for i, node in enumerate((2, 6, 7))}
    plan = boosting.fit(df, "k", ["x"], [], [(0, 1)], boosting.Boosting(trees=1, depth=1)).scores._jdf.queryExecution().optimizedPlan().toString()
    assert "pred" in plan  # the last scores are a plan, not another copy of the table


def test_only_models_that_held_a_row_out_score_it(spark, homes, monkeypatch):
    data = modeling.training_table(homes, SPEC, "zpid", "sold_price", 2)
    fitted = modeling.boosted(data, SPEC, "zpid", trees(), [(f, s) for f in (0, 1) for s in (1, 2)])
    rows = modeling._missing_as_null(data, SPEC)
    got = {(r.zpid, r.fold, r.seed): r.pred_log for r in boosting.held_out_scores(rows, fitted, SPEC.numeric, SPEC.categorical, ["zpid"]).collect()}
    want = {(r.zpid, r.fold, r.seed): r.pred_log for r in fitted.predictions("t").collect()}
    assert got.keys() == want.keys() and len(got) == 784 and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_fits_that_grew_together_are_stored_in_one_table(spark, homes, tmp_path):
    data = modeling.training_table(homes, SPEC, "zpid", "sold_price", 2)
    learner = {"t": trees()}
    rows = modeling.predictions_of(data, SPEC, "zpid", learner, 2, (1, 2), str(tmp_path))
    assert len(list(tmp_path.glob("together-*"))) == 1 and not list(tmp_path.glob("[0-9a-f]" * 64))
    want = {(r.fold, r.part, r.zpid): r for r in modeling.seed_average(rows, "zpid").collect()}
    averages = modeling.averages_of(data, SPEC, "zpid", learner, 2, (1, 2), str(tmp_path), train_too=True)
    assert "Aggregate" not in averages._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.fold, r.part, r.zpid): r for r in averages.collect()}
    assert got.keys() == want.keys() and all(abs(got[k].pred_log - want[k].pred_log) < 1e-9 and got[k].price == want[k].price for k in want)


def test_repeated_and_null_keys_are_averaged_together(spark, homes, tmp_path):
    twice = homes.withColumn("zpid", F.when(F.col("zpid") % 9 != 0, F.col("zpid"))).unionByName(homes.where("zpid % 5 = 1").withColumn("noise", F.lit(9.0)))
    data = modeling.training_table(twice, SPEC, "zpid", "sold_price", 2)
    learner = {"t": trees()}
    rows = modeling.predictions_of(data, SPEC, "zpid", learner, 2, (1, 2), str(tmp_path))
    averages = modeling.averages_of(data, SPEC, "zpid", learner, 2, (1, 2), str(tmp_path), train_too=True)
    table = lambda df: {(r.fold, r.part, r.zpid): r.pred_log for r in df.collect()}
    want, got = table(modeling.seed_average(rows, "zpid")), table(averages)
    assert averages.count() == len(want) and got == pytest.approx(want)


def test_apart_and_together_grow_the_same_trees(spark, homes, monkeypatch):
    data = modeling.training_table(homes.withColumn("hood", F.when(F.col("zpid") % 7 != 0, F.col("hood"))), SPEC, "zpid", "sold_price", 2)
    settings, models = boosting.Boosting(trees=3, depth=3, step=0.3, bins=32), [(0, 1), (1, 2)]
    monkeypatch.setattr(boosting, "KEEP", 2)
    grown = []
    for most in (0, 1000):
        monkeypatch.setattr(boosting, "APART_ROWS", most)
        fitted = modeling.boosted(data, SPEC, "zpid", settings, models)
        rows = sorted(map(tuple, fitted.predictions("t", train_too=True).collect()))
        grown.append((rows, {r[:-1]: r.gain for r in fitted.gains("t").collect()}, fitted.trees))
    (rows, gains, trees), (apart_rows, apart_gains, apart_trees) = grown
    assert rows == apart_rows and gains == pytest.approx(apart_gains) and [len(x) for x in apart_trees] == [3, 3]
    for one, other in zip(sum(trees, []), sum(apart_trees, [])):
        for part in ("feature", "cut", "missing_left", "value", "gain"):
            assert np.array_equal(getattr(one, part), getattr(other, part)), part
        assert {n: x.tolist() for n, x in one.left_codes.items()} == {n: x.tolist() for n, x in other.left_codes.items()}


def test_best_splits_of_all_nodes_are_those_of_each(spark):
    """With few rows and many ties: empty first bins, missing values on both sides, codes of equal signs."""
    rng = np.random.default_rng(8)
    settings = boosting.Boosting(least_rows=2)
    for _ in range(60):
        n, sizes = int(rng.integers(5, 60)), [12, 5, 6]
        bins = {f: (rng.integers(0, s, n) if f != 1 else rng.integers(2, s, n)).astype(np.int32) for f, s in enumerate(sizes)}
        place, sign = rng.integers(0, 3, n), rng.integers(0, 3, n)
        got = boosting._best_splits(bins, place, sign, 3, sizes, {2}, settings)
        for node in range(3):
            rows = [(f, b, int(-(sign[(place == node) & (x == b)] - 1).sum()), int(((place == node) & (x == b)).sum())) for f, x in bins.items() for b in np.unique(x[place == node])]
            want = boosting.best_split(*map(np.array, zip(*rows)), {2}, 2, settings.ridge) if rows else None
            if want is None:
                assert got.feature[node] == -1
                continue
            assert (got.gain[node], got.feature[node], got.cut[node], got.side[node]) == want[:4]
            assert want[1] != 2 or got.codes[node].tolist() == want[4].tolist()


def test_swapped_features_score_like_rows_with_that_value(spark, homes):
    """Trees of up to seven levels are scored by sets of leaves, deeper ones node by node."""
    data = modeling.training_table(homes.withColumn("hood", F.when(F.col("zpid") % 7 != 0, F.col("hood"))), SPEC, "zpid", "sold_price", 2)
    for depth in (3, 7, 8):
        fitted = modeling.boosted(data, SPEC, "zpid", boosting.Boosting(trees=3, depth=depth, step=0.3, bins=32), [(f, s) for f in (0, 1) for s in (1, 2)])
        mixed = modeling._missing_as_null(modeling.shuffled_copy(data, "zpid", modeling._inputs(SPEC), 5, within=["fold"]), SPEC)
        mixed = modeling._missing_as_null(mixed, SPEC, "shuffled_")
        read = lambda df, *more: {(r.zpid, r.seed, *[r[m] for m in more]): r.pred_log for r in df.collect()}
        got = read(boosting.held_out_scores(mixed, fitted, SPEC.numeric, SPEC.categorical, ["zpid"], "shuffled_"), "feature")
        assert len(got) == 392 * 2 * 4
        for feature in ("", "size", "noise", "hood"):
            rows = mixed.withColumn(feature, F.col(f"shuffled_{feature}")) if feature else mixed
            want = read(boosting.held_out_scores(rows, fitted, SPEC.numeric, SPEC.categorical, ["zpid"]))
            assert {k[:2]: x for k, x in got.items() if k[2] == feature} == want


def test_registered_fits_use_the_full_settings(spark, monkeypatch):
    from dwellstat.plans import catalog, model_queries
    seen = []

    def stop(*arguments, **named):
        seen.extend(x for x in arguments if isinstance(x, boosting.Boosting))
        seen.extend(v for x in arguments if isinstance(x, dict) for v in x.values())
        raise InterruptedError

    monkeypatch.setattr(model_queries, "model_rows", lambda *_: None)
    monkeypatch.setattr(modeling, "training_table", lambda *_: None)
    for name in ("cross_validate", "boosted", "ablation"):
        monkeypatch.setattr(modeling, name, stop)
    for name in ("gbt_cv", "ablation", "learner_blends", "gain_importance", "permutation"):
        seen.clear()
        with pytest.raises(InterruptedError):
            catalog.queries()[name](spark, "")
        assert boosting.Boosting(trees=2000, depth=7, step=0.02) in seen, name
        forests = [x(1) for x in seen if callable(x) and hasattr(x(1), "getNumTrees")]
        assert [(x.getNumTrees(), x.getMaxDepth(), x.getMaxBins()) for x in forests] == ([(100, 7, 512)] if name == "learner_blends" else [])


def test_counts_of_a_leaf_are_merged_as_batches_come(spark, monkeypatch):
    """A task with many batches holds a few counts a leaf, and the medians stay exact."""
    seen, merge = [], boosting._merged
    parts = lambda x: (seen.append(len(x)), merge(x))[1]
    monkeypatch.setattr(boosting, "_merged", parts)
    monkeypatch.setattr(boosting, "LEAF_PARTS", 3)
    rng = np.random.default_rng(5)
    y = rng.normal(size=600)

    class State:
        """Runs a task's function here, on batches of 20 rows."""

        def mapInArrow(self, function, schema):  # noqa: N802
            level_rows = [object()] * 30
            out = pd.concat([b.to_pandas() for b in function(iter(level_rows))])
            return spark.createDataFrame(out, schema)

    place = iter(range(10**6))

    def level(_):
        at = 20 * (next(place) % 30)
        yield 0, None, np.ones(20, np.int64), y[at:at + 20]

    assert boosting._leaf_values(State(), level) == [(0, 1, np.sort(y)[299])]
    assert seen and max(seen) <= 4


def test_fits_stored_side_by_side_keep_all_places(spark, tmp_path):
    store = fits.PredictionStore(spark, str(tmp_path), "part string, k long, price double, y_log double, pred_log double", "k")
    scores = spark.range(20).selectExpr("id AS k", "1D AS price", "0D AS y_log", "0 AS fold", "array(0.5D) AS pred")
    assert store.index() == {}
    keys = [fits.FitKey("t", 0, i, f"{i:064x}") for i in range(12)]
    fits.run_jobs(spark, [lambda k=k: store.put_together([k], scores) for k in keys], 6)
    assert store.stored(keys) == [True] * 12
    assert len(list(tmp_path.glob("index-*"))) == 12
