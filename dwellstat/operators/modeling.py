"""Price models: feature matrix, seed-averaged cross-validation, metrics, blends, importances.

Fits and predictions are Spark ML jobs; the loops below only decide which fits to launch.
Predictions are long tables (learner, fold, seed, row, prediction), so every later figure is an
ordinary aggregate.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellstat.operators import boosting, fits as fitting, ordering, sampling
from dwellstat.session import scratch_path, staged

#: Codes of a category column that keep a bin of their own.
MOST_CODES = 500
#: Seeds whose predictions are averaged.
SEEDS = tuple(range(42, 47))
#: Code of a category without a value.
MISSING = "missing"


@dataclass(frozen=True)
class FeatureSpec:
    """Columns of the feature matrix. ``groups`` names feature groups for ablation and reports."""

    numeric: Sequence[str]
    categorical: Sequence[str] = ()
    groups: dict[str, Sequence[str]] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    def without(self, *dropped: str) -> FeatureSpec:
        gone = set(dropped)
        return FeatureSpec(
            [c for c in self.numeric if c not in gone],
            [c for c in self.categorical if c not in gone],
            {g: [c for c in cols if c not in gone] for g, cols in self.groups.items()},
        )

    def group_of(self, name: str) -> str:
        return next((g for g, cols in self.groups.items() if name in cols), "")


def prepared(df: DataFrame, spec: FeatureSpec, key: str, target: str) -> DataFrame:
    """Rows with a positive target, its logarithm, numeric features as doubles and missing flags.

    Spark ML trees reject missing values, so a flag keeps what imputation would hide.
    """
    kept = df.filter(F.col(target) > 0)
    numeric = [F.col(c).cast("double").alias(c) for c in spec.numeric]
    flags = [F.col(c).isNull().cast("double").alias(f"{c}__missing") for c in spec.numeric]
    codes = [F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c) for c in spec.categorical]
    return kept.select(key, F.col(target).cast("double").alias("price"), F.ln(target).alias("y_log"), *numeric, *flags, *codes)


def frequent_codes(train: DataFrame, column: str, most: int = MOST_CODES) -> list[str]:
    """The most frequent codes of a column, at most ``most`` as trees need a bin per code; equal counts go by code."""
    counts = train.groupBy(F.col(f"`{column}`").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return [r.code for r in counts.orderBy(F.desc("n"), "code").limit(most).collect()]


def feature_stages(spec: FeatureSpec, train: DataFrame) -> list:
    """Stages of the feature vector; codes that are not frequent in ``train`` get one index together."""
    stages: list = [
        StringIndexerModel.from_labels(frequent_codes(train, c), inputCol=c, outputCol=f"{c}__index", handleInvalid="keep")
        for c in spec.categorical
    ]
    stages.append(Imputer(inputCols=list(spec.numeric), outputCols=[f"{c}__filled" for c in spec.numeric], strategy="mean"))
    stages.append(VectorAssembler(inputCols=vector_slots(spec), outputCol="features"))
    return stages


def vector_slots(spec: FeatureSpec) -> list[str]:
    return (
        [f"{c}__filled" for c in spec.numeric]
        + [f"{c}__missing" for c in spec.numeric]
        + [f"{c}__index" for c in spec.categorical]
    )


Learner = Callable[[int], object]


def spark_boosted_trees(trees: int = 2000, depth: int = 7, step: float = 0.02, max_bins: int = 512) -> Learner:
    """Boosted trees on absolute error with row and column subsampling."""
    return lambda seed: GBTRegressor(
        labelCol="y_log", lossType="absolute", maxIter=trees, maxDepth=depth, stepSize=step, maxBins=max_bins,
        subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=3, seed=seed,
    )


def random_forest(trees: int = 100, depth: int = 7, max_bins: int = 512) -> Learner:
    return lambda seed: RandomForestRegressor(
        labelCol="y_log", numTrees=trees, maxDepth=depth, maxBins=max_bins, subsamplingRate=0.8,
        featureSubsetStrategy="0.8", minInstancesPerNode=3, seed=seed,
    )


def linear(regularisation: float = 0.01) -> Learner:
    return lambda seed: LinearRegression(labelCol="y_log", regParam=regularisation, solver="normal")


@dataclass
class Fit:
    learner: str
    fold: int
    seed: int
    model: PipelineModel


def fit_fold(data: DataFrame, spec: FeatureSpec, learners: dict[str, Learner], fold: int, seeds: Sequence[int] = SEEDS) -> list[Fit]:
    """One model per learner and seed, trained on the rows of the other folds.

    The feature stages, the frequent codes among them, are fitted on those rows once. The matrix is
    kept on disk, as several folds are fitted at a time and each would hold its own in memory.
    """
    train = data.filter(F.col("fold") != fold)
    prepare = Pipeline(stages=feature_stages(spec, train)).fit(train)
    matrix = prepare.transform(train).select("y_log", "features").persist(StorageLevel.DISK_ONLY)
    fits = [Fit(name, fold, seed, PipelineModel(stages=[*prepare.stages, make(seed).fit(matrix)]))
            for name, make in learners.items() for seed in seeds]
    matrix.unpersist()
    return fits


def fit_folds(data: DataFrame, spec: FeatureSpec, learners: dict[str, Learner], folds: int = 5, seeds: Sequence[int] = SEEDS) -> list[Fit]:
    """The models of every fold; ``data`` needs a ``fold`` column."""
    return [fit for fold in range(folds) for fit in fit_fold(data, spec, learners, fold, seeds)]


def predict_folds(data: DataFrame, fits: Sequence[Fit], key: str, train_too: bool = False) -> DataFrame:
    """Long predictions: learner, fold, seed, part (test/train), key, price, y_log, pred_log."""
    tables = []
    for fit in fits:
        rows = data if train_too else data.filter(F.col("fold") == fit.fold)
        part = F.when(F.col("fold") == fit.fold, F.lit("test")).otherwise(F.lit("train"))
        tables.append(
            fit.model.transform(rows).select(
                F.lit(fit.learner).alias("learner"), F.lit(fit.fold).alias("fold"), F.lit(fit.seed).alias("seed"),
                part.alias("part"), key, "price", "y_log", F.col("prediction").alias("pred_log"),
            )
        )
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def seed_average(predictions: DataFrame, key: str) -> DataFrame:
    """Mean prediction over seeds, in log space."""
    return predictions.groupBy("learner", "fold", "part", key).agg(
        F.avg("pred_log").alias("pred_log"), F.first("y_log").alias("y_log"), F.first("price").alias("price")
    )


def fold_metrics(predictions: DataFrame, by: Sequence[str] = ("learner", "part")) -> DataFrame:
    """Log RMSE and exact median percent difference per fold."""
    by = list(by)
    pct = F.abs(F.exp("pred_log") - F.col("price")) / F.col("price") * 100
    errors = predictions.withColumns({"pct_diff": pct, "_sq": F.pow(F.col("pred_log") - F.col("y_log"), 2)})
    rmse = errors.groupBy(*by, "fold").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg("_sq")).alias("log_rmse"))
    middle = ordering.medians(errors, "pct_diff", [*by, "fold"]).withColumnRenamed("median", "median_pct")
    return rmse.join(middle, [*by, "fold"])


def metric_summary(folds: DataFrame, by: Sequence[str] = ("learner", "part")) -> DataFrame:
    """Mean and population deviation over folds."""
    return folds.groupBy(*by).agg(
        F.avg("log_rmse").alias("log_rmse_mean"), F.stddev_pop("log_rmse").alias("log_rmse_std"),
        F.avg("median_pct").alias("median_pct_mean"), F.stddev_pop("median_pct").alias("median_pct_std"),
    )


def blends(predictions: DataFrame, learners: Sequence[str], key: str) -> DataFrame:
    """Equal-weight means of every non-empty set of learners; the set's name becomes ``learner``.

    Learners are put side by side first, so every blend is arithmetic within the row. A row some
    member of a set has no prediction for is left out of that blend.
    """
    sets = [c for size in range(1, len(learners) + 1) for c in itertools.combinations(range(len(learners)), size)]
    wide = predictions.groupBy("fold", "part", key).agg(
        *[F.max(F.when(F.col("learner") == n, F.col("pred_log"))).alias(f"p{i}") for i, n in enumerate(learners)],
        F.first("y_log").alias("y_log"), F.first("price").alias("price"),
    )
    mixed = F.array(
        *[F.struct(F.lit(" + ".join(learners[i] for i in s)).alias("learner"),
                   (sum(F.col(f"p{i}") for i in s) / len(s)).alias("pred_log")) for s in sets]
    )
    return wide.select("fold", "part", key, "y_log", "price", F.inline(mixed)).filter(F.col("pred_log").isNotNull())


def residual_correlation(predictions: DataFrame, learners: Sequence[str], key: str) -> DataFrame:
    """Correlation of out-of-fold residuals for every pair of learners."""
    residual = F.col("y_log") - F.col("pred_log")
    rows = predictions.groupBy("fold", key).agg(
        *[F.max(F.when(F.col("learner") == n, residual)).alias(f"r{i}") for i, n in enumerate(learners)]
    )
    pairs = list(itertools.combinations(range(len(learners)), 2))

    def guarded(i: int, j: int):
        a, b = F.col(f"r{i}"), F.col(f"r{j}")
        both = a.isNotNull() & b.isNotNull()
        a, b = F.when(both, a), F.when(both, b)
        return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))

    table = rows.agg(*[guarded(i, j).alias(f"c{i}_{j}") for i, j in pairs])
    cells = F.array(
        *[F.struct(F.lit(learners[i]).alias("first"), F.lit(learners[j]).alias("second"), F.col(f"c{i}_{j}").alias("correlation"))
          for i, j in pairs]
    )
    return table.select(F.inline(cells))


def gain_importance(spark, fits: Sequence[Fit], spec: FeatureSpec) -> DataFrame:
    """Importance per feature: mean over seeds, then folds, normalised to 1, highest first.

    A feature's vector slots (value, missing flag, index) are added up. The input is one number
    per model and slot, so it is small whatever the data size.
    """
    slots = vector_slots(spec)
    rows = []
    for fit in fits:
        weights = fit.model.stages[-1].featureImportances.toArray()
        rows += [(fit.learner, fit.fold, fit.seed, slot.rsplit("__", 1)[0], float(w)) for slot, w in zip(slots, weights)]
    long = spark.createDataFrame(rows, "learner string, fold int, seed int, feature string, gain double")
    return normalised_importance(long)


def normalised_importance(long: DataFrame) -> DataFrame:
    """(learner, fold, seed, feature, gain) rows → normalised importance, highest first."""
    per_seed = long.groupBy("learner", "fold", "seed", "feature").agg(F.sum("gain").alias("gain"))
    per_fold = per_seed.groupBy("learner", "fold", "feature").agg(F.avg("gain").alias("gain"))
    per_feature = per_fold.groupBy("learner", "feature").agg(F.avg("gain").alias("gain"))
    totals = per_feature.groupBy("learner").agg(F.sum("gain").alias("_all"))
    return (
        per_feature.join(totals, "learner")
        .select("learner", "feature", F.try_divide("gain", "_all").alias("importance"))
        .orderBy("learner", F.desc("importance"), "feature")
    )


def shuffled_copy(rows: DataFrame, key: str, columns: Sequence[str], seed, prefix: str = "shuffled_", within: Sequence[str] = ()) -> DataFrame:
    """Adds a permuted copy of each column: row i of one seeded order gets the values of row i of
    another, ``within`` groups if there are any. Both orders are numbered in buckets, so a group's
    permutation is distributed."""
    base = ordering.seeded_row_numbers(rows, f"{seed}-base", [key], within, name="_rn")
    other = ordering.seeded_row_numbers(rows.select(key, *within, *columns), f"{seed}-other", [key], within, name="_rn")
    return base.join(other.select("_rn", *within, *[F.col(c).alias(f"{prefix}{c}") for c in columns]), ["_rn", *within]).drop("_rn")


def _inputs(spec: FeatureSpec) -> list[str]:
    return [*spec.numeric, *[f"{c}__missing" for c in spec.numeric], *spec.categorical]


def _swapped(test: DataFrame, spec: FeatureSpec, key: str, seed: str) -> DataFrame:
    """Every test row once as it is (feature '') and once per feature with that feature's values shuffled."""
    inputs = _inputs(spec)
    owner = {c: c.rsplit("__missing", 1)[0] for c in inputs}
    names = F.array(F.lit(""), *[F.lit(n) for n in spec.names])
    mixed = shuffled_copy(test, key, inputs, seed, within=["fold"]).withColumn("feature", F.explode(names))
    return mixed.withColumns({c: F.when(F.col("feature") == owner[c], F.col(f"shuffled_{c}")).otherwise(F.col(c)) for c in inputs})


def permutation_importance(data: DataFrame, fits: Sequence[Fit] | boosting.Fitted, spec: FeatureSpec, key: str, shuffles: int = 6,
                           learner: str = "boosted") -> DataFrame:
    """Loss of accuracy when one feature is scrambled: mean and deviation over folds, seeds and shuffles.

    Every test row is repeated once per feature with that feature replaced, so one transform per
    fit and shuffle scores all features. Boosted models score a row beside its shuffled copy, a
    shuffle at a time, and share among the features what replacing one of them leaves as it is.
    """
    tables = []
    if isinstance(fits, boosting.Fitted):
        held_out = data.filter(F.col("fold").isin([f for f, _ in fits.models]))
        for shuffle in range(shuffles):
            rows = shuffled_copy(held_out, key, _inputs(spec), str(shuffle), within=["fold"])
            rows = _missing_as_null(_missing_as_null(rows, spec), spec, "shuffled_")
            scores = boosting.held_out_scores(rows, fits, spec.numeric, spec.categorical, swapped="shuffled_")
            tables.append(scores.select(F.lit(learner).alias("learner"), "fold", "seed", F.lit(shuffle).alias("shuffle"), "feature", "price", "y_log", "pred_log"))
    else:
        for fit in fits:
            test = data.filter(F.col("fold") == fit.fold)
            for shuffle in range(shuffles):
                swapped = _swapped(test, spec, key, f"{fit.fold}-{shuffle}")
                tables.append(
                    fit.model.transform(swapped).select(
                        F.lit(fit.learner).alias("learner"), F.lit(fit.fold).alias("fold"), F.lit(fit.seed).alias("seed"),
                        F.lit(shuffle).alias("shuffle"), "feature", "price", "y_log", F.col("prediction").alias("pred_log"),
                    )
                )
    scored = staged(functools.reduce(DataFrame.unionByName, tables), "permuted")
    per_run = ["learner", "seed", "shuffle"]
    metrics = fold_metrics(scored, [*per_run, "feature"])
    base = metrics.filter(F.col("feature") == "").select(
        *per_run, "fold", F.col("log_rmse").alias("_rmse"), F.col("median_pct").alias("_pct")
    )
    deltas = metrics.filter(F.col("feature") != "").join(base, [*per_run, "fold"]).withColumns(
        {"d_pct": F.col("median_pct") - F.col("_pct"), "d_rmse": F.col("log_rmse") - F.col("_rmse")}
    )
    group = F.create_map(*[F.lit(v) for n in spec.names for v in (n, spec.group_of(n))])
    return (
        deltas.groupBy("learner", "feature")
        .agg(F.avg("d_pct").alias("d_median_pct"), F.stddev_pop("d_pct").alias("d_median_pct_std"), F.avg("d_rmse").alias("d_log_rmse"))
        .withColumn("feature_group", F.try_element_at(group, F.col("feature")))
    )


def training_table(df: DataFrame, spec: FeatureSpec, key: str, target: str, folds: int = 5) -> DataFrame:
    """Prepared rows with folds, written once to the shared folder.

    Every fit and prediction starts from that copy, so a lost executor costs a re-read instead of
    the enrichment joins.
    """
    return staged(sampling.kfold(prepared(df, spec, key, target), key, folds), "training")


def _variant(learner: Learner | boosting.Boosting, seed: int):
    return learner if isinstance(learner, boosting.Boosting) else learner(seed)


def boosted(data: DataFrame, spec: FeatureSpec, key: str, settings: boosting.Boosting, models: Sequence[tuple[int, int]]) -> boosting.Fitted:
    """The models (fold, seed) of one setting, grown together; missing codes count as missing values."""
    return boosting.fit(_missing_as_null(data, spec), key, spec.numeric, spec.categorical, models, settings)


def _missing_as_null(data: DataFrame, spec: FeatureSpec, prefix: str = "") -> DataFrame:
    return data.withColumns({f"{prefix}{c}": F.nullif(F.col(f"{prefix}{c}"), F.lit(MISSING)) for c in spec.categorical})


def predictions_of(data: DataFrame, spec: FeatureSpec, key: str, learners: dict[str, Learner | boosting.Boosting], folds: int, seeds: Sequence[int],
                   store: str | None = None, at_once: int = 4) -> DataFrame:
    """Long predictions of every learner, fold and seed for all rows of ``data``, which has folds.

    What ``store`` already holds for the same content is read; the rest is fitted, ``at_once`` fits at
    a time (boosted models of one learner grow together and are one job), and stored. Without a
    folder, the store lasts for this call only.
    """
    found, keys = _fitted(data, spec, key, learners, folds, seeds, store, at_once)
    return found.get(keys)


def averages_of(data: DataFrame, spec: FeatureSpec, key: str, learners: dict[str, Learner | boosting.Boosting], folds: int, seeds: Sequence[int],
                store: str | None = None, at_once: int = 4, train_too: bool = False) -> DataFrame:
    """The same predictions averaged over the seeds, in log space; of held-out rows only unless ``train_too``."""
    found, keys = _fitted(data, spec, key, learners, folds, seeds, store, at_once)
    return found.averaged(keys, functools.partial(seed_average, key=key), train_too)


def _fitted(data: DataFrame, spec: FeatureSpec, key: str, learners: dict[str, Learner | boosting.Boosting], folds: int, seeds: Sequence[int],
            store: str | None, at_once: int) -> tuple[fitting.PredictionStore, list[fitting.FitKey]]:
    """The store with all the fits, and their keys."""
    spark = data.sparkSession
    found, planned = _planned(data, spec, key, learners, folds, seeds, store or scratch_path(spark, "predictions"))
    jobs: list[fitting.Job] = []
    for name, learner in learners.items():
        missing = [k for n, k, stored in planned if n == name and not stored]
        if isinstance(learner, boosting.Boosting):
            if missing:
                jobs.append(functools.partial(_store_boosted, found, data, spec, key, learner, missing))
        else:
            for fold in sorted({k.fold for k in missing}):
                jobs.append(functools.partial(_store_fold, found, data, spec, key, name, learner, fold, [k for k in missing if k.fold == fold]))
    fitting.run_jobs(spark, jobs, at_once)
    return found, [k for _, k, _ in planned]


def missing_fits(data: DataFrame, spec: FeatureSpec, key: str, learners: dict[str, Learner | boosting.Boosting], folds: int, seeds: Sequence[int],
                 store: str) -> int:
    """How many fits a run with this store would start."""
    return sum(not stored for _, _, stored in _planned(data, spec, key, learners, folds, seeds, store)[1])


def _planned(data: DataFrame, spec: FeatureSpec, key: str, learners: dict, folds: int, seeds: Sequence[int], store: str):
    """(the store, a (learner, key, whether stored) per fit)."""
    kinds = dict(data.dtypes)
    found = fitting.PredictionStore(data.sparkSession, store, f"part string, `{key}` {kinds[key]}, price double, y_log double, pred_log double", key)
    digest = fitting.table_digest(data)
    keys = [(name, fitting.fit_key(digest, spec.names, name, fitting.settings_of(_variant(learner, s)), f, s, folds))
            for name, learner in learners.items() for f in range(folds) for s in seeds]
    return found, [(name, k, stored) for (name, k), stored in zip(keys, found.stored([k for _, k in keys]))]


def _store_boosted(found: fitting.PredictionStore, data: DataFrame, spec: FeatureSpec, key: str, learner: boosting.Boosting, keys: list) -> None:
    found.put_together(keys, boosted(data, spec, key, learner, [(k.fold, k.seed) for k in keys]).scores)


def _store_fold(found: fitting.PredictionStore, data: DataFrame, spec: FeatureSpec, key: str, name: str, learner: Learner, fold: int, keys: list) -> None:
    for k, fit in zip(keys, fit_fold(data, spec, {name: learner}, fold, [k.seed for k in keys])):
        found.put(k, predict_folds(data, [fit], key, train_too=True))


def cross_validate(df: DataFrame, spec: FeatureSpec, key: str, target: str, learners: dict[str, Learner | boosting.Boosting],
                   folds: int = 5, seeds: Sequence[int] = SEEDS, train_too: bool = False, store: str | None = None, at_once: int = 4):
    """(prepared data with folds, seed-averaged predictions)."""
    data = training_table(df, spec, key, target, folds)
    # written once: metrics, blends and correlations read averages instead of every seed
    return data, staged(averages_of(data, spec, key, learners, folds, seeds, store, at_once, train_too), "predictions")


def sweep(df: DataFrame, spec: FeatureSpec, key: str, target: str, configs: dict[str, Learner | boosting.Boosting],
          folds: int = 5, seeds: Sequence[int] = SEEDS, store: str | None = None, at_once: int = 4) -> DataFrame:
    """Metrics of every named configuration on the same folds; the first is the baseline."""
    _, predictions = cross_validate(df, spec, key, target, configs, folds, seeds, store=store, at_once=at_once)
    summary = metric_summary(fold_metrics(predictions))
    return _against_baseline(summary, next(iter(configs)))


def ablation(df: DataFrame, spec: FeatureSpec, key: str, target: str, learner: Learner | boosting.Boosting, folds: int = 5,
             seeds: Sequence[int] = SEEDS, store: str | None = None, at_once: int = 4) -> DataFrame:
    """Metrics with all features and without each feature group, on the same folds."""
    variants = {"all": spec, **{f"without {g}": spec.without(*cols) for g, cols in spec.groups.items()}}
    data = training_table(df, spec, key, target, folds)
    tables = [averages_of(data, variant, key, {name: learner}, folds, seeds, store, at_once)
              for name, variant in variants.items()]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return _against_baseline(metric_summary(fold_metrics(staged(out, "predictions"))), "all")


def _against_baseline(summary: DataFrame, baseline: str) -> DataFrame:
    base = summary.filter(F.col("learner") == baseline).agg(
        F.struct(F.max("median_pct_mean").alias("pct"), F.max("log_rmse_mean").alias("rmse"))
    ).scalar()
    return summary.withColumn("_base", base).withColumns(
        {"d_median_pct": F.col("median_pct_mean") - F.col("_base.pct"), "d_log_rmse": F.col("log_rmse_mean") - F.col("_base.rmse")}
    ).drop("_base")
