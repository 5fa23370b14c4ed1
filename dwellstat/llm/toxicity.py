"""Toxicity by a chain of linear classifiers.

The categories are label columns, predicted one after the other: the model of a category sees, beside
words, the log odds that the models before it gave. While training, those odds are out-of-fold
predictions, so a later model learns how far an earlier one can be trusted on unseen text.

Features say whether a word, or a word's beginning of ``PREFIXES`` bytes, occurs in the text at
least so many times (``LEVELS``); words are hashed to ``BITS`` bits. Each category keeps the ``SELECTED`` features that tell it apart best
by the likelihood ratio statistic, so text of any length is judged by telling words only.

Models are fitted on a bounded sample of labelled rows, at most ``FIT_ROWS`` for each value of the
last category, chosen by a hash of the id and weighted back to their share; features are counted and
models applied by tasks, and every document is scored on its whole text. The models are fitted in
one task, as the sample is bounded; the driver gets the models only.

Cases: a null, empty or wordless text has no features and gets the models' base rate; a label that
is null is not used for its category; of repeated labels of a document the largest counts; without
labels, or with one value only, a category's probability is that constant (0 without labels) and
nothing is rejected by it unless the constant is 1; null ids never match a label; repeated rows are
scored each; empty tables give no rows; other columns are ignored or kept whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellstat.llm import common, textkernel
from dwellstat.llm.common import packed, unpacked, written

#: Category -> expression over the label columns; the last one decides.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}
FIT_ROWS = 10_000
BITS = 20
PREFIXES = (4, 5, 6, 7)
#: Least numbers of occurrences that are features of their own.
LEVELS = (1, 2, 4)
SELECTED = 2000
#: Least number of documents with a selected feature, and least value of the statistic.
MIN_DOCS, MIN_G2 = 4, 12.0
FOLDS = 5
RIDGE = 0.1
STEPS = 200

common.by_value(__name__, textkernel.__name__)


class Model(NamedTuple):
    """Weights of one category: selected features, then the log odds of earlier categories, then the base.

    ``threshold`` is the chance from which the category is assigned.
    """

    features: np.ndarray
    weights: np.ndarray
    chained: np.ndarray
    base: float
    threshold: float = 0.5


def _features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text index, hashed feature) of every word and word beginning, repeats included."""
    body, offsets = textkernel.utf8(column, lower=True)
    mask = np.uint64((1 << BITS) - 1)
    for begin, part, starts, ends in textkernel.spans(body, offsets, alnum=True):
        sums = textkernel.prefix_sums(part)
        owner = np.searchsorted(offsets, starts + begin, "right") - 1
        yield owner, (textkernel.stretch(sums, starts, ends) & mask).astype(np.int64)
        for n in PREFIXES:
            long = np.flatnonzero(ends - starts > n)
            hashed = textkernel.mix64(textkernel.stretch(sums, starts[long], starts[long] + n) + np.uint64(n))
            yield owner[long], (hashed & mask).astype(np.int64)


def _present(column: pa.Array, roots: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature) pairs in order of the texts; with ``roots``, only those words and beginnings.

    A feature is a hashed word or beginning with a level that says how often it occurs at least.
    """
    found = [np.zeros(0, np.int64)]
    for owner, hashed in _features(column):
        if roots is not None:
            inside = roots[hashed]
            owner, hashed = owner[inside], hashed[inside]
        found.append(owner << BITS | hashed)
    pairs, counts = np.unique(np.concatenate(found), return_counts=True)
    owner, hashed = pairs >> BITS, pairs & ((1 << BITS) - 1)
    often = [counts >= least for least in LEVELS]
    owners = np.concatenate([owner[o] for o in often])
    features = np.concatenate([hashed[o] | i << BITS for i, o in enumerate(often)])
    order = np.argsort(owners, kind="stable")
    return owners[order], features[order]


def _among(features: np.ndarray, every: np.ndarray) -> np.ndarray:
    """Place of each feature in the sorted ``every``, -1 where it is missing."""
    if not len(every):
        return np.full(len(features), -1, np.int64)
    at = np.minimum(np.searchsorted(every, features), len(every) - 1)
    return np.where(every[at] == features, at, -1)


def fit_sample(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", categories: dict[str, str] = CATEGORIES) -> DataFrame:
    """(doc_id, text, row_weight, one column per category): the labelled rows to learn from."""
    *_, last = categories
    values = labels.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), *[F.expr(e).cast("double").alias(c) for c, e in categories.items()])
    values = values.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in categories]).where(F.col(last).isNotNull())
    order = F.xxhash64("doc_id", F.lit(7))
    chosen = None
    for side in (values.where(F.col(last) > 0.5), values.where(F.col(last) <= 0.5)):
        picked = side.orderBy(order, "doc_id").limit(FIT_ROWS)
        size = side.agg(F.count("*")).first()[0]
        picked = picked.withColumn("row_weight", F.lit(max(1.0, size / FIT_ROWS)))
        chosen = picked if chosen is None else chosen.union(picked)
    # at most 2 * FIT_ROWS rows of a few numbers each
    texts = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")


def _selected(sample: DataFrame, categories: list[str]) -> list[list[int]]:
    """Per category the features with the largest likelihood ratio statistic."""
    totals = sample.agg(*[F.sum(F.when(F.col(c).isNotNull(), 1.0).otherwise(0.0)).alias(f"n_{c}") for c in categories],
                        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(f"p_{c}") for c in categories]).first()
    counts = sample.select(F.explode("features").alias("feature"), *categories).groupBy("feature").agg(
        *[F.count(c).cast("double").alias(f"n_{c}") for c in categories], *[F.coalesce(F.sum(c), F.lit(0.0)).alias(f"p_{c}") for c in categories])
    counts = written(counts.where(F.greatest(*[F.col(f"n_{c}") for c in categories], F.lit(0.0)) >= MIN_DOCS), "tox-counts")
    out = []
    for c in categories:
        n, p = float(totals[f"n_{c}"] or 0), float(totals[f"p_{c}"] or 0)
        if not 0 < p < n:
            out.append([])
            continue

        def term(seen: Column, expected: Column) -> Column:
            return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

        a, here = F.col(f"p_{c}"), F.col(f"n_{c}")
        g2 = 2 * (term(a, here * p / n) + term(here - a, here * (n - p) / n)
                  + term(p - a, (n - here) * p / n) + term(n - here - p + a, (n - here) * (n - p) / n))
        best = counts.select("feature", g2.alias("g2")).where(F.col("g2") >= MIN_G2).orderBy(F.desc("g2"), "feature").limit(SELECTED)
        out.append(sorted(r["feature"] for r in best.collect()))
    return out


def _logistic(owner: np.ndarray, feature: np.ndarray, extra: np.ndarray, y: np.ndarray, w: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Ridge logistic regression on sparse 0/1 features and dense ``extra`` columns, by Adam steps on the whole sample."""
    n, k = len(y), extra.shape[1]
    beta = np.zeros(width + k + 1)
    prior = np.clip(np.average(y, weights=w), 1e-6, 1 - 1e-6)
    beta[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(beta), np.zeros_like(beta)
    ridge = np.r_[np.full(width, RIDGE), np.full(k, RIDGE), 0.0]
    for step in range(1, STEPS + 1):
        z = np.bincount(owner, beta[feature], n) + extra @ beta[width:width + k] + beta[-1]
        r = w * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        grad = np.r_[np.bincount(feature, r[owner], width), extra.T @ r, r.sum()] + ridge * beta
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        rate = 0.2 * (1 - step / (STEPS + 1))
        beta -= rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
    return beta[:width], beta[width:width + k], float(beta[-1])


def _threshold(odds: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The chance between 0.2 and 0.8 that gives the best F1 on out-of-fold predictions; 0.5 among equals."""
    def f1(t: float) -> float:
        said = odds >= np.log(t / (1 - t))
        return 2 * (w * y)[said].sum() / max(1e-9, w[said].sum() + (w * y).sum())

    return max((round(f1(t), 9), -abs(t - 0.5), t) for t in np.arange(0.2, 0.81, 0.05).round(2))[2]


def _chain(rows: pa.Table, names: list[str], chosen: list[list[int]], every: np.ndarray) -> list[Model]:
    """Fits the categories one after the other on the sample's selected features."""
    rows = rows.combine_chunks()
    columns = {c: rows.column(c).to_numpy() for c in ("row_weight", *names, "fold")}
    lists = rows.column("features").combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int32()))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    feature = lists.flatten().to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()) if len(lists) else [])
    fold, weight = columns["fold"], columns["row_weight"]
    models, odds = [], np.zeros((len(lists), 0))
    for c, own in zip(names, chosen, strict=True):
        y = columns[c].astype(np.float64)
        known = ~np.isnan(y)
        if not known.any() or y[known].min() == y[known].max():
            level = float(y[known][0]) if known.any() else 0.0
            models.append(Model(np.zeros(0, np.int64), np.zeros(0), np.zeros(odds.shape[1]), 40.0 if level > 0.5 else -40.0))
            odds = np.column_stack([odds, np.zeros(len(lists))])
            continue
        local = np.full(len(every), -1, np.int64)
        local[np.searchsorted(every, own)] = np.arange(len(own))
        mine = local[feature]
        used, mine = owner[mine >= 0], mine[mine >= 0]

        def learn(train: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
            number = np.cumsum(train) - 1
            inside = train[used]
            return _logistic(number[used[inside]], mine[inside], odds[train], y[train], weight[train], len(own))

        out_of_fold = np.zeros(len(lists))
        for f in range(FOLDS):
            train = known & (fold != f)
            if train.any():
                beta, chain, base = learn(train)
                z = np.bincount(used, beta[mine], len(lists)) + odds @ chain + base
                out_of_fold[fold == f] = z[fold == f]
        beta, chain, base = learn(known)
        models.append(Model(np.asarray(own, np.int64), beta, chain, base, _threshold(out_of_fold[known], y[known], weight[known])))
        odds = np.column_stack([odds, np.clip(out_of_fold, -10, 10)])
    return models


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", categories: dict[str, str] = CATEGORIES) -> list[Model]:
    """The chain of models, one per category."""
    names = list(categories)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textkernel.slices(batch, "text"):
                owner, feature = _present(part.column("text"))
                ends = np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row_weight"), *[part.column(c) for c in names],
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(feature.astype(np.int32)))],
                    names=["doc_id", "row_weight", *names, "features"])

    kind = dict(docs.dtypes)[key]
    sample = fit_sample(docs, labels, text, key, categories).select("doc_id", "row_weight", *names, "text")
    schema = f"doc_id {kind}, row_weight double, {', '.join(f'{c} double' for c in names)}, features array<int>"
    sample = written(sample.mapInArrow(extract, schema), "tox-sample")
    chosen = _selected(sample, names)
    every = np.array(sorted(set().union(*chosen)), np.int64)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("features")
            flat = _among(lists.flatten().to_numpy(), every)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            owner, flat = owner[flat >= 0], flat[flat >= 0]
            ends = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ["row_weight", *names]], batch.column("fold"),
                                              pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))],
                                             names=["row_weight", *names, "fold", "features"])

    folded = sample.select("row_weight", *names, F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(FOLDS)).cast("int").alias("fold"), "features")
    narrowed = folded.mapInArrow(narrow, f"row_weight double, {', '.join(f'{c} double' for c in names)}, fold int, features array<int>")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            models = _chain(pa.Table.from_batches(held), names, chosen, every)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps([tuple(m) for m in models])], pa.binary())], names=["models"])

    # one task for the bounded sample; only the models come back
    found = narrowed.repartition(1).mapInArrow(train, "models binary").collect()
    if not found:
        return _chain(narrowed.limit(0).toArrow(), names, chosen, every)
    return [Model(*m) for m in pickle.loads(found[0]["models"])]


def scored(docs: DataFrame, models: list[Model], text: str = "text", key: str = "doc_id", categories: dict[str, str] = CATEGORIES,
           with_text: bool = False) -> DataFrame:
    """(doc_id, p_<category>...): the chain applied to every whole text, which comes last if asked for."""
    names = list(categories)
    own = ["text"] if with_text else []
    every = np.array(sorted(set().union(*[m.features.tolist() for m in models])), np.int64)
    table = np.zeros((len(models), len(every)))
    for i, m in enumerate(models):
        table[i, np.searchsorted(every, m.features)] = m.weights

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = np.zeros(1 << BITS, bool)
        roots[every & ((1 << BITS) - 1)] = True
        for batch in batches:
            for part in textkernel.slices(batch, "text"):
                owner, feature = _present(part.column("text"), roots)
                feature = _among(feature, every)
                owner, feature = owner[feature >= 0], feature[feature >= 0]
                odds, chances = np.zeros((part.num_rows, 0)), []
                for i, m in enumerate(models):
                    z = np.bincount(owner, table[i][feature], part.num_rows) + odds @ m.chained + m.base
                    odds = np.column_stack([odds, np.clip(z, -10, 10) if len(m.features) else np.zeros(part.num_rows)])
                    chances.append(1 / (1 + np.exp(-np.clip(z, -40, 40))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(p) for p in chances], *[part.column(c) for c in own]],
                                                 names=["doc_id", *[f"p_{c}" for c in names], *own])

    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(score, f"doc_id {kind}, {', '.join([*[f'p_{c} double' for c in names], *[f'{c} string' for c in own]])}")


def judged(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Chance of every category per document, and whether the last one rejects it."""
    *_, last = CATEGORIES
    models = fit(docs, labels, text, key)
    return scored(docs, models, text, key).withColumn("rejected", F.col(f"p_{last}") >= float(models[-1].threshold))


def filtered(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents that are not rejected, with all their columns.

    The verdict is computed beside the row, so no join is needed; the text goes through the tasks once.
    """
    models = fit(docs, labels, text, key)
    at = [c.lower() for c in docs.columns].index(text.lower())
    rows = packed(docs, text=F.col(f"`{text}`")).withColumn("row", F.col("row").dropFields(f"_{at}"))
    *_, last = CATEGORIES
    verdicts = scored(rows, models, "text", "row", with_text=True).where(F.col(f"p_{last}") < float(models[-1].threshold))
    return verdicts.withColumnRenamed("doc_id", "row").select(*unpacked(docs.columns, **{docs.columns[at]: F.col("text")}))
