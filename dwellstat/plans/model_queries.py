"""Price-model queries: metrics and blends on formula predictions (checked in SQL), and real fits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dwellstat.operators import boosting, modeling, sampling
from dwellstat.plans.registry import query, table
from dwellstat.session import scratch_path, shared_folder, staged

R = 6
LEARNERS = ("a", "b", "c")

_PRED_SQL = """
    WITH p AS (SELECT o_orderkey, o_totalprice AS price, ln(o_totalprice) AS y_log, CAST(('0x' || substr(md5('42|' || o_orderkey), 1, 8))::BIGINT % 5 AS INT) AS fold,
        unnest(['a', 'b', 'c']) AS learner, unnest([(o_orderkey % 41) / 100.0::DOUBLE - 0.2, (o_custkey % 37) / 90.0::DOUBLE - 0.2, (o_orderkey % 29 + o_custkey % 23) / 120.0::DOUBLE - 0.2]) AS e FROM orders),
    preds AS (SELECT *, y_log + e AS pred_log FROM p)"""


def formula_predictions(spark, sf_dir):
    o = sampling.kfold(table(spark, sf_dir, "orders"), "o_orderkey")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    errors = F.array(
        F.struct(F.lit("a").alias("learner"), ((k % 41) / 100 - 0.2).alias("e")),
        F.struct(F.lit("b").alias("learner"), ((c % 37) / 90 - 0.2).alias("e")),
        F.struct(F.lit("c").alias("learner"), ((k % 29 + c % 23) / 120 - 0.2).alias("e")),
    )
    rows = o.select("o_orderkey", F.col("o_totalprice").alias("price"), F.ln("o_totalprice").alias("y_log"), "fold", F.inline(errors))
    return rows.withColumns({"pred_log": F.col("y_log") + F.col("e"), "part": F.lit("test")}).drop("e")


def _metrics_sql(source: str, name: str) -> str:
    return f"""{name} AS (SELECT learner, fold, count(*) AS n, sqrt(avg(pow(pred_log - y_log, 2))) AS log_rmse,
        median(abs(exp(pred_log) - price) / price * 100) AS median_pct FROM {source} GROUP BY learner, fold)"""


@query("fold_metrics", _PRED_SQL + "," + _metrics_sql("preds", "m") + f"""
    SELECT learner, fold, n, round(log_rmse, {R}) AS log_rmse, round(median_pct, {R}) AS median_pct FROM m""")
def fold_metrics(spark, sf_dir):
    out = modeling.fold_metrics(formula_predictions(spark, sf_dir), ["learner"])
    return out.withColumns({c: F.round(c, R) for c in ("log_rmse", "median_pct")})


@query("blends", _PRED_SQL + """,
    sets(blend, member) AS (VALUES ('a', 'a'), ('b', 'b'), ('c', 'c'), ('a + b', 'a'), ('a + b', 'b'), ('a + c', 'a'), ('a + c', 'c'), ('b + c', 'b'), ('b + c', 'c'),
        ('a + b + c', 'a'), ('a + b + c', 'b'), ('a + b + c', 'c')),
    mixed AS (SELECT blend AS learner, fold, o_orderkey, avg(pred_log) AS pred_log, any_value(y_log) AS y_log, any_value(price) AS price
        FROM preds JOIN sets ON learner = member GROUP BY blend, fold, o_orderkey),""" + _metrics_sql("mixed", "m") + f"""
    SELECT learner, round(avg(log_rmse), {R}) AS log_rmse_mean, round(stddev_pop(log_rmse), {R}) AS log_rmse_std,
        round(avg(median_pct), {R}) AS median_pct_mean, round(stddev_pop(median_pct), {R}) AS median_pct_std FROM m GROUP BY learner""")
def blends(spark, sf_dir):
    mixed = modeling.blends(formula_predictions(spark, sf_dir), LEARNERS, "o_orderkey")
    out = modeling.metric_summary(modeling.fold_metrics(mixed, ["learner"]), ["learner"])
    return out.withColumns({c: F.round(c, R) for c in out.columns if c != "learner"})


@query("residual_corr", _PRED_SQL + f""",
    w AS (SELECT o_orderkey, max(-e) FILTER (learner = 'a') AS a, max(-e) FILTER (learner = 'b') AS b, max(-e) FILTER (learner = 'c') AS c FROM preds GROUP BY o_orderkey)
    SELECT 'a' AS first, 'b' AS second, round(corr(a, b), {R}) AS correlation FROM w UNION ALL SELECT 'a', 'c', round(corr(a, c), {R}) FROM w
    UNION ALL SELECT 'b', 'c', round(corr(b, c), {R}) FROM w""")
def residual_corr(spark, sf_dir):
    out = modeling.residual_correlation(formula_predictions(spark, sf_dir), LEARNERS, "o_orderkey")
    return out.withColumn("correlation", F.round("correlation", R))


@query("importance_table", f"""
    WITH g AS (SELECT 'm' AS learner, event_type AS feature, user_id % 2 AS fold, event_id % 3 AS seed, sum(value) AS gain FROM events GROUP BY ALL),
    f AS (SELECT learner, feature, avg(gain) AS gain FROM (SELECT learner, feature, fold, avg(gain) AS gain FROM g GROUP BY ALL) GROUP BY ALL)
    SELECT learner, feature, round(gain / sum(gain) OVER (PARTITION BY learner), {R}) AS importance FROM f""")
def importance_table(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    long = e.select(F.lit("m").alias("learner"), (F.col("user_id") % 2).alias("fold"), (F.col("event_id") % 3).alias("seed"),
                    F.col("event_type").alias("feature"), F.col("value").alias("gain"))
    out = modeling.normalised_importance(long)
    return out.withColumn("importance", F.round("importance", R))


@query("shuffled_column", """
    SELECT count(*) AS n, sum(o_custkey)::BIGINT AS total, min(o_custkey) AS low, max(o_custkey) AS high, true AS moved FROM orders""")
def shuffled_column(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    mixed = modeling.shuffled_copy(o, "o_orderkey", ["o_custkey"], 1)
    moved = F.avg((F.col("o_custkey") != F.col("shuffled_o_custkey")).cast("double")) > 0.9
    v = "shuffled_o_custkey"
    return mixed.agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"), moved.alias("moved"))


# --- fits ------------------------------------------------------------------------------------

SPEC = modeling.FeatureSpec(
    numeric=("quantity", "lines", "discount", "acctbal", "age"),
    categorical=("priority", "segment"),
    groups={"order": ("quantity", "lines", "discount", "age", "priority"), "buyer": ("acctbal", "segment")},
)


def model_rows(spark, sf_dir):
    """Orders with line totals and buyer fields as a price table; some values are missing."""
    li = table(spark, sf_dir, "lineitem")
    lines = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("lines"), F.avg("l_discount").alias("discount"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    o = table(spark, sf_dir, "orders")
    rows = o.join(lines, "o_orderkey", "left").join(c, "o_custkey", "left")
    return rows.select(
        "o_orderkey", F.col("o_totalprice").alias("sold_price"), "quantity", "lines", "discount",
        F.when(F.col("acctbal") > 0, F.col("acctbal")).alias("acctbal"),
        F.datediff(F.lit("2002-01-01").cast("date"), F.col("o_orderdate").cast("date")).alias("age"),
        F.col("o_orderpriority").alias("priority"), "segment",
    )


def _trees() -> boosting.Boosting:
    """The full settings: 2,000 trees of depth 7 (README: what the fits take)."""
    return boosting.Boosting()


def _few_trees(depth: int = 4) -> boosting.Boosting:
    """What ``sweep`` compares over depths, and enough for what ``tree_fit_checks`` asks of any fit."""
    return boosting.Boosting(trees=4, depth=depth, step=0.2)


def _store(spark) -> str:
    """Predictions are shared by the queries of a session: what one has fitted, the others read."""
    return f"{shared_folder(spark)}/dwellstat/price-models-{spark.sparkContext.applicationId}"


def _fitted(spark, sf_dir, learners, train_too=False):
    return modeling.cross_validate(model_rows(spark, sf_dir), SPEC, "o_orderkey", "sold_price", learners, train_too=train_too, store=_store(spark))


_LINE_SPEC = modeling.FeatureSpec(numeric=("age",))

_LINE_SQL = """
    WITH r AS (SELECT o_orderkey, o_totalprice AS price, ln(o_totalprice) AS y_log, date_diff('day', o_orderdate::DATE, DATE '2002-01-01') AS age,
        CAST(('0x' || substr(md5('42|' || o_orderkey), 1, 8))::BIGINT % 5 AS INT) AS fold FROM orders WHERE o_totalprice > 0),
    lines AS (SELECT f.fold, regr_slope(y_log, age) AS slope, regr_intercept(y_log, age) AS base FROM r, (SELECT DISTINCT fold FROM r) f
        WHERE r.fold <> f.fold GROUP BY f.fold),
    preds AS (SELECT 'line' AS learner, r.*, base + slope * age AS pred_log FROM r JOIN lines USING (fold)),"""


@query("linear_folds", _LINE_SQL + _metrics_sql("preds", "m") + f" SELECT learner, fold, n, round(log_rmse, {R}) AS log_rmse, round(median_pct, 4) AS median_pct FROM m")
def linear_folds(spark, sf_dir):
    """Out-of-fold errors of a straight line through one feature, which SQL can fit as well."""
    _, predictions = modeling.cross_validate(
        model_rows(spark, sf_dir), _LINE_SPEC, "o_orderkey", "sold_price", {"line": modeling.linear(0.0)}, seeds=(42,), store=_store(spark))
    out = modeling.fold_metrics(predictions, ["learner"])
    return out.withColumns({"log_rmse": F.round("log_rmse", R), "median_pct": F.round("median_pct", 4)})


# a round of boosting that SQL can grow as well: two levels, every row and feature, few values per feature
_ROUND = boosting.Boosting(trees=1, depth=2, step=1.0, row_share=1.0, column_share=1.0)
_ROUND_NUMERIC, _ROUND_CODES = ("lines", "year"), ("priority", "segment")


def _level_sql(number: int, rows: str) -> str:
    """Best split per model and node of ``rows`` (model, node, k, fold, g, x0, x1, c2, c3), and its rows one level down."""
    n = number
    return f"""
    u{n} AS (SELECT model, node, fold, g, f, CASE f WHEN 0 THEN x0 WHEN 1 THEN x1 END AS x, CASE f WHEN 2 THEN c2 WHEN 3 THEN c3 END AS c FROM {rows}, range(4) AS q(f)),
    h{n} AS (SELECT model, node, f, x, c, sum(g)::DOUBLE AS g, count(*)::DOUBLE AS n FROM u{n} WHERE fold <> model GROUP BY ALL),
    t{n} AS (SELECT *, sum(g) OVER w AS ga, sum(n) OVER w AS na, coalesce(sum(g) FILTER (x IS NULL AND c IS NULL) OVER w, 0) AS gm,
        coalesce(sum(n) FILTER (x IS NULL AND c IS NULL) OVER w, 0) AS nm FROM h{n} WINDOW w AS (PARTITION BY model, node, f)),
    o{n} AS (SELECT *, sum(g) OVER w AS gl, sum(n) OVER w AS nl, row_number() OVER w AS place FROM t{n} WHERE x IS NOT NULL OR c IS NOT NULL
        WINDOW w AS (PARTITION BY model, node, f ORDER BY CASE WHEN f < 2 THEN x ELSE g / n END, c)),
    s{n} AS (SELECT model, node, f, place, x, side, ga, na, gl + side * gm AS gl, nl + side * nm AS nl FROM o{n}, range(2) AS q(side)),
    b{n} AS (SELECT *, gl * gl / (nl + 1.0) + (ga - gl) * (ga - gl) / (na - nl + 1.0) - ga * ga / (na + 1.0) AS gain FROM s{n} WHERE nl >= 3 AND na - nl >= 3),
    best{n} AS (SELECT * FROM b{n} WHERE gain > 1e-6 QUALIFY row_number() OVER (PARTITION BY model, node ORDER BY gain DESC, f, place, side) = 1),
    codes{n} AS (SELECT o.model, o.node, o.c FROM o{n} o JOIN best{n} b ON o.model = b.model AND o.node = b.node AND o.f = b.f AND o.place <= b.place WHERE o.f >= 2),
    v{n} AS (SELECT r.*, b.f AS bf, b.x AS bx, b.side, CASE b.f WHEN 0 THEN x0 WHEN 1 THEN x1 END AS rx, CASE b.f WHEN 2 THEN c2 WHEN 3 THEN c3 END AS rc
        FROM {rows} r LEFT JOIN best{n} b ON r.model = b.model AND r.node = b.node),
    r{n} AS (SELECT v.* EXCLUDE (node, bf, bx, side, rx, rc), CASE WHEN bf IS NULL THEN v.node ELSE 2 * v.node + CASE WHEN rx IS NULL AND rc IS NULL THEN 1 - side
            WHEN bf < 2 THEN (rx > bx)::INT ELSE (codes.c IS NULL)::INT END END AS node
        FROM v{n} v LEFT JOIN codes{n} codes ON v.model = codes.model AND v.node = codes.node AND v.rc = codes.c)"""


_ROUND_SQL = """
    WITH lines AS (SELECT l_orderkey, count(*)::DOUBLE AS lines FROM lineitem GROUP BY l_orderkey),
    r AS (SELECT o_orderkey AS k, o_totalprice AS price, ln(o_totalprice) AS y, CAST(('0x' || substr(md5('42|' || o_orderkey), 1, 8))::BIGINT % 5 AS INT) AS fold,
        lines AS x0, CASE WHEN o_orderkey % 7 <> 0 THEN year(o_orderdate)::DOUBLE END AS x1, o_orderpriority AS c2, CASE WHEN o_orderkey % 11 <> 0 THEN c_mktsegment END AS c3
        FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 0),
    base AS (SELECT model, quantile_disc(y, 0.5) AS b FROM r JOIN (SELECT DISTINCT fold AS model FROM r) ON fold <> model GROUP BY model),
    r0 AS (SELECT model, 1 AS node, r.*, b, sign(b - y)::INT AS g FROM r, base),""" + _level_sql(1, "r0") + "," + _level_sql(2, "r1")


def _round_rows(spark, sf_dir):
    rows = model_rows(spark, sf_dir).where("sold_price > 0")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    k = F.col("o_orderkey")
    rows = rows.join(o, "o_orderkey").select(k, F.col("sold_price").alias("price"), F.ln("sold_price").alias("y_log"), "lines", F.when(k % 7 != 0, F.col("year")).alias("year"),
                                             "priority", F.when(k % 11 != 0, F.col("segment")).alias("segment"))
    return sampling.kfold(rows, "o_orderkey")


def _round(spark, sf_dir):
    return boosting.fit(staged(_round_rows(spark, sf_dir), "round"), "o_orderkey", _ROUND_NUMERIC, _ROUND_CODES, [(f, 42) for f in range(5)], _ROUND)


@query("boosted_round", _ROUND_SQL + f""",
    leaf AS (SELECT model, node, quantile_disc(y - b, 0.5) AS value FROM r2 WHERE fold <> model GROUP BY ALL)
    SELECT model AS fold, CASE WHEN r2.fold = model THEN 'test' ELSE 'train' END AS part, round(b + value, {R}) AS pred_log, count(*) AS n
    FROM r2 JOIN leaf USING (model, node) GROUP BY ALL""")
def boosted_round(spark, sf_dir):
    """Rows by fold, part and prediction after one tree of two levels, with missing values in both kinds of features."""
    rows = _round(spark, sf_dir).predictions("trees", train_too=True)
    return rows.groupBy("fold", "part", F.round("pred_log", R).alias("pred_log")).agg(F.count(F.lit(1)).alias("n"))


@query("boosted_gains", _ROUND_SQL + f""",
    g AS (SELECT model, f, gain FROM best1 UNION ALL SELECT model, f, gain FROM best2),
    a AS (SELECT model, f, avg(gain) AS gain FROM g GROUP BY ALL),
    i AS (SELECT q.f, sum(coalesce(a.gain, 0)) / 5 AS gain FROM range(4) AS q(f) CROSS JOIN (SELECT DISTINCT model FROM r0) m LEFT JOIN a ON a.f = q.f AND a.model = m.model GROUP BY q.f)
    SELECT 'trees' AS learner, ['lines', 'year', 'priority', 'segment'][f + 1] AS feature, round(gain / sum(gain) OVER (), {R}) AS importance,
        row_number() OVER (ORDER BY gain DESC, ['lines', 'year', 'priority', 'segment'][f + 1]) AS place FROM i""")
def boosted_gains(spark, sf_dir):
    """Gain importances of the same round, with their rank."""
    out = modeling.normalised_importance(_round(spark, sf_dir).gains("trees"))
    place = F.row_number().over(Window.partitionBy("learner").orderBy(F.desc("importance"), "feature"))
    return out.withColumn("place", place).withColumn("importance", F.round("importance", R))


@query("tree_fit_checks", """
    SELECT CAST(('0x' || substr(md5('42|' || o_orderkey), 1, 8))::BIGINT % 5 AS INT) AS fold, 5 * count(*) AS n, true AS finite, true AS gains_add_up
    FROM orders WHERE o_totalprice > 0 GROUP BY fold""")
def tree_fit_checks(spark, sf_dir):
    """What holds for any fit of the trees: every row predicted once per seed and by a number, gains that sum to 1."""
    fitted = _grown(spark, sf_dir, _few_trees())[1]
    gains = modeling.normalised_importance(fitted.gains("trees")).agg(F.abs(F.sum("importance") - 1) < 1e-9).scalar()
    finite = F.bool_and(F.abs("pred_log") < 100)
    return fitted.predictions("trees").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), finite.alias("finite")).withColumn("gains_add_up", gains)


def _grown(spark, sf_dir, settings):
    data = modeling.training_table(model_rows(spark, sf_dir), SPEC, "o_orderkey", "sold_price")
    return data, modeling.boosted(data, SPEC, "o_orderkey", settings, [(f, s) for f in range(5) for s in modeling.SEEDS])


@query("gbt_cv")
def gbt_cv(spark, sf_dir):
    _, predictions = _fitted(spark, sf_dir, {"trees": _trees()}, train_too=True)
    return modeling.metric_summary(modeling.fold_metrics(predictions))


@query("learner_blends")
def learner_blends(spark, sf_dir):
    learners = {"boosted": _trees(), "forest": modeling.random_forest(), "linear": modeling.linear()}
    _, predictions = _fitted(spark, sf_dir, learners)
    mixed = modeling.blends(predictions, list(learners), "o_orderkey")
    return modeling.metric_summary(modeling.fold_metrics(mixed))


@query("gain_importance")
def gain_importance(spark, sf_dir):
    return modeling.normalised_importance(_grown(spark, sf_dir, _trees())[1].gains("trees"))


@query("sweep")
def sweep(spark, sf_dir):
    configs = {"depth 4": _few_trees(), "depth 2": _few_trees(2)}
    return modeling.sweep(model_rows(spark, sf_dir), SPEC, "o_orderkey", "sold_price", configs, store=_store(spark))


@query("permutation")
def permutation(spark, sf_dir):
    data, fitted = _grown(spark, sf_dir, _trees())
    return modeling.permutation_importance(data, fitted, SPEC, "o_orderkey")


@query("ablation")
def ablation(spark, sf_dir):
    return modeling.ablation(model_rows(spark, sf_dir), SPEC, "o_orderkey", "sold_price", _trees(), store=_store(spark))


@query("stored_fits", """
    SELECT fold, 25 AS first_run, 0 AS second_run, 5 AS other_setting, 25 AS other_rows FROM range(1) q(fold)""")
def stored_fits(spark, sf_dir):
    """Fits that a run starts: all the first time, none the second, and all again for other settings or rows."""
    rows = model_rows(spark, sf_dir)
    folder = scratch_path(spark, "stored-fits")
    learner, seeds = {"line": modeling.linear(0.0)}, modeling.SEEDS

    def started(df, learners, chosen=seeds) -> int:
        data = modeling.training_table(df, _LINE_SPEC, "o_orderkey", "sold_price")
        return modeling.missing_fits(data, _LINE_SPEC, "o_orderkey", learners, 5, chosen, folder), data

    n_first, data = started(rows, learner)
    modeling.predictions_of(data, _LINE_SPEC, "o_orderkey", learner, 5, seeds, folder)
    n_second, _ = started(rows, learner)
    n_setting, _ = started(rows, {"line": modeling.linear(0.5)}, seeds[:1])
    n_rows, _ = started(rows.withColumn("age", F.col("age") + 1), learner)
    counts = [F.lit(n).alias(c) for n, c in ((n_first, "first_run"), (n_second, "second_run"), (n_setting, "other_setting"), (n_rows, "other_rows"))]
    return data.agg(F.min(F.lit(0)).cast("long").alias("fold")).select("fold", *counts)
