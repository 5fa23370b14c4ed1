"""Rater and model analytics over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwellstat.functions import checks, usage
from dwellstat.operators import agreement, joins, ordering, photos, sampling, stages, summaries
from dwellstat.plans import views
from dwellstat.plans.registry import query, table
from dwellstat.session import scratch_path, staged
from dwellstat.plans.views import with_views

R = 6
GROUPS = {"all": None, "pair": ("r0", "r1")}
REFERENCES = ("all", "pair", "r0", "r1", "r2", "r3")


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, R) for c in columns})


def good_scores(spark, sf_dir):
    return views.scores(spark, sf_dir).filter(checks.no_error("error"))


def means(spark, sf_dir):
    return agreement.mean_scores(good_scores(spark, sf_dir), ["model", "image_path", "zpid", "room_type"])


def ratings(spark, sf_dir):
    return summaries.latest_ratings(views.rating_log(spark, sf_dir), arrival="arrival")


def references(spark, sf_dir):
    return agreement.consensus(ratings(spark, sf_dir), GROUPS)


def _rank_sql(source: str, keys: str, x: str, y: str) -> str:
    """Average-tie ranks and guarded correlation, written with window functions."""
    return f"""ranked AS (SELECT *,
        rank() OVER (PARTITION BY {keys} ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0::DOUBLE AS rx,
        rank() OVER (PARTITION BY {keys} ORDER BY {y}) + (count(*) OVER (PARTITION BY {keys}, {y}) - 1) / 2.0::DOUBLE AS ry FROM {source}),
    rho AS (SELECT {keys}, count(*) AS n, CASE WHEN min({x}) < max({x}) AND min({y}) < max({y}) THEN corr(rx, ry) END AS rho
        FROM ranked GROUP BY {keys})"""


_CONSISTENCY_SQL = with_views("good_scores") + """,
    per_item AS (SELECT model, room_type, image_path, stddev_samp(score) AS sd, avg(score) AS m FROM good_scores GROUP BY ALL),
    cons AS (SELECT model, room_type, count(*) AS n_images, avg(sd) AS within_image_std, stddev_samp(m) AS between_image_std,
        avg(sd) / nullif(stddev_samp(m), 0) AS ratio_within_over_between FROM per_item GROUP BY ALL)"""


@query("consistency", _CONSISTENCY_SQL + f"""
    SELECT model, room_type, n_images, round(within_image_std, {R}) AS within_image_std, round(between_image_std, {R}) AS between_image_std,
        round(ratio_within_over_between, {R}) AS ratio_within_over_between FROM cons""")
def consistency(spark, sf_dir):
    return rounded(agreement.consistency(good_scores(spark, sf_dir)), "within_image_std", "between_image_std", "ratio_within_over_between")


@query("compression", with_views("good_scores") + f"""
    SELECT model, room_type, round(avg((score <= 2 OR score >= top - 1)::INT), {R}) AS share_in_extremes, max(score) - min(score) AS range_used,
        CAST(any_value(top) - 1 AS DOUBLE) AS scale_span,
        avg((score <= 2 OR score >= top - 1)::INT) < 0.05 OR max(score) - min(score) < 0.6 * (any_value(top) - 1) AS compressed
    FROM (SELECT *, CASE room_type WHEN 'kitchen' THEN 7 ELSE 8 END AS top FROM good_scores) GROUP BY model, room_type""")
def compression(spark, sf_dir):
    return rounded(agreement.compression(good_scores(spark, sf_dir), agreement.top_level_of()), "share_in_extremes")


@query("disagreement", with_views("good_scores") + f"""
    SELECT model, room_type, round(avg((room_type_judgment IS DISTINCT FROM room_type)::INT), {R}) AS disagreement_rate
    FROM good_scores GROUP BY model, room_type""")
def disagreement(spark, sf_dir):
    return rounded(agreement.disagreement_rate(good_scores(spark, sf_dir), "room_type", "room_type_judgment", ["model", "room_type"]), "disagreement_rate")


@query("mean_scores", with_views("means") + f" SELECT model, image_path, zpid, room_type, round(mean_score, {R}) AS mean_score FROM means")
def mean_scores(spark, sf_dir):
    return rounded(means(spark, sf_dir), "mean_score")


@query("consensus", with_views("consensus") + f" SELECT reference, image_path, round(human_score, {R}) AS human_score FROM consensus")
def consensus(spark, sf_dir):
    return rounded(references(spark, sf_dir), "human_score")


_AGREE_SQL = with_views("means", "consensus") + """,
    joined AS (SELECT m.model, m.room_type, c.reference, m.image_path, mean_score, human_score, mean_score - human_score AS gap
        FROM means m JOIN consensus c USING (image_path)),"""


@query("agreement_all", _AGREE_SQL + _rank_sql("joined", "model, reference", "mean_score", "human_score") + f"""
    SELECT model, reference, r.n, round(rho, {R}) AS spearman, round(mad, {R}) AS mean_abs_dev, round(bias, {R}) AS bias, round(off, {R}) AS pct_off_by_1
    FROM rho r JOIN (SELECT model, reference, avg(abs(gap)) AS mad, avg(gap) AS bias, 100 * avg((abs(gap) > 1)::INT) AS off FROM joined GROUP BY ALL)
    USING (model, reference) WHERE r.n >= 3""")
def agreement_all(spark, sf_dir):
    out = agreement.agreement(means(spark, sf_dir), references(spark, sf_dir))
    return rounded(out, "spearman", "mean_abs_dev", "bias", "pct_off_by_1")


@query("agreement_by_room", _AGREE_SQL + _rank_sql("joined", "model, reference, room_type", "mean_score", "human_score") + f"""
    SELECT model, reference, room_type, r.n, round(rho, {R}) AS spearman, round(mad, {R}) AS mean_abs_dev, round(bias, {R}) AS bias, round(off, {R}) AS pct_off_by_1
    FROM rho r JOIN (SELECT model, reference, room_type, avg(abs(gap)) AS mad, avg(gap) AS bias, 100 * avg((abs(gap) > 1)::INT) AS off FROM joined GROUP BY ALL)
    USING (model, reference, room_type) WHERE r.n >= 3""")
def agreement_by_room(spark, sf_dir):
    out = agreement.agreement(means(spark, sf_dir), references(spark, sf_dir), by=("model", "reference", "room_type"))
    return rounded(out, "spearman", "mean_abs_dev", "bias", "pct_off_by_1")


@query("agreement_matrix", _AGREE_SQL + _rank_sql("joined", "model, reference", "mean_score", "human_score") + " SELECT model, "
       + ", ".join(f'round(avg(rho) FILTER (reference = \'{r}\'), {R}) AS "{r}"' for r in REFERENCES) + " FROM rho WHERE n >= 3 GROUP BY model")
def agreement_matrix(spark, sf_dir):
    table = agreement.agreement(means(spark, sf_dir), references(spark, sf_dir))
    return rounded(agreement.wide(table, "model", "reference", "spearman", REFERENCES), *REFERENCES)


_VS_MODEL_SQL = with_views("means") + """,
    joined AS (SELECT a.model, a.room_type, a.image_path, a.mean_score, b.mean_score AS reference_mean, a.mean_score - b.mean_score AS diff
        FROM means a JOIN means b ON a.image_path = b.image_path AND b.model = 'm0' WHERE a.model <> 'm0')"""


@query("spearman_vs_model", _VS_MODEL_SQL + "," + _rank_sql("joined", "model, room_type", "mean_score", "reference_mean")
       + f" SELECT model, room_type, n, round(rho, {R}) AS rho FROM rho")
def spearman_vs_model(spark, sf_dir):
    pairs = agreement.against_reference_model(means(spark, sf_dir), "m0")
    return rounded(ordering.spearman(pairs, "mean_score", "reference_mean", ["model", "room_type"]), "rho")


@query("disagreements_vs_model", _VS_MODEL_SQL + """
    SELECT model, image_path, room_type, round(mean_score, 6) AS mean_score, round(reference_mean, 6) AS reference_mean, round(diff, 6) AS diff
    FROM joined WHERE abs(diff) >= 2""")
def disagreements_vs_model(spark, sf_dir):
    pairs = agreement.against_reference_model(means(spark, sf_dir), "m0").filter(F.abs("diff") >= 2)
    return rounded(pairs, "mean_score", "reference_mean", "diff")


@query("largest_gaps", _AGREE_SQL + f"""
    gaps AS (SELECT room_type, image_path, gap, abs(gap) AS abs_gap FROM joined WHERE reference = 'all' AND model = 'm1')
    SELECT room_type, image_path, round(gap, {R}) AS gap FROM gaps
    QUALIFY row_number() OVER (PARTITION BY room_type ORDER BY round(abs_gap, {R}) DESC, image_path) <= 20""")
def largest_gaps(spark, sf_dir):
    human = references(spark, sf_dir).filter("reference = 'all'")
    gaps = means(spark, sf_dir).filter("model = 'm1'").join(human, "image_path").withColumn("gap", F.col("mean_score") - F.col("human_score"))
    top = ordering.top_per_group(gaps, ["room_type"], [F.desc_nulls_last(F.round(F.abs("gap"), R)), F.col("image_path")], 20)
    return top.select("room_type", "image_path", F.round("gap", R).alias("gap")).orderBy("room_type", F.desc_nulls_last(F.abs("gap")))


_PAIRS_SQL = with_views("ratings") + """,
    joined AS (SELECT a.rater AS rater_a, b.rater AS rater_b, a.score AS sa, b.score AS sb FROM ratings a JOIN ratings b
        ON a.image_path = b.image_path AND a.rater < b.rater),""" + _rank_sql("joined", "rater_a, rater_b", "sa", "sb")


@query("inter_rater", _PAIRS_SQL + f" SELECT rater_a, rater_b, n AS n_common, round(rho, {R}) AS rho FROM rho WHERE n >= 10")
def inter_rater(spark, sf_dir):
    return rounded(agreement.rater_pairs(ratings(spark, sf_dir)), "rho")


@query("outlier_raters", _PAIRS_SQL + f""",
    both_ways AS (SELECT rater_a AS rater, rho FROM rho WHERE n >= 10 UNION ALL SELECT rater_b, rho FROM rho WHERE n >= 10),
    per AS (SELECT rater, count(DISTINCT image_path) AS n_rated, any_value(m) AS m FROM ratings LEFT JOIN
        (SELECT rater, avg(rho) AS m FROM both_ways GROUP BY rater) USING (rater) GROUP BY rater),
    g AS (SELECT avg(m) AS grand, stddev_samp(m) AS sd FROM per)
    SELECT rater, n_rated, round(m, {R}) AS mean_rho_vs_others,
        coalesce(grand - m > 0.2 OR (sd > 0 AND grand - m > 2 * sd), false) AS outlier FROM per, g""")
def outlier_raters(spark, sf_dir):
    r = ratings(spark, sf_dir)
    return rounded(agreement.rater_summary(r, agreement.rater_pairs(r)), "mean_rho_vs_others")


@query("agreement_ceiling", _PAIRS_SQL + f" SELECT round(avg(rho), {R}) AS ceiling, count(rho) AS pairs FROM rho WHERE n >= 10")
def agreement_ceiling(spark, sf_dir):
    return rounded(agreement.agreement_ceiling(agreement.rater_pairs(ratings(spark, sf_dir))), "ceiling")


_TWO_RUNS_SQL = with_views("good_scores") + """,
    a AS (SELECT image_path, room_type, floor(avg(score)) AS s FROM good_scores WHERE replicate <= 2 GROUP BY ALL),
    b AS (SELECT image_path, room_type, floor(avg(score)) AS s FROM good_scores WHERE replicate > 2 GROUP BY ALL)"""


@query("run_diff", _TWO_RUNS_SQL + """
    SELECT a.image_path, a.room_type, CAST(a.s AS BIGINT) AS score_before, CAST(b.s AS BIGINT) AS score_after, CAST(b.s - a.s AS BIGINT) AS change
    FROM a JOIN b USING (image_path) WHERE a.s <> b.s""")
def run_diff(spark, sf_dir):
    s = good_scores(spark, sf_dir)
    runs = [s.filter(c).groupBy("image_path", "room_type").agg(F.floor(F.avg("score")).alias("score")) for c in ("replicate <= 2", "replicate > 2")]
    out = joins.run_changes(*runs, "image_path", "score", "room_type")
    return out.orderBy("room_type", F.desc(F.abs("change")), "image_path")


@query("before_after", with_views("good_scores", "consensus") + """,
    m AS (SELECT replicate <= 2 AS early, image_path, room_type, avg(score) AS mean_score FROM good_scores WHERE model = 'm1' GROUP BY ALL),
    joined AS (SELECT early, room_type, mean_score, human_score, mean_score - human_score AS gap FROM m JOIN consensus USING (image_path) WHERE reference = 'all'),
    """ + _rank_sql("joined", "early, room_type", "mean_score", "human_score") + f""",
    t AS (SELECT early, room_type, r.n, rho, mad, bias FROM rho r JOIN (SELECT early, room_type, avg(abs(gap)) AS mad, avg(gap) AS bias FROM joined GROUP BY ALL) USING (early, room_type))
    SELECT b.room_type, b.n, round(a.bias, {R}) AS bias_before, round(b.bias, {R}) AS bias_after, round(a.rho, {R}) AS spearman_before,
        round(b.rho, {R}) AS spearman_after, round(a.mad, {R}) AS mean_abs_dev_before, round(b.mad, {R}) AS mean_abs_dev_after,
        round(abs(b.bias) - abs(a.bias), {R}) AS abs_bias_delta
    FROM t a JOIN t b ON a.room_type = b.room_type WHERE a.early AND NOT b.early""")
def before_after(spark, sf_dir):
    human = references(spark, sf_dir).filter("reference = 'all'")
    s = good_scores(spark, sf_dir).filter("model = 'm1'")
    tables = [
        agreement.agreement(agreement.mean_scores(s.filter(c), ["image_path", "room_type"]), human, by=("room_type",))
        for c in ("replicate <= 2", "replicate > 2")
    ]
    out = agreement.before_after(*tables, "room_type", ["bias", "spearman", "mean_abs_dev"])
    return rounded(out, *[c for c in out.columns if c not in ("room_type", "n")])


@query("replicate_summary", with_views("scores") + f"""
    SELECT model, image_path, count(*) FILTER (length(coalesce(error, '')) = 0) AS n_ok,
        round(avg(score) FILTER (length(coalesce(error, '')) = 0), {R}) AS mean_score,
        round(avg(confidence) FILTER (length(coalesce(error, '')) = 0), {R}) AS mean_confidence,
        count(*) FILTER (length(coalesce(error, '')) = 0) = 3 AND count(DISTINCT level) FILTER (length(coalesce(error, '')) = 0) = 1 AS consistent
    FROM scores GROUP BY model, image_path""")
def replicate_summary(spark, sf_dir):
    out = agreement.replicate_summary(views.scores(spark, sf_dir), ["model", "image_path"], 3)
    return rounded(out, "mean_score", "mean_confidence")


@query("score_range", with_views("good_scores") + f"""
    SELECT image_path, min(score) AS score_min, round(avg(score), {R}) AS score_mean, max(score) AS score_max FROM good_scores GROUP BY image_path""")
def score_range(spark, sf_dir):
    return rounded(agreement.score_range(good_scores(spark, sf_dir)), "score_mean")


@query("replicate_lists", with_views("good_scores") + """,
    all_answers AS (SELECT image_path, replicate, score, reasoning FROM good_scores WHERE model = 'm1')
    SELECT image_path, count(*) AS n, string_agg(replicate || ':' || CAST(CAST(score * 2 AS BIGINT) AS VARCHAR) || ':' || reasoning, ';'
        ORDER BY replicate, score, reasoning) AS answers
    FROM all_answers GROUP BY image_path""")
def replicate_lists(spark, sf_dir):
    s = good_scores(spark, sf_dir).filter("model = 'm1'")
    out = agreement.replicate_lists(s, ["image_path"], ["score", "reasoning"])
    line = F.transform("answers", lambda a: F.concat_ws(":", a["replicate"].cast("string"), (a["score"] * 2).cast("bigint").cast("string"), a["reasoning"]))
    return out.select("image_path", F.size("answers").cast("bigint").alias("n"), F.array_join(line, ";").alias("answers"))


@query("model_ids", with_views("scores") + """
    SELECT model, string_agg(response_model, ', ' ORDER BY response_model) AS ids FROM (SELECT DISTINCT model, response_model FROM scores) GROUP BY model""")
def model_ids(spark, sf_dir):
    return agreement.joined_names(views.scores(spark, sf_dir), "model", "response_model", "ids")


@query("cost_rollup", with_views("scores") + f""",
    priced AS (SELECT *, greatest(input_tokens - cached_input_tokens - cache_write_tokens, 0) AS fresh,
        CASE model WHEN 'm0' THEN [2.5, 10, 1.25, 2.5] WHEN 'm1' THEN [1.5, 9, 0.15, 1.5] ELSE [1, 5, 0.1, 1.25] END::DOUBLE[] AS p FROM scores),
    costed AS (SELECT *, (fresh * p[1] + cached_input_tokens * p[3] + cache_write_tokens * p[4] + output_tokens * p[2]) / 1000000 AS cost_usd FROM priced),
    share AS (SELECT CAST(floor(76499 * avg((label IN ('click', 'view'))::INT)) AS BIGINT) AS items FROM (SELECT event_type AS label FROM events))
    SELECT model, round(avg(cost_usd), 9) AS mean_cost_per_call_usd, round(avg(latency_s), {R}) AS mean_latency_s, any_value(items) AS est_scoreable_images,
        round(avg(cost_usd) * any_value(items), 4) AS full_run_standard_usd, round(avg(cost_usd) * any_value(items) * 0.5, 4) AS full_run_batch_usd
    FROM costed, share GROUP BY model""")
def cost_rollup(spark, sf_dir):
    out = summaries.scoring_cost(
        _costed(spark, sf_dir), table(spark, sf_dir, "events"), "event_type", F.lit(76499), rooms=("click", "view"))
    return out.withColumns({
        "mean_cost_per_call_usd": F.round("mean_cost_per_call_usd", 9), "mean_latency_s": F.round("mean_latency_s", R),
        "full_run_standard_usd": F.round("full_run_standard_usd", 4), "full_run_batch_usd": F.round("full_run_batch_usd", 4)})


def _costed(spark, sf_dir):
    names = F.create_map(*[F.lit(v) for pair in views.PRICED_MODELS.items() for v in pair])
    cost = usage.model_cost(F.try_element_at(names, F.col("model")), "input_tokens", "output_tokens", "cached_input_tokens", "cache_write_tokens")
    return views.scores(spark, sf_dir).withColumn("cost_usd", cost)


@query("usage_shapes", with_views("scores") + """
    SELECT event_id, CASE model WHEN 'm1' THEN input_tokens WHEN 'm2' THEN input_tokens + cached_input_tokens + cache_write_tokens ELSE input_tokens END AS input_tokens,
        CASE model WHEN 'm1' THEN output_tokens + thought_tokens ELSE output_tokens END AS output_tokens,
        cached_input_tokens AS cached_tokens, CASE model WHEN 'm2' THEN cache_write_tokens ELSE 0 END AS write_tokens,
        CASE model WHEN 'm1' THEN thought_tokens ELSE 0 END AS thought_tokens FROM scores""")
def usage_shapes(spark, sf_dir):
    s = views.scores(spark, sf_dir)
    provider = F.when(F.col("model") == "m0", "openai").when(F.col("model") == "m1", "gemini").otherwise("anthropic")
    i, o, c, w, t = [F.col(x) for x in ("input_tokens", "output_tokens", "cached_input_tokens", "cache_write_tokens", "thought_tokens")]
    body = (
        F.when(F.col("model") == "m0", F.to_json(F.struct(i.alias("prompt_tokens"), o.alias("completion_tokens"),
                                                         F.struct(c.alias("cached_tokens")).alias("prompt_tokens_details"))))
        .when(F.col("model") == "m1", F.to_json(F.struct(i.alias("prompt_token_count"), o.alias("candidates_token_count"),
                                                        c.alias("cached_content_token_count"), t.alias("thoughts_token_count"))))
        .otherwise(F.to_json(F.struct(i.alias("input_tokens"), o.alias("output_tokens"), c.alias("cache_read_input_tokens"),
                                      w.alias("cache_creation_input_tokens"))))
    )
    staged = stages.once(s.select("event_id", provider.alias("_p"), body.alias("_b")), u=usage.normal_usage("_p", "_b"))
    return staged.select("event_id", "u.*")


@query("usage_stats", with_views("scores") + f"""
    SELECT model, count(*) AS n, round(avg(output_tokens), {R}) AS mean, min(output_tokens) AS min, max(output_tokens) AS max,
        count(*) FILTER (length(coalesce(error, '')) > 0) AS invalid, median(output_tokens) AS median FROM scores GROUP BY model""")
def usage_stats(spark, sf_dir):
    return rounded(summaries.usage_stats(views.scores(spark, sf_dir), ["model"], "output_tokens", ~checks.no_error("error")), "mean")


@query("run_totals", with_views("scores", "consensus") + f"""
    SELECT replicate, round(sum(latency_s), 4) AS run_cost_usd, count(*) FILTER (abs(score - human_score) > 1) AS off_by_1,
        round(avg(abs(score - human_score)), {R}) AS mean_abs_gap
    FROM scores LEFT JOIN (SELECT * FROM consensus WHERE reference = 'all') USING (image_path) GROUP BY replicate""")
def run_totals(spark, sf_dir):
    human = references(spark, sf_dir).filter("reference = 'all'").select("image_path", "human_score")
    rows = joins.lookup(views.scores(spark, sf_dir).drop("ts"), human, ["image_path"]).withColumn("gap", F.col("score") - F.col("human_score"))
    out = summaries.run_totals(rows, ["replicate"], "gap", "latency_s")
    return out.withColumns({"run_cost_usd": F.round("run_cost_usd", 4), "mean_abs_gap": F.round("mean_abs_gap", R), "replicate": F.col("replicate").cast("bigint")})


@query("cached_share", with_views("scores") + f"""
    SELECT model, sum(cached_input_tokens)::BIGINT AS cached, sum(input_tokens)::BIGINT AS prompt,
        round(sum(cached_input_tokens) / sum(input_tokens), {R}) AS cached_share FROM scores GROUP BY model""")
def cached_share(spark, sf_dir):
    out = views.scores(spark, sf_dir).groupBy("model").agg(F.sum("cached_input_tokens").alias("cached"), F.sum("input_tokens").alias("prompt"))
    return out.withColumn("cached_share", F.round(F.try_divide("cached", "prompt"), R))


@query("label_agreement", """
    SELECT count(*) FILTER (quality = toxic) AS agree, count(*) AS n, round(avg((quality = toxic)::INT), 6) AS agreement_rate FROM labels""")
def label_agreement(spark, sf_dir):
    return rounded(agreement.label_agreement(table(spark, sf_dir, "labels"), "quality", "toxic"), "agreement_rate")


@query("label_disagreements", "SELECT doc_id, quality, toxic FROM labels WHERE quality <> toxic")
def label_disagreements(spark, sf_dir):
    return table(spark, sf_dir, "labels").filter(~F.col("quality").eqNullSafe(F.col("toxic"))).select("doc_id", "quality", "toxic")


@query("confusion", """
    SELECT quality, count(*) FILTER (toxic = 0) AS truth_0, count(*) FILTER (toxic = 1) AS truth_1 FROM labels GROUP BY quality""")
def confusion(spark, sf_dir):
    return agreement.confusion(table(spark, sf_dir, "labels"), "quality", "toxic", [0, 1])


_ROOMS = ("kitchen", "bathroom", "bedroom", "living_room")


@query("image_features", with_views("good_scores") + " SELECT zpid, " + ", ".join(
    f"max(score) FILTER (room_type = '{r}') AS {r}_score, round(avg(score) FILTER (room_type = '{r}'), {R}) AS {r}_mean, "
    f"count(score) FILTER (room_type = '{r}') AS {r}_count" for r in _ROOMS) + " FROM good_scores GROUP BY zpid")
def image_features(spark, sf_dir):
    return rounded(photos.photo_features(good_scores(spark, sf_dir), "zpid", "room_type", "score"), *[f"{r}_mean" for r in _ROOMS])


@query("score_histogram", with_views("good_scores") + """,
    s AS (SELECT *, CASE room_type WHEN 'kitchen' THEN 7 ELSE 8 END AS top FROM good_scores)
    SELECT model, room_type, CAST(least(floor((score - 1) / 0.5), ceil((top - 1) / 0.5) - 1) AS BIGINT) AS bin, count(*) AS count,
        CAST(1 + 0.5 * least(floor((score - 1) / 0.5), ceil((top - 1) / 0.5) - 1) AS DOUBLE) AS bin_start
    FROM s WHERE score >= 1 AND score <= top GROUP BY ALL""")
def score_histogram(spark, sf_dir):
    return agreement.score_histogram(good_scores(spark, sf_dir), ["model", "room_type"], "score", agreement.top_level_of())


@query("level_summary", _AGREE_SQL + f"""
    g AS (SELECT * FROM joined WHERE reference = 'all' AND model = 'm1')
    SELECT CASE WHEN grouping(room_type) = 1 THEN 'all' ELSE room_type END AS room_type, count(*) AS n, round(avg(mean_score), {R}) AS model_level,
        round(avg(human_score), {R}) AS human_level, count(*) FILTER (abs(gap) > 1) AS off_by_1, count(*) FILTER (abs(gap) > 1.5) AS off_by_1_5,
        count(*) FILTER (abs(gap) > 2) AS off_by_2, round(avg((mean_score >= 5.5)::INT), {R}) AS share_high, round(stddev_samp(mean_score), {R}) AS score_std
    FROM g GROUP BY ROLLUP (room_type)""")
def level_summary(spark, sf_dir):
    human = references(spark, sf_dir).filter("reference = 'all'")
    gaps = means(spark, sf_dir).filter("model = 'm1'").join(human, "image_path")
    return rounded(agreement.level_summary(gaps), "model_level", "human_level", "share_high", "score_std")


_PICK_SQL = _AGREE_SQL + _rank_sql("joined", "model, reference", "mean_score", "human_score") + """,
    pairs AS (SELECT a.rater AS ra, b.rater AS rb, a.score AS sa, b.score AS sb FROM ratings a JOIN ratings b ON a.image_path = b.image_path AND a.rater < b.rater),
    pr AS (SELECT *, rank() OVER (PARTITION BY ra, rb ORDER BY sa) + (count(*) OVER (PARTITION BY ra, rb, sa) - 1) / 2.0::DOUBLE AS rx,
        rank() OVER (PARTITION BY ra, rb ORDER BY sb) + (count(*) OVER (PARTITION BY ra, rb, sb) - 1) / 2.0::DOUBLE AS ry FROM pairs),
    ceiling AS (SELECT avg(c) AS ceiling FROM (SELECT corr(rx, ry) AS c FROM pr GROUP BY ra, rb HAVING count(*) >= 10)),
    per_item AS (SELECT model, room_type, image_path, stddev_samp(score) AS sd, avg(score) AS m FROM good_scores GROUP BY ALL),
    ratio AS (SELECT model, avg(r) AS consistency_ratio FROM (SELECT model, room_type, avg(sd) / nullif(stddev_samp(m), 0) AS r FROM per_item GROUP BY ALL) GROUP BY model),
    cost AS (SELECT model, avg((greatest(input_tokens - cached_input_tokens - cache_write_tokens, 0) * p[1] + cached_input_tokens * p[3] + cache_write_tokens * p[4]
        + output_tokens * p[2]) / 1000000) AS c FROM (SELECT *, CASE model WHEN 'm0' THEN [2.5, 10, 1.25, 2.5] WHEN 'm1' THEN [1.5, 9, 0.15, 1.5]
        ELSE [1, 5, 0.1, 1.25] END::DOUBLE[] AS p FROM scores) GROUP BY model),
    al AS (SELECT model, rho FROM rho WHERE reference = 'all' AND n >= 3)"""


@query("pick_model", _PICK_SQL + f"""
    SELECT model, round(rho, {R}) AS spearman, round(consistency_ratio, {R}) AS consistency_ratio, round(c, 9) AS mean_cost_per_call_usd
    FROM al JOIN ratio USING (model) JOIN cost USING (model)
    WHERE rho >= least((SELECT ceiling FROM ceiling), (SELECT max(rho) FROM al)) - 0.05""")
def pick_model(spark, sf_dir):
    r = staged(ratings(spark, sf_dir), "ratings")
    averages, references = staged(means(spark, sf_dir), "means"), staged(agreement.consensus(r, GROUPS), "references")
    table_all = agreement.agreement(averages, references).filter("reference = 'all'")
    costs = _costed(spark, sf_dir).groupBy("model").agg(F.avg("cost_usd").alias("mean_cost_per_call_usd"))
    out = agreement.pick_model(table_all, agreement.consistency(good_scores(spark, sf_dir)), costs, agreement.agreement_ceiling(staged(agreement.rater_pairs(r), "pairs")))
    return rounded(out, "spearman", "consistency_ratio").withColumn("mean_cost_per_call_usd", F.round("mean_cost_per_call_usd", 9))


@query("most_consistent", _CONSISTENCY_SQL + f"""
    SELECT model, round(avg(ratio_within_over_between), {R}) AS ratio FROM cons GROUP BY model ORDER BY avg(ratio_within_over_between), model LIMIT 1""")
def most_consistent(spark, sf_dir):
    ratio = agreement.consistency(good_scores(spark, sf_dir)).groupBy("model").agg(F.avg("ratio_within_over_between").alias("ratio"))
    return rounded(ratio.orderBy(F.asc_nulls_last("ratio"), "model").limit(1), "ratio")


# --- raters ----------------------------------------------------------------------------------


@query("latest_rating", with_views("ratings") + " SELECT rater, image_path, score, timestamp FROM ratings")
def latest_rating(spark, sf_dir):
    return ratings(spark, sf_dir).withColumn("score", F.col("score").cast("bigint"))


@query("rater_progress", with_views("rating_log") + """,
    size AS (SELECT count(DISTINCT image_path) AS s FROM rating_log)
    SELECT rater, count(DISTINCT image_path) AS n_rated, any_value(s) AS subset_size, count(DISTINCT image_path) = any_value(s) AS complete
    FROM rating_log, size GROUP BY rater""")
def rater_progress(spark, sf_dir):
    log = views.rating_log(spark, sf_dir)
    return summaries.rating_progress(log, log)


_SUBSET_SQL = with_views("rating_log") + """,
    items AS (SELECT DISTINCT image_path, room_type FROM rating_log),
    subset AS (SELECT image_path, room_type FROM items QUALIFY row_number() OVER (PARTITION BY room_type ORDER BY md5('42|' || image_path), image_path) <= 30)"""


@query("rating_subset", _SUBSET_SQL + " SELECT image_path, room_type FROM subset")
def rating_subset(spark, sf_dir):
    return _subset(spark, sf_dir)


@query("frozen_subset", _SUBSET_SQL + " SELECT image_path, room_type FROM subset")
def frozen_subset(spark, sf_dir):
    """The subset as kept by its first draw; a later draw of other items changes nothing."""
    path = scratch_path(spark, "subset")
    sampling.freeze(spark, _subset(spark, sf_dir), path)
    return sampling.freeze(spark, _subset(spark, sf_dir).limit(1), path)


def _subset(spark, sf_dir):
    items = views.rating_log(spark, sf_dir).select("image_path", "room_type").distinct()
    return sampling.frozen_subset(items, "room_type", "image_path", _ROOMS, 30, 42)


@query("next_unrated", _SUBSET_SQL + """,
    ordered AS (SELECT r.rater, image_path, row_number() OVER (PARTITION BY r.rater ORDER BY md5('rater|' || r.rater || '|' || image_path), image_path) - 1 AS position
        FROM subset, (VALUES ('r0'), ('r1'), ('r2'), ('r3')) r(rater)),
    done AS (SELECT DISTINCT rater, image_path FROM rating_log WHERE arrival % 3 = 0)
    SELECT o.rater, coalesce(min(position) FILTER (d.rater IS NULL), count(*)) AS next_position, count(d.rater) AS done_count, count(*) AS total
    FROM ordered o LEFT JOIN done d ON o.rater = d.rater AND o.image_path = d.image_path GROUP BY o.rater""")
def next_unrated(spark, sf_dir):
    order = sampling.rater_order(_subset(spark, sf_dir), views.RATERS, "rater", "image_path")
    return sampling.next_unrated(order, views.rating_log(spark, sf_dir).filter("arrival % 3 = 0"), "rater", "image_path")


@query("quota_counters", with_views("photos") + """
    SELECT label, count(DISTINCT zpid) AS n_keys FROM photos WHERE label IN ('kitchen', 'bathroom', 'bedroom', 'living_room') GROUP BY label""")
def quota_counters(spark, sf_dir):
    return summaries.keys_per_label(views.photos(spark, sf_dir), "label", "zpid", _ROOMS)


@query("run_manifest", """
    WITH m AS (SELECT user_id AS timestamp, 'old' AS label, max(event_id) AS cost FROM events WHERE event_type = 'view' GROUP BY user_id),
    e AS (SELECT user_id AS timestamp, 'new' AS label, min(event_id) AS cost FROM events WHERE event_type = 'signup' GROUP BY user_id),
    u AS (SELECT * FROM m WHERE timestamp NOT IN (SELECT timestamp FROM e) UNION ALL SELECT * FROM e)
    SELECT * FROM u WHERE timestamp IN (SELECT user_id FROM events WHERE event_type = 'error')""")
def run_manifest(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "timestamp")
    old = e.filter("event_type = 'view'").groupBy("timestamp").agg(F.lit("old").alias("label"), F.max("event_id").alias("cost"))
    new = e.filter("event_type = 'signup'").groupBy("timestamp").agg(F.lit("new").alias("label"), F.min("event_id").alias("cost"))
    return summaries.prune_runs(summaries.upsert_runs(old, new), e.filter("event_type = 'error'"))


@query("latest_run", """
    SELECT event_id, user_id, value FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)""")
def latest_run(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("run", F.col("ts").cast("date"))
    return summaries.latest_run(e, "run").select("event_id", "user_id", "value")
