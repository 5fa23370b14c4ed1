"""Sampling, quotas, chunk plans and folds over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwellstat.functions import seeded
from dwellstat.operators import ordering, sampling
from dwellstat.plans import views
from dwellstat.plans.registry import query, table
from dwellstat.plans.views import with_views
from dwellstat.session import staged

R = 6
BINS = 12
ROOMS = ("kitchen", "bathroom", "bedroom", "living_room")
_ROOM_LIST = "('kitchen', 'bathroom', 'bedroom', 'living_room')"

_BINS_SQL = """
    WITH area AS (SELECT l_orderkey, sum(l_quantity) AS sqft FROM lineitem GROUP BY l_orderkey),
    pool AS (SELECT o_orderkey AS zpid, o_totalprice / sqft AS ppsf, ln(o_totalprice / sqft) AS log_ppsf FROM orders JOIN area ON o_orderkey = l_orderkey
        WHERE o_totalprice > 0 AND sqft >= 20 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)),
    edges AS (SELECT unnest(list_sort(list_distinct(quantile_cont(log_ppsf, [""" + ", ".join(f"{i}::DOUBLE / {BINS}" for i in range(BINS + 1)) + """])))) AS edge FROM pool),
    inner_edges AS (SELECT edge FROM edges WHERE edge > (SELECT min(edge) FROM edges) AND edge < (SELECT max(edge) FROM edges)),
    binned AS (SELECT p.*, 1 + (SELECT count(*) FROM inner_edges WHERE edge < log_ppsf) AS bin FROM pool p)"""


def binned_pool(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    area = li.groupBy(F.col("l_orderkey").alias("zpid")).agg(F.sum("l_quantity").alias("sqft"))
    pool = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("zpid"), F.col("o_totalprice").alias("price")).join(area, "zpid")
    pool = pool.filter((F.col("price") > 0) & (F.col("sqft") >= 20))
    pool = pool.join(li.filter("l_quantity = 50").select(F.col("l_orderkey").alias("zpid")), "zpid", "left_anti")
    ppsf = F.try_divide("price", "sqft")
    pool = pool.select("zpid", ppsf.alias("ppsf"), F.ln(ppsf).alias("log_ppsf"))
    # read for the edges and again for the rows
    return sampling.quantile_bins(staged(pool, "pool"), "log_ppsf", BINS)


@query("quantile_bins", _BINS_SQL + f" SELECT zpid, round(ppsf, {R}) AS ppsf, bin FROM binned")
def quantile_bins(spark, sf_dir):
    return binned_pool(spark, sf_dir).select("zpid", F.round("ppsf", R).alias("ppsf"), "bin")


@query("bin_edges", """
    SELECT unnest([0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]::DOUBLE[]) AS prob,
        unnest(list_transform(quantile_cont(o_totalprice, [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]), lambda x: round(x, 4))) AS edge FROM orders""")
def bin_edges(spark, sf_dir):
    out = ordering.exact_quantiles(table(spark, sf_dir, "orders"), "o_totalprice", [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0])
    return out.select("prob", F.round("quantile", 4).alias("edge"))


@query("bin_sample", _BINS_SQL + f"""
    SELECT zpid, round(ppsf, {R}) AS ppsf, bin FROM binned
    QUALIFY row_number() OVER (PARTITION BY bin ORDER BY md5('42|' || zpid), zpid) <= CASE WHEN bin IN (1, 2, 11, 12) THEN 40 ELSE 20 END""")
def bin_sample(spark, sf_dir):
    out = sampling.bin_sample(binned_pool(spark, sf_dir), "zpid", "bin", sampling.bin_quotas(sampling.bin_table(spark, BINS, 20), 20), 40, 42)
    return out.select("zpid", F.round("ppsf", R).alias("ppsf"), "bin").orderBy("bin", "ppsf")


_SINGLES = f"""
    singles AS (SELECT label, zpid, image_path FROM photos WHERE label IN {_ROOM_LIST}
        QUALIFY row_number() OVER (PARTITION BY label, zpid ORDER BY md5('42|' || label || '|' || zpid || '|' || image_path), image_path) = 1)"""


@query("stratified_sample", with_views("photos") + "," + _SINGLES + """
    SELECT label, zpid, image_path FROM singles QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('42|' || zpid), zpid) <= 38""")
def stratified_sample(spark, sf_dir):
    return sampling.stratified_sample(views.photos(spark, sf_dir), "label", "zpid", "image_path", ROOMS, 38, 42)


@query("sample_shortfalls", with_views("photos") + """
    SELECT l.label, count(p.zpid) AS n FROM (VALUES ('kitchen'), ('bathroom'), ('attic')) l(label)
    LEFT JOIN (SELECT DISTINCT label, zpid FROM photos QUALIFY row_number() OVER (PARTITION BY label ORDER BY zpid) <= 38) p USING (label)
    GROUP BY l.label HAVING count(p.zpid) < 25""")
def sample_shortfalls(spark, sf_dir):
    sample = sampling.stratified_sample(views.photos(spark, sf_dir), "label", "zpid", "image_path", ("kitchen", "bathroom", "attic"), 38, 42)
    return sampling.shortfalls(sample, "label", ("kitchen", "bathroom", "attic"), 25)


_QUOTA_SQL = """
    w AS (SELECT bin, CASE WHEN bin IN (1, 2, 11, 12) THEN 17 ELSE 10 END AS weight FROM {bins}),
    s AS (SELECT *, 38 * weight / sum(weight) OVER () AS share FROM w),
    b AS (SELECT *, CAST(floor(share) AS BIGINT) AS base FROM s),
    quota AS (SELECT bin, weight, base + (row_number() OVER (ORDER BY round(base - share, 9), bin) <= 38 - sum(base) OVER ())::BIGINT AS q FROM b)"""


@query("allocate", _BINS_SQL + "," + _QUOTA_SQL.format(bins="(SELECT DISTINCT bin FROM binned)") + " SELECT bin, weight, q AS quota FROM quota")
def allocate(spark, sf_dir):
    bins = binned_pool(spark, sf_dir).select("bin").distinct()
    return sampling.allocate(sampling.bin_table(spark, BINS, 17).join(bins, "bin"), 38, "bin")


_TWO_PASS_SQL = _BINS_SQL + """,
    photos AS (SELECT 'images/' || l_orderkey || '/' || l_linenumber || '_' || l_partkey || '_' || l_suppkey || '.jpg' AS image_path, l_orderkey AS zpid,
        CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'kitchen' WHEN 'AO' THEN 'bathroom' WHEN 'NF' THEN 'bedroom' WHEN 'NO' THEN 'living_room' ELSE 'other' END AS label
        FROM lineitem),
    labelled AS (SELECT label, zpid, bin, image_path FROM photos JOIN binned USING (zpid) WHERE label <> 'other'),
    singles AS (SELECT * FROM labelled QUALIFY row_number() OVER (PARTITION BY label, bin, zpid
        ORDER BY md5('42|' || label || '|' || bin || '|' || zpid || '|' || image_path), image_path) = 1),
""" + _QUOTA_SQL.format(bins=f"(SELECT unnest(range(1, {BINS + 1})) AS bin)") + """,
    pass1 AS (SELECT s.* FROM singles s JOIN quota USING (bin) QUALIFY row_number() OVER (PARTITION BY label, bin ORDER BY md5('42|' || zpid), zpid) <= q),
    rest AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42-top-up|' || zpid), zpid) AS rn FROM
        (SELECT * FROM singles EXCEPT SELECT * FROM pass1)),
    taken AS (SELECT label, count(*) AS n FROM pass1 GROUP BY label),
    sampled AS (SELECT label, zpid, bin, image_path, 1 AS pass_no FROM pass1
        UNION ALL SELECT r.label, zpid, bin, image_path, 2 FROM rest r LEFT JOIN taken USING (label) WHERE rn <= 38 - coalesce(n, 0))"""


def _labelled(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    path = F.concat(F.lit("images/"), F.col("l_orderkey").cast("string"), F.lit("/"), F.concat_ws(
        "_", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")), F.lit(".jpg"))
    flag = F.concat("l_returnflag", "l_linestatus")
    label = F.when(flag == "AF", "kitchen").when(flag == "AO", "bathroom").when(flag == "NF", "bedroom").when(flag == "NO", "living_room")
    photos = li.select(path.alias("image_path"), F.col("l_orderkey").alias("zpid"), label.alias("label")).filter("label is not null")
    return photos.join(binned_pool(spark, sf_dir).select("zpid", "bin"), "zpid")


def _two_pass(spark, sf_dir):
    quotas = sampling.allocate(sampling.bin_table(spark, BINS, 17), 38, "bin")
    return sampling.two_pass_sample(_labelled(spark, sf_dir), "label", "zpid", "image_path", "bin", 38, quotas, 42)


@query("two_pass_sample", _TWO_PASS_SQL + " SELECT label, zpid, bin, image_path, pass_no FROM sampled")
def two_pass_sample(spark, sf_dir):
    return _two_pass(spark, sf_dir)


@query("sample_plus_custom", _TWO_PASS_SQL + """
    SELECT label, CAST(zpid AS VARCHAR) AS zpid, bin, image_path, 'sampled' AS source FROM sampled
    UNION ALL SELECT CASE WHEN s_nationkey % 2 = 0 THEN 'kitchen' ELSE 'bedroom' END, 'custom_' || s_suppkey, NULL, 'custom/' || s_suppkey || '.jpg', 'custom' FROM supplier""")
def sample_plus_custom(spark, sf_dir):
    key = F.col("s_suppkey").cast("string")
    custom = table(spark, sf_dir, "supplier").select(
        F.when(F.col("s_nationkey") % 2 == 0, "kitchen").otherwise("bedroom").alias("label"),
        F.concat(F.lit("custom_"), key).alias("zpid"), F.concat(F.lit("custom/"), key, F.lit(".jpg")).alias("image_path"))
    sampled = _two_pass(spark, sf_dir).drop("pass_no").withColumn("zpid", F.col("zpid").cast("string"))
    return sampling.with_custom_rows(sampled, custom)


@query("capped_sample", with_views("photos") + """,
    c AS (SELECT * FROM photos QUALIFY row_number() OVER (PARTITION BY zpid ORDER BY image_path) <= 6)
    SELECT zpid, image_path FROM c ORDER BY md5('7|' || zpid), zpid, image_path LIMIT 100""")
def capped_sample(spark, sf_dir):
    return sampling.capped_sample(views.photos(spark, sf_dir), "zpid", "image_path", 6, 100, 7).select("zpid", "image_path")


_COVER_SQL = with_views("photos") + f""",
    firsts AS (SELECT zpid, label, min(image_path) AS f FROM photos WHERE label IN {_ROOM_LIST} GROUP BY ALL),
    covered AS (SELECT p.*, (SELECT count(*) FROM firsts f WHERE f.zpid = p.zpid AND f.f < p.image_path) AS seen_before FROM photos p),
    processed AS (SELECT * FROM covered WHERE seen_before < 4)"""


@query("coverage_prefix", _COVER_SQL + " SELECT image_path, zpid, label FROM processed")
def coverage_prefix(spark, sf_dir):
    return sampling.coverage_prefix(views.photos(spark, sf_dir), "zpid", "image_path", "label", ROOMS).select("image_path", "zpid", "label")


@query("quota_prefix", _COVER_SQL + """,
    per AS (SELECT zpid, count(*) AS calls, """ + ", ".join(f"bool_or(label = '{r}')::INT AS h{i}" for i, r in enumerate(ROOMS)) + """ FROM processed GROUP BY zpid),
    run AS (SELECT zpid, calls, row_number() OVER w AS position, coalesce(sum(calls) OVER p, 0) AS before, """
       + ", ".join(f"coalesce(sum(h{i}) OVER p, 0) AS b{i}" for i in range(4)) + """ FROM per
        WINDOW w AS (ORDER BY md5('42|' || zpid), zpid), p AS (ORDER BY md5('42|' || zpid), zpid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT zpid, position, calls, CAST(least(calls, 3000 - before) AS BIGINT) AS calls_allowed FROM run
    WHERE NOT (b0 >= 250 AND b1 >= 250 AND b2 >= 250 AND b3 >= 250) AND before < 3000""")
def quota_prefix(spark, sf_dir):
    processed = sampling.coverage_prefix(views.photos(spark, sf_dir), "zpid", "image_path", "label", ROOMS)
    return sampling.quota_prefix(processed, "zpid", "label", ROOMS, 250, 3000, 42)


@query("chunk_plan", with_views("photos") + """
    SELECT chunk_id, count(*) AS n, min(image_path) AS first_path, max(image_path) AS last_path FROM
        (SELECT image_path, 'full_' || lpad(CAST((row_number() OVER (ORDER BY image_path) - 1) // 11539 AS VARCHAR), 3, '0') AS chunk_id FROM photos) GROUP BY chunk_id""")
def chunk_plan(spark, sf_dir):
    plan = sampling.chunk_plan(views.photos(spark, sf_dir), "image_path", sampling.rows_per_chunk())
    return plan.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.min("image_path").alias("first_path"), F.max("image_path").alias("last_path"))


@query("kfold", """
    SELECT o_orderkey, CAST(('0x' || substr(md5('42|' || o_orderkey), 1, 8))::BIGINT % 5 AS INT) AS fold FROM orders""")
def kfold(spark, sf_dir):
    return sampling.kfold(table(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey", "fold")


@query("balanced_kfold", """
    SELECT o_orderkey, CAST((row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) - 1) % 5 AS INT) AS fold FROM orders""")
def balanced_kfold(spark, sf_dir):
    return sampling.balanced_kfold(table(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey", "fold")


@query("seeded_order", """
    SELECT c_custkey, md5('42|' || c_custkey || '|' || c_mktsegment) AS order_key FROM customer""")
def seeded_order(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", seeded.order_key(42, "c_custkey", "c_mktsegment").alias("order_key"))
