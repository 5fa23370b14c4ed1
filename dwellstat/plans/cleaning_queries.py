"""Parsing, cleaning and enrichment over the given tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from dwellstat import reference_values as rv
from dwellstat.functions import checks, dates, facts, history, text
from dwellstat.operators import agreement, cleaning, enrich, joins, ordering, photos, stages, summaries
from dwellstat.plans import views
from dwellstat.plans.registry import query, table
from dwellstat.plans.views import with_views

R = 6  # decimals compared between engines


@query("lenient_parse", """
    SELECT c_custkey, trim(split_part('  ' || c_name || ' , x', ',', 1)) AS first_part,
           try_cast(trim(replace(replace(c_custkey || ',' || '000 Lot', ',', ''), 'Lot', '')) AS DOUBLE) AS lot_area,
           try_cast(regexp_replace('$' || c_acctbal || ' USD', '[^0-9.]', '', 'g') AS DOUBLE) AS digits,
           try_cast(replace('$1,' || c_custkey, '$', '').replace(',', '') AS DOUBLE) AS currency,
           CASE WHEN c_nationkey % 5 <> 0 THEN CAST(c_nationkey AS BIGINT) END AS lot_key,
           CAST(c_nationkey AS VARCHAR) AS code
    FROM customer""")
def lenient_parse(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    nation = F.col("c_nationkey").cast("string")
    return c.select(
        "c_custkey",
        text.first_part(F.concat(F.lit("  "), "c_name", F.lit(" , x"))).alias("first_part"),
        text.lenient_double(F.concat(F.col("c_custkey").cast("string"), F.lit(",000 Lot")), ",", "Lot").alias("lot_area"),
        text.digits_double(F.concat(F.lit("$"), F.col("c_acctbal").cast("string"), F.lit(" USD"))).alias("digits"),
        text.currency_double(F.concat(F.lit("$1,"), F.col("c_custkey").cast("string"))).alias("currency"),
        text.lenient_long(F.when(F.col("c_nationkey") % 5 != 0, F.concat(nation, F.lit(".0"))).otherwise("n/a")).alias("lot_key"),
        text.code_string(F.concat(nation, F.lit(".0"))).alias("code"),
    )


@query("id_from_url", """
    SELECT page_id, nullif(regexp_extract(url || CASE WHEN page_id % 3 = 0 THEN '' ELSE '/' || page_id || '_zpid/' END, '/(\\d+)_zpid', 1), '') AS zpid,
           regexp_extract('images/' || page_id || CASE WHEN page_id % 2 = 0 THEN '/a_hero.jpg' ELSE '/b_1.PNG' END, '([^/]+)/[^/]*$', 1) AS folder,
           (page_id % 2 = 0)::INT AS is_hero,
           CASE WHEN page_id % 2 = 0 THEN 'image/jpeg' ELSE 'image/png' END AS mime,
           CASE WHEN page_id % 3 = 0 THEN 'webp' WHEN page_id % 3 = 1 THEN 'png' ELSE 'jpg' END AS saved_as
    FROM pages""")
def id_from_url(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    k = F.col("page_id")
    path = F.concat(F.lit("images/"), k.cast("string"), F.when(k % 2 == 0, F.lit("/a_hero.jpg")).otherwise("/b_1.PNG"))
    link = F.concat("url", F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("/"), k.cast("string"), F.lit("_zpid/"))))
    content = F.when(k % 3 == 0, "image/webp; q=1").when(k % 3 == 1, "image/png").otherwise("text/html")
    return p.select(
        "page_id", text.listing_id(link).alias("zpid"), text.parent_folder(path).alias("folder"), text.is_hero(path).alias("is_hero"),
        text.mime_of(path).alias("mime"), text.suffix_of_content_type(content).alias("saved_as"),
    )


@query("url_tokens", """
    WITH cells AS (SELECT page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hrefs FROM pages),
    parts AS (SELECT page_id, unnest(string_split_regex(url || ' | ' || array_to_string(hrefs, ','), '[\\s,|]+')) AS link FROM cells)
    SELECT page_id, link, count(*) AS n FROM parts WHERE link LIKE 'http%' GROUP BY page_id, link""")
def url_tokens(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    hrefs = F.array_join(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), ",")
    links = p.select("page_id", F.explode(text.link_list(F.concat(F.col("url"), F.lit(" | "), hrefs))).alias("link"))
    return links.groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("n"))


def _line_key():
    parts = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    return F.concat_ws("-", *parts, F.date_format("l_shipdate", "yyyyMMdd"))


@query("photo_variants", """
    WITH v AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d') AS listing, l_partkey AS p, l_suppkey AS s, l_linenumber AS n FROM lineitem),
    urls AS (SELECT listing, unnest([0, 1, 2, 3]) AS pos, unnest([
        'http://x/fp/' || md5('a' || p % 3) || '-cc_ft_' || 100 * n || '.jpg',
        'http://x/fp/' || md5('a' || s % 3) || '-uncropped_scaled_within_1_' || 100 * (s % 7) || '.webp',
        'http://x/other/' || s % 2 || '.jpg',
        'http://x/fp/' || md5('a' || p % 3) || '-cc_ft_400.jpg']) AS url FROM v),
    keyed AS (SELECT *, coalesce(nullif(regexp_extract(url, '/([a-f0-9]{16,})[-_]', 1), ''), regexp_extract(url, '([^/]*)$', 1)) AS k,
        coalesce(try_cast(nullif(regexp_extract(url, '(?:cc_ft_|within_\\d+_)(\\d+)', 1), '') AS BIGINT), 0) AS size FROM urls),
    best AS (SELECT listing, k, arg_min(url, (-size, pos)) AS url, min(pos) AS first_pos FROM keyed GROUP BY listing, k)
    SELECT listing, row_number() OVER (PARTITION BY listing ORDER BY first_pos) - 1 AS img_index, k AS photo_hash, url FROM best""")
def photo_variants(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    listing = _line_key()

    def digest(c):
        return F.md5(F.concat(F.lit("a"), (F.col(c) % 3).cast("string")))

    cell = F.concat_ws(
        ",",
        F.concat(F.lit("http://x/fp/"), digest("l_partkey"), F.lit("-cc_ft_"), (F.col("l_linenumber") * 100).cast("string"), F.lit(".jpg")),
        F.concat(F.lit("http://x/fp/"), digest("l_suppkey"), F.lit("-uncropped_scaled_within_1_"), (F.col("l_suppkey") % 7 * 100).cast("string"), F.lit(".webp")),
        F.concat(F.lit("http://x/other/"), (F.col("l_suppkey") % 2).cast("string"), F.lit(".jpg")),
        F.concat(F.lit("http://x/fp/"), digest("l_partkey"), F.lit("-cc_ft_400.jpg")),
    )
    cells = li.select(listing.alias("listing"), cell.alias("cell"))
    return photos.largest_variants(cells, text.link_list("cell"), "listing")


LINK_CELL_SQL = """
    WITH cells AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d') AS zpid,
        'http://p/' || l_linenumber % 3 || '.jpg' AS hero,
        ['http://p/' || l_partkey % 3 || '.jpg', 'http://p/' || l_suppkey % 3 || '.jpg', '', 'http://p/' || l_linenumber % 3 || '.jpg',
         'http://p/' || l_partkey % 3 || '.jpg'] AS links FROM lineitem),
    parts AS (SELECT zpid, hero, unnest(links) AS url, unnest([1, 2, 3, 4, 5]) AS pos FROM cells)"""


def _link_cells(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    key = _line_key()

    def link(c):
        return F.concat(F.lit("http://p/"), (F.col(c) % 3).cast("string"), F.lit(".jpg"))

    cell = F.concat(link("l_partkey"), F.lit(" , "), link("l_suppkey"), F.lit(",,"), link("l_linenumber"), F.lit(","), link("l_partkey"))
    return li.select(key.alias("zpid"), link("l_linenumber").alias("main_image-src"), cell.alias("all_images"))


@query("dedup_link_list", LINK_CELL_SQL + """,
    firsts AS (SELECT zpid, url, min(pos) AS pos FROM parts WHERE url <> '' GROUP BY zpid, url)
    SELECT zpid, string_agg(url, ',' ORDER BY pos) AS all_images FROM firsts GROUP BY zpid""")
def dedup_link_list(spark, sf_dir):
    return _link_cells(spark, sf_dir).select("zpid", text.distinct_links("all_images").alias("all_images"))


@query("image_tasks", LINK_CELL_SQL + """,
    kept AS (SELECT *, row_number() OVER (PARTITION BY zpid ORDER BY pos) - 1 AS list_position FROM parts WHERE url LIKE 'http%')
    SELECT zpid, url, list_position, url = hero AS is_hero,
        'images/' || zpid || '/' || zpid || '_' || CASE WHEN url = hero THEN 'hero'
            ELSE CAST(count(*) FILTER (url <> hero) OVER (PARTITION BY zpid ORDER BY list_position) AS VARCHAR) END AS stem
    FROM kept""")
def image_tasks(spark, sf_dir):
    out = photos.image_tasks(_link_cells(spark, sf_dir))
    return out.withColumn("list_position", F.col("list_position").cast("bigint"))


@query("listing_links", """
    SELECT l_orderkey AS zpid, 'http://p/' || l_partkey || '.jpg' AS url FROM lineitem
    WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem)
    UNION ALL SELECT l_orderkey, 'http://p/' || l_suppkey || '.jpg' FROM lineitem
    WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem)""")
def listing_links(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    cell = F.concat(F.lit("http://p/"), F.col("l_partkey").cast("string"), F.lit(".jpg,http://p/"), F.col("l_suppkey").cast("string"), F.lit(".jpg"))
    rows = li.select(F.col("l_orderkey").alias("zpid"), cell.alias("all_images"))
    return rows.filter(F.col("zpid") == rows.agg(F.min("zpid")).scalar()).select("zpid", F.explode(F.split("all_images", ",")).alias("url"))


_RAW_SALE_SQL = """
    WITH h AS (SELECT o_orderkey AS k, o_orderkey, o_custkey, o_orderstatus, o_orderkey % 19 = 0 AS broken,
        CASE WHEN o_orderstatus = 'O' THEN 3 ELSE 2 END AS pos,
        CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE CAST(CAST(floor(o_totalprice * 20) AS BIGINT) AS VARCHAR) END AS p2,
        CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE strftime(o_orderdate, '%m/%d/%Y') END AS d2 FROM orders),
    picked AS (SELECT *, CASE WHEN pos = 2 THEN p2 ELSE '250000' END AS p, CASE WHEN pos = 2 THEN d2 ELSE '02/03/1994' END AS d FROM h),
    sale AS (SELECT *, CASE WHEN NOT broken AND p <> '' AND d IS NOT NULL THEN p END AS sold_price_text,
        CASE WHEN NOT broken AND p <> '' AND d IS NOT NULL THEN d END AS sold_date FROM picked)"""


@query("sale_from_history", _RAW_SALE_SQL + " SELECT k AS row_key, sold_price_text AS sold_price, sold_date FROM sale")
def sale_from_history(spark, sf_dir):
    raw = views.raw_sales(spark, sf_dir)
    sale = history.first_sale(*[history.history_values(f"price_history_{p}", f"price_history_{p}") for p in ("event", "price", "date")])
    return raw.select("row_key", sale.alias("s")).select("row_key", "s.*")


_CLEAN_SQL = _RAW_SALE_SQL + """,
    typed AS (SELECT k, o_custkey, o_orderstatus, sold_date, try_cast(sold_price_text AS DOUBLE) AS sold_price,
        CASE k % 4 WHEN 0 THEN 'Condo' WHEN 1 THEN 'Cooperative' WHEN 2 THEN 'Townhouse' END AS type,
        CASE WHEN k % 10 <> 0 THEN CAST(90 + k * 37 % 21000 AS DOUBLE) END AS sqft, CAST(1000 + k % 3000 AS DOUBLE) AS lot FROM sale),
    ruled AS (SELECT *, CASE WHEN sqft < 100 OR sqft > 20000 OR (k % 4 IN (0, 1) AND sqft > 10000) THEN NULL ELSE sqft END AS area FROM typed),
    tagged AS (SELECT *, CASE WHEN sold_price IS NULL THEN 'sale_missing'
        WHEN sold_price < 100000 OR sold_price > 10000000 THEN 'price_out_of_range'
        WHEN sold_price / area < 100 THEN 'price_per_sqft_below_floor' END AS reject_reason FROM ruled)"""


@query("clean_sales", _CLEAN_SQL + f"""
    SELECT k AS row_key, CASE WHEN k % 101 <> 0 THEN CAST(k AS VARCHAR) END AS zpid, o_custkey || ' Main St Apt ' || k % 9 AS address,
        CASE WHEN k % 3 = 0 THEN 'Queens' ELSE 'Brooklyn' END AS borough, type, area AS "area-sqft",
        CASE WHEN k % 4 IN (0, 1) THEN NULL ELSE lot END AS lot_area, CAST(1900 + k % 120 AS DOUBLE) AS built_in,
        CASE WHEN k % 8 <> 0 THEN k % 4 + 0.5::DOUBLE END AS bathrooms, sold_price, sold_date,
        CAST(date_diff('day', strptime(sold_date, '%m/%d/%Y')::DATE, DATE '2026-07-02') AS INT) AS days_old,
        CAST(2 AS INT) AS fact_rows, k % 6 || '' AS bedroom_fact, 'Status ' || o_orderstatus AS bare_fact
    FROM tagged WHERE reject_reason IS NULL""")
def clean_sales(spark, sf_dir):
    kept, _ = cleaning.clean_sales(views.raw_sales(spark, sf_dir))
    facts_by_label = F.map_from_entries(F.transform("facts_features", lambda r: F.struct(r["label"], r["value"])))
    return kept.select(
        "row_key", "zpid", "address", "borough", "type", "area-sqft", "lot_area", "built_in", "bathrooms", "sold_price", "sold_date",
        "days_old", F.size("facts_features").alias("fact_rows"), F.try_element_at(facts_by_label, F.lit("Bedrooms")).alias("bedroom_fact"),
        F.try_element_at(facts_by_label, F.lit("_bare")).alias("bare_fact"),
    )


@query("reject_split", _CLEAN_SQL + """
    SELECT reject_reason, count(*) AS n, min(k) AS first_row FROM tagged GROUP BY reject_reason""")
def reject_split(spark, sf_dir):
    kept, rejected = cleaning.clean_sales(views.raw_sales(spark, sf_dir))
    both = kept.select(F.lit(None).cast("string").alias("reject_reason"), "row_key").unionByName(rejected.select("reject_reason", "row_key"))
    return both.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"), F.min("row_key").alias("first_row"))


@query("price_per_sqft_rules", f"""
    WITH area AS (SELECT l_orderkey, sum(l_quantity) AS sqft FROM lineitem GROUP BY l_orderkey),
    priced AS (SELECT o_orderkey, o_totalprice AS price, CASE WHEN sqft < 20 OR sqft > 300 THEN NULL ELSE sqft END AS sqft
        FROM orders LEFT JOIN area ON o_orderkey = l_orderkey)
    SELECT o_orderkey, price, sqft, round(price / sqft, {R}) AS ppsf FROM priced
    WHERE NOT coalesce(price < 10000 OR price > 400000, false) AND NOT coalesce(price / sqft < 500, false) AND price > 0""")
def price_per_sqft_rules(spark, sf_dir):
    area = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("sqft"))
    priced = joins.lookup(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price")), area, ["o_orderkey"])
    odd = (F.col("sqft") < 20) | (F.col("sqft") > 300)
    priced = priced.withColumn("sqft", F.when(~F.coalesce(odd, F.lit(False)), F.col("sqft")))
    ppsf = F.try_divide("price", "sqft")
    rules = [("range", (F.col("price") < 10000) | (F.col("price") > 400000)), ("floor", ppsf < 500)]
    kept, _ = cleaning.split_rejects(cleaning.tag_rejects(priced, rules))
    return cleaning.positive_target(kept, "price").withColumn("ppsf", F.round(ppsf, R))


@query("age_days", """
    SELECT o_orderkey, CAST(DATE '2026-07-02' - CAST(o_orderdate AS DATE) AS INT) AS days_old,
        least(date_trunc('month', o_orderdate)::DATE, DATE '1999-06-15') AS snapshot,
        CASE WHEN o_orderkey % 5 <> 0 THEN strptime(strftime(o_orderdate, '%Y-%m-%d') || 'T101112', '%Y-%m-%dT%H%M%S') END AS run_time
    FROM orders""")
def age_days(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    us = F.date_format("o_orderdate", "M/d/yyyy")
    folder = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(F.col("o_orderkey") % 5 != 0, "T101112").otherwise("T1x"))
    return o.select(
        "o_orderkey",
        dates.age_days(dates.us_date(us)).alias("days_old"),
        dates.snapshot_date(dates.us_date(us), dt.date(1999, 6, 15)).alias("snapshot"),
        dates.folder_timestamp(folder).alias("run_time"),
    )


_ADDRESS_SQL = """
    WITH a AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 20 = 0 THEN 'Nospace' ELSE
        c_custkey % 300 || ' ' || c_mktsegment || ' Ave' || CASE c_custkey % 4 WHEN 0 THEN ' APT 3b, rear' WHEN 1 THEN ' #2'
            WHEN 2 THEN ' Unit 5 Floor 2' ELSE '' END END AS address FROM customer),
    keyed AS (SELECT *, CASE WHEN instr(address, ' ') > 0 THEN split_part(address, ' ', 1) END AS house_number,
        CASE WHEN instr(address, ' ') > 0 THEN trim(regexp_replace(substr(address, instr(address, ' ') + 1),
            '\\s+(#|apt\\b|unit\\b|ph\\b|penthouse\\b|fl\\b|floor\\b|ste\\b|suite\\b|rm\\b|room\\b).*', '', 'is')) END AS street FROM a)"""


def _addresses(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    tail = F.when(k % 4 == 0, " APT 3b, rear").when(k % 4 == 1, " #2").when(k % 4 == 2, " Unit 5 Floor 2").otherwise("")
    address = F.when(k % 20 == 0, F.lit("Nospace")).otherwise(
        F.concat((k % 300).cast("string"), F.lit(" "), F.col("c_mktsegment"), F.lit(" Ave"), tail))
    return c.select("c_custkey", "c_nationkey", address.alias("address"))


@query("street_key", _ADDRESS_SQL + """ SELECT c_custkey, house_number, street,
    CASE WHEN c_nationkey % 4 <> 0 THEN nullif(CAST(c_nationkey % 5 || lpad(CAST(c_custkey % 300 AS VARCHAR), 5, '0') || '0000' AS BIGINT), 0) END AS bbl
    FROM keyed""")
def street_key(spark, sf_dir):
    block = F.lpad((F.col("c_custkey") % 300).cast("string"), 5, "0")
    borough = F.when(F.col("c_nationkey") % 4 != 0, (F.col("c_nationkey") % 5).cast("string")).otherwise("")
    return _addresses(spark, sf_dir).select(
        "c_custkey", text.house_number("address").alias("house_number"), text.street_name("address").alias("street"),
        text.lot_key(borough, block, F.lit("0000")).alias("bbl"),
    )


@query("geocode_join", _ADDRESS_SQL + f""",
    known AS (SELECT house_number, street, n_name AS borough, min(c_custkey) AS bbl, round(avg(c_custkey), {R}) AS latitude
        FROM keyed JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 = 0 AND street IS NOT NULL GROUP BY ALL)
    SELECT c_custkey, house_number, street, n_name AS borough, known.bbl, known.latitude
    FROM keyed JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN known USING (house_number, street) WHERE known.borough = n_name
    UNION ALL
    SELECT c_custkey, house_number, street, n_name, NULL, NULL FROM keyed JOIN nation ON c_nationkey = n_nationkey
    WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.house_number = keyed.house_number AND k.street = keyed.street AND k.borough = n_name)""")
def geocode_join(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("borough"))
    located = _addresses(spark, sf_dir).join(nation, "c_nationkey")
    known = (
        located.filter((F.col("c_custkey") % 3 == 0) & text.street_name("address").isNotNull())
        .groupBy(text.house_number("address").alias("house_number"), text.street_name("address").alias("street"), "borough")
        .agg(F.min("c_custkey").alias("bbl"), F.round(F.avg("c_custkey"), R).alias("latitude"))
    )
    out = enrich.geocode(located, known)
    return out.select("c_custkey", "house_number", "street", "borough", "bbl", "latitude")


@query("zip_urls", """
    WITH z AS (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'none' ELSE CAST(11200 + c_custkey % 50 AS VARCHAR) || '.0' END AS raw FROM customer),
    n AS (SELECT c_custkey, nullif(regexp_extract(regexp_replace(raw, '\\.0$', ''), '\\d{5}'), '') AS zip FROM z)
    SELECT c_custkey, zip, coalesce('https://www.zillow.com/brooklyn-new-york-ny-' || zip || '/sold/?searchQueryState=' ||
        url_encode('{"filterState":{"price":{"min":1001},"rs":{"value":true},"fsba":{"value":false},"fsbo":{"value":false},' ||
        '"nc":{"value":false},"cmsn":{"value":false},"auc":{"value":false},"fore":{"value":false},"mf":{"value":false},' ||
        '"land":{"value":false},"apa":{"value":false},"manu":{"value":false},"doz":{"value":"12m"}}}'), '') AS url FROM n""")
def zip_urls(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    raw = F.when(F.col("c_custkey") % 9 == 0, "none").otherwise(F.concat((11200 + F.col("c_custkey") % 50).cast("string"), F.lit(".0")))
    zipped = c.select("c_custkey", text.zip5(raw).alias("zip"))
    return zipped.withColumn("url", text.sold_search_url("zip"))


@query("facts_html", """
    WITH x AS (SELECT c_custkey, c_mktsegment, c_nationkey, c_acctbal, c_name FROM customer)
    SELECT c_custkey, c_mktsegment AS category, '_general' AS subsection, 'Nation' AS label, c_nationkey || ':x' AS value FROM x
    UNION ALL SELECT c_custkey, c_mktsegment, 'Money & more', 'Balance', CAST(c_custkey AS VARCHAR) FROM x
    UNION ALL SELECT c_custkey, c_mktsegment, 'Money & more', '_bare', 'no label ' || c_name FROM x
    UNION ALL SELECT c_custkey, '_uncategorised', '_general', '_bare', 'plain' FROM x WHERE c_custkey % 2 = 0""")
def facts_html(spark, sf_dir):
    c = stages.spread(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_name"))
    html = F.concat(
        F.lit('<div><div data-testid="category-group"><h3> '), "c_mktsegment", F.lit(" </h3><ul><li>Nation: "),
        F.col("c_nationkey").cast("string"), F.lit(":x</li></ul><h6>Money &amp; more</h6><li>Balance: 0</li><li>Balance: <b>"),
        F.col("c_custkey").cast("string"), F.lit("</b><br></li><li> no <i>label</i> "), "c_name", F.lit("</li><li></li></div>"),
        F.when(F.col("c_custkey") % 2 == 0, F.lit('<div data-testid="category-group"><li>plain</li></div>')).otherwise(""),
        F.lit("<li>outside: any group</li></div>"),
    )
    return c.select("c_custkey", F.inline(facts.facts_rows(html)))


@query("facts_of_pages")
def facts_of_pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    rows = p.select("page_id", F.inline(facts.facts_rows("html", None, "h1", "h2", "li")))
    return rows.groupBy("category", "subsection", "label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("pages"))


@query("category_default", """
    SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'other' END AS label,
        CASE WHEN event_type IN ('click', 'view') THEN '' ELSE event_type END AS other_label,
        CASE WHEN event_id % 9 = 0 THEN 'n/a' WHEN value - 50 > 1 THEN 'high' WHEN value - 50 < -1 THEN 'low' ELSE 'ok' END AS direction
    FROM events""")
def category_default(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    label = text.allowed_or("event_type", ("click", "view"), "other")
    return e.select(
        "event_id", label.alias("label"), F.when(label == "other", F.col("event_type")).otherwise("").alias("other_label"),
        checks.gap_label(F.when(F.col("event_id") % 9 != 0, F.col("value") - 50)).alias("direction"),
    )


@query("taxonomy_audit", """
    SELECT event_type AS label, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view', 'purchase') GROUP BY event_type""")
def taxonomy_audit(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("event_type", "label")
    return summaries.frequency(photos.out_of_taxonomy(e, "label", ("click", "view", "purchase")), "label")


@query("contract_check", """
    WITH a AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 2 = 0 END AS is_room,
        CASE WHEN event_id % 3 = 0 THEN NULL ELSE round(value / 40, 0) + CASE WHEN event_id % 8 = 0 THEN 0.5::DOUBLE ELSE 0 END END AS score FROM events),
    v AS (SELECT event_id, 'room_flag_missing' AS rule FROM a WHERE is_room IS NULL
        UNION ALL SELECT event_id, 'score_missing' FROM a WHERE is_room AND score IS NULL
        UNION ALL SELECT event_id, 'score_for_other_room' FROM a WHERE NOT is_room AND score IS NOT NULL
        UNION ALL SELECT event_id, 'score_out_of_range' FROM a WHERE score < 1 OR score > 8
        UNION ALL SELECT event_id, 'score_not_whole' FROM a WHERE score <> floor(score))
    SELECT rule, count(*) AS n, min(event_id) AS first_id FROM v GROUP BY rule""")
def contract_check(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    answers = e.select(
        "event_id", F.when(i % 5 != 0, i % 2 == 0).alias("is_room"),
        F.when(i % 3 != 0, F.round(F.col("value") / 40, 0) + F.when(i % 8 == 0, 0.5).otherwise(0.0)).alias("score"),
    )
    broken = answers.select("event_id", F.explode(checks.score_violations("is_room", "score", F.lit(8))).alias("rule"))
    return broken.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query("level_contract", with_views("scores") + """,
    v AS (SELECT event_id, 'level_out_of_range' AS rule FROM scores WHERE level > CASE room_type WHEN 'kitchen' THEN 7 ELSE 8 END
        UNION ALL SELECT event_id, 'label_unknown' FROM scores WHERE coalesce(room_type_judgment NOT IN ('kitchen', 'bathroom', 'bedroom', 'living_room'), true)
        UNION ALL SELECT event_id, 'score_not_a_level' FROM scores WHERE room_type = 'living_room' AND score <> floor(score))
    SELECT rule, count(*) AS n FROM v GROUP BY rule""")
def level_contract(spark, sf_dir):
    rules = checks.level_violations("score", "level", "room_type", "room_type_judgment", agreement.top_level_of(), rv.SCORED_ROOMS)
    return summaries.frequency(views.scores(spark, sf_dir).select(F.explode(rules).alias("rule")), "rule")


@query("route_rooms", with_views("scores") + """
    SELECT scored_room, count(*) AS n FROM (SELECT CASE WHEN room_type_judgment IS NULL THEN room_type
        WHEN room_type_judgment IN ('kitchen', 'bathroom', 'bedroom', 'living_room') THEN room_type_judgment END AS scored_room FROM scores)
    WHERE scored_room IS NOT NULL GROUP BY scored_room""")
def route_rooms(spark, sf_dir):
    routed = photos.route(views.scores(spark, sf_dir), "room_type", "room_type_judgment")
    return summaries.frequency(routed.filter(F.col("scored_room").isNotNull()), "scored_room")


@query("rows_from_offset", """
    SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority <> '5-LOW' AND o_totalprice >= 2000
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10""")
def rows_from_offset(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    link = F.when(F.col("o_orderpriority") == "5-LOW", " ").otherwise(F.col("o_orderpriority"))
    kept = o.filter((F.trim(link) != "") & (F.col("o_totalprice") >= 2000)).orderBy(F.desc("o_totalprice"), "o_orderkey")
    return kept.offset(10).limit(25).select("o_orderkey", "o_totalprice")


@query("first_n_per_group", """
    SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 5""")
def first_n_per_group(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return ordering.top_per_group(o, ["o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey")], 5).drop("rank")


@query("error_and_validity_filters", with_views("scores") + """
    SELECT room_type, count(*) AS n, min(event_id) AS first_id FROM scores
    WHERE length(coalesce(error, '')) = 0 AND score > 0 AND latency_s >= 2 GROUP BY room_type""")
def error_and_validity_filters(spark, sf_dir):
    s = views.scores(spark, sf_dir)
    kept = s.filter(checks.no_error("error") & (F.col("score") > 0) & (F.col("latency_s") >= 2))
    return kept.groupBy("room_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query("natural_order", """
    SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS number,
        row_number() OVER (ORDER BY CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_size END NULLS LAST,
            CASE WHEN p_partkey % 10 = 0 THEN 'stem' ELSE 'kitchen' || p_size END, p_partkey) AS place FROM part""")
def natural_order(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 10 == 0, "a/1/stem.jpg").otherwise(F.concat(F.lit("a/1/kitchen"), F.col("p_size").cast("string"), F.lit(".jpg")))
    keyed = p.select("p_partkey", text.natural_number(name).alias("_n"), text.file_stem(name).alias("_stem"))
    # one sortable text per row, so that equal numbers can be cut into buckets as well
    number = F.when(F.col("_n") == float("inf"), "~").otherwise(F.lpad(F.col("_n").cast("bigint").cast("string"), 19, "0"))
    keyed = keyed.withColumn("_sort", F.concat_ws("|", number, "_stem", F.lpad(F.col("p_partkey").cast("string"), 19, "0")))
    numbered = ordering.row_numbers(ordering.text_bucket(keyed, "_sort"), ["_sort"], name="place")
    return numbered.select("p_partkey", F.when(F.col("_n") != float("inf"), F.col("_n")).alias("number"), "place")


@query("drop_rename_project", """
    SELECT c_custkey, c_acctbal AS lot_area FROM customer WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL""")
def drop_rename_project(spark, sf_dir):
    c = cleaning.drop_required(table(spark, sf_dir, "customer"), ["c_name", "c_nationkey"])
    return c.dropna(subset=["c_acctbal", "c_mktsegment"]).withColumnRenamed("c_acctbal", "lot_area").select("c_custkey", "lot_area")


# --- enrichment ------------------------------------------------------------------------------

_ASOF_SQL = with_views("sales", "lots") + """,
    bounds(boundary, version) AS (VALUES (DATE '1996-06-23', 'v1'), (DATE '1997-09-25', 'v2'), (DATE '1999-01-26', 'v3'), (DATE '2000-04-14', 'v4')),
    versioned AS (SELECT s.*, CASE WHEN sold_date IS NULL THEN NULL ELSE coalesce(b.version, 'v1') END AS version
        FROM sales s ASOF LEFT JOIN bounds b ON s.sold_date >= b.boundary),
    one_lot AS (SELECT * FROM lots QUALIFY row_number() OVER (PARTITION BY bbl, version ORDER BY assesstot) = 1),
    joined AS (SELECT v.*, l.bldgclass, l.assesstot, l.schooldist, l.histdist, l.landmark FROM versioned v LEFT JOIN one_lot l USING (bbl, version))"""


def _sales_with_lots(spark, sf_dir):
    sales = views.sales(spark, sf_dir).withColumn("version", enrich.version_as_of("sold_date", views.VERSIONS))
    return enrich.attach_lots(sales, views.lots(spark, sf_dir))


@query("asof_lot_version", _ASOF_SQL + f"""
    SELECT version, count(*) AS sales, count(bldgclass) AS matched, round(avg((bldgclass IS NOT NULL)::INT), {R}) AS matched_share,
        round(avg(sold_price), 4) AS mean_price, count(*) FILTER (sold_date < DATE '1996-06-23') AS predates_first
    FROM joined GROUP BY version""")
def asof_lot_version(spark, sf_dir):
    report = summaries.version_report(
        _sales_with_lots(spark, sf_dir), "version", "sold_price", F.col("bldgclass").isNotNull(),
        enrich.predates_versions("sold_date", views.VERSIONS),
    )
    return report.withColumns({"matched_share": F.round("matched_share", R), "mean_price": F.round("mean_price", 4)})


@query("lot_fields", _ASOF_SQL + f"""
    SELECT zpid, version, round(assesstot, 2) AS assesstot, bldgclass, regexp_replace(schooldist, '\\.0$', '') AS schooldist,
        CASE WHEN bldgclass IS NOT NULL THEN (histdist IS NOT NULL AND lower(trim(histdist)) <> 'individual landmark')::INT::DOUBLE END AS histdist,
        CASE WHEN bldgclass IS NOT NULL THEN (landmark IS NOT NULL)::INT::DOUBLE END AS landmark FROM joined""")
def lot_fields(spark, sf_dir):
    out = enrich.clean_lot_fields(_sales_with_lots(spark, sf_dir))
    return out.select("zpid", "version", F.round("assesstot", 2).alias("assesstot"), "bldgclass", "schooldist", "histdist", "landmark")


_BOUNDS_SQL = with_views("sales", "lots") + """,
    days(version, since) AS (VALUES ('v1', DATE '1993-06-23'), ('v2', DATE '1995-09-25'), ('v3', DATE '1997-01-26'), ('v4', DATE '1999-04-14')),
    known AS (SELECT bbl, since + CAST(bbl % 90 AS INTEGER) AS since, version, max(assesstot) AS assesstot FROM lots JOIN days USING (version) GROUP BY ALL)"""


@query("asof_boundaries", _BOUNDS_SQL + """
    SELECT s.zpid, k.since, k.version, round(k.assesstot, 2) AS assesstot FROM sales s ASOF LEFT JOIN known k ON s.bbl = k.bbl AND s.sold_date >= k.since""")
def asof_boundaries(spark, sf_dir):
    """Newest lot record at or before each sale, with boundaries that differ from lot to lot."""
    days = F.create_map(*[F.lit(x) for v, d in (("v1", dt.date(1993, 6, 23)), ("v2", dt.date(1995, 9, 25)), ("v3", dt.date(1997, 1, 26)), ("v4", dt.date(1999, 4, 14)))
                          for x in (v, d)])
    since = F.date_add(F.element_at(days, F.col("version")), (F.col("bbl") % 90).cast("int"))
    known = views.lots(spark, sf_dir).select("bbl", since.alias("since"), "assesstot", "version")
    out = joins.as_of(views.sales(spark, sf_dir), known, ["bbl"], "sold_date", "since")
    return out.select("zpid", "since", "version", F.round("assesstot", 2).alias("assesstot"))


@query("missing_versions", _ASOF_SQL + " SELECT DISTINCT version FROM versioned WHERE version IS NOT NULL AND version <> 'v3'")
def missing_versions(spark, sf_dir):
    sales = views.sales(spark, sf_dir).withColumn("version", enrich.version_as_of("sold_date", views.VERSIONS))
    return enrich.missing_versions(sales, "version", views.lots(spark, sf_dir).filter("version = 'v3'"))


_CATEGORY_SQL = with_views("pois", "homes") + """,
    tagged AS (SELECT *, ['amenity=' || amenity, 'shop=' || shop] AS tags FROM pois),
    by_category AS (SELECT * FROM (SELECT *, unnest(['dining', 'nightlife', 'groceries', 'retail', 'civic_finance', 'education', 'disamenity']) AS category FROM tagged)
        WHERE CASE category WHEN 'dining' THEN list_has_any(tags, ['amenity=restaurant', 'amenity=cafe', 'shop=coffee'])
            WHEN 'nightlife' THEN list_contains(tags, 'amenity=bar') WHEN 'groceries' THEN list_contains(tags, 'shop=bakery')
            WHEN 'retail' THEN list_contains(tags, 'shop=clothes') WHEN 'civic_finance' THEN list_contains(tags, 'amenity=bank')
            WHEN 'education' THEN list_contains(tags, 'amenity=school') ELSE list_contains(tags, 'amenity=fuel') END)"""


@query("radius_counts", _CATEGORY_SQL + """,
    dated AS (SELECT *, CASE WHEN sold_date IS NOT NULL THEN least(date_trunc('month', sold_date)::DATE, DATE '2024-03-10') END AS snapshot FROM homes WHERE latitude IS NOT NULL),
    hits AS (SELECT zpid, category, count(*) AS n FROM dated h JOIN by_category p ON p.valid_from <= snapshot
            AND (p.valid_to IS NULL OR snapshot < p.valid_to)
            AND abs(p.latitude - h.latitude) < 0.006
            AND 2 * 6371000.0::DOUBLE * asin(sqrt(pow(sin(radians(p.latitude - h.latitude) / 2), 2) + cos(radians(h.latitude)) * cos(radians(p.latitude))
                * pow(sin(radians(p.longitude - h.longitude) / 2), 2))) <= 600
        GROUP BY zpid, category)
    SELECT d.zpid, """ + ", ".join(
        f"CASE WHEN any_value(snapshot) IS NOT NULL THEN coalesce(max(n) FILTER (category = '{c}'), 0) END AS {c}" for c in rv.POI_CATEGORIES)
    + " FROM dated d LEFT JOIN hits USING (zpid) GROUP BY d.zpid")
def radius_counts(spark, sf_dir):
    pois = views.tagged_pois(spark, sf_dir).withColumn("category", F.explode(enrich.poi_categories("tags")))
    homes = views.homes(spark, sf_dir).withColumn("snapshot", dates.snapshot_date("sold_date", views.POI_LATEST))
    return enrich.radius_counts(homes, pois, tuple(rv.POI_CATEGORIES))


@query("tag_counts", with_views("pois") + """
    SELECT category, count(*) AS count FROM (SELECT 'amenity=' || amenity AS category FROM pois UNION ALL SELECT 'shop=' || shop FROM pois)
    WHERE category IS NOT NULL GROUP BY category""")
def tag_counts(spark, sf_dir):
    return enrich.tag_counts(views.tagged_pois(spark, sf_dir))


@query("circle_requests", with_views("homes") + """,
    n AS (SELECT *, date_trunc('month', sold_date)::DATE AS month,
        (row_number() OVER (PARTITION BY date_trunc('month', sold_date) ORDER BY zpid) - 1) // 100 AS chunk
        FROM homes WHERE latitude IS NOT NULL AND sold_date IS NOT NULL)
    SELECT least(month, DATE '2024-03-10') AS snapshot, month, chunk, count(*) AS circles, min(zpid) AS first_zpid, max(zpid) AS last_zpid, category, filter
    FROM n, (VALUES """ + ", ".join(f"('{c}', '{' or '.join(tags)}')" for c, tags in rv.POI_CATEGORIES.items()) + """) c(category, filter)
    GROUP BY month, chunk, category, filter""")
def circle_requests(spark, sf_dir):
    requests = enrich.circle_requests(views.homes(spark, sf_dir), views.POI_LATEST, rows_per_request=100)
    circles = F.transform(F.split("bcircles", r"\|"), lambda c: F.split_part(c, F.lit(":"), F.lit(1)).cast("bigint"))
    return requests.select(
        "snapshot", "month", "chunk", "circles", F.get(circles, 0).alias("first_zpid"),
        F.element_at(circles, -1).alias("last_zpid"), "category", "filter",
    )


# --- joins -----------------------------------------------------------------------------------


@query("lookup_join", """
    SELECT o_orderkey, n_name, c_acctbal FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) c
    ON CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def lookup_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("c_custkey"))
    c = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select("c_custkey", "c_nationkey", "c_acctbal")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    with_customer = joins.lookup(o, joins.require_unique(c, ["c_custkey"], "customer"), ["c_custkey"])
    return joins.lookup(with_customer, n, ["c_nationkey"]).select("o_orderkey", "n_name", "c_acctbal")


@query("semi_exclude", """
    SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
    AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
    AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)""")
def semi_exclude(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey"))
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    big = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    kept = joins.keep_matching(o, c.filter("c_acctbal > 0"), ["o_custkey"])
    kept = joins.exclude(kept, c.filter("c_mktsegment = 'BUILDING'"), ["o_custkey"])
    return joins.exclude(kept, big, ["o_orderkey"])


@query("pending_tasks", with_views("scores") + """,
    images AS (SELECT DISTINCT image_path FROM scores),
    grid AS (SELECT image_path, model, replicate FROM images, (SELECT unnest(['m0', 'm1', 'm2']) AS model), (SELECT unnest([1, 2, 3, 4, 5]) AS replicate))
    SELECT image_path, model, replicate FROM grid g WHERE NOT EXISTS (SELECT 1 FROM scores s WHERE s.image_path = g.image_path
        AND s.model = g.model AND s.replicate = g.replicate AND length(coalesce(s.error, '')) = 0)""")
def pending_tasks(spark, sf_dir):
    s = views.scores(spark, sf_dir)
    grid = joins.task_grid(s.select("image_path").distinct(), views.MODELS, 5)
    return joins.pending(grid, s, ["image_path", "model", "replicate"], error="error")


@query("usable_log_rows", with_views("scores") + """
    SELECT model, image_path, replicate, event_id, coalesce(error, '') AS error FROM scores QUALIFY row_number() OVER (
        PARTITION BY model, image_path, replicate ORDER BY (length(coalesce(error, '')) > 0)::INT, ts DESC, event_id) = 1""")
def usable_log_rows(spark, sf_dir):
    s = views.scores(spark, sf_dir)
    kept = joins.usable_rows(s, ["model", "image_path", "replicate"], "error", [F.desc("ts"), F.col("event_id")])
    return kept.select("model", "image_path", "replicate", "event_id", F.coalesce("error", F.lit("")).alias("error"))


@query("shared_and_missing_keys", """
    SELECT 'shared' AS side, count(*) AS n FROM (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N')
    UNION ALL SELECT 'only_first', count(*) FROM (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N')""")
def shared_and_missing_keys(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    a, b = [li.filter(F.col("l_returnflag") == f).select("l_orderkey") for f in ("A", "N")]
    shared = a.intersect(b).agg(F.lit("shared").alias("side"), F.count(F.lit(1)).alias("n"))
    return shared.unionByName(joins.exclude(a.distinct(), b, ["l_orderkey"]).agg(F.lit("only_first").alias("side"), F.count(F.lit(1)).alias("n")))
