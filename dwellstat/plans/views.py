"""Domain tables derived from the given tables, once as DataFrames and once as SQL text.

The SQL text is written separately (it is the check, not a translation at run time). Some rows are
given missing or odd values on purpose, by key, so that edge rules are exercised on whole tables.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellstat.operators import stages
from dwellstat.plans.registry import table

VERSIONS = (
    (dt.date(1996, 6, 23), "v1"),
    (dt.date(1997, 9, 25), "v2"),
    (dt.date(1999, 1, 26), "v3"),
    (dt.date(2000, 4, 14), "v4"),
)
POI_LATEST = dt.date(2024, 3, 10)
MODELS = ("m0", "m1", "m2")
RATERS = ("r0", "r1", "r2", "r3")
PRICED_MODELS = {"m0": "gpt-4o", "m1": "gemini-3.5-flash", "m2": "claude-haiku-4-5"}
AMENITIES = ("restaurant", "cafe", "bar", "bank", "school", "fuel", "bench")
SHOPS = ("coffee", "bakery", "clothes")


def _pick(values, index) -> F.Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("zpid"),
        F.col("o_totalprice").alias("sold_price"),
        F.when(F.col("o_orderkey") % 97 != 0, F.col("o_orderdate").cast("date")).alias("sold_date"),
        F.when(F.col("o_custkey") % 50 != 0, F.col("o_custkey")).alias("bbl"),
        F.col("o_orderpriority").alias("kind"),
        F.col("o_orderstatus").alias("status"),
    )


def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    each = c.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(len(VERSIONS))))).filter((F.col("c_custkey") + F.col("k")) % 11 != 0)
    key = F.col("c_custkey")
    rows = each.select(
        key.alias("bbl"),
        F.concat(F.lit("v"), F.col("k").cast("string")).alias("version"),
        F.col("c_mktsegment").alias("bldgclass"),
        (F.col("c_acctbal") + F.col("k") * 100).alias("assesstot"),
        F.concat(F.col("c_nationkey").cast("string"), F.lit(".0")).alias("schooldist"),
        F.when(key % 7 == 0, F.lit(" Individual Landmark")).when(key % 5 == 0, F.lit("District")).alias("histdist"),
        F.when(key % 6 == 0, F.lit("L")).alias("landmark"),
    )
    # some lots are listed twice
    return rows.withColumn(
        "assesstot", F.explode(F.when(F.col("bbl") % 13 == 0, F.array("assesstot", F.col("assesstot") + 1)).otherwise(F.array("assesstot")))
    )


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    flag = F.concat("l_returnflag", "l_linestatus")
    label = (
        F.when(flag == "AF", "kitchen").when(flag == "AO", "bathroom").when(flag == "NF", "bedroom")
        .when(flag == "NO", "living_room").when(flag == "RF", "floorplan").otherwise("other")
    )
    path = F.concat(
        F.lit("images/"), F.col("l_orderkey").cast("string"), F.lit("/"),
        F.concat_ws("_", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")),
        F.lit(".jpg"),
    )
    return li.select(path.alias("image_path"), F.col("l_orderkey").alias("zpid"), label.alias("label"))


def _room(event_type) -> F.Column:
    return (
        F.when(event_type == "view", "bathroom").when(event_type == "purchase", "bedroom")
        .when(event_type == "signup", "living_room").otherwise("kitchen")
    )


def _image() -> F.Column:
    return F.concat(F.lit("images/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type"), F.lit(".jpg"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    room = _room(F.col("event_type"))
    score = 1 + F.least(F.floor(F.col("value") / 10), F.lit(14)) / 2
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return e.select(
        i.alias("event_id"),
        F.concat(F.lit("m"), (i % 3).cast("string")).alias("model"),
        F.concat_ws("-", F.lit("m"), (i % 3).cast("string"), (F.col("user_id") % 3).cast("string")).alias("response_model"),
        _image().alias("image_path"),
        F.col("user_id").alias("zpid"),
        room.alias("room_type"),
        (F.floor(i / 3) % 5 + 1).cast("int").alias("replicate"),
        score.alias("score"),
        F.floor(score).alias("level"),
        ((i % 100) / 100).alias("confidence"),
        F.when(i % 11 == 0, F.lit(None)).when(i % 7 == 0, F.lit("other")).otherwise(room).alias("room_type_judgment"),
        F.col("props").alias("reasoning"),
        (300 + i % 200).alias("input_tokens"),
        (50 + k).alias("output_tokens"),
        (i % 90).alias("cached_input_tokens"),
        (i % 13).alias("cache_write_tokens"),
        (i % 50).alias("thought_tokens"),
        (F.col("value") / 10).alias("latency_s"),
        F.when(i % 37 == 0, F.lit("timeout")).when(i % 41 == 0, F.lit(None)).otherwise("").alias("error"),
        F.col("ts").alias("ts"),
    )


def rating_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("r"), (F.col("event_id") % 4).cast("string")).alias("rater"),
        _image().alias("image_path"),
        _room(F.col("event_type")).alias("room_type"),
        (1 + F.least(F.floor(F.col("value") / 20), F.lit(7))).cast("int").alias("score"),
        F.col("ts").alias("timestamp"),
        F.col("event_id").alias("arrival"),
    )


def tagged_pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    crowded = i % 3 == 0
    amenity = _pick(AMENITIES, (i % len(AMENITIES)).cast("int"))
    shop = _pick(SHOPS, (F.col("user_id") % 5).cast("int"))
    tags = F.map_from_entries(
        F.filter(
            F.array(
                F.struct(F.lit("amenity").alias("k"), amenity.alias("v")),
                F.struct(F.lit("shop").alias("k"), shop.alias("v")),
                F.struct(F.lit("surface").alias("k"), F.col("event_type").alias("v")),
            ),
            lambda e: e["v"].isNotNull(),
        )
    )
    since = F.col("ts").cast("date")
    return e.select(
        i.alias("id"),
        tags.alias("tags"),
        F.when(crowded, 40.65 + (i % 200) / 100000).otherwise(40.6 + (i * 7919 % 2000) / 20000).alias("latitude"),
        F.when(crowded, -73.95 + (i % 170) / 100000).otherwise(-74.0 + (i * 104729 % 2003) / 20000).alias("longitude"),
        since.alias("valid_from"),
        F.when(i % 4 == 0, F.date_add(since, (i % 20).cast("int"))).alias("valid_to"),
    )


def homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("zpid"),
        F.when(k % 40 != 0, 40.6 + (k * 6151 % 2000) / 20000).alias("latitude"),
        (-74.0 + (k * 3571 % 2003) / 20000).alias("longitude"),
        F.when(k % 31 != 0, F.date_add(F.lit(dt.date(2024, 1, 5)), (k % 120).cast("int"))).alias("sold_date"),
    )


def raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw listing export: text cells with JSON, HTML and comma lists, built per order."""
    o = stages.spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"))
    k = F.col("o_orderkey")
    key, price = k.cast("string"), (F.floor(F.col("o_totalprice") * 20)).cast("bigint")

    def cells(name: str, values: list) -> F.Column:
        text = F.to_json(F.array(*[F.struct(v.alias(name)) for v in values]), {"ignoreNullFields": "false"})
        return F.when(k % 19 == 0, F.lit("[{broken")).otherwise(text)

    status = F.col("o_orderstatus")
    event = F.when(status == "O", "Price change").otherwise("Sold")
    sale_price = F.when(k % 23 == 0, "").otherwise(price.cast("string"))
    sale_date = F.when(k % 29 == 0, F.lit(None)).otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    kind = F.when(k % 4 == 0, "Condo").when(k % 4 == 1, "Cooperative").when(k % 4 == 2, "Townhouse")
    link = [F.concat(F.lit("https://photos.example/"), (F.col("o_custkey") % m).cast("string"), F.lit("-cc_ft_960.jpg")) for m in (2, 3, 5)]
    html = F.concat(
        F.lit('<div data-testid="category-group"><h3>Interior</h3><h6>Rooms</h6><ul><li>Bedrooms: '), (k % 6).cast("string"),
        F.lit("</li><li><span>Status</span> "), status, F.lit("</li></ul></div>"),
    )
    meta = {c: F.lit("") for c in (
        "web-scraper-start-url", "listing-link", "results-for", "public_tax_history_property_taxes_percentage_change",
        "public_tax_history_tax_assessment_percentage_change", "price_history_percentage_change", "price", "price_history_merged")}
    # readers use a cell several times
    o = stages.once(
        o,
        price_history_event=cells("price_history_event", [F.lit("Listed"), event, F.lit("Sold")]),
        price_history_price=cells("price_history_price", [F.lit("1"), sale_price, F.lit("250000")]),
        price_history_date=cells("price_history_date", [F.lit("01/01/1990"), sale_date, F.lit("02/03/1994")]),
    )
    return o.select(
        k.alias("row_key"),
        *[v.alias(n) for n, v in meta.items()],
        F.when(k % 101 == 0, F.lit("https://listing.example/none")).otherwise(F.concat(F.lit("https://listing.example/home/"), key, F.lit("_zpid/"))).alias("listing-link-href"),
        F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(" Main St Apt "), (k % 9).cast("string"), F.lit(" , Town, NY")).alias("address"),
        F.when(k % 3 == 0, "Queens").when(k % 3 == 1, "Nowhere").alias("borough"),
        kind.alias("type"),
        F.concat(F.lit("hood-"), (F.col("o_custkey") % 25).cast("string")).alias("neighborhood"),
        F.when(k % 10 == 0, F.lit("--")).otherwise(F.format_number(F.lit(90) + k * 37 % 21000, 0)).alias("area-sqft"),
        F.concat(F.format_number(F.lit(1000) + k % 3000, 0), F.lit(" Lot")).alias("area"),
        (F.lit(1900) + k % 120).cast("string").alias("built_in"),
        (k % 6).cast("string").alias("bedrooms"),
        F.when(k % 8 == 0, F.lit("")).otherwise((k % 4 + 0.5).cast("string")).alias("bathrooms"),
        html.alias("facts_features_text"),
        "price_history_event",
        "price_history_price",
        "price_history_date",
        link[0].alias("main_image-src"),
        F.concat(link[0], F.lit(", "), link[1], F.lit(",,"), link[2], F.lit(" , "), link[0]).alias("all_images"),
    )


# --- the same tables as SQL --------------------------------------------------------------------

_ROOM = ("CASE event_type WHEN 'view' THEN 'bathroom' WHEN 'purchase' THEN 'bedroom' "
         "WHEN 'signup' THEN 'living_room' ELSE 'kitchen' END")
_IMAGE = "'images/' || user_id || '/' || event_type || '.jpg'"

_SQL = {
    "sales": ((), """
        SELECT o_orderkey AS zpid, o_totalprice AS sold_price,
               CASE WHEN o_orderkey % 97 <> 0 THEN CAST(o_orderdate AS DATE) END AS sold_date,
               CASE WHEN o_custkey % 50 <> 0 THEN o_custkey END AS bbl,
               o_orderpriority AS kind, o_orderstatus AS status
        FROM orders"""),
    "lots": ((), """
        SELECT c_custkey AS bbl, 'v' || k AS version, c_mktsegment AS bldgclass,
               c_acctbal + k * 100 + extra AS assesstot, c_nationkey || '.0' AS schooldist,
               CASE WHEN c_custkey % 7 = 0 THEN ' Individual Landmark' WHEN c_custkey % 5 = 0 THEN 'District' END AS histdist,
               CASE WHEN c_custkey % 6 = 0 THEN 'L' END AS landmark
        FROM customer, (SELECT unnest([1, 2, 3, 4]) AS k), (SELECT unnest([0, 1]) AS extra)
        WHERE (c_custkey + k) % 11 <> 0 AND (extra = 0 OR c_custkey % 13 = 0)"""),
    "photos": ((), """
        SELECT 'images/' || l_orderkey || '/' || l_linenumber || '_' || l_partkey || '_' || l_suppkey || '.jpg' AS image_path,
               l_orderkey AS zpid,
               CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'kitchen' WHEN 'AO' THEN 'bathroom' WHEN 'NF' THEN 'bedroom'
                    WHEN 'NO' THEN 'living_room' WHEN 'RF' THEN 'floorplan' ELSE 'other' END AS label
        FROM lineitem"""),
    "scores": ((), f"""
        SELECT event_id, 'm' || event_id % 3 AS model, 'm-' || event_id % 3 || '-' || user_id % 3 AS response_model,
               {_IMAGE} AS image_path, user_id AS zpid, {_ROOM} AS room_type,
               (event_id // 3) % 5 + 1 AS replicate,
               1 + least(floor(value / 10), 14) / 2 AS score,
               floor(1 + least(floor(value / 10), 14) / 2) AS level,
               (event_id % 100) / 100.0::DOUBLE AS confidence,
               CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'other' ELSE {_ROOM} END AS room_type_judgment,
               props AS reasoning,
               300 + event_id % 200 AS input_tokens, 50 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS output_tokens,
               event_id % 90 AS cached_input_tokens, event_id % 13 AS cache_write_tokens, event_id % 50 AS thought_tokens,
               value / 10 AS latency_s,
               CASE WHEN event_id % 37 = 0 THEN 'timeout' WHEN event_id % 41 = 0 THEN NULL ELSE '' END AS error, ts
        FROM events"""),
    "good_scores": (("scores",), "SELECT * FROM scores WHERE length(coalesce(error, '')) = 0"),
    "rating_log": ((), f"""
        SELECT 'r' || event_id % 4 AS rater, {_IMAGE} AS image_path, {_ROOM} AS room_type,
               CAST(1 + least(floor(value / 20), 7) AS BIGINT) AS score, ts AS timestamp, event_id AS arrival
        FROM events"""),
    "ratings": (("rating_log",), """
        SELECT rater, image_path, score, timestamp FROM rating_log
        QUALIFY row_number() OVER (PARTITION BY rater, image_path ORDER BY timestamp DESC, arrival DESC) = 1"""),
    "means": (("good_scores",), """
        SELECT model, image_path, zpid, room_type, avg(score) AS mean_score FROM good_scores
        GROUP BY model, image_path, zpid, room_type"""),
    "consensus": (("ratings",), """
        SELECT reference, image_path, avg(score) AS human_score FROM (
            SELECT 'all' AS reference, * FROM ratings
            UNION ALL SELECT 'pair', * FROM ratings WHERE rater IN ('r0', 'r1')
            UNION ALL SELECT rater, * FROM ratings) GROUP BY reference, image_path"""),
    "pois": ((), """
        SELECT event_id AS id,
               ['restaurant', 'cafe', 'bar', 'bank', 'school', 'fuel', 'bench'][event_id % 7 + 1] AS amenity,
               ['coffee', 'bakery', 'clothes'][user_id % 5 + 1] AS shop, event_type AS surface,
               CASE WHEN event_id % 3 = 0 THEN 40.65::DOUBLE + (event_id % 200) / 100000::DOUBLE
                    ELSE 40.6::DOUBLE + (event_id * 7919 % 2000) / 20000::DOUBLE END AS latitude,
               CASE WHEN event_id % 3 = 0 THEN -73.95::DOUBLE + (event_id % 170) / 100000::DOUBLE
                    ELSE -74.0::DOUBLE + (event_id * 104729 % 2003) / 20000::DOUBLE END AS longitude,
               CAST(ts AS DATE) AS valid_from,
               CASE WHEN event_id % 4 = 0 THEN CAST(ts AS DATE) + CAST(event_id % 20 AS INTEGER) END AS valid_to
        FROM events"""),
    "homes": ((), """
        SELECT c_custkey AS zpid,
               CASE WHEN c_custkey % 40 <> 0 THEN 40.6::DOUBLE + (c_custkey * 6151 % 2000) / 20000::DOUBLE END AS latitude,
               -74.0::DOUBLE + (c_custkey * 3571 % 2003) / 20000::DOUBLE AS longitude,
               CASE WHEN c_custkey % 31 <> 0 THEN DATE '2024-01-05' + CAST(c_custkey % 120 AS INTEGER) END AS sold_date
        FROM customer"""),
}


def with_views(*names: str) -> str:
    """``WITH`` clause for the named tables and what they build on."""
    seen: list[str] = []

    def add(name: str) -> None:
        for inner in _SQL[name][0]:
            add(inner)
        if name not in seen:
            seen.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({_SQL[n][1]})" for n in seen) + "\n"
