"""Request and response batches, files, and streaming over the given tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from dwellstat import reference_values as rv
from dwellstat.operators import batches, sampling, summaries
from dwellstat.plans import views
from dwellstat.plans.registry import query, table
from dwellstat.plans.views import with_views
from dwellstat.session import scratch_path
from dwellstat.sources import readers, writers
from dwellstat.streaming import logs

R = 6
PROMPT = "Classify the room shown in the photo."


@query("request_lines", with_views("photos") + """
    SELECT image_path, '{"key":"' || image_path || '","request":{"contents":[{"role":"user","parts":[{"fileData":{"mimeType":"image/jpeg","fileUri":"' || image_path
        || '"}},{"text":"Photo to classify:"}]}],"systemInstruction":{"parts":[{"text":"Classify the room shown in the photo."}]},"generationConfig":{"temperature":0,'
        || '"mediaResolution":"MEDIA_RESOLUTION_LOW","responseMimeType":"application/json","responseSchema":{"type":"object","properties":{"room_type":{"type":"string",'
        || '"enum":["kitchen","bathroom","bedroom","living_room","floorplan","other"]},"other_label":{"type":"string","nullable":true}},"required":["room_type","other_label"]}}}}' AS line
    FROM photos""")
def request_lines(spark, sf_dir):
    lines = batches.request_lines(views.photos(spark, sf_dir), "image_path", PROMPT, "MEDIA_RESOLUTION_LOW", rv.PHOTO_LABELS)
    return lines.select("image_path", "line")


def result_lines(spark, sf_dir):
    """Result lines as a remote batch would return them: answers in two text parts, some errors, some junk."""
    e = table(spark, sf_dir, "events")
    i, k = F.col("event_id"), F.get_json_object("props", "$.k").try_cast("bigint")
    key = F.concat(F.lit("images/"), F.col("user_id").cast("string"), F.lit("/"), i.cast("string"), F.when(i % 10 == 0, "_hero.jpg").otherwise(".jpg"))
    label = F.when(F.col("event_type") == "view", "bathroom").when(F.col("event_type") == "error", "other").otherwise("kitchen")
    answer = F.concat(F.lit('":"'), label, F.lit('","other_label":'), F.when(label == "other", F.lit('"hall"}')).otherwise("null}"))
    parts = F.array(F.struct(F.lit('{"room_type').alias("text")), F.struct(answer.alias("text")))
    response = F.struct(
        F.array(F.struct(F.struct(parts.alias("parts")).alias("content"))).alias("candidates"),
        F.struct((300 + i % 50).alias("promptTokenCount"), F.when(i % 6 != 0, k).alias("candidatesTokenCount"),
                 F.when(i % 2 == 0, i % 40).alias("thoughtsTokenCount")).alias("usageMetadata"),
        F.lit("v-1").alias("modelVersion"),
    )
    ok = F.to_json(F.struct(key.alias("key"), response.alias("response")))
    failed = F.to_json(F.struct(key.alias("key"), F.struct(F.lit(500).alias("code")).alias("error")))
    line = F.when(i % 33 == 0, "  ").when(i % 17 == 0, failed).when(i % 19 == 0, F.concat(F.substring(ok, 1, 40))).otherwise(ok)
    return e.select(line.alias("value"), F.concat(F.lit("chunk_"), (i % 7).cast("string")).alias("source_chunk"))


_RESULT_SQL = """
    WITH b AS (SELECT event_id AS i, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
        event_id % 17 = 0 AS failed, event_id % 17 <> 0 AND event_id % 19 = 0 AS junk FROM events WHERE event_id % 33 <> 0),
    f AS (SELECT *, NOT failed AND NOT junk AS ok, CASE WHEN junk THEN '' ELSE 'images/' || user_id || '/' || i || CASE WHEN i % 10 = 0 THEN '_hero.jpg' ELSE '.jpg' END END AS key FROM b),
    r AS (SELECT *, CASE WHEN ok THEN 300 + i % 50 ELSE 0 END AS input_tokens, CASE WHEN ok AND i % 6 <> 0 THEN k ELSE 0 END AS output_tokens,
        CASE WHEN ok AND i % 2 = 0 THEN i % 40 ELSE 0 END AS thinking_tokens,
        CASE WHEN NOT ok THEN NULL WHEN event_type = 'view' THEN 'bathroom' WHEN event_type = 'error' THEN 'other' ELSE 'kitchen' END AS room_type FROM f)"""
_RESULT_COLUMNS = """key AS image_path, CASE WHEN junk THEN '' ELSE CAST(user_id AS VARCHAR) END AS zpid, (NOT junk AND i % 10 = 0)::INT AS is_hero, room_type,
        CASE WHEN ok AND room_type = 'other' THEN 'hall' ELSE '' END AS other_label, CASE WHEN ok THEN 'v-1' ELSE '' END AS response_model,
        input_tokens, output_tokens, thinking_tokens, round((input_tokens * 1.5::DOUBLE + (output_tokens + thinking_tokens) * 9.0::DOUBLE) / 1000000 * 0.5, 9) AS cost_usd,
        'chunk_' || i % 7 AS source_chunk"""


@query("parse_responses", _RESULT_SQL + f"""
    SELECT {_RESULT_COLUMNS}, CASE WHEN ok THEN '' WHEN failed THEN '{{"code":500}}' ELSE 'no response' END AS error FROM r""")
def parse_responses(spark, sf_dir):
    return _parsed(spark, sf_dir)


def _parsed(spark, sf_dir):
    return batches.parse_responses(result_lines(spark, sf_dir)).withColumn("cost_usd", F.round("cost_usd", 9))


@query("batch_summary", _RESULT_SQL + f"""
    SELECT 'chunk_' || i % 7 AS source_chunk, count(*) FILTER (ok) AS classified, count(*) FILTER (NOT ok) AS errors,
        round(avg(input_tokens) FILTER (ok), {R}) AS input_per_image, round(avg(output_tokens) FILTER (ok), {R}) AS output_per_image,
        round(avg(thinking_tokens) FILTER (ok), {R}) AS thinking_per_image,
        round(sum((input_tokens * 1.5::DOUBLE + (output_tokens + thinking_tokens) * 9.0::DOUBLE) / 1000000 * 0.5) FILTER (ok), 9) AS cost_usd
    FROM r GROUP BY i % 7""")
def batch_summary(spark, sf_dir):
    out = summaries.batch_summary(batches.parse_responses(result_lines(spark, sf_dir)), ["source_chunk"])
    return out.withColumns({c: F.round(c, R) for c in ("input_per_image", "output_per_image", "thinking_per_image")}).withColumn("cost_usd", F.round("cost_usd", 9))


@query("label_distribution", _RESULT_SQL + " SELECT room_type, count(*) AS n FROM r GROUP BY room_type")
def label_distribution(spark, sf_dir):
    return summaries.frequency(batches.parse_responses(result_lines(spark, sf_dir)), "room_type")


@query("scored_tasks", with_views("photos") + """
    SELECT image_path, label, CAST(length(image_path) % 8 + 1 AS BIGINT) AS score FROM photos WHERE label IN ('kitchen', 'bedroom')""")
def scored_tasks(spark, sf_dir):
    tasks = views.photos(spark, sf_dir).filter(F.col("label").isin("kitchen", "bedroom")).select("image_path", "label")

    def scorer(batch: pd.DataFrame) -> pd.DataFrame:
        return batch.assign(score=batch["image_path"].str.len() % 8 + 1)

    return batches.score_tasks(tasks, scorer, "image_path string, label string, score bigint")


# --- files -----------------------------------------------------------------------------------


@query("roundtrip_csv", """
    SELECT page_id, url, html FROM pages""")
def roundtrip_csv(spark, sf_dir):
    path = scratch_path(spark, "csv")
    writers.write_csv(table(spark, sf_dir, "pages"), path)
    return readers.read_csv(spark, path, "page_id bigint, url string, html string")


@query("text_csv", """
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS priority FROM orders""")
def text_csv(spark, sf_dir):
    path = scratch_path(spark, "csv")
    o = table(spark, sf_dir, "orders")
    writers.write_csv(o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("priority")), path)
    return readers.read_text_csv(spark, path)


@query("csv_column_subset", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_totalprice FROM orders")
def csv_column_subset(spark, sf_dir):
    path = scratch_path(spark, "csv")
    writers.write_csv(table(spark, sf_dir, "orders"), path)
    return readers.read_csv(spark, path, "o_orderkey string, o_totalprice double, o_orderstatus string", ["o_orderkey", "o_totalprice"])


@query("roundtrip_parquet", "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_returnflag = 'A'")
def roundtrip_parquet(spark, sf_dir):
    path = scratch_path(spark, "parquet")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    writers.write_parquet(rows, path, ["l_returnflag"])
    return readers.read_parquet(spark, path, rows.schema).filter("l_returnflag = 'A'")


@query("version_archive", """
    SELECT version, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM (
        SELECT 'v1' AS version, c_acctbal FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'v2', c_acctbal FROM customer WHERE c_custkey % 2 = 1 OR c_custkey % 3 = 0) GROUP BY version""")
def version_archive(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    paths = {}
    for version, keep in (("v1", "c_custkey % 2 = 0"), ("v2", "c_custkey % 2 = 1 or c_custkey % 3 = 0")):
        paths[version] = scratch_path(spark, f"lots-{version}")
        writers.write_csv(c.filter(keep), paths[version])
    lots = readers.read_versions(spark, paths, "c_custkey bigint, c_acctbal double", ["c_custkey", "c_acctbal"])
    return lots.groupBy("version").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("append_resume", """
    SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS keys FROM events GROUP BY event_type""")
def append_resume(spark, sf_dir):
    path = scratch_path(spark, "log")
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    # overlapping runs; the third repeats the first
    for keep in ("event_id % 5 <= 1", "event_id % 5 between 1 and 3", "event_id % 5 <= 1", "event_id % 5 >= 3"):
        writers.append_pending(spark, e.filter(keep), path, ["event_id"])
    return spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("keys"))


@query("request_files", with_views("photos") + """,
    c AS (SELECT image_path, (row_number() OVER (ORDER BY image_path) - 1) // 5000 AS chunk FROM photos)
    SELECT 'full_' || lpad(CAST(chunk AS VARCHAR), 3, '0') AS chunk_id, count(*) AS lines, min(image_path) AS first_key FROM c GROUP BY chunk""")
def request_files(spark, sf_dir):
    path = scratch_path(spark, "requests")
    plan = sampling.chunk_plan(views.photos(spark, sf_dir), "image_path", 5000)
    items = writers.gathered(plan.select("image_path", "chunk_id"))
    writers.write_request_files(batches.request_lines(items, "image_path", PROMPT, "MEDIA_RESOLUTION_LOW", rv.PHOTO_LABELS), path, together=True)
    back = spark.read.schema("value string, chunk_id string").text(path)
    key = F.get_json_object("value", "$.key")
    return back.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("lines"), F.min(key).alias("first_key"))


@query("result_files", _RESULT_SQL + """
    SELECT 'chunk_' || i % 7 AS source_chunk, count(*) FILTER (ok) AS answers, count(*) FILTER (NOT ok) AS errors FROM r GROUP BY i % 7""")
def result_files(spark, sf_dir):
    path = scratch_path(spark, "results")
    result_lines(spark, sf_dir).repartition(7, "source_chunk").write.partitionBy("source_chunk").text(path)
    lines = spark.read.schema("value string, source_chunk string").text(path)
    parsed = batches.parse_responses(lines)
    return parsed.groupBy("source_chunk").agg(F.count_if(F.col("error") == "").alias("answers"), F.count_if(F.col("error") != "").alias("errors"))


@query("json_documents", "SELECT user_id || '' AS timestamp, count(*) AS n FROM events GROUP BY user_id")
def json_documents(spark, sf_dir):
    path = scratch_path(spark, "json")
    e = table(spark, sf_dir, "events")
    e.select(F.col("user_id").cast("string").alias("timestamp"), F.array("event_type").alias("rooms"), F.col("props").alias("label")).write.json(path)
    runs = readers.read_json_lines(spark, path, readers.RUN_META)
    return runs.groupBy("timestamp").agg(F.count(F.lit(1)).alias("n"))


@query("json_document_files", """
    SELECT event_type || '' AS label, count(*) AS n, min(event_id) || '' AS first_file, sum(value) > 0 AS paid FROM events GROUP BY event_type, user_id % 20""")
def json_document_files(spark, sf_dir):
    """Whole-file JSON documents, an indented array of entries each, through the document reader."""
    path = scratch_path(spark, "documents")
    e = table(spark, sf_dir, "events")
    bundle = e.groupBy("event_type", (F.col("user_id") % 20).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("low"), F.sum("value").alias("cost"))
    entry = F.struct(F.col("low").cast("string").alias("file"), F.col("event_type").alias("label"), F.array(F.col("n").cast("string")).alias("rooms"), F.col("cost").alias("cost_usd"))
    documents = bundle.select("event_type", "part", F.to_json(F.array(entry), {"pretty": "true"}).alias("value"))
    documents.repartition("event_type", "part").write.partitionBy("event_type", "part").text(path)
    runs = readers.read_json_document(spark, f"{path}/*/*", readers.RUN_ENTRY)
    return runs.select("label", F.col("rooms")[0].cast("bigint").alias("n"), F.col("file").alias("first_file"), (F.col("cost_usd") > 0).alias("paid"))


@query("image_files", """
    SELECT user_id % 50 || '' AS zpid, count(*) AS images, (count(*) * 8 + count(*))::BIGINT AS bytes FROM events WHERE event_type <> 'click' GROUP BY user_id % 50""")
def image_files(spark, sf_dir):
    """Inventory of a folder of files, one folder per listing; files of other kinds are left out."""
    path = f"{scratch_path(spark, 'folder')}/images"
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("k"), "event_type", F.format_string("%08d", "event_id").alias("value"))
    for kind, suffix in (("event_type <> 'click'", "txt"), ("event_type = 'click'", "csv")):
        e.where(kind).repartition("k").select("k", "value").write.mode("append").format(suffix if suffix == "csv" else "text").partitionBy("k").save(path)
    found = readers.image_inventory(spark, path, suffixes=("txt",))
    per = found.groupBy(F.regexp_replace("zpid", "^k=", "").alias("zpid")).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
    return per.select("zpid", (F.col("bytes") / 9).cast("bigint").alias("images"), "bytes")


@query("poi_elements", """
    SELECT event_id AS id, event_type AS amenity, round(value, 4) AS lat FROM events""")
def poi_elements(spark, sf_dir):
    path = scratch_path(spark, "pois")
    e = table(spark, sf_dir, "events")
    element = F.struct(F.col("event_id").alias("id"), F.round("value", 4).alias("lat"), F.create_map(F.lit("amenity"), F.col("event_type")).alias("tags"))
    e.select(F.array(element).alias("elements")).write.json(path)
    return readers.read_poi_elements(spark, path, lines=True).select("id", F.try_element_at("tags", F.lit("amenity")).alias("amenity"), "lat")


@query("prediction_cache", "SELECT o_orderkey, round(ln(o_totalprice), 6) AS pred_log FROM orders")
def prediction_cache(spark, sf_dir):
    path = scratch_path(spark, "predictions")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.ln("o_totalprice").alias("pred_log"), (F.col("o_orderkey") % 5).alias("fold"))
    writers.write_parquet(o, path, ["fold"])
    return spark.read.parquet(path).select("o_orderkey", F.round("pred_log", 6).alias("pred_log"))


# --- streams ---------------------------------------------------------------------------------


@query("stream_collect", _RESULT_SQL + f" SELECT {_RESULT_COLUMNS} FROM r WHERE ok")
def stream_collect(spark, sf_dir):
    source, log, state = [scratch_path(spark, n) for n in ("arrivals", "collected", "state")]
    lines = result_lines(spark, sf_dir)
    # the same lines arrive twice, in separate files, whose number follows that of the session's cores
    share = max(1, spark.sparkContext.defaultParallelism // 4)
    lines.repartition(4 * share).write.parquet(source)
    lines.repartition(2 * share).write.mode("append").parquet(source)
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 3 * share).parquet(source)
    logs.collect_results(stream, log, state).awaitTermination()
    columns = batches.parse_responses(lines).drop("error")
    return logs.read_log(spark, log, columns.schema).drop("run", "batch_id", "division").withColumn("cost_usd", F.round("cost_usd", 9))


@query("stream_ratings", with_views("ratings") + " SELECT rater, image_path, score, timestamp FROM ratings")
def stream_ratings(spark, sf_dir):
    source, log, state = [scratch_path(spark, n) for n in ("arrivals", "ratings", "state")]
    rows = views.rating_log(spark, sf_dir).withColumn("score", F.col("score").cast("bigint"))
    rows.repartition(5, "arrival").write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    logs.collect_ratings(stream, log, state).awaitTermination()
    kept = summaries.latest_ratings(rows, arrival="arrival", fields=("score", "arrival")).schema
    return logs.current_ratings(logs.read_log(spark, log, kept))


@query("stream_status", """
    SELECT user_id % 10 AS chunk, event_type AS state, count(*) AS n FROM events GROUP BY ALL""")
def stream_status(spark, sf_dir):
    source, counts, state = [scratch_path(spark, n) for n in ("states", "counts", "state")]
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("chunk"), F.col("event_type").alias("state"))
    e.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(source)
    logs.chunk_status(stream, counts, state).awaitTermination()
    return logs.current_status(spark, counts, "chunk bigint, state string, n bigint")
