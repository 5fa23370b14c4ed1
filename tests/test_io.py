import datetime as dt
import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from dwellstat import reference_values as rv
from dwellstat.functions import checks, usage
from dwellstat.operators import batches, joins, summaries
from dwellstat.session import scratch_path, shared_folder
from dwellstat.sources import readers, writers
from dwellstat.streaming import logs


def test_csv_cells(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text('zpid,note,price\n007,"a ""quoted"", <b>\nline</b>",1.5\n8,,nan\n')
    df = readers.read_csv(spark, str(path), "zpid string, price double, note string")
    assert [tuple(r) for r in df.collect()] == [("007", 1.5, 'a "quoted", <b>\nline</b>'), ("8", None, None)]
    assert readers.read_text_csv(spark, str(path)).collect()[1].note == ""
    with pytest.raises(ValueError, match="missing_one"):
        readers.read_csv(spark, str(path), "missing_one string")


def test_versions_and_json(spark, tmp_path):
    paths = {}
    for v in ("a", "b"):
        p = tmp_path / f"{v}.csv"
        p.write_text(f"bbl,other,bldgclass\n1,x,{v}1\n")
        paths[v] = str(p)
    lots = readers.read_versions(spark, paths, "bbl bigint, bldgclass string")
    assert sorted(tuple(r) for r in lots.collect()) == [(1, "a1", "a"), (1, "b1", "b")]
    doc = tmp_path / "pois.json"
    doc.write_text(json.dumps({"elements": [{"id": 1, "tags": {"shop": "tea"}}, {"id": 2}]}, indent=1))
    assert [(r.id, r.tags) for r in readers.read_poi_elements(spark, str(doc)).collect()] == [(1, {"shop": "tea"}), (2, None)]
    meta = tmp_path / "runs.json"
    meta.write_text(json.dumps([{"file": "f", "label": "l", "timestamp": "t", "rooms": ["k"], "cost_usd": 0.5}]))
    assert readers.read_json_document(spark, str(meta), readers.RUN_ENTRY).first().rooms == ["k"]


def test_image_inventory(spark, tmp_path):
    for name in ("images/1/a.jpg", "images/1/b_hero.PNG", "images/2/c.txt", "images/2/d.webp"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    got = readers.image_inventory(spark, str(tmp_path / "images")).orderBy("image_path").collect()
    assert [tuple(r) for r in got] == [("images/1/a.jpg", "1", 5), ("images/1/b_hero.PNG", "1", 5), ("images/2/d.webp", "2", 5)]


def test_append_pending_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    for rows in (df, df, df.unionByName(spark.createDataFrame([(3, "d")], "k int, v string"))):
        writers.append_pending(spark, rows, path, ["k"])
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_folder(spark) == configured
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def response(key, text, **usage_fields):
    return json.dumps({"key": key, "response": {"candidates": [{"content": {"parts": [{"text": t} for t in text]}}], "usageMetadata": usage_fields, "modelVersion": "v"}})


LINES = [
    response("images/7/7_hero.jpg", ['{"room_type":"other",', '"other_label":"hall"}'], promptTokenCount=100, thoughtsTokenCount=5),
    response("images/7/b.jpg", ['{"room_type":"kitchen","other_label":null}'], promptTokenCount=100, candidatesTokenCount=10),
    response("images/7/c.jpg", ["not json"]),
    json.dumps({"key": "images/7/d.jpg", "error": {"code": 3}}),
    json.dumps({"key": "images/7/e.jpg", "status": "EXPIRED"}),
    "", "{broken",
]


def test_parse_responses(spark):
    lines = spark.createDataFrame([(x, "c0") for x in LINES], "value string, source_chunk string")
    got = batches.parse_responses(lines).collect()
    assert len(got) == 6
    first, second = got[:2]
    assert (first.zpid, first.is_hero, first.room_type, first.other_label, first.output_tokens, first.thinking_tokens) == ("7", 1, "other", "hall", 0, 5)
    assert first.cost_usd == pytest.approx((100 * 1.5 + 5 * 9) / 1e6 / 2)
    assert (second.room_type, second.other_label, second.error) == ("kitchen", "", "")
    assert [r.error for r in got[2:]] == ["unreadable answer", '{"code":3}', "EXPIRED", "no response"]
    summary = summaries.batch_summary(batches.parse_responses(lines), ["source_chunk"]).first()
    assert (summary.classified, summary.errors, summary.input_per_image) == (2, 4, 100.0)


def test_request_lines(spark):
    df = spark.createDataFrame([("images/1/a.png",)], "image_path string")
    body = json.loads(batches.request_lines(df, "image_path", "say", "LOW", rv.PHOTO_LABELS).first().line)
    assert body["key"] == "images/1/a.png"
    parts = body["request"]["contents"][0]["parts"]
    assert parts[0] == {"fileData": {"mimeType": "image/png", "fileUri": "images/1/a.png"}} and parts[1] == {"text": "Photo to classify:"}
    assert body["request"]["generationConfig"]["responseSchema"]["properties"]["room_type"]["enum"] == list(rv.PHOTO_LABELS)


def test_cost(spark):
    df = spark.createDataFrame([("gpt-4o", 1000, 100, 600, 0), ("claude-haiku-4-5", 100, 10, 80, 50), ("none", 1, 1, 1, 1)], "m string, i int, o int, c int, w int")
    got = [r.x for r in df.select(usage.model_cost("m", "i", "o", "c", "w").alias("x")).collect()]
    assert got[0] == pytest.approx((400 * 2.5 + 600 * 1.25 + 1000) / 1e6)
    assert got[1] == pytest.approx((80 * 0.1 + 50 * 1.25 + 10 * 5) / 1e6) and got[2] is None


def test_contract(spark):
    df = spark.createDataFrame([("attic", None), ("kitchen", "x"), ("other", "hall"), (None, None)], "l string, o string")
    got = [r.v for r in df.select(checks.label_violations("l", "o", rv.PHOTO_LABELS).alias("v")).collect()]
    assert got == [["label_unknown"], ["other_label_without_other"], [], ["label_missing"]]


def test_pending_retries_errors(spark):
    tasks = joins.task_grid(spark.createDataFrame([("p",)], "image_path string"), ["m"], 3)
    done = spark.createDataFrame([("p", "m", 1, ""), ("p", "m", 2, "boom"), ("p", "m", 2, "boom")], "image_path string, model string, replicate int, error string")
    assert sorted(r.replicate for r in joins.pending(tasks, done, ["image_path", "model", "replicate"], "error").collect()) == [2, 3]


def test_scorer(spark):
    def scorer(batch: pd.DataFrame) -> pd.DataFrame:
        return batch.assign(score=batch["k"] * 2)

    assert sorted(r.score for r in batches.score_tasks(spark.range(3).withColumnRenamed("id", "k"), scorer, "k long, score long").collect()) == [0, 2, 4]


def test_collected_results_do_not_repeat(spark, tmp_path):
    source, log, state = [str(tmp_path / n) for n in ("in", "log", "state")]
    os.makedirs(source)
    schema = "value string, source_chunk string"
    (tmp_path / "in" / "c0.json").write_text("\n".join(json.dumps({"value": v, "source_chunk": "c0"}) for v in LINES))
    for _ in range(2):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source)
        logs.collect_results(stream, log, state).awaitTermination()
        # a second delivery repeats the old answers and adds one
        more = [*LINES[:2], response("images/8/x.jpg", ['{"room_type":"bedroom"}'])]
        (tmp_path / "in" / "c1.json").write_text("\n".join(json.dumps({"value": v, "source_chunk": "c1"}) for v in more))
    columns = batches.parse_responses(spark.createDataFrame([("", "")], schema)).drop("error").schema
    got = logs.read_log(spark, log, columns).collect()
    assert sorted(r.image_path for r in got) == ["images/7/7_hero.jpg", "images/7/b.jpg", "images/8/x.jpg"]
    # a new checkpoint on the old log, and other files: nothing is lost or repeated
    other = tmp_path / "other"
    other.mkdir()
    more = [LINES[0], response("images/9/y.jpg", ['{"room_type":"bedroom"}'])]
    (other / "c2.json").write_text("\n".join(json.dumps({"value": v, "source_chunk": "c2"}) for v in more))
    logs.collect_results(spark.readStream.schema(schema).json(str(other)), log, str(tmp_path / "state2")).awaitTermination()
    paths = sorted(r.image_path for r in logs.read_log(spark, log, columns).collect())
    assert paths == ["images/7/7_hero.jpg", "images/7/b.jpg", "images/8/x.jpg", "images/9/y.jpg"]


def test_csv_columns_go_by_name_in_every_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n3,4\n")
    (tmp_path / "b.csv").write_text("b,c,a\n20,x,10\n")
    got = readers.read_csv(spark, str(tmp_path), "a int, b int").collect()
    assert sorted((r.a, r.b) for r in got) == [(1, 2), (3, 4), (10, 20)]
    texts = readers.read_text_csv(spark, str(tmp_path)).collect()
    assert sorted((r.a, r.b, r.c) for r in texts) == [("1", "2", ""), ("10", "20", "x"), ("3", "4", "")]
    with pytest.raises(ValueError, match="columns not found: d"):
        readers.read_csv(spark, str(tmp_path), "a int, d int")


def test_append_stores_the_same_row_again(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k int, v string")
    for n in (1, 5):
        writers.append_pending(spark, rows.repartition(n), str(tmp_path / str(n)), ["k"])
        assert sorted(map(tuple, spark.read.parquet(str(tmp_path / str(n))).collect())) == [(1, "a"), (2, "c")]


def test_lookup_reads_only_what_is_used(spark, sf_dir):
    orders, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    joined = joins.lookup(orders.withColumnRenamed("o_custkey", "c_custkey"), customer, ["c_custkey"]).select("o_orderkey", "c_acctbal")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "struct<o_orderkey:bigint,o_custkey:bigint>" in plan and "struct<c_custkey:bigint,c_acctbal:double>" in plan


def test_ratings_stream_last_write_wins(spark, tmp_path):
    schema = "rater string, image_path string, score int, timestamp timestamp_ntz, arrival int"
    source, log, state = [str(tmp_path / n) for n in ("in", "log", "state")]
    at = [dt.datetime(2026, 1, d) for d in (1, 2, 3)]
    for batch in ([("a", "p", 3, at[1], 1), ("b", "p", 1, at[0], 2), ("c", "p", 5, at[0], 3), ("c", "p", 3, at[0], 4), ("d", "p", 8, at[0], 5)],
                  [("a", "p", 9, at[0], 6), ("b", "p", 2, at[2], 7), ("d", "p", 4, at[0], 8)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        logs.collect_ratings(spark.readStream.schema(schema).parquet(source), log, state).awaitTermination()
    stored = logs.read_log(spark, log, summaries.latest_ratings(spark.createDataFrame([], schema), arrival="arrival", fields=("score", "arrival")).schema)
    assert {r.rater: r.score for r in logs.current_ratings(stored).collect()} == {"a": 3, "b": 2, "c": 3, "d": 4}


def test_chunks_written_per_folder(spark, tmp_path):
    df = spark.createDataFrame([("c0", "x"), ("c1", "y"), ("c0", "z")], "chunk_id string, line string")
    writers.write_request_files(df, str(tmp_path / "req"))
    assert sorted(p for p in os.listdir(tmp_path / "req") if p.startswith("chunk_id")) == ["chunk_id=c0", "chunk_id=c1"]
    assert spark.read.text(str(tmp_path / "req")).filter(F.col("chunk_id") == "c0").count() == 2


def test_items_are_gathered_before_they_become_lines(spark, tmp_path, sf_dir, monkeypatch):
    """Only paths and chunk ids are shuffled and sorted, and the files are a small part of their text."""
    from dwellstat.plans import catalog
    seen = []
    monkeypatch.setattr(writers, "write_request_files", lambda lines, path, write=writers.write_request_files, **named: (seen.append((lines, path)), write(lines, path, **named)))
    want = {r.chunk_id: r.lines for r in catalog.queries()["request_files"](spark, sf_dir).collect()}
    (lines, path), = seen
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert plan.index("mediaResolution") < plan.index("REPARTITION") and "mediaResolution" not in plan[plan.index("REPARTITION"):]
    back = spark.read.text(path)
    assert {r.chunk_id: r["count"] for r in back.groupBy("chunk_id").count().collect()} == want
    stored = sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(path) for f in files)
    assert stored < back.agg(F.sum(F.length("value"))).first()[0] / 10
    spread = spark.createDataFrame([(f"c{i % 3}", f"x{i}") for i in range(30)], "chunk_id string, line string").repartition(4)
    writers.write_request_files(writers.gathered(spread), str(tmp_path / "req"), together=True)
    files = [f for at, _, files in os.walk(tmp_path / "req") for f in files if f.startswith("part-")]
    assert len(files) == 3 and spark.read.text(str(tmp_path / "req")).count() == 30


def test_answer_with_a_null_label_is_kept(spark):
    lines = [response(f"images/{i}/x.jpg", [a]) for i, a in enumerate(['{"room_type":null}', '{"other_label":"x"}', "not json", '{"room_type":"kitchen"}'])]
    df = spark.createDataFrame([(v, "c0") for v in lines], "value string, source_chunk string")
    got = {r.image_path: (r.room_type, r.error) for r in batches.parse_responses(df).collect()}
    assert got == {"images/0/x.jpg": (None, ""), "images/1/x.jpg": (None, "unreadable answer"), "images/2/x.jpg": (None, "unreadable answer"),
                   "images/3/x.jpg": ("kitchen", "")}
