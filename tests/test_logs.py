"""Compacted logs and versioned status tables."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwellstat.operators import batches, summaries
from dwellstat.streaming import logs

RATINGS = "rater string, image_path string, score long, timestamp string, arrival long"


def rating_files(spark, folder, n):
    folder.mkdir(exist_ok=True)
    for i in range(n):
        rows = [{"rater": f"r{k % 3}", "image_path": f"p{(i * 7 + k) % 20}", "score": (i + k) % 8, "timestamp": f"2024-01-{1 + i % 28:02d}", "arrival": i * 10 + k} for k in range(5)]
        (folder / f"{i:04d}.json").write_text("\n".join(map(json.dumps, rows)))


def collect(spark, folder, log, state):
    stream = spark.readStream.schema(RATINGS).option("maxFilesPerTrigger", 1).json(str(folder))
    logs.collect_ratings(stream, log, state).awaitTermination()


def schema_of(spark):
    return summaries.latest_ratings(spark.createDataFrame([], RATINGS), arrival="arrival", fields=("score", "arrival")).schema


def test_files_read_stay_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(logs, "COMPACT_EVERY", 4)
    monkeypatch.setattr(logs, "DIVISIONS", 3)
    log, source = str(tmp_path / "log"), tmp_path / "in"
    rating_files(spark, source, 18)
    collect(spark, source, log, str(tmp_path / "state"))
    stored = logs.read_log(spark, log, schema_of(spark))
    every_batch = spark.read.schema(T.StructType([*schema_of(spark).fields, T.StructField("run", T.StringType()), T.StructField("batch_id", T.IntegerType()),
                                                  T.StructField("division", T.IntegerType())])).parquet(log)
    assert sorted(map(tuple, stored.collect()), key=str) == sorted(map(tuple, every_batch.collect()), key=str)
    # the last compaction was before batch 16: three divisions, and what two batches wrote
    raw = stored.filter("batch_id > 15").select(F.input_file_name()).distinct().count()
    assert 0 < raw <= 6
    assert logs._newest_manifest(spark, log).seq == 3 and set(logs._newest_manifest(spark, log).covered.values()) == {15}
    compacted = spark.read.parquet(f"{log}/_compact/seq=3")
    assert len(compacted.inputFiles()) <= 3


def test_crash_between_the_steps_loses_nothing(spark, tmp_path, monkeypatch):
    log, source = str(tmp_path / "log"), tmp_path / "in"
    rating_files(spark, source, 3)
    collect(spark, source, log, str(tmp_path / "state"))
    before = sorted(map(tuple, logs.read_log(spark, log, schema_of(spark)).collect()), key=str)
    # files without a manifest row are what a crash leaves
    spark.createDataFrame([], schema_of(spark)).write.parquet(f"{log}/_compact/seq=0")
    assert sorted(map(tuple, logs.read_log(spark, log, schema_of(spark)).collect()), key=str) == before
    for _ in range(2):
        logs.compact(spark, log, schema_of(spark))
        assert sorted(map(tuple, logs.read_log(spark, log, schema_of(spark)).collect()), key=str) == before
    assert logs._newest_manifest(spark, log).seq == 0
    rating_files(spark, source, 5)
    collect(spark, source, log, str(tmp_path / "state"))
    assert logs.read_log(spark, log, schema_of(spark)).filter("batch_id > 2").count() > 0


STATES = "chunk long, state string"
STATUS = "chunk bigint, state string, n bigint"


def count_states(spark, folder, path, state):
    stream = spark.readStream.schema(STATES).option("maxFilesPerTrigger", 1).json(str(folder))
    logs.chunk_status(stream, path, state).awaitTermination()
    return sorted(map(tuple, logs.current_status(spark, path, STATUS).collect()))


def test_status_versions(spark, tmp_path):
    path, source = str(tmp_path / "status"), tmp_path / "in"
    source.mkdir()
    assert logs.current_status(spark, path, STATUS).count() == 0
    (source / "a.json").write_text('{"chunk": 1, "state": "sent"}\n{"chunk": 2, "state": "sent"}')
    (source / "b.json").write_text('{"chunk": 1, "state": "done"}\n{"chunk": 1, "state": "sent"}')
    assert count_states(spark, source, path, str(tmp_path / "one")) == [(1, "done", 1), (1, "sent", 2), (2, "sent", 1)]
    held = logs.current_status(spark, path, STATUS)
    # a version without a pointer is what a crash leaves; readers keep the whole table before it
    spark.createDataFrame([(9, "x", 9)], STATUS).write.parquet(f"{path}/versions/half")
    (source / "c.json").write_text('{"chunk": 3, "state": "sent"}')
    assert (3, "sent", 1) in count_states(spark, source, path, str(tmp_path / "one"))
    assert sorted(map(tuple, held.collect())) == [(1, "done", 1), (1, "sent", 2), (2, "sent", 1)]
    # a new checkpoint counts from the beginning
    (source / "d.json").write_text('{"chunk": 3, "state": "sent"}')
    assert count_states(spark, source, path, str(tmp_path / "two")) == [(1, "done", 1), (1, "sent", 2), (2, "sent", 1), (3, "sent", 2)]


def test_a_batch_is_parsed_once_and_its_copy_is_no_part_of_the_log(spark, tmp_path):
    log, source = str(tmp_path / "log"), tmp_path / "in"
    lines = [(json.dumps({"key": f"images/1/{i % 5}.jpg", "response": {"candidates": [{"content": {"parts": [{"text": json.dumps({"room_type": "kitchen"})}]}}]}}), f"c{i % 2}") for i in range(12)]
    df = spark.createDataFrame(lines, "value string, source_chunk string")
    df.repartition(3).write.parquet(str(source))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    logs.collect_results(stream, log, str(tmp_path / "state")).awaitTermination()
    schema = batches.parse_responses(df).drop("error").schema
    stored = logs.read_log(spark, log, schema)
    assert sorted(r.image_path for r in stored.collect()) == [f"images/1/{i}.jpg" for i in range(5)]
    # one copy, of the last batch
    held = list((tmp_path / "log" / "_batch").iterdir())
    assert len(held) == 1 and 0 < spark.read.parquet(str(held[0])).count() <= 4
