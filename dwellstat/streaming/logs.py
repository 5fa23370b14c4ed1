"""Incremental collection of result files and ratings.

Each micro-batch is written to a folder of its run and ``batch_id`` in overwrite mode; the run is the
query's id, which Spark keeps in the checkpoint and makes anew with it. A retried batch therefore replaces itself, and a new checkpoint
on an old log adds to it. The log is further divided by a digest of the key, so that a batch reads
only the divisions its own keys fall into, and compacted from time to time, so that a division is one
file and those of the batches since.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from dwellstat.operators import batches, joins, ordering, stages, summaries


#: Divisions of a log by key digest; a batch with few keys reads few of them.
DIVISIONS = 256
#: Batches after which a log is compacted.
COMPACT_EVERY = 16


def _run(batch: DataFrame) -> str:
    """Id of the streaming query that a micro-batch belongs to."""
    run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    if not run:
        raise RuntimeError("a log is written by a streaming query only")
    return run


def _division(keys: Sequence[str]):
    return F.pmod(F.xxhash64(*keys), F.lit(DIVISIONS)).cast("int")


def _write_batch(df: DataFrame, path: str, run: str, batch_id: int, keys: Sequence[str]) -> None:
    divided = df.withColumn("division", _division(keys)).repartition("division")
    divided.write.mode("overwrite").partitionBy("division").parquet(f"{path}/run={run}/batch_id={batch_id}")


def _held(batch: DataFrame, path: str) -> DataFrame:
    """The batch's rows from a folder that every batch of the run overwrites; readers of the log skip it."""
    batch.write.mode("overwrite").parquet(path)
    return batch.sparkSession.read.schema(batch.schema).parquet(path)


def _earlier(batch: DataFrame, path: str, run: str, batch_id: int, schema: T.StructType, keys: Sequence[str]) -> DataFrame | None:
    """What any earlier batch of any run wrote in the batch's divisions; its own leftovers do not count."""
    log = read_log(batch.sparkSession, path, schema)
    if log is None:
        return None
    # at most DIVISIONS numbers
    wanted = [r[0] for r in batch.select(_division(keys).alias("d")).distinct().collect()]
    own = (F.col("run") == run) & (F.col("batch_id") >= batch_id)
    return log.filter(F.col("division").isin(wanted) & ~own)


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """All batches of a log with their ``run``, ``batch_id`` and ``division``; None before the first was written."""
    added = [T.StructField("run", T.StringType()), T.StructField("batch_id", T.IntegerType()), T.StructField("division", T.IntegerType())]
    fields = [f for f in schema.fields if f.name not in {a.name for a in added}]
    whole = T.StructType([*fields, *added])
    batches = _existing(spark.read.schema(whole), path)
    newest = _newest_manifest(spark, path)
    if batches is None or newest is None:
        return batches
    # one number per run: its batches up to that one are in the compacted files
    covered = F.lit(False)
    for run, upto in newest.covered.items():
        covered = covered | ((F.col("run") == run) & (F.col("batch_id") <= upto))
    compacted = spark.read.schema(whole).parquet(f"{path}/_compact/seq={newest.seq}")
    return compacted.unionByName(batches.filter(~covered))


_MANIFEST = "covered map<string,int>, seq long"


def _newest_manifest(spark: SparkSession, path: str):
    found = _existing(spark.read.schema(_MANIFEST), f"{path}/_manifest")
    return None if found is None else found.orderBy(F.desc("seq")).first()


def compact(spark: SparkSession, path: str, schema: T.StructType, before: tuple[str, int] | None = None) -> None:
    """Puts the rows of all batches into one file per division and makes readers use them.

    ``before`` (run, batch_id) leaves out the batch that is being written. The files are whole before
    the manifest row that names them is written, and batch folders stay, so a crash at any point
    leaves the log as it was. Readers take the newest manifest: the compacted files and the batches
    after it, so what a batch reads does not grow with the number of batches before it.
    """
    log = read_log(spark, path, schema)
    if log is None:
        return
    if before is not None:
        log = log.filter((F.col("run") != before[0]) | (F.col("batch_id") < before[1]))
    covered = {r.run: r.upto for r in log.groupBy("run").agg(F.max("batch_id").alias("upto")).collect()}
    newest = _newest_manifest(spark, path)
    if not covered or newest is not None and newest.covered == covered:
        return
    seq = newest.seq + 1 if newest is not None else 0
    log.repartition("division").write.mode("overwrite").partitionBy("division").parquet(f"{path}/_compact/seq={seq}")
    spark.createDataFrame([(covered,)], "covered map<string,int>").coalesce(1).write.mode("overwrite").parquet(f"{path}/_manifest/seq={seq}")


def _compact_at_times(batch: DataFrame, path: str, schema: T.StructType, run: str, batch_id: int) -> None:
    if batch_id and batch_id % COMPACT_EVERY == 0:
        compact(batch.sparkSession, path, schema, (run, batch_id))


def collect_results(lines: DataFrame, log_path: str, checkpoint: str, key: str = "image_path") -> StreamingQuery:
    """Parses new result lines and appends the answers whose key no earlier batch holds.

    Uniqueness comes from an anti join with the log instead of streaming state, so state does not
    grow with the number of photos. Unusable answers are not stored and may be sent again.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        run = _run(batch)
        rows = batches.parse_responses(stages.spread(batch)).filter(F.col("error") == "").drop("error")
        single = ordering.keep_first(rows, [key], [F.col("source_chunk"), F.to_json(F.struct(*rows.columns))])
        single = _held(single, f"{log_path}/_batch/run={run}")
        _compact_at_times(batch, log_path, rows.schema, run, batch_id)
        earlier = _earlier(single, log_path, run, batch_id, rows.schema, [key])
        fresh = single if earlier is None else joins.exclude(single, earlier, [key])
        _write_batch(fresh, log_path, run, batch_id, [key])

    return (
        lines.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def collect_ratings(ratings: DataFrame, log_path: str, checkpoint: str, arrival: str = "arrival",
                    keys: Sequence[str] = ("rater", "image_path")) -> StreamingQuery:
    """Stores each micro-batch's last rating per (rater, photo); ``current_ratings`` resolves the rest.

    ``arrival`` is the column that tells which of two ratings with one time came later.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        newest = summaries.latest_ratings(batch, keys, arrival=arrival, fields=("score", arrival))
        _compact_at_times(batch, log_path, newest.schema, _run(batch), batch_id)
        _write_batch(newest, log_path, _run(batch), batch_id, keys)

    return (
        ratings.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def current_ratings(log: DataFrame, keys: Sequence[str] = ("rater", "image_path"), arrival: str = "arrival") -> DataFrame:
    """Last rating per key by time; of equal times the later arrival counts."""
    return summaries.latest_ratings(log.drop("run", "batch_id", "division"), keys, arrival=arrival)


_POINTER = "seq long, version string"


def _pointers(spark: SparkSession, path: str) -> DataFrame:
    return _existing(spark.read.schema(_POINTER + ", batch string"), f"{path}/pointers") or spark.createDataFrame([], _POINTER + ", batch string")


def _existing(reader, path: str) -> DataFrame | None:
    try:
        return reader.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def chunk_status(states: DataFrame, path: str, checkpoint: str, by: Sequence[str] = ("chunk", "state")) -> StreamingQuery:
    """Running counts per chunk and state, read by ``current_status``.

    A micro-batch hands over the counts that changed. It writes the whole table, the last one with
    those counts put in, to a version folder of its own and then a pointer to that folder. Nothing a
    reader may be using is touched, and a crash between the two steps leaves the last version current.
    A retried batch builds on the version before its own.
    """

    def store(counts: DataFrame, batch_id: int) -> None:
        spark, batch = counts.sparkSession, f"{_run(counts)}-{batch_id}"
        # a row per version; the newest of the others is what this one builds on
        others = _pointers(spark, path).filter(F.col("batch") != batch).orderBy(F.desc("seq"))
        newest, mine = others.first(), others.filter(F.col("version").startswith(f"{_run(counts)}-")).first()
        whole = counts
        if mine is not None:  # a new checkpoint counts from the beginning
            last = spark.read.schema(counts.schema).parquet(f"{path}/versions/{mine.version}")
            whole = last.join(counts.select(*by), list(by), "left_anti").unionByName(counts)
        whole.write.mode("overwrite").parquet(f"{path}/versions/{batch}")
        pointer = spark.createDataFrame([(newest.seq + 1 if newest is not None else 0, batch)], _POINTER)
        pointer.write.mode("overwrite").parquet(f"{path}/pointers/batch={batch}")

    return (
        states.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
        .writeStream.outputMode("update").foreachBatch(store)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def current_status(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The table of the newest pointer, whole also while a batch is being written; empty before the first."""
    newest = _pointers(spark, path).orderBy(F.desc("seq")).first()
    if newest is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/versions/{newest.version}")
