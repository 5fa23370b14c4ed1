"""Writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellstat.operators import joins, ordering


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, readable by ``readers.read_csv``."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", False).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_pending(spark: SparkSession, rows: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Appends the rows whose keys the log does not hold yet; running it again changes nothing.

    Of rows with one key the first by all columns is stored, so a retry stores the same.
    """
    rows = ordering.keep_first(rows, keys, [F.to_json(F.struct(*rows.columns))])
    try:
        done = spark.read.schema(rows.schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        rows.write.parquet(path)
        return
    joins.pending(rows, done, keys).write.mode("append").parquet(path)


def gathered(items: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    """The rows of each chunk in one task and in order of the chunks, for ``write_request_files``.

    Gather items before they are made into lines, which are many times as wide.
    """
    return items.repartition(chunk).sortWithinPartitions(chunk)


def write_request_files(lines: DataFrame, path: str, chunk: str = "chunk_id", line: str = "line", together: bool = False) -> None:
    """JSON-lines request files, one folder per chunk, compressed, as lines differ by little more than their item.

    A chunk has a fixed number of rows, so gathering it in one file is bounded; ``together`` if it
    was ``gathered`` before.
    """
    rows = lines.select(chunk, F.col(line).alias("value"))
    (rows if together else rows.repartition(chunk)).write.mode("overwrite").option("compression", "gzip").partitionBy(chunk).text(path)
