"""Readers for files, version archives, image folders and databases."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwellstat import reference_values as rv
from dwellstat.sources import csv_records

POI_ELEMENT = "id bigint, lat double, lon double, tags map<string,string>"
RUN_META = "timestamp string, rooms array<string>, label string"
RUN_ENTRY = "file string, label string, timestamp string, rooms array<string>, model string, cost_usd double"


def _layouts(spark: SparkSession, path: str | list[str]) -> dict[str, list[str]]:
    """The distinct header records below a path with their column names; a row per layout reaches the driver."""
    heads = csv_records.headers(spark, path).select("header").distinct().collect()
    if not heads:
        raise ValueError(f"{path}: no CSV files with a header")
    texts = sorted(r.header for r in heads)
    return {t: next(csv.reader(io.StringIO(t.removeprefix("\ufeff").removesuffix("\r"), newline=""))) for t in texts}


def _text_cells(spark: SparkSession, path: str | list[str], layouts: dict[str, list[str]], names: Sequence[str]) -> DataFrame:
    """The named columns as text from every record below the headers; a file without a column has nulls in it."""
    rows = csv_records.records(spark, path).where("not head")

    def cells(layout: Sequence[str]) -> Column:
        parsed = F.from_csv(F.col("text"), ", ".join(f"c{i} string" for i in range(len(layout))), {"quote": '"', "escape": '"'})
        empty = F.lit(None).cast("string")
        # one evaluation per record however many columns are taken
        return F.transform(F.array(parsed), lambda p: F.struct(
            *[(p[f"c{layout.index(n)}"] if n in layout else empty).alias(f"_{i}") for i, n in enumerate(names)]))

    if len(layouts) == 1:
        made = cells(next(iter(layouts.values())))
    else:
        heads = csv_records.headers(spark, path).withColumnRenamed("file", "head_of")
        rows = rows.join(heads, F.col("file") == F.col("head_of"))
        made = F.coalesce(*[F.when(F.col("header") == head, cells(layout)) for head, layout in layouts.items()])
    return rows.select(F.inline(made)).toDF(*names)


def read_csv(spark: SparkSession, path: str | list[str], schema: str | T.StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV with a header whose cells may hold commas, quotes, line breaks, HTML or JSON.

    Columns are matched by name in every file, whatever their order there. Files are read in splits
    also where cells hold line breaks (see ``csv_records``).
    """
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    names = list(columns) if columns is not None else wanted.names
    layouts = _layouts(spark, path)
    absent = sorted({f.name for f in wanted for layout in layouts.values() if f.name not in layout})
    if absent:
        raise ValueError(f"{path}: columns not found: {', '.join(absent)}")
    return _text_cells(spark, path, layouts, names).select(*[_typed(wanted[n]) for n in names])


def _typed(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType):
        return column
    value = column.try_cast(field.dataType)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        value = F.when(F.isnan(value), F.lit(None)).otherwise(value)
    return value.alias(field.name)


def read_text_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV with every column as text and empty cells as empty text, by name over all files.

    Columns that only some files have are empty text in the others.
    """
    layouts = _layouts(spark, path)
    names = list(dict.fromkeys(n for layout in layouts.values() for n in layout))
    cells = _text_cells(spark, path, layouts, names)
    return cells.select(*[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names])


def read_parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def read_versions(spark: SparkSession, paths: dict[str, str], schema: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One file per version in one table with a ``version`` column; each file is read once."""
    out = None
    for version, path in paths.items():
        part = read_csv(spark, path, schema, columns).withColumn("version", F.lit(version))
        out = part if out is None else out.unionByName(part)
    return out


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Result lines with the name of the file each came from as ``source_chunk``."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:_results)?\.[^.]+$", 1)
    return spark.read.text(path).select("value", name.alias("source_chunk"))


def read_json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON: one object or an array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object per line; files are split."""
    return spark.read.schema(schema).json(path)


def read_poi_elements(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Place elements with their tag map from exports of the form ``{"elements": [...]}``, one per
    file or, with ``lines``, one per line."""
    read = read_json_lines if lines else read_json_document
    document = read(spark, path, f"elements array<struct<{_fields(POI_ELEMENT)}>>")
    return document.select(F.inline("elements"))


def _fields(ddl: str) -> str:
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in T.StructType.fromDDL(ddl))


def image_inventory(spark: SparkSession, root: str, suffixes: Sequence[str] = rv.IMAGE_SUFFIXES) -> DataFrame:
    """Image files below the folder: path from the folder's own name on, listing id, size.

    Only path and length are selected, so file contents are not read.
    """
    base = root.rstrip("/")
    name = base.rsplit("/", 1)[-1]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).select("path", "length")
    relative = F.concat(F.lit(f"{name}/"), F.regexp_extract("path", f".*?/{_quoted(name)}/(.*)$", 1))
    return (
        files.filter(F.lower("path").rlike(rf"\.({'|'.join(suffixes)})$"))
        .select(relative.alias("image_path"), F.regexp_extract("path", r"([^/]+)/[^/]*$", 1).alias("zpid"), F.col("length").alias("bytes"))
    )


def _quoted(name: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else f"\\{c}" for c in name)


def read_database(spark: SparkSession, url: str, table: str, partition_column: str, lower: int, upper: int,
                  partitions: int, driver: str | None = None, **options: str) -> DataFrame:
    """Database table over JDBC in parallel key ranges (the driver jar comes from the caller)."""
    reader = (
        spark.read.format("jdbc").option("url", url).option("dbtable", table)
        .option("partitionColumn", partition_column).option("lowerBound", lower)
        .option("upperBound", upper).option("numPartitions", partitions)
    )
    if driver:
        reader = reader.option("driver", driver)
    return reader.options(**options).load()
