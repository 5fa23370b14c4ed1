"""Request lines out, result lines in."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellstat.functions import text, usage
from dwellstat.operators import stages


def request_lines(items: DataFrame, item: str, prompt: str, resolution: str, labels: Sequence[str],
                  caption: str = "Photo to classify:") -> DataFrame:
    """One JSON request per photo (columns item, ``line``); the photo itself goes by reference."""
    def lit_array(values):
        return F.array(*[F.lit(v) for v in values])

    schema = F.struct(
        F.lit("object").alias("type"),
        F.struct(
            F.struct(F.lit("string").alias("type"), lit_array(labels).alias("enum")).alias("room_type"),
            F.struct(F.lit("string").alias("type"), F.lit(True).alias("nullable")).alias("other_label"),
        ).alias("properties"),
        lit_array(["room_type", "other_label"]).alias("required"),
    )
    no_file = F.lit(None).cast("struct<mimeType:string,fileUri:string>")
    photo = F.struct(
        F.struct(text.mime_of(item).alias("mimeType"), F.col(item).alias("fileUri")).alias("fileData"),
        F.lit(None).cast("string").alias("text"),
    )
    words = F.struct(no_file.alias("fileData"), F.lit(caption).alias("text"))
    request = F.struct(
        F.array(F.struct(F.lit("user").alias("role"), F.array(photo, words).alias("parts"))).alias("contents"),
        F.struct(F.array(F.struct(F.lit(prompt).alias("text"))).alias("parts")).alias("systemInstruction"),
        F.struct(
            F.lit(0).alias("temperature"),
            F.lit(resolution).alias("mediaResolution"),
            F.lit("application/json").alias("responseMimeType"),
            schema.alias("responseSchema"),
        ).alias("generationConfig"),
    )
    return items.withColumn("line", F.to_json(F.struct(F.col(item).alias("key"), request.alias("request"))))


def parse_responses(lines: DataFrame, line: str = "value", chunk: str = "source_chunk") -> DataFrame:
    """Result lines → classification rows; ``error`` is empty for usable answers.

    Thinking tokens bill as output. Blank lines are skipped.
    """
    rows = stages.once(lines.filter(F.trim(line) != "").select(chunk, line), _row=usage.response_row(line))
    rows = stages.once(rows, _answer=usage.answer_row(F.col("_row.response")))
    rows = stages.once(rows, _failure=usage.failure_text(F.col("_row"), F.col("_answer")))
    parsed = rows.select(chunk, *usage.answer_fields(F.col("_row"), F.col("_answer"), F.col("_failure")))
    cost = usage.flat_cost("input_tokens", F.col("output_tokens") + F.col("thinking_tokens"))
    return parsed.select(
        F.col("key").alias("image_path"),
        text.parent_folder("key").alias("zpid"),
        text.is_hero("key").alias("is_hero"),
        "room_type",
        "other_label",
        "response_model",
        "input_tokens",
        "output_tokens",
        "thinking_tokens",
        cost.alias("cost_usd"),
        F.col(chunk).alias("source_chunk"),
        "error",
    )


def score_tasks(tasks: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Applies a caller-supplied scorer to batches of tasks (the one place a model is called)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield scorer(batch)

    return tasks.mapInPandas(run, schema)
