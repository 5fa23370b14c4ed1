"""Token usage, cost and response parsing for batches of model requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dwellstat import reference_values as rv

RESPONSE_LINE = (
    "key string, error string, status string, "
    "response struct<candidates:array<struct<content:struct<parts:array<struct<text:string>>>>>,"
    "usageMetadata:struct<promptTokenCount:bigint,candidatesTokenCount:bigint,thoughtsTokenCount:bigint>,"
    "modelVersion:string>"
)
ANSWER = "room_type string, other_label string"


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast("bigint")


def flat_cost(input_tokens, output_tokens, price_in: float = rv.PHOTO_PRICE_INPUT,
              price_out: float = rv.PHOTO_PRICE_OUTPUT, batch: bool = True) -> Column:
    """Cost at one price pair per million tokens."""
    cost = (_col(input_tokens) * price_in + _col(output_tokens) * price_out) / 1_000_000
    return cost * rv.BATCH_DISCOUNT if batch else cost


def model_cost(model, input_tokens, output_tokens, cached_tokens=None, write_tokens=None,
               prices: dict = rv.TOKEN_PRICES, batch: bool = False) -> Column:
    """Cost by model with cached and cache-write tokens at their own rates; null for an unknown model."""
    zero = F.lit(0)
    cached = zero if cached_tokens is None else _col(cached_tokens)
    write = zero if write_tokens is None else _col(write_tokens)
    table = F.create_map(
        *[v for name, row in prices.items() for v in (F.lit(name), F.array(*[F.lit(float(p)) for p in row]))]
    )
    price = F.try_element_at(table, _col(model))
    fresh = F.greatest(_col(input_tokens) - cached - write, zero)
    cost = (
        fresh * F.get(price, 0) + cached * F.get(price, 2) + write * F.get(price, 3) + _col(output_tokens) * F.get(price, 1)
    ) / 1_000_000
    return cost * rv.BATCH_DISCOUNT if batch else cost


def normal_usage(provider, usage_json) -> Column:
    """Struct(input, output, cached, write, thought) from three provider shapes of usage JSON.

    Input is always the whole prompt; output includes thinking where the provider bills it so.
    """
    provider, usage = _col(provider), _col(usage_json)

    def number(path: str) -> Column:
        return _zero(F.get_json_object(usage, path).try_cast("bigint"))

    def shape(inp, out, cached, write, thought) -> Column:
        return F.struct(
            inp.cast("bigint").alias("input_tokens"), out.cast("bigint").alias("output_tokens"),
            cached.cast("bigint").alias("cached_tokens"), write.cast("bigint").alias("write_tokens"),
            thought.cast("bigint").alias("thought_tokens"),
        )

    nil = F.lit(0)
    read, write = number("$.cache_read_input_tokens"), number("$.cache_creation_input_tokens")
    thought = number("$.thoughts_token_count")
    return (
        F.when(
            provider == "openai",
            shape(number("$.prompt_tokens"), number("$.completion_tokens"),
                  number("$.prompt_tokens_details.cached_tokens"), nil, nil),
        )
        .when(
            provider == "gemini",
            shape(number("$.prompt_token_count"), number("$.candidates_token_count") + thought,
                  number("$.cached_content_token_count"), nil, thought),
        )
        .when(
            provider == "anthropic",
            shape(number("$.input_tokens") + read + write, number("$.output_tokens"), read, write, nil),
        )
    )


def response_row(line) -> Column:
    """Struct of one JSON result line, null fields where it does not parse."""
    return F.from_json(_col(line), RESPONSE_LINE)


def answer_text(response: Column) -> Column:
    """The text parts of a response, joined."""
    return F.array_join(F.get(response["candidates"], 0)["content"]["parts"]["text"], "")


def answer_row(response: Column) -> Column:
    """The answer inside a response, read as JSON."""
    return F.from_json(answer_text(response), ANSWER)


def failure_text(row: Column, answer: Column) -> Column:
    """Why a line gives no usable answer; null when it does.

    An answer that names its label as null is usable; one that does not name it is not.
    """
    named = F.array_contains(F.json_object_keys(answer_text(row["response"])), "room_type")
    return F.coalesce(
        F.nullif(row["error"], F.lit("")),
        F.when(row["response"].isNull(), F.coalesce(row["status"], F.lit("no response"))),
        F.when(answer["room_type"].isNull() & ~F.coalesce(named, F.lit(False)), F.lit("unreadable answer")),
    )


def answer_fields(row: Column, answer: Column, failure: Column) -> list[Column]:
    """Answer columns; blank texts and zero tokens for a failed line."""
    ok = failure.isNull()
    response = row["response"]
    tokens = response["usageMetadata"]

    def when_ok(value: Column, other) -> Column:
        return F.when(ok, value).otherwise(F.lit(other))

    return [
        F.coalesce(row["key"], F.lit("")).alias("key"),
        F.when(ok, answer["room_type"]).alias("room_type"),
        when_ok(F.coalesce(answer["other_label"], F.lit("")), "").alias("other_label"),
        when_ok(F.coalesce(response["modelVersion"], F.lit("")), "").alias("response_model"),
        when_ok(_zero(tokens["promptTokenCount"]), 0).cast("bigint").alias("input_tokens"),
        when_ok(_zero(tokens["candidatesTokenCount"]), 0).cast("bigint").alias("output_tokens"),
        when_ok(_zero(tokens["thoughtsTokenCount"]), 0).cast("bigint").alias("thinking_tokens"),
        F.coalesce(failure, F.lit("")).alias("error"),
    ]
