"""Sale price and date from the price-history cells of a listing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def history_values(cell, key: str) -> Column:
    """One field of a JSON list of objects as an array; anything else gives an empty array."""
    cell = F.trim(_col(cell))
    parsed = F.from_json(cell, f"array<struct<`{key}`:string>>")
    return F.coalesce(F.when(cell.startswith("["), parsed.getField(key)), F.array().cast("array<string>"))


def first_sale(events: Column, prices: Column, dates: Column, sold: str = "Sold") -> Column:
    """Struct(sold_price, sold_date) taken at the first sale event.

    Both fields are null unless both are filled at that position; later sales are not looked at.
    """
    at = F.coalesce(F.array_position(events, sold), F.lit(0)).cast("int")
    price = F.nullif(F.when(at > 0, F.get(prices, at - 1)), F.lit(""))
    date = F.nullif(F.when(at > 0, F.get(dates, at - 1)), F.lit(""))
    both = price.isNotNull() & date.isNotNull()
    return F.struct(F.when(both, price).alias("sold_price"), F.when(both, date).alias("sold_date"))
