"""Row rules and the listing clean-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellstat import reference_values as rv
from dwellstat.functions import dates, facts, history, text
from dwellstat.operators import stages


def drop_required(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drops columns that must exist (Spark alone would ignore a missing one)."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"columns not found: {', '.join(absent)}")
    return df.drop(*columns)


def tag_rejects(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """Adds ``reject_reason``: the first rule a row breaks, null when it passes all.

    A rule that evaluates to null does not reject, so missing values pass.
    """
    reason = F.lit(None).cast("string")
    for name, broken in reversed(list(rules)):
        reason = F.when(F.coalesce(broken, F.lit(False)), F.lit(name)).otherwise(reason)
    return df.withColumn("reject_reason", reason)


def split_rejects(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    kept = tagged.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    return kept, tagged.filter(F.col("reject_reason").isNotNull())


def plausible_sqft(sqft: str = "area-sqft", kind: str = "type") -> Column:
    """Floor area, null where impossible for the kind of home."""
    area = F.col(f"`{sqft}`")
    is_unit = F.coalesce(F.col(kind).isin(*rv.UNIT_TYPES), F.lit(False))
    bad = (area < rv.SQFT_FLOOR) | (area > rv.SQFT_CEILING) | (is_unit & (area > rv.UNIT_SQFT_CEILING))
    return F.when(F.coalesce(bad, F.lit(False)), F.lit(None).cast("double")).otherwise(area)


def owned_lot_area(lot_area: str = "lot_area", kind: str = "type") -> Column:
    """Lot area, null for units that do not own their lot."""
    return F.when(F.coalesce(F.col(kind).isin(*rv.UNIT_TYPES), F.lit(False)), F.lit(None).cast("double")).otherwise(F.col(lot_area))


def price_rules(price: str, sqft: str) -> list[tuple[str, Column]]:
    p, area = F.col(f"`{price}`"), F.col(f"`{sqft}`")
    return [
        ("price_out_of_range", (p < rv.PRICE_FLOOR) | (p > rv.PRICE_CEILING)),
        ("price_per_sqft_below_floor", F.try_divide(p, area) < rv.PRICE_PER_SQFT_FLOOR),
    ]


def clean_sales(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw listing export → (kept sales, rejected rows with their reason).

    One narrow pass: parsing, sale derivation and all rules happen without a shuffle.
    """
    df = drop_required(raw, rv.RAW_METADATA_COLUMNS).withColumnRenamed("area", "lot_area")
    df = stages.once(df, **{f"_{p}": history.history_values(f"price_history_{p}", f"price_history_{p}") for p in ("event", "price", "date")})
    df = stages.once(df, _sale=history.first_sale(F.col("_event"), F.col("_price"), F.col("_date"))).drop("_event", "_price", "_date")
    df = df.withColumns(
        {
            "zpid": text.listing_id("listing-link-href"),
            "address": text.first_part("address"),
            "borough": text.allowed_or("borough", rv.BOROUGHS, rv.DEFAULT_BOROUGH),
            "lot_area": text.lenient_double("lot_area", ",", "Lot"),
            "built_in": text.lenient_double("built_in"),
            "bedrooms": text.lenient_double("bedrooms"),
            "bathrooms": text.lenient_double("bathrooms"),
            "all_images": text.distinct_links("all_images"),
            "sold_date": F.col("_sale.sold_date"),
        }
    )
    df = stages.once(
        df,
        _sale_missing=F.col("_sale.sold_price").isNull(),
        sold_price=text.lenient_double("_sale.sold_price"),
        **{"area-sqft": text.lenient_double(F.col("`area-sqft`"), ",")},
    ).drop("_sale")
    df = df.withColumns({"area-sqft": plausible_sqft(), "lot_area": owned_lot_area()})
    df = df.withColumn("days_old", dates.age_days(dates.us_date("sold_date")))
    rules = [("sale_missing", F.col("_sale_missing")), *price_rules("sold_price", "area-sqft")]
    kept, rejected = split_rejects(tag_rejects(df, rules))
    # HTML is read for kept rows only
    kept = kept.withColumn("facts_features", facts.facts_rows("facts_features_text"))
    return kept.drop("_sale_missing", "facts_features_text"), rejected.drop("_sale_missing")


def positive_target(df: DataFrame, target: str) -> DataFrame:
    return df.filter(F.col(target) > 0)


def image_links(sales: DataFrame) -> DataFrame:
    """Listings with both a main photo and a photo list."""
    return sales.select("main_image-src", "all_images", "zpid").dropna()
