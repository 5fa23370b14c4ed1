"""The three end-to-end flows, wired from the operators."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellstat import reference_values as rv
from dwellstat.functions import checks, dates
from dwellstat.operators import agreement, batches, cleaning, enrich, joins, modeling, sampling, summaries
from dwellstat.session import staged

STRUCTURE = ("bedrooms", "bathrooms", "area-sqft", "built_in", "lot_area", "days_old")
LOT_FEATURES = ("bldgarea", "resarea", "builtfar", "bldgdepth", "lotfront", "residfar", "assesstot", "assessland")
CODES = ("type", "neighborhood", "bldgclass")


def price_features() -> modeling.FeatureSpec:
    """The feature matrix of the price model: structure, lot record, places, categories."""
    places = tuple(rv.POI_CATEGORIES)
    return modeling.FeatureSpec(
        numeric=(*STRUCTURE, *LOT_FEATURES, *places),
        categorical=CODES,
        groups={"structure": (*STRUCTURE, "type", "neighborhood"), "lot": (*LOT_FEATURES, "bldgclass"), "places": places},
    )


def valuation_table(
    raw: DataFrame,
    addresses: DataFrame,
    lots: DataFrame,
    pois: DataFrame,
    versions: Sequence[tuple[dt.date, str]] = rv.LOT_VERSIONS,
    latest_places: dt.date | None = None,
    categories: Sequence[str] = tuple(rv.POI_CATEGORIES),
) -> DataFrame:
    """Raw listings → one row per sale with lot record as of the sale and place counts as of its month.

    ``addresses`` is unique per house number, street and borough; ``pois`` has one row per place
    and category. Every kept sale gives a row, also without an id and when an id repeats.
    """
    kept, _ = cleaning.clean_sales(raw)
    # row numbers are fixed once the rows are written; the wide rows stay where they are, and what
    # the lookups shuffle are the few columns they need
    sold = staged(kept.withColumns({"sale_day": dates.us_date("sold_date"), "_sale": F.monotonically_increasing_id()}), "kept-sales")
    geocoded = enrich.geocode(sold.select("_sale", "sale_day", "address", "borough"), addresses)
    placed = geocoded.drop("address", "borough", "house_number", "street").withColumn("_row", F.monotonically_increasing_id())
    placed = staged(placed, "placed-sales")
    versioned = placed.withColumn("version", enrich.version_as_of("sale_day", versions))
    newest = latest_places or dt.date.today()
    spots = placed.select("_row", "latitude", "longitude", dates.snapshot_date("sale_day", newest).alias("snapshot"))
    counts = enrich.radius_counts(spots, pois, categories, key="_row")
    found = joins.lookup(enrich.attach_lots(versioned.drop("sale_day"), lots), counts, ["_row"]).drop("_row")
    return enrich.clean_lot_fields(joins.lookup(sold, found, ["_sale"])).drop("_sale")


def photo_batches(images: DataFrame, done: DataFrame, prompt: str, item: str = "image_path") -> DataFrame:
    """Inventory → request lines with stable chunk ids, photos already classified left out.

    Chunks are planned over the whole inventory, so a chunk id means the same photos in every run.
    """
    planned = sampling.chunk_plan(images, item, sampling.rows_per_chunk())
    return batches.request_lines(joins.pending(planned, done, [item]), item, prompt, "MEDIA_RESOLUTION_LOW", rv.PHOTO_LABELS)


def rating_report(scores: DataFrame, ratings: DataFrame, groups: dict[str, Sequence[str] | None], labels: DataFrame,
                  label: str, corpus_items: Column) -> dict[str, DataFrame]:
    """Every table of the model comparison, by name."""
    # each is read by several tables
    good = staged(scores.filter(checks.no_error("error")), "good-scores")
    ratings = staged(ratings, "ratings")
    means = staged(agreement.mean_scores(good, ["model", "image_path", "zpid", "room_type"]), "means")
    references = staged(agreement.consensus(ratings, groups), "references")
    pairs = staged(agreement.rater_pairs(ratings), "pairs")
    overall = staged(agreement.agreement(means, references), "agreement")
    consistency = staged(agreement.consistency(good), "consistency")
    costs = summaries.scoring_cost(good, labels, label, corpus_items)
    ceiling = agreement.agreement_ceiling(pairs)
    return {
        "consistency": consistency,
        "compression": agreement.compression(good, agreement.top_level_of()),
        "histogram": agreement.score_histogram(good, ["model", "room_type"], "score", agreement.top_level_of()),
        "room_disagreement": agreement.disagreement_rate(good, "room_type", "room_type_judgment", ["model", "room_type"]),
        "agreement": overall,
        "agreement_by_room": agreement.agreement(means, references, by=("model", "reference", "room_type")),
        "raters": agreement.rater_summary(ratings, pairs),
        "rater_pairs": pairs,
        "ceiling": ceiling,
        "costs": costs,
        "model_ids": agreement.joined_names(good, "model", "response_model", "response_models"),
        "candidates": agreement.pick_model(overall.filter(F.col("reference") == "all"), consistency, costs, ceiling),
    }
