"""The valuation flow."""

import datetime as dt
import json

from dwellstat import reference_values as rv
from dwellstat.operators import enrich
from dwellstat.plans import flows

CELLS = {"price_history_event": "Sold", "price_history_price": "500000", "price_history_date": "7/1/2026"}
COLUMNS = [*rv.RAW_METADATA_COLUMNS, "listing-link-href", "address", "borough", "type", "neighborhood", "area-sqft", "area", "built_in",
           "bedrooms", "bathrooms", "facts_features_text", *CELLS, "main_image-src", "all_images"]


def test_lookups_get_few_columns_and_every_sale_its_rows(spark, monkeypatch):
    base = {n: json.dumps([{n: v}]) for n, v in CELLS.items()}
    rows = [{**base, "address": a, "borough": "Queens", "neighborhood": n} for a, n in (("1 A St, B", "x"), ("1 A St, B", "y"), ("2 A St, B", "twice"), ("none", "z"))]
    raw = spark.createDataFrame([[r.get(c) for c in COLUMNS] for r in rows], ",".join(f"`{c}` string" for c in COLUMNS))
    addresses = spark.createDataFrame(
        [("1", "A St", "Queens", 7, 40.7, -73.9), ("2", "A St", "Queens", 8, 40.7, -73.9), ("2", "A St", "Queens", 9, None, None)],
        "house_number string, street string, borough string, bbl long, latitude double, longitude double")
    lots = spark.createDataFrame([(7, "v1", "A", 5.0), (9, "v1", "B", 6.0)], "bbl long, version string, bldgclass string, assesstot double")
    pois = spark.createDataFrame([("dining", 40.7, -73.9, None, None)], "category string, latitude double, longitude double, valid_from date, valid_to date")
    given, geocode = [], enrich.geocode
    monkeypatch.setattr(enrich, "geocode", lambda sales, *more: given.append(sales.columns) or geocode(sales, *more))
    out = flows.valuation_table(raw, addresses, lots, pois, [(dt.date(2020, 1, 1), "v1")], dt.date(2030, 1, 1), ["dining"])
    assert sorted(given[0]) == ["_sale", "address", "borough", "sale_day"]
    got = {(r.neighborhood, r.bbl, r.version, r.bldgclass, r.dining) for r in out.collect()}
    assert got == {("x", 7, "v1", "A", 1), ("y", 7, "v1", "A", 1), ("twice", 8, "v1", None, 1), ("twice", 9, "v1", "B", None), ("z", None, "v1", None, None)}
    assert out.count() == 5 and not {"_sale", "_row", "house_number", "street"} & set(out.columns)
