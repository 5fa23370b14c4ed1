import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from dwellstat import reference_values as rv
from dwellstat.functions import dates, facts, history, text
from dwellstat.operators import cleaning, photos
from dwellstat.plans import catalog, views

CELLS = ("price_history_event", "price_history_price", "price_history_date")
TEXT_COLUMNS = [
    *rv.RAW_METADATA_COLUMNS, "listing-link-href", "address", "borough", "type", "neighborhood", "area-sqft", "area", "built_in",
    "bedrooms", "bathrooms", "facts_features_text", *CELLS, "main_image-src", "all_images",
]


def history_cells(events, prices, days):
    return dict(zip(CELLS, [json.dumps([{n: v} for v in vs]) for n, vs in zip(CELLS, (events, prices, days))]))


def raw(spark, *rows):
    base = {"listing-link-href": "https://x/1_zpid/", "address": "1 A St, B", **history_cells(["Sold"], ["500000"], ["7/1/2026"])}
    schema = ",".join(f"`{c}` string" for c in TEXT_COLUMNS)
    return spark.createDataFrame([[{**base, **r}.get(c) for c in TEXT_COLUMNS] for r in rows], schema)


def sale(price, **more):
    return {**history_cells(["Sold"], [price], ["7/1/2026"]), **more}


def test_sale_rules(spark):
    rows = [
        sale("500000", neighborhood="plain"),
        {**history_cells(["Listed"], ["1"], ["7/1/2026"]), "neighborhood": "no sale"},
        {**history_cells(["Sold", "Sold"], ["", "500000"], ["7/1/2026", "7/1/2026"]), "neighborhood": "first sale empty"},
        {"price_history_event": "[{bad", "neighborhood": "malformed"},
        sale("call us", neighborhood="unparsable price"),
        sale("100000", neighborhood="floor"),
        sale("99999", neighborhood="below floor"),
        sale("10000000", neighborhood="ceiling"),
        sale("10000001", neighborhood="above ceiling"),
        sale("150000", neighborhood="cheap per sqft", **{"area-sqft": "1,501"}),
    ]
    kept, rejected = cleaning.clean_sales(raw(spark, *rows))
    assert {r.neighborhood for r in kept.collect()} == {"plain", "unparsable price", "floor", "ceiling"}
    reasons = {r.neighborhood: r.reject_reason for r in rejected.collect()}
    assert reasons == {
        "no sale": "sale_missing", "first sale empty": "sale_missing", "malformed": "sale_missing",
        "below floor": "price_out_of_range", "above ceiling": "price_out_of_range",
        "cheap per sqft": "price_per_sqft_below_floor",
    }


@pytest.mark.parametrize("kind,area,expected", [
    (None, "99", None), (None, "100", 100.0), (None, "20,000", 20000.0), (None, "20,001", None),
    ("Condo", "10,001", None), ("Condo", "10,000", 10000.0), ("Townhouse", "10,001", 10001.0), (None, "n/a", None),
])
def test_sqft(spark, kind, area, expected):
    kept, _ = cleaning.clean_sales(raw(spark, sale("9000000", type=kind, **{"area-sqft": area})))
    assert kept.first()["area-sqft"] == expected


def test_cells(spark):
    row = sale("500000", type="Condo", area="1,200 Lot", borough="Elsewhere", address=" 9 B Ave , X", all_images="b, a,,b ,c", built_in="1931")
    got = cleaning.clean_sales(raw(spark, row))[0].first()
    assert (got.zpid, got.address, got.borough, got.lot_area, got.all_images, got.built_in, got.days_old) == (
        "1", "9 B Ave", "Brooklyn", None, "b,a,c", 1931.0, 1)


def test_missing_metadata_column_is_an_error(spark):
    with pytest.raises(ValueError, match="price_history_merged"):
        cleaning.clean_sales(raw(spark, {}).drop("price_history_merged"))


def test_history_values(spark):
    cells = [('[{"k":"a"},{"z":1},{"k":2}]', ["a", None, "2"]), ("[1,2]", []), ("oops", []), ('{"k":"v"}', []), ("", []), (None, [])]
    df = spark.createDataFrame([(c,) for c, _ in cells], "c string").select("c", history.history_values("c", "k").alias("v"))
    assert {r.c: r.v for r in df.collect()} == dict(cells)


def check(spark, value, make, expected):
    assert spark.createDataFrame([(value,)], "v string").select(make("v").alias("x")).first().x == expected


@pytest.mark.parametrize("make,value,expected", [
    (text.street_name, "12 Main St APT 4, rear", "Main St"), (text.street_name, "12 Unity Ave #3", "Unity Ave"),
    (text.street_name, "Nowhere", None), (text.house_number, "12-34 Main", "12-34"), (text.street_name, "1 Floral Pl", "Floral Pl"),
    (text.zip5, "11201.0", "11201"), (text.zip5, "x", None), (text.code_string, "8.0", "8"), (text.code_string, "A5", "A5"),
    (text.lenient_long, "3012.0", 3012), (text.lenient_long, "x", None), (text.lenient_long, "12d", None), (text.lenient_double, "12f", None), (text.lenient_double, " 1.5e3 ", 1500.0), (text.lenient_double, ".5", 0.5), (text.photo_key, "http://h/a.jpg", "a.jpg"),
    (text.photo_key, "http://h/fp/0123456789abcdef-cc_ft_960.jpg", "0123456789abcdef"),
    (text.photo_size, "http://h/x-uncropped_scaled_within_1536_1152.webp", 1152), (text.photo_size, "http://h/a.jpg", 0),
    (text.is_hero, "images/1/1_hero.jpg", 1), (text.is_hero, "images/1/1_hero_2.jpg", 0), (text.parent_folder, "images/77/a.jpg", "77"),
    (text.link_list, '["http://a", {"x":"http://b"}, 5]', ["http://a", "http://b"]), (text.link_list, "http://a|http://b x", ["http://a", "http://b"]),
    (text.mime_of, "a/b.PNG", "image/png"), (text.mime_of, "a/b.tiff", "image/jpeg"), (text.lenient_double, "nan", None),
    (dates.us_date, "7/4/2025", dt.date(2025, 7, 4)), (dates.us_date, "2025-07-04", None),
    (dates.folder_timestamp, "2026-07-14T144924", dt.datetime(2026, 7, 14, 14, 49, 24)),
])
def test_text(spark, make, value, expected):
    check(spark, value, make, expected)


def test_largest_variants(spark):
    digest = "0123456789abcdef"
    rows = [
        ("odd", [f"http://h/{digest}-cc_ft_5.jpg", None, "http://h/a/b.jpg", f"http://h/{digest}_within_9_0070.webp", "no slash", "http://h/c/b.jpg",
                 f"http://h/x/{digest}", f"http://h/{digest}-cc_ft_70.jpg", "http://h/\nn/é", "http://h/"]),
        ("wide", [f"http://h/{digest}-cc_ft_{n}.jpg" for n in ("9223372036854775808", "0" * 30 + "8", "9223372036854775807", "9" * 5000, "12")]),
        ("none", []), (None, ["http://h/z"]), ("null", None), ("odd", ["http://h/y", "http://h/w", "http://h/y"]),
    ]
    df = spark.createDataFrame(rows, "zpid string, links array<string>").coalesce(1)
    found = photos.largest_variants(df, F.col("links"), "zpid")
    assert [(f.name, f.dataType.simpleString()) for f in found.schema] == [
        ("zpid", "string"), ("img_index", "bigint"), ("photo_hash", "string"), ("url", "string")]
    assert [tuple(r) for r in found.collect()] == [
        ("odd", 0, digest, f"http://h/{digest}_within_9_0070.webp"), ("odd", 2, "b.jpg", "http://h/a/b.jpg"), ("odd", 3, "no slash", "no slash"),
        ("odd", 4, "é", "http://h/\nn/é"), ("odd", 5, "", "http://h/"),
        ("wide", 0, digest, f"http://h/{digest}-cc_ft_9223372036854775807.jpg"),
        (None, 0, "z", "http://h/z"), ("odd", 0, "y", "http://h/y"), ("odd", 1, "w", "http://h/w"),
    ]


def test_largest_variants_takes_each_link_once(spark):
    """Patterns and sorts over an array's links are interpreted link by link, some of them twice."""
    df = spark.createDataFrame([("a", ["http://h/x"])], "zpid string, links array<string>")
    plan = photos.largest_variants(df, F.col("links"), "zpid")._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "Exchange" not in plan


def test_lot_key(spark):
    df = spark.createDataFrame([("3", "00012", "0001"), ("0", "00000", "0000"), ("3", None, "1"), ("3", "", "1")], "b string, k string, l string")
    assert [r.x for r in df.select(text.lot_key("b", "k", "l").alias("x")).collect()] == [3000120001, None, None, None]


def test_facts(spark):
    html = (
        '<div data-testid="category-group"><h3> In<b>side</b> </h3><li>Early: bird</li><h6>Heat</h6><ul><li><span>Type:</span> gas: hot</li>'
        "<li>Type: oil</li><li>bare</li><li>bare</li><li> </li></ul><script>li: x</script></div>"
        '<div data-testid="category-group"><li>Loose</li></div><li>outside: x</li>'
    )
    df = spark.createDataFrame([(html,), ("no markup",), (None,)], "h string").select(facts.facts_rows("h").alias("f"))
    first, plain, missing = [r.f for r in df.collect()]
    assert [tuple(r) for r in first] == [
        ("Inside", "_general", "Early", "bird"), ("Inside", "Heat", "Type", "oil"), ("Inside", "Heat", "_bare", "bare"),
        ("Inside", "Heat", "_bare", "bare"), ("_uncategorised", "_general", "_bare", "Loose"),
    ]
    assert plain == [] and missing == []
    nested = df.select(facts.nested_facts("f").alias("n"), facts.bare_facts("f").alias("b")).first()
    assert nested.n == {"Inside": {"_general": {"Early": "bird"}, "Heat": {"Type": "oil"}}}
    assert [(b.category, b.texts) for b in nested.b] == [("Inside", ["bare", "bare"]), ("_uncategorised", ["Loose"])]


def test_rules_let_missing_values_pass(spark):
    df = spark.createDataFrame([(None,), (1.0,), (9.0,)], "p double")
    kept, rejected = cleaning.split_rejects(cleaning.tag_rejects(df, [("high", F.col("p") > 5)]))
    assert [r.p for r in kept.collect()] == [None, 1.0] and rejected.first().reject_reason == "high"


def test_plain_markup_reads_as_the_tolerant_reader_does(spark):
    bits = ['<div data-testid="category-group">', '<DIV class="a b">', "<h3>", "</h3>", "<h6>", "</h6>", "<li>", '<li class="x">', "</li>", "</div>",
            "<br/>", "<br>", "a: b", "c &amp; d", " : ", "&lt;li&gt;", "<!-- c -->", "<p title='x'>", "<script>", "</script>", "<", "</p >"]
    rng, marks, plain = random.Random(7), (("data-testid", "category-group"), "h3", "h6", "li"), 0
    for i in range(2000):
        html = "".join(rng.choices(bits if i % 4 == 0 else bits[:16], k=rng.randint(1, 12)))
        fast, slow = facts._Outline(*marks), facts._Outline(*marks)
        fast.read(html)
        slow.feed(html)
        slow.close()
        assert fast.groups == slow.groups, html
        plain += bool(facts._PLAIN.fullmatch(html))
    assert 1000 < plain < 2000


def test_costly_rows_are_spread(spark, sf_dir):
    assert views.raw_sales(spark, sf_dir).rdd.getNumPartitions() > 1
    assert catalog.queries()["facts_html"](spark, sf_dir).rdd.getNumPartitions() > 1
