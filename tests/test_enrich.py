import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from dwellstat import reference_values as rv
from dwellstat.operators import circles, enrich, joins

VERSIONS = [(dt.date(2025, 9, 25), "b"), (dt.date(2025, 6, 23), "a"), (dt.date(2026, 1, 26), "c")]


def test_version_as_of(spark):
    cases = {dt.date(2020, 1, 1): "a", dt.date(2025, 6, 23): "a", dt.date(2025, 9, 24): "a", dt.date(2025, 9, 25): "b",
             dt.date(2026, 1, 25): "b", dt.date(2026, 1, 26): "c", dt.date(2030, 1, 1): "c", None: None}
    df = spark.createDataFrame([(d,) for d in cases], "d date")
    assert {r.d: r.v for r in df.select("d", enrich.version_as_of("d", VERSIONS).alias("v")).collect()} == cases
    early = df.filter(enrich.predates_versions("d", VERSIONS)).collect()
    assert [r.d for r in early] == [dt.date(2020, 1, 1)]


def test_attach_lots(spark):
    sales = spark.createDataFrame([(1, 10, "a"), (2, 10, "b"), (3, None, "a"), (4, 11, None)], "zpid int, bbl long, version string")
    lots = spark.createDataFrame([(10, "a", "z9"), (10, "a", "a1"), (None, "a", "q"), (11, "a", "x")], "bbl long, version string, bldgclass string")
    got = {r.zpid: r.bldgclass for r in enrich.attach_lots(sales, lots).collect()}
    assert got == {1: "a1", 2: None, 3: None, 4: None}


def test_require_versions(spark):
    sales = spark.createDataFrame([("a",), ("b",), (None,)], "version string")
    with pytest.raises(ValueError, match="b"):
        enrich.require_versions(sales, "version", spark.createDataFrame([("a",)], "version string"))


def test_clean_lot_fields(spark):
    df = spark.createDataFrame([("A5", "Individual Landmark ", "x", "8.0"), ("A5", "Heights", None, "K"), (None, None, None, None)],
                               "bldgclass string, histdist string, landmark string, schooldist string")
    assert [tuple(r) for r in enrich.clean_lot_fields(df).collect()] == [("A5", 0.0, 1.0, "8"), ("A5", 1.0, 0.0, "K"), (None, None, None, None)]


def test_lookup_rejects_repeated_keys(spark):
    dim = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="key repeats"):
        joins.lookup(spark.createDataFrame([(1,)], "k int"), joins.require_unique(dim, ["k"], "dim"), ["k"]).collect()


def test_poi_categories(spark):
    df = spark.createDataFrame([({"amenity": "cafe", "shop": "coffee"},), ({"amenity": "cafe", "shop": "clothes", "x": "y"},), ({"a": "b"},)], "tags map<string,string>")
    got = [sorted(r.c) for r in df.select(enrich.poi_categories("tags").alias("c")).collect()]
    assert got == [["dining"], ["dining", "retail"], []]
    assert len(rv.POI_CATEGORIES) == 15


def _haversine(a, b):
    la1, lo1, la2, lo2 = map(math.radians, (*a, *b))
    h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    return 2 * enrich.EARTH_RADIUS_M * math.asin(math.sqrt(min(1.0, h)))


@pytest.mark.parametrize("centre,radius", [((40.65, -73.95), 600.0), ((-17.0, 179.999), 600.0), ((68.0, 20.0), 2500.0), ((0.0, 0.0), 600.0)])
def test_radius_counts_against_brute_force(spark, centre, radius):
    rng = np.random.default_rng(5)
    spread = radius / enrich.METRES_PER_DEGREE * 3
    wide = spread / math.cos(math.radians(centre[0]))

    def around(n):
        lat = centre[0] + rng.uniform(-spread, spread, n)
        lon = (centre[1] + rng.uniform(-wide, wide, n) + 180) % 360 - 180
        return list(zip(lat.tolist(), lon.tolist()))

    days = [dt.date(2024, 1, 1) + dt.timedelta(days=int(d)) for d in rng.integers(0, 120, 400)]
    places = around(300) + [(centre[0], centre[1])] * 100
    pois = [
        (("p", "q")[i % 2], *places[i], None if i % 17 == 0 else days[i], None if i % 3 else days[i] + dt.timedelta(days=int(i % 40)))
        for i in range(400)
    ]
    homes = [(i, *spot, (dt.date(2024, 2, 1), dt.date(2024, 3, 1), dt.date(2024, 3, 10), None)[i % 4]) for i, spot in enumerate(around(40) + [(centre[0], centre[1])] * 8)]
    homes.append((99, None, 1.0, dt.date(2024, 2, 1)))
    got = enrich.radius_counts(
        spark.createDataFrame(homes, "zpid int, latitude double, longitude double, snapshot date"),
        spark.createDataFrame(pois, "category string, latitude double, longitude double, valid_from date, valid_to date"),
        ["p", "q", "r"], radius, rows_per_salt=7,
    ).collect()
    want = {}
    for z, la, lo, snap in homes[:-1]:
        alive = [p for p in pois if snap and (p[3] is None or p[3] <= snap) and (p[4] is None or snap < p[4]) and (p[3] is None or p[4] is None or p[3] < p[4])]
        near = [p for p in alive if _haversine((la, lo), p[1:3]) <= radius]
        want[z] = tuple(sum(p[0] == c for p in near) for c in "pqr") if snap else (None,) * 3
    assert {r.zpid: (r.p, r.q, r.r) for r in got} == want
    assert any(v[0] and v[0] > 10 for v in want.values())


def test_circle_requests(spark):
    homes = spark.createDataFrame([(i, 40.5, -73.9, dt.date(2024, 1 + i % 2, 5)) for i in range(7)] + [(8, None, 1.0, dt.date(2024, 1, 1))],
                                  "zpid int, latitude double, longitude double, sold_date date")
    rows = enrich.circle_requests(homes, dt.date(2024, 1, 20), {"c": ("a=b", "c=d")}, rows_per_request=3).collect()
    assert sorted((r.month.month, r.chunk, r.circles, str(r.snapshot), r["filter"]) for r in rows) == [
        (1, 0, 3, "2024-01-01", "a=b or c=d"), (1, 1, 1, "2024-01-01", "a=b or c=d"), (2, 0, 3, "2024-01-20", "a=b or c=d")]
    assert next(r for r in rows if r.chunk == 1).bcircles == "6:-73.9,40.5,600"


def test_tag_counts(spark):
    df = spark.createDataFrame(pd.DataFrame({"tags": [{"amenity": "bar", "x": "y"}, {"amenity": "bar", "shop": "tea"}]}), "tags map<string,string>")
    assert [tuple(r) for r in enrich.tag_counts(df).collect()] == [("amenity=bar", 2), ("shop=tea", 1)]


def test_geocode_miss_is_null(spark):
    sales = spark.createDataFrame([("12 Main St Apt 2", "Brooklyn"), ("Nowhere", "Brooklyn")], "address string, borough string")
    ref = spark.createDataFrame([("12", "Main St", "Brooklyn", 7, 1.5)], "house_number string, street string, borough string, bbl long, latitude double")
    assert {r.address: r.bbl for r in enrich.geocode(sales, ref).collect()} == {"12 Main St Apt 2": 7, "Nowhere": None}


def test_places_around_the_pole(spark):
    """A circle over the pole holds places on every meridian; long radii are compared place by place."""
    spots = spark.createDataFrame([(1, 89.9, 0.0, dt.date(2020, 1, 1)), (2, 40.0, 179.9, dt.date(2020, 1, 1))],
                                  "zpid long, latitude double, longitude double, snapshot date")
    places = [("a", 89.95, 180.0), ("a", 89.9, 90.0), ("a", 89.85, -3.0), ("a", 89.0, 0.0), ("a", 40.1, -179.9), ("a", 43.0, 175.0)]
    pois = spark.createDataFrame([(c, la, lo, None, None) for c, la, lo in places],
                                 "category string, latitude double, longitude double, valid_from date, valid_to date")
    counts = lambda radius: {r.zpid: r.a for r in enrich.radius_counts(spots, pois, ["a"], radius).collect()}
    assert counts(30_000.0) == {1: 3, 2: 1}
    assert counts(600_000.0) == {1: 4, 2: 2}


@pytest.mark.parametrize("radius", [3.0, 600.0, 40_000.0, 3_000_000.0, 12_000_000.0])
def test_circle_sums_against_brute_force(radius):
    """All latitudes, poles and the date line among them, against the chord of every pair."""
    rng = np.random.default_rng(8)
    for lat0, lon0 in ((0.0, 0.0), (40.0, 180.0), (-89.99, 10.0), (90.0, 0.0), (-60.0, -179.9999)):
        spread = 4 * radius / enrich.METRES_PER_DEGREE
        points = [(np.clip(lat0 + rng.uniform(-spread, spread, n), -90, 90),
                   (lon0 + rng.uniform(-spread, spread, n) / max(math.cos(math.radians(lat0)), 0.01) + 180) % 360 - 180) for n in (30, 2000)]
        category, weight = rng.integers(0, 3, 2000), rng.integers(1, 4, 2000)
        here, there = [np.stack(circles._unit_vectors(*map(np.radians, p)), 1) for p in points]
        near = ((here[:, None] - there[None]) ** 2).sum(2) <= (2 * math.sin(radius / (2 * enrich.EARTH_RADIUS_M))) ** 2
        want = np.stack([(near * weight * (category == c)).sum(1) for c in range(4)], 1)
        assert (circles.counts(*points[0], *points[1], category, weight, radius, 4) == want).all()


def test_radius_counts_pair_circles_and_places_in_tasks_only(spark):
    """No join of circles with cells or places, whose rows were broadcast or grew with the square of the density."""
    homes = spark.createDataFrame([(1, 40.6, -73.9, dt.date(2024, 1, 1))], "zpid long, latitude double, longitude double, snapshot date")
    pois = spark.createDataFrame([("a", 40.6, -73.9, None, None)], "category string, latitude double, longitude double, valid_from date, valid_to date")
    plan = enrich.radius_counts(homes, pois, ["a"])._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and plan.count("Join Inner") == 2  # places and circles, each with the row of their tile


def test_requests_with_text_ids(spark):
    rows = [(k, 40.0, -73.0, dt.date(2020, 1, 5)) for k in ("a1", "b2", "c3")]
    df = spark.createDataFrame(rows, "zpid string, latitude double, longitude double, sold_date date")
    got = enrich.circle_requests(df, dt.date(2024, 1, 1), {"x": ["k=v"]}, rows_per_request=2).orderBy("chunk").collect()
    assert [r.circles for r in got] == [2, 1] and got[0].bcircles.startswith("a1:")


def test_many_versions(spark):
    versions = [(dt.date(1990, 1, 1) + dt.timedelta(days=i), f"v{i}") for i in range(700)]
    row = spark.sql("SELECT DATE '1990-12-31' AS d").select(enrich.version_as_of("d", versions).alias("v")).first()
    assert row.v == "v364"


def test_snapshots_with_the_same_places_are_counted_at_once(monkeypatch):
    import numpy as np

    from dwellstat.operators import circles
    rng = np.random.default_rng(4)
    calls, count = [], circles.counts
    monkeypatch.setattr(circles, "counts", lambda *a: (calls.append(1), count(*a))[1])
    lat, lon, number = 40 + rng.random(300) / 50, -74 + rng.random(300) / 50, rng.integers(1, 31, 300)
    plat, plon, category, weight = 40 + rng.random(500) / 50, -74 + rng.random(500) / 50, rng.integers(0, 2, 500), rng.integers(1, 4, 500)
    for since, until, most in ((np.zeros(500, int), np.full(500, 31), 1), (rng.choice([0, 7, 12], 500), rng.choice([7, 20, 31], 500), 4), (rng.integers(0, 31, 500), rng.integers(0, 32, 500), 30)):
        calls.clear()
        got = circles.counts_at(lat, lon, number, plat, plon, category, weight, since, until, 600.0, 2)
        assert len(calls) <= most and got.sum() > 0
        for i, n in enumerate(number):
            alive = (since < n) & (n <= until)
            assert got[i].tolist() == count(lat[i:i + 1], lon[i:i + 1], plat[alive], plon[alive], category[alive], weight[alive], 600.0, 2)[0].tolist()
