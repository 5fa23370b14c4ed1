"""Enrichment: address lookup, as-of lot records, places within a radius."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellstat import reference_values as rv
from dwellstat.functions import dates, text
from dwellstat.operators import circles, joins, ordering
from dwellstat.session import staged

EARTH_RADIUS_M = circles.EARTH_RADIUS_M
METRES_PER_DEGREE = EARTH_RADIUS_M * math.pi / 180.0
#: Places and circles of a tile that meet in one task.
TILE_PLACES, TILE_CIRCLES = 250_000, 50_000


# --- address lookup -------------------------------------------------------------------------


def geocode(sales: DataFrame, addresses: DataFrame, address: str = "address", borough: str = "borough") -> DataFrame:
    """Adds lot key and position by (house number, street, borough); misses stay null.

    ``addresses`` is unique per house_number, street, borough and carries bbl, latitude, longitude.
    """
    keyed = sales.withColumns(
        {"house_number": text.house_number(address), "street": text.street_name(address)}
    )
    if borough != "borough":
        keyed = keyed.withColumn("borough", F.col(borough))
    return joins.lookup(keyed, addresses, ["house_number", "street", "borough"])


# --- as-of lot versions ----------------------------------------------------------------------


def version_as_of(date, versions: Sequence[tuple[dt.date, str]] = rv.LOT_VERSIONS) -> Column:
    """Newest version whose boundary is on or before the date.

    Earlier dates take the earliest version, a missing date none. The boundary list is plan-time
    configuration: a balanced CASE inside code generation and no join at all. Its depth grows with
    the logarithm of the list, so lists of any length work.
    """
    if not versions:
        raise ValueError("no versions given")
    date = date if isinstance(date, Column) else F.col(date)
    ordered = sorted(versions)

    def choose(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(ordered[lo][1])
        mid = (lo + hi + 1) // 2
        return F.when(date < F.lit(ordered[mid][0]), choose(lo, mid - 1)).otherwise(choose(mid, hi))

    return F.when(date.isNotNull(), choose(0, len(ordered) - 1))


def predates_versions(date, versions: Sequence[tuple[dt.date, str]] = rv.LOT_VERSIONS) -> Column:
    date = date if isinstance(date, Column) else F.col(date)
    return F.coalesce(date < F.lit(min(versions)[0]), F.lit(False))


def missing_versions(sales: DataFrame, version: str, available: DataFrame) -> DataFrame:
    """Versions the sales need and the lot table lacks."""
    needed = sales.select(version).filter(F.col(version).isNotNull()).distinct()
    return needed.join(available.select(version).distinct(), version, "left_anti")


def require_versions(sales: DataFrame, version: str, available: DataFrame) -> None:
    """Raises before anything is written when a needed version is not on hand."""
    gaps = sorted(r[0] for r in missing_versions(sales, version, available).toLocalIterator())
    if gaps:
        raise ValueError(f"lot versions missing: {', '.join(gaps)}")


def attach_lots(sales: DataFrame, lots: DataFrame, lot: str = "bbl", version: str = "version") -> DataFrame:
    """Left join of the lot record as it stood in the sale's version.

    ``lots`` may repeat a key: the first record by the remaining columns counts. Write it
    partitioned by version so that only the needed versions are read.
    """
    rest = [F.col(c) for c in lots.columns if c not in (lot, version)]
    known = lots.filter(F.col(lot).isNotNull())
    return joins.lookup(sales, ordering.keep_first(known, [lot, version], rest), [lot, version])


def clean_lot_fields(df: DataFrame, present: str = "bldgclass") -> DataFrame:
    """Designations as 1/0 flags (null where no lot matched) and codes as clean text."""
    matched = F.col(present).isNotNull()
    changes = {}
    for name in rv.LOT_FLAG_FIELDS:
        if name in df.columns:
            value = F.col(name)
            if name == "histdist":
                value = F.when(F.lower(F.trim(value)) == "individual landmark", F.lit(None)).otherwise(value)
            changes[name] = F.when(matched, value.isNotNull().cast("double"))
    for name in rv.LOT_CODE_FIELDS:
        if name in df.columns:
            changes[name] = text.code_string(name)
    return df.withColumns(changes)


# --- places ----------------------------------------------------------------------------------


def poi_categories(tags, categories: dict[str, Sequence[str]] = rv.POI_CATEGORIES) -> Column:
    """Distinct categories of a tag map: a place counts once per category however many tags match."""
    tags = tags if isinstance(tags, Column) else F.col(tags)
    by_tag: dict[str, list[str]] = {}
    for category, wanted in categories.items():
        for tag in wanted:
            by_tag.setdefault(tag, []).append(category)
    table = F.create_map(*[v for tag, names in by_tag.items() for v in (F.lit(tag), F.array(*map(F.lit, names)))])
    present = F.transform(F.map_entries(tags), lambda e: F.try_element_at(table, F.concat_ws("=", e["key"], e["value"])))
    return F.array_distinct(F.flatten(F.array_compact(present)))


def tag_counts(pois: DataFrame, tags: str = "tags", keys: Sequence[str] = rv.POI_KEYS) -> DataFrame:
    """Count of every ``key=value`` over a fixed set of keys, most common first."""
    wanted = F.map_filter(F.col(tags), lambda k, _: k.isin(*keys))
    pairs = pois.select(F.explode(F.map_entries(wanted)).alias("e"))
    counts = pairs.groupBy(F.concat_ws("=", "e.key", "e.value").alias("category")).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), "category")


class _Tiles:
    """Latitude/longitude tiles four radii high, so that a circle touches few of them."""

    def __init__(self, radius_m: float):
        if radius_m <= 0:
            raise ValueError("the radius must be positive")
        self.degrees = radius_m / METRES_PER_DEGREE * (1 + 1e-6) + 1e-7
        self.high = 4 * self.degrees
        self.columns = max(1, int(360.0 // self.high))
        self.wide = 360.0 / self.columns

    def row(self, lat: Column) -> Column:
        return F.floor(lat / self.high)

    def column(self, lon: Column) -> Column:
        return F.floor((lon + 180.0) / self.wide)

    def wrapped(self, column: Column) -> Column:
        return F.pmod(column, F.lit(self.columns))

    def reached(self, spots: DataFrame) -> DataFrame:
        """Each spot with every tile its circle can touch.

        The circle's widest stretch in longitude is where a meridian touches it. A circle that
        holds a pole takes whole rows of tiles.
        """
        over_pole = F.abs("lat") + self.degrees >= 90.0
        touch = F.degrees(F.asin(F.least(F.sin(F.lit(math.radians(min(self.degrees, 90.0)))) / F.cos(F.radians("lat")), F.lit(1.0)))) * (1 + 1e-6) + 1e-7
        first, last = self.column(F.col("lon") - touch), self.column(F.col("lon") + touch)
        round_all = over_pole | (last - first + 1 >= self.columns)
        first = F.when(round_all, F.lit(0)).otherwise(first).cast("bigint")
        last = F.when(round_all, F.lit(self.columns - 1)).otherwise(last).cast("bigint")
        rows = F.sequence(self.row(F.col("lat") - self.degrees), self.row(F.col("lat") + self.degrees))
        tiles = spots.withColumns({"_y": F.explode(rows), "_first": first, "_last": last}).withColumn("_x", F.explode(F.sequence("_first", "_last")))
        return tiles.withColumn("_x", self.wrapped(F.col("_x"))).drop("_first", "_last")


def radius_counts(
    properties: DataFrame,
    pois: DataFrame,
    categories: Sequence[str],
    radius_m: float = rv.POI_RADIUS_M,
    key: str = "zpid",
    snapshot: str = "snapshot",
    rows_per_salt: int = TILE_PLACES,
) -> DataFrame:
    """Places within the radius that exist at the snapshot, one count column per category.

    ``properties``: key, latitude, longitude, snapshot. ``pois``: category, latitude, longitude,
    valid_from, valid_to (either end may be null = open). Properties without a position are left
    out; without a snapshot their counts are null; otherwise a category without places counts 0.

    Equal positions are counted once. Circles and places meet by tile, and within a tile by sorted
    strips (``circles.counts``). The places of a crowded tile are dealt to salts and its circles to
    parts, so no task holds more than ``rows_per_salt`` of the one and ``TILE_CIRCLES`` of the other.
    """
    tiles = _Tiles(radius_m)
    placed = properties.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
        key, F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.col(snapshot).alias("snap")
    )
    spots = staged(placed.filter(F.col("snap").isNotNull()).select("lat", "lon", "snap").distinct(), "circle-spots")
    around = tiles.reached(spots)
    places = staged(_places(pois, categories, spots, tiles), "circle-places")
    # one row per tile with places and circles
    deal = staged(
        places.groupBy("_y", "_x").agg(F.ceil(F.count(F.lit(1)) / F.lit(rows_per_salt)).alias("_salts"))
        .join(around.groupBy("_y", "_x").agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE_CIRCLES)).alias("_parts")), ["_y", "_x"]), "circle-tiles"
    )
    counted = _tile_counts(around, places, deal, spots, radius_m, len(categories))
    sums = [F.sum(F.get("n", i)).alias(c) for i, c in enumerate(categories)]
    joined = joins.lookup(placed, counted.groupBy("lat", "lon", "snap").agg(*sums), ["lat", "lon", "snap"])
    return joined.select(
        key, *[F.when(F.col("snap").isNotNull(), F.coalesce(F.col(c), F.lit(0))).cast("bigint").alias(c) for c in categories]
    )


def _snapshots(spots: DataFrame) -> Column:
    return spots.select("snap").distinct().agg(F.array_sort(F.collect_list("snap"))).scalar()


def _places(pois: DataFrame, categories: Sequence[str], spots: DataFrame, tiles: _Tiles) -> DataFrame:
    """(_y, _x, category, lat, lon, since, until, weight): places alive at a snapshot, by the numbers of the snapshots.

    A place begins with the first snapshot on or after its beginning and is gone at the first on or
    after its end, so places at one position are as many rows as there are pairs of snapshots at most.
    """

    def before(day: str) -> Column:
        return F.size(F.filter("_snapshots", lambda s: s < F.col(day)))

    known = (
        pois.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & F.col("category").isin(*categories))
        .withColumn("_snapshots", _snapshots(spots))
        .select(
            (F.array_position(F.array(*map(F.lit, categories)), F.col("category")) - 1).cast("int").alias("category"),
            F.col("latitude").alias("lat"),
            F.col("longitude").alias("lon"),
            F.when(F.col("valid_from").isNull(), F.lit(0)).otherwise(before("valid_from")).alias("since"),
            F.when(F.col("valid_to").isNull(), F.size("_snapshots")).otherwise(before("valid_to")).alias("until"),
        )
        .filter("since < until")
    )
    weighed = known.groupBy("category", "lat", "lon", "since", "until").agg(F.count(F.lit(1)).alias("weight"))
    return weighed.withColumns({"_y": tiles.row(F.col("lat")), "_x": tiles.wrapped(tiles.column(F.col("lon")))})


def _tile_counts(around: DataFrame, places: DataFrame, deal: DataFrame, spots: DataFrame, radius_m: float, n_categories: int) -> DataFrame:
    """(lat, lon, snap, n): counts by category of a spot and some of the places, to be added up."""
    group = ["_y", "_x", "_salt", "_part"]

    def numbers(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))

    left = (
        around.join(deal, ["_y", "_x"])
        .withColumn("_part", F.pmod(F.xxhash64("lat", "lon", "snap"), F.col("_parts")))
        .withColumn("_salt", numbers("_salts"))
        .withColumn("_snapshots", _snapshots(spots))
        .select(*group, "lat", "lon", "snap", F.array_position("_snapshots", F.col("snap")).alias("number"))
    )
    right = (
        places.join(deal, ["_y", "_x"])
        .withColumn("_salt", F.pmod(F.xxhash64("category", "lat", "lon", "since", "until"), F.col("_salts")))
        .withColumn("_part", numbers("_parts"))
        .select(*group, "category", "lat", "lon", "since", "until", "weight")
    )

    def sums(spots: pa.Table, places: pa.Table) -> pa.Table:
        spots = spots.sort_by([("number", "ascending"), ("lat", "ascending"), ("lon", "ascending")])
        lat, lon, number = (spots.column(c).to_numpy() for c in ("lat", "lon", "number"))
        plat, plon, category, weight, since, until = (places.column(c).to_numpy() for c in ("lat", "lon", "category", "weight", "since", "until"))
        found = circles.counts_at(lat, lon, number, plat, plon, category, weight, since, until, radius_m, n_categories)
        ends = np.arange(len(lat) + 1, dtype=np.int32) * n_categories
        return spots.select(["lat", "lon", "snap"]).append_column("n", pa.ListArray.from_arrays(pa.array(ends), pa.array(found.reshape(-1))))

    schema = f"lat {dict(left.dtypes)['lat']}, lon {dict(left.dtypes)['lon']}, snap {dict(left.dtypes)['snap']}, n array<bigint>"
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(sums, schema)


def circle_requests(
    properties: DataFrame,
    latest: dt.date,
    categories: dict[str, Sequence[str]] = rv.POI_CATEGORIES,
    radius_m: float = rv.POI_RADIUS_M,
    rows_per_request: int = rv.POI_REQUEST_ROWS,
    key: str = "zpid",
    sold_date: str = "sold_date",
) -> DataFrame:
    """Count requests for a remote place service: circles in groups of one month and a fixed size.

    Rows without a position or date are left out. A group holds at most ``rows_per_request`` rows.
    """
    placed = properties.filter(
        F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & F.col(sold_date).isNotNull()
    ).withColumn("_month", F.trunc(sold_date, "month"))
    bucket = ordering.text_bucket if dict(placed.dtypes)[key] == "string" else ordering.value_bucket
    numbered = ordering.row_numbers(bucket(placed, key), [key], ["_month"], "_rn")
    chunk = F.floor((F.col("_rn") - 1) / rows_per_request)
    circle = F.concat(F.col(key).cast("string"), F.lit(":"), F.col("longitude").cast("string"), F.lit(","),
                      F.col("latitude").cast("string"), F.lit(f",{radius_m:g}"))
    requests = (
        numbered.groupBy("_month", chunk.alias("chunk"))
        .agg(F.array_sort(F.collect_list(F.struct("_rn", circle.alias("c")))).alias("_c"), F.count(F.lit(1)).alias("circles"))
        .select(
            dates.snapshot_date("_month", latest).alias("snapshot"),
            F.col("_month").alias("month"),
            "chunk",
            "circles",
            F.array_join(F.transform("_c", lambda r: r["c"]), "|").alias("bcircles"),
        )
    )
    filters = F.create_map(*[v for name, tags in categories.items() for v in (F.lit(name), F.lit(" or ".join(tags)))])
    return requests.select("*", F.explode(filters).alias("category", "filter"))
