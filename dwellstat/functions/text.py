"""String parsing for listing cells, addresses, links and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dwellstat import reference_values as rv


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def match_or_null(text, pattern: str, group: int = 1) -> Column:
    """Regex group, null where nothing matched."""
    return F.nullif(F.regexp_extract(_col(text), pattern, group), F.lit(""))


def listing_id(url) -> Column:
    return match_or_null(url, r"/(\d+)_zpid")


def first_part(text) -> Column:
    """Text before the first comma, trimmed."""
    return F.trim(F.split_part(_col(text), F.lit(","), F.lit(1)))


#: A decimal number as text. A cast alone would also take suffixes such as ``12d``.
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf|infinity)$"


def _number(text: Column) -> Column:
    """The number a text spells out, null for any other text."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(_NUMBER), trimmed.try_cast("double"))


def lenient_double(text, *remove: str) -> Column:
    """Number after removing the given literal pieces; null where it does not parse."""
    out = _col(text).cast("string")
    for piece in remove:
        out = F.replace(out, F.lit(piece), F.lit(""))
    return finite_or_null(_number(out))


def finite_or_null(value) -> Column:
    """NaN counts as missing everywhere, as comparisons with it would otherwise be true."""
    value = _col(value)
    return F.when(F.isnan(value), F.lit(None).cast("double")).otherwise(value)


def digits_double(text) -> Column:
    """Number from digits and points only."""
    return F.regexp_replace(_col(text).cast("string"), "[^0-9.]", "").try_cast("double")


def currency_double(text) -> Column:
    return lenient_double(text, "$", ",")


def lenient_long(text) -> Column:
    """Nullable integer key; ``8.0`` counts as 8, anything unparsable as missing."""
    return _number(_col(text).cast("string")).try_cast("bigint")


def code_string(code) -> Column:
    """Category code as text, without the trailing ``.0`` that a numeric read leaves."""
    return F.regexp_replace(_col(code).cast("string"), r"\.0$", "")


def zip5(raw) -> Column:
    """First run of five digits, null if none."""
    return match_or_null(F.regexp_replace(F.trim(_col(raw).cast("string")), r"\.0$", ""), r"(\d{5})")


def sold_search_url(zip_code, window: str = "12m", price_min: int = 1001) -> Column:
    """Search address with a percent-encoded JSON filter; empty text where the zip is missing."""
    state = F.struct(
        F.struct(
            F.struct(F.lit(price_min).alias("min")).alias("price"),
            *[F.struct(F.lit(flag).alias("value")).alias(name) for name, flag in rv.SEARCH_FLAGS],
            F.struct(F.lit(window).alias("value")).alias("doz"),
        ).alias("filterState")
    )
    url = F.concat(
        F.lit(rv.SEARCH_URL_PREFIX), _col(zip_code), F.lit(rv.SEARCH_URL_MIDDLE), F.url_encode(F.to_json(state))
    )
    return F.coalesce(url, F.lit(""))


def house_number(address) -> Column:
    """Text before the first space; null when there is no space."""
    return F.when(F.instr(_col(address), " ") > 0, F.split_part(_col(address), F.lit(" "), F.lit(1)))


def street_name(address) -> Column:
    """Text after the first space, cut at the first apartment or unit designator."""
    address = _col(address)
    street = address.substr(F.instr(address, " ") + 1, F.length(address))
    cut = F.regexp_replace(
        street,
        rv.UNIT_DESIGNATOR,
        "",
    )
    return F.when(F.instr(address, " ") > 0, F.trim(cut))


def lot_key(borough, block, lot) -> Column:
    """Integer lot key from its three text parts; null when a part is missing or the key is 0."""
    parts = [F.nullif(_col(p), F.lit("")) for p in (borough, block, lot)]
    return F.nullif(F.concat(*parts).try_cast("bigint"), F.lit(0).cast("bigint"))


def distinct_links(cell) -> Column:
    """Comma list without repeats or blanks, first-seen order kept."""
    parts = F.transform(F.split(_col(cell), ","), lambda p: F.trim(p))
    return F.array_join(F.array_distinct(F.filter(parts, lambda p: p != "")), ",")


def link_tokens(cell) -> Column:
    """``http…`` tokens of a cell split at white space, commas and bars."""
    return F.filter(F.split(F.trim(_col(cell)), r"[\s,|]+"), lambda p: p.startswith("http"))


def link_list(cell) -> Column:
    """As ``link_tokens``, also reading JSON arrays of links or of objects holding links."""
    cell = F.trim(_col(cell))
    raw = F.coalesce(F.from_json(cell, "array<string>"), F.array().cast("array<string>"))
    # an object element arrives as its JSON text, a plain link as itself
    from_objects = F.flatten(
        F.transform(
            raw,
            lambda e: F.when(
                e.startswith("{"), F.coalesce(F.map_values(F.from_json(e, "map<string,string>")), F.array().cast("array<string>"))
            ).otherwise(F.array(e)),
        )
    )
    links = F.filter(F.transform(from_objects, lambda p: F.trim(p)), lambda p: p.startswith("http"))
    use_json = cell.startswith("[") & (F.size(from_objects) > 0)
    return F.when(use_json, links).otherwise(link_tokens(cell))


#: The digest in a photo's link, and the size of the variant.
PHOTO_KEY = r"/([a-f0-9]{16,})[-_]"
PHOTO_SIZE = r"(?:cc_ft_|within_\d+_)(\d+)"


def photo_key(url) -> Column:
    """Identity of a photo independent of its size; the last path part when no digest is found."""
    url = _col(url)
    return F.coalesce(match_or_null(url, PHOTO_KEY), F.substring_index(url, "/", -1))


def photo_size(url) -> Column:
    return F.coalesce(match_or_null(url, PHOTO_SIZE).try_cast("bigint"), F.lit(0).cast("bigint"))


def parent_folder(path) -> Column:
    """Name of the folder that holds the file; empty when there is none."""
    return F.regexp_extract(_col(path), r"([^/]+)/[^/]*$", 1)


def is_hero(path) -> Column:
    """1 when the file stem ends in ``_hero``."""
    return _col(path).rlike(r"_hero(\.[^./]*)?$").cast("int")


def suffix(path) -> Column:
    return F.lower(F.regexp_extract(_col(path), r"\.([^./]+)$", 1))


def mime_of(path) -> Column:
    return _lookup(suffix(path), rv.MIME_BY_SUFFIX, "image/jpeg")


def suffix_of_content_type(content_type) -> Column:
    """File suffix for a content type with or without parameters; jpg when unknown."""
    return _lookup(F.trim(F.split_part(_col(content_type), F.lit(";"), F.lit(1))), rv.SUFFIX_BY_MIME, "jpg")


def _lookup(key: Column, table: dict, default) -> Column:
    entries = F.create_map(*[F.lit(v) for pair in table.items() for v in pair])
    return F.coalesce(F.try_element_at(entries, key), F.lit(default))


def natural_number(path) -> Column:
    """First number in the file stem, infinity when there is none (sorts last)."""
    stem = file_stem(path)
    return F.coalesce(match_or_null(stem, r"(\d+)").try_cast("double"), F.lit(float("inf")))


def file_stem(path) -> Column:
    return F.regexp_replace(F.substring_index(_col(path), "/", -1), r"\.[^.]*$", "")


def allowed_or(value, allowed, default) -> Column:
    """The value when it is in the set, the default otherwise (also for null)."""
    value = _col(value)
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default))
