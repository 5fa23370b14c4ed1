"""Photo tasks, variants, routing and per-listing photo features."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwellstat import reference_values as rv
from dwellstat.functions import text

# executors need no installed copy of this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_KEY, _SIZE = text.PHOTO_KEY, text.PHOTO_SIZE


def image_tasks(listings: DataFrame, links: str = "all_images", hero: str = "main_image-src", key: str = "zpid",
                folder: str = "images") -> DataFrame:
    """One row per photo link: the main photo is ``_hero``, the others are numbered in list order.

    The numbering happens inside each listing's own array, so nothing is shuffled.
    """
    tokens = text.link_tokens(links)
    placed = F.transform(tokens, lambda url, i: F.struct(url.alias("url"), i.alias("list_position")))
    main = F.trim(F.col(f"`{hero}`"))
    id_text = F.trim(F.col(key).cast("string"))
    others = F.transform(
        F.filter(placed, lambda p: p["url"] != main),
        lambda p, i: F.struct(p["url"].alias("url"), p["list_position"].alias("list_position"),
                              (i + 1).cast("string").alias("tail")),
    )
    heroes = F.transform(
        F.filter(placed, lambda p: p["url"] == main),
        lambda p: F.struct(p["url"].alias("url"), p["list_position"].alias("list_position"), F.lit("hero").alias("tail")),
    )
    tasks = listings.select(key, id_text.alias("_id"), F.inline(F.concat(heroes, others)))
    stem = F.concat_ws("/", F.lit(folder), "_id", F.concat_ws("_", "_id", "tail"))
    return tasks.select(key, "url", "list_position", (F.col("tail") == "hero").alias("is_hero"), stem.alias("stem"))


def largest_variants(listings: DataFrame, links: Column, key: str) -> DataFrame:
    """One row per photo of a listing, its largest variant, indexed by first appearance.

    Of equally large variants the first counts. Works inside each listing's own array, a batch of
    listings at a time, so nothing is shuffled.
    """
    held = listings.select(F.col(key).alias("_key"), links.alias("_links"))
    schema = T.StructType([held.schema["_key"]]).add("img_index", "long").add("photo_hash", "string").add("url", "string")
    return held.mapInArrow(_variants, schema).withColumnRenamed("_key", key)


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("_links")
        urls, owner = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        if not len(urls):
            continue
        keys = _keys(urls)
        codes = pc.dictionary_encode(keys, null_encoding="encode")
        photo = owner.astype(np.int64) * len(codes.dictionary) + codes.indices.to_numpy(zero_copy_only=False)
        # by photo, then largest and first variant; the sort is stable
        by_size = np.lexsort((-_sizes(urls), photo))
        starts = np.flatnonzero(np.diff(photo[by_size], prepend=-1))
        first, best = np.minimum.reduceat(by_size, starts), by_size[starts]
        by_place = np.argsort(first)
        first, best = first[by_place], best[by_place]
        mine = owner[first]
        index = np.arange(len(mine)) - np.searchsorted(mine, mine)
        out = pa.RecordBatch.from_arrays(
            [batch.column("_key").take(pa.array(mine)), pa.array(index, pa.int64()), keys.take(pa.array(first)), urls.take(pa.array(best))],
            names=["_key", "img_index", "photo_hash", "url"],
        )
        yield out.filter(pc.is_valid(out.column("photo_hash")))


def _group(urls: pa.Array, pattern: str) -> pa.Array:
    """What the one group of a pattern matched first, null where nothing did. Arrow wants groups named."""
    return pc.struct_field(pc.extract_regex(urls, re.sub(r"\((?!\?)", "(?P<g>", pattern)), "g")


def _keys(urls: pa.Array) -> pa.Array:
    """As ``text.photo_key``."""
    found = _group(urls, _KEY)
    missed = pc.is_null(found)
    return pc.replace_with_mask(found, missed, pc.replace_substring_regex(urls.filter(missed), "(?s)^.*/", ""))


def _sizes(urls: pa.Array) -> np.ndarray:
    """As ``text.photo_size``: 0 without a size or for one beyond a bigint."""
    digits = pc.utf8_ltrim(pc.fill_null(_group(urls, _SIZE), "0"), "0")
    digits = pc.if_else(pc.equal(digits, ""), "0", digits)
    if pc.max(pc.binary_length(digits)).as_py() > 18:  # one may not fit
        return np.array([int(d) if len(d) < 20 and int(d) < 1 << 63 else 0 for d in digits.to_pylist()], np.int64)
    return digits.cast(pa.int64()).to_numpy()


def route(photos: DataFrame, label: str, judged: str | None = None, rooms: Sequence[str] = rv.SCORED_ROOMS) -> DataFrame:
    """Adds ``scored_room``: the label when it is a scored room, the judge's room when the judge
    disagrees, null when neither is scored (such photos are not sent on)."""
    own = F.when(F.col(label).isin(*rooms), F.col(label))
    if judged is None:
        return photos.withColumn("scored_room", own)
    other = F.when(F.col(judged).isin(*rooms), F.col(judged))
    return photos.withColumn("scored_room", F.when(F.col(judged).isNull(), own).otherwise(other))


def out_of_taxonomy(photos: DataFrame, label: str, labels: Sequence[str] = rv.PHOTO_LABELS) -> DataFrame:
    return photos.filter(~F.coalesce(F.col(label).isin(*labels), F.lit(False)))


def photo_features(scores: DataFrame, key: str, room: str, score: str, rooms: Sequence[str] = rv.SCORED_ROOMS) -> DataFrame:
    """Per listing and room the max, mean and count of scores, one row per listing.

    Conditional aggregates keep it at one shuffle with map-side combine.
    """
    def of(name: str) -> Column:
        return F.when(F.col(room) == name, F.col(score))

    columns = []
    for name in rooms:
        columns += [F.max(of(name)).alias(f"{name}_score"), F.avg(of(name)).alias(f"{name}_mean"), F.count(of(name)).alias(f"{name}_count")]
    return scores.groupBy(key).agg(*columns)
