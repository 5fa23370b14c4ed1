"""Near-duplicate documents by DartMinHash signatures and a banded join.

A document is the weighted set of its runs of five words, each weighing as often as it occurs; two
documents are linked when their weighted Jaccard similarity is at least 0.8, and classes are the
connected groups of links and equal texts.

1. Darts are thrown into the region of each element, weight times rank, by hashes of the element
   alone. Rank cells double in length up to one and have an expected dart per unit after that, so a
   document of total weight W looks at ranks up to ``DARTS / W`` only and sees about ``DARTS`` darts
   however long it is. The earliest dart of each of ``BANDS * ROWS`` coordinates is the signature.
2. Equal texts are one node. Nodes that agree on all rows of a band share a bucket. Each bucket is
   compared with one centre, the member that shares most buckets with others, so a group of
   thousands of copies costs one comparison each.
3. Links are verified on the texts themselves. Members of buckets that are still in different
   components are compared through a join on their rarest shingles: with shingles ordered from rare
   to frequent, similar documents share one early in both, and their places bound what they can
   still share. That misses nothing and forms no pairs merely for sharing a frequent passage.

At similarity 0.8 a pair shares no bucket with a probability of 5e-5.

Cases: a text below five words links to equal texts only; null texts are never copies of each other
unless the row repeats; of repeated rows one stays; null ids are kept as ids; very long texts are
hashed in blocks; empty tables give no rows; other columns are ignored or kept whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dwellstat.llm import common, textkernel
from dwellstat.llm.common import packed, unpacked, written
from dwellstat.llm.graph import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
#: Expected darts per document: a coordinate stays empty with a probability below 1e-5.
DARTS = 1480
#: Lengths of the first rank cells; unit cells follow.
_CELLS = ((0.0, 0.0625), (0.0625, 0.0625), (0.125, 0.125), (0.25, 0.25), (0.5, 0.5))

common.by_value(__name__, textkernel.__name__)


def _uniform(bits: np.ndarray) -> np.ndarray:
    return (bits >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def _thrown(seeds: np.ndarray, length: float) -> tuple[np.ndarray, np.ndarray]:
    """Darts of equal cells: (index of the cell, hash of the dart), a Poisson number for each cell."""
    u = _uniform(textkernel.mix64(seeds))
    hit = np.flatnonzero(u >= np.exp(-length))
    u, mass, count = u[hit], np.exp(-length), np.zeros(len(hit), np.int64)
    upto, k = mass, 0
    while k < 40:
        more = u >= upto
        if not more.any():
            break
        count += more
        k += 1
        mass *= length / k
        upto += mass
    cell = np.repeat(hit, count)
    number = np.arange(len(cell)) - np.repeat(np.cumsum(count) - count, count)
    return cell, textkernel.mix64(seeds[cell] ^ textkernel.mix64(number.astype(np.uint64) + np.uint64(77)))


def dart_minhash(owner: np.ndarray, elements: np.ndarray, weights: np.ndarray, n_sets: int, coordinates: int = BANDS * ROWS,
                 darts: int = DARTS) -> np.ndarray:
    """Signatures of weighted sets, one row per set: the earliest dart of each coordinate.

    ``owner`` is the set of each (distinct) element and ``weights`` any positive numbers. A value
    holds the dart's rank in its upper 40 bits and part of its hash below, so equal values are the
    same dart. Coordinates without a dart keep the largest value.
    """
    best = np.full(n_sets * coordinates, np.iinfo(np.uint64).max, np.uint64)
    total = np.bincount(owner, weights, n_sets)
    limit = darts / np.maximum(total, 1e-12)
    strips = np.ceil(weights).astype(np.int64)
    element = np.repeat(np.arange(len(elements)), strips)
    level = np.arange(len(element)) - np.repeat(np.cumsum(strips) - strips, strips)
    seed = textkernel.mix64(elements[element] ^ textkernel.mix64(level.astype(np.uint64)))
    reach, height = limit[owner[element]], (weights[element] - level)

    def keep(strip: np.ndarray, start: np.ndarray | float, length: float, dart: np.ndarray) -> None:
        rank = start + length * _uniform(dart)
        inside = rank < reach[strip]
        short = height[strip] < 1.0
        if short.any():  # the top strip of a fractional weight is only partly in the region
            inside &= ~short | (_uniform(textkernel.mix64(dart ^ np.uint64(0xABCDEF))) < height[strip])
        strip, rank, dart = strip[inside], rank[inside], dart[inside]
        scrambled = textkernel.mix64(dart)
        slot = owner[element[strip]] * coordinates + ((scrambled >> np.uint64(40)) % np.uint64(coordinates)).astype(np.int64)
        value = (rank * 2.0 ** 26).astype(np.uint64) << np.uint64(24) | (scrambled & np.uint64(0xFFFFFF))
        np.minimum.at(best, slot, value)

    for number, (start, length) in enumerate(_CELLS):
        strip = np.flatnonzero(reach > start)
        cell, dart = _thrown(seed[strip] + np.uint64(number + 1), length)
        keep(strip[cell], start, length, dart)
    units = np.maximum(np.ceil(reach) - 1, 0).astype(np.int64)
    strip = np.repeat(np.arange(len(seed)), units)
    unit = np.arange(len(strip)) - np.repeat(np.cumsum(units) - units, units) + 1
    cell, dart = _thrown(seed[strip] + unit.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D), 1.0)
    keep(strip[cell], unit[cell].astype(np.float64), 1.0, dart)
    return best.reshape(n_sets, coordinates)


def _counted(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text with their counts: (text index, hash, count)."""
    body, offsets = textkernel.utf8(column)
    hashes, first = textkernel.shingles(*textkernel.words(body, offsets), SHINGLE)
    owner = np.repeat(np.arange(len(column)), np.diff(first))
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    begin = np.flatnonzero(new)
    return owner[begin], hashes[begin], np.diff(np.append(begin, len(owner)))


def _elements(column: pa.Array) -> list[np.ndarray]:
    """Per text its shingle occurrences as sorted distinct numbers: the k-th copy of a shingle is its own element."""
    owner, hashes, counts = _counted(column)
    copies = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    keys = textkernel.mix64(np.repeat(hashes, counts) ^ textkernel.mix64(copies.astype(np.uint64)))
    cuts = np.searchsorted(np.repeat(owner, counts), np.arange(len(column) + 1))
    return [np.sort(keys[cuts[i]:cuts[i + 1]]) for i in range(len(column))]


def text_key(text: Column, key: Column) -> Column:
    """Digest of a text; rows without a text are told apart by their id."""
    return F.coalesce(F.md5(text), F.concat(F.lit("-"), key.cast("string")), F.lit("-"))


def signed(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, text_id, weight, bands): per document its total weight and a hash per band."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textkernel.slices(batch, "text"):
                owner, hashes, counts = _counted(part.column("text"))
                best = dart_minhash(owner, hashes, counts.astype(np.float64), part.num_rows)
                bands = np.zeros((part.num_rows, BANDS), np.uint64)
                for r in range(ROWS):
                    bands = textkernel.mix64(bands ^ best[:, r * BANDS:(r + 1) * BANDS])
                bands = textkernel.mix64(bands + np.arange(BANDS, dtype=np.uint64))
                total = np.bincount(owner, counts, part.num_rows).astype(np.int64)
                sizes = np.where(total > 0, BANDS, 0)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                flat = bands[total > 0].reshape(-1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_id"), pa.array(total),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "text_id", "weight", "bands"])

    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("doc_id"), text_key(F.col(text), F.col(key)).alias("text_id"), F.col(text).alias("text"))
    return rows.mapInArrow(sign, f"doc_id {kind}, text_id string, weight long, bands array<long>")


def _similar(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose texts reach the similarity."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            sides = [batch.column("text_a"), batch.column("text_b")]
            good = []
            for i in range(batch.num_rows):
                if b[i] != last:
                    last, own = b[i], _elements(sides[1].slice(i, 1))[0]
                other = _elements(sides[0].slice(i, 1))[0]
                shared = len(np.intersect1d(own, other, assume_unique=True))
                good.append(shared > 0 and shared >= similarity * (len(own) + len(other) - shared))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()).filter(pa.array(good, pa.bool_())),
                                              pa.array(b, pa.int64()).filter(pa.array(good, pa.bool_()))], names=["a", "b"])

    with_a = pairs.join(texts.select(F.col("row").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("row").alias("b"), F.col("text").alias("text_b")), "b")
    return with_b.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long")


def _fitting(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose total weights allow the similarity."""
    sized = (pairs.join(nodes.select(F.col("row").alias("a"), F.col("weight").alias("wa")), "a")
             .join(nodes.select(F.col("row").alias("b"), F.col("weight").alias("wb")), "b"))
    return sized.where(F.least("wa", "wb") >= similarity * F.greatest("wa", "wb")).select("a", "b")


def _rare_pairs(members: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs of different components that share one of their rarest shingle occurrences.

    With elements ordered from rare to frequent, two sets of the given similarity share an element
    among the first ``n - ceil(similarity * n) + 1`` of each. What a product is too large by rounding
    is taken off before, as it would shorten the prefix by one.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textkernel.slices(batch, "text"):
                sets = _elements(part.column("text"))
                rows = np.repeat(part.column("row").to_numpy(), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.concatenate(sets).view(np.int64))], names=["row", "e"])

    elements = written(texts.join(members.select("row").distinct(), "row").select("row", "text").mapInArrow(explode, "row long, e long"),
                       "near-elements")
    common_ones = elements.groupBy("e").agg(F.count("*").alias("df")).where("df > 1")
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.coalesce("df", F.lit(1)), "e"))
    ranked = elements.join(common_ones, "e", "left").select("row", "e", "df", place.alias("place"), F.count("*").over(Window.partitionBy("row")).alias("n"))
    prefix = ranked.where(F.col("place") <= F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1).where("df > 1").select("row", "e", "place", "n")
    prefix = written(prefix.join(members.select("row", "component").distinct(), "row"), "near-prefix")
    # the smaller set of a pair needs a shorter prefix; both places bound what the sets can still share
    share = 2 * similarity / (1 + similarity)
    small = prefix.where(F.col("place") <= F.col("n") - F.ceil(share * F.col("n") - 1e-9) + 1)
    other = prefix.select("e", F.col("row").alias("b"), F.col("component").alias("cb"), F.col("place").alias("pb"), F.col("n").alias("nb"))
    ordered = (F.col("n") < F.col("nb")) | ((F.col("n") == F.col("nb")) & (F.col("row") < F.col("b")))
    enough = 1 + F.least(F.col("n") - F.col("place"), F.col("nb") - F.col("pb")) >= share / 2 * (F.col("n") + F.col("nb")) - 1e-9
    other = other.withColumnRenamed("e", "eb")
    joined = small.join(other, (F.col("e") == F.col("eb")) & (F.col("component") != F.col("cb")) & ordered & enough)
    return joined.select(F.col("row").alias("a"), "b").distinct()


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_id, class_id, class_size, stays): one row per document.

    ``class_id`` is the least doc_id of the class, and the first row with it (the least text digest
    among equal ids) stays.
    """
    rows = written(signed(docs, text, key).withColumn("row", F.monotonically_increasing_id()), "near-signed")
    # aggregates that join back are written first, so that Spark can split a frequent text or class
    firsts = written(rows.groupBy("text_id").agg(F.min("row").alias("row")), "near-firsts")
    nodes = written(firsts.select("row").join(rows, "row"), "near-nodes")
    cells = nodes.select("row", F.explode("bands").alias("bucket"))
    full = cells.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = written(cells.join(full, "bucket"), "near-members")
    degrees = members.groupBy("row").agg(F.sum("n").alias("degree"))
    centres = members.join(degrees, "row").groupBy("bucket").agg(F.max_by("row", F.struct("degree", -F.col("row"))).alias("centre"))
    stars = members.join(written(centres, "near-centres"), "bucket").where("row <> centre").select(F.col("row").alias("a"), F.col("centre").alias("b")).distinct()
    stars = written(_fitting(stars, nodes, similarity), "near-stars")

    wanted = members.select("row").distinct().join(nodes.select("row", "doc_id", "text_id"), "row")
    wanted = wanted.select("row", _row_key("doc_id", "text_id").alias("row_key"))
    bodies = docs.select(F.col(key).alias("doc_id"), text_key(F.col(text), F.col(key)).alias("text_id"), F.col(text).alias("text"))
    bodies = bodies.select(_row_key("doc_id", "text_id").alias("row_key"), "text")
    texts = written(bodies.join(wanted, "row_key").dropDuplicates(["row_key"]).select("row", "text"), "near-texts")

    links = written(_similar(stars, texts, similarity), "near-links")
    groups = components(links, "near-components")
    placed = members.join(groups.select(F.col("node").alias("row"), "component"), "row", "left").withColumn(
        "component", F.coalesce("component", "row"))
    placed = written(placed, "near-placed")
    mixed = (placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
             .where("low <> high").select("bucket"))
    mixed = written(mixed, "near-mixed")
    open_cells = written(placed.join(mixed, "bucket").where("n > 2"), "near-open")
    pairs = _rare_pairs(open_cells, texts, similarity)
    tried = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    fresh = _fitting(pairs.join(tried, ["a", "b"], "left_anti"), nodes, similarity)
    more = written(_similar(written(fresh, "near-pairs"), texts, similarity), "near-more")
    if not more.isEmpty():
        groups = components(links.union(more), "near-components")
    by_text = rows.join(firsts.select("text_id", F.col("row").alias("first")), "text_id").select("doc_id", "text_id", "row", "first")
    joined = by_text.join(groups.select(F.col("node").alias("first"), "component"), "first", "left").withColumn(
        "component", F.coalesce("component", "first"))
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_id", "row")).alias("least")
    joined = written(joined, "near-joined")
    named = written(joined.groupBy("component").agg(least, F.count("*").alias("class_size")), "near-classes")
    return joined.join(named, "component").select(
        "doc_id", "text_id", F.col("least.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("least.row")).alias("stays"))


def _row_key(key: str, text_id: str) -> Column:
    return F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("")), text_id)


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, with all its columns; of rows with its id and text, the one with the least hash.

    Rows without a text stay unless all of their columns repeat.
    """
    whole = docs.where(F.col(f"`{text}`").isNotNull())
    staying = classes(whole, text, key, similarity).where("stays").select(_row_key("doc_id", "text_id").alias("row_key"))
    text_id = text_key(F.col(f"`{text}`"), F.col(f"`{key}`"))
    rows = packed(whole, doc_id=F.col(f"`{key}`"), text_id=text_id).withColumn("row_key", _row_key("doc_id", "text_id"))
    kept = rows.join(staying, "row_key", "left_semi")
    one = Window.partitionBy("row_key").orderBy(F.xxhash64("row"))
    found = kept.withColumn("n", F.row_number().over(one)).where("n = 1").select(*unpacked(docs.columns))
    return found.union(docs.where(F.col(f"`{text}`").isNull()).dropDuplicates())
