"""Search for benchmark items inside training documents.

Texts are lower-cased and cut into words of letters and digits; a text's shingles are its runs of
five words. An item leaks into a document when at least 0.8 of its distinct shingles occur there.

Candidates come from size-partitioned MinHash. Documents fall into classes by their number of
shingles, each class up to twice the size of the one before. A class has four bins per shingle of
its largest document, chosen by the leading bits of the hash, and a text's signature keeps the
smallest hash of every bin. As bins are that many, a shared shingle is the smallest on both sides
with a probability near 0.9 however long the document is, and an item with ten shared shingles is
overlooked less than once in a billion times. Items that leak with fewer than ``SAFE`` shared shingles
would be overlooked more often, up to one in nine with a single one; all their shingles count as
smallest on both sides, so none of them is overlooked. Items too long for a class are never compared
with it.

Bins nest from class to class, so one number per hash tells in which classes it is a minimum. Two
fixed-size bitmaps (``BITMAP_BITS``), of all item hashes and of those of short items, are shipped to
the tasks; only hashes that the first admits leave them. Candidates, and no other pairs, are then
verified exactly: the distinct shingles of the item found in the document are counted against all of
the item's.

Cases: a null or short text has no shingles and neither leaks nor is leaked into, which includes
items below five words; repeated rows of a document give one result per item, the largest; items
that share an id are compared each by its own text, and the id gets the largest result; null ids are
kept as ids; empty tables give no rows; other columns are ignored or, in ``cleaned``, kept.
``cleaned`` decides by id and text, so rows that share an id, null or not, with a leaking one stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellstat.llm import common, textkernel
from dwellstat.llm.common import joined_on, packed, unpacked, written

SHINGLE = 5
CONTAINMENT = 0.8
#: Bits of the shipped bitmap: one megabyte whatever the size of the benchmark.
BITMAP_BITS = 1 << 23
#: Bins per shingle of a class's largest document, as a power of two.
BIN_BITS = 2
#: Items that leak with fewer shared shingles than this are searched by all their shingles.
SAFE = 10

common.by_value(__name__, textkernel.__name__)


def _leading_zeros(x: np.ndarray) -> np.ndarray:
    """Leading zero bits of 64-bit numbers."""
    n = np.zeros(len(x), np.int64)
    x = x.copy()
    for step in (32, 16, 8, 4, 2, 1):
        small = x < np.uint64(1 << (64 - step))
        n += np.where(small, step, 0)
        x = np.where(small, x << np.uint64(step), x)
    return n + (x == 0)


def minimum_from(hashes: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """For sorted distinct hashes of texts (``fresh`` marks the first of each): the least size class
    in whose bins each is the minimum."""
    before = np.concatenate([np.zeros(1, np.uint64), hashes[:-1]]) if len(hashes) else hashes
    return np.where(fresh, 0, np.maximum(_leading_zeros(hashes ^ before) + 1 - BIN_BITS, 0))


def size_class(n: np.ndarray) -> np.ndarray:
    """The class of a text with ``n`` shingles: the least c with 2**c >= n."""
    return 64 - _leading_zeros(np.maximum(n, 1).astype(np.uint64) - np.uint64(1))


def _distinct(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text sorted distinct hashes: (text index, hash, whether it is the text's first)."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = owner[1:] != owner[:-1]
    new = fresh.copy()
    new[1:] |= hashes[1:] != hashes[:-1]
    return owner[new], hashes[new], fresh[new]


def _shingled(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    body, offsets = textkernel.utf8(column, lower=True)
    return textkernel.shingles(*textkernel.words(body, offsets, alnum=True), SHINGLE)


def _digest(text: str) -> Column:
    return F.unhex(F.md5(F.col(text)))


def _short(n_shingles, containment: float):
    """Whether fewer than ``SAFE`` shared shingles make an item leak; for numbers and columns."""
    return containment * n_shingles <= SAFE - 1


def item_index(items: DataFrame, text: str = "text", key: str = "item_id", containment: float = CONTAINMENT) -> DataFrame:
    """(item_id, item_key, n_shingles, hash, from_class): every distinct shingle of every item.

    ``item_key`` stands for the id and the text together.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textkernel.slices(batch, "text"):
                owner, hashes, fresh = _distinct(*_shingled(part.column("text")))
                total = np.bincount(owner, minlength=part.num_rows)
                least = np.where(_short(total[owner], containment), 0, minimum_from(hashes, fresh))
                rows = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [part.column("item_id").take(rows), part.column("item_key").take(rows), pa.array(total[owner]),
                     pa.array(hashes.view(np.int64)), pa.array(least.astype(np.int32))],
                    names=["item_id", "item_key", "n_shingles", "hash", "from_class"])

    kind = dict(items.dtypes)[key]
    named = F.concat(F.col(key).isNull().cast("string"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("|"), F.md5(F.col(text)))
    rows = items.select(F.col(key).alias("item_id"), F.unhex(F.md5(named)).alias("item_key"), F.col(text).alias("text"))
    return rows.mapInArrow(index, f"item_id {kind}, item_key binary, n_shingles long, hash long, from_class int").distinct()


def _bitmap(index: DataFrame) -> bytes:
    """The item hashes as ``BITMAP_BITS`` bits; the number of rows gathered is fixed by that size."""
    bit = F.pmod("hash", F.lit(BITMAP_BITS)) + 1  # positions count from one
    parts = index.groupBy(F.bitmap_bucket_number(bit).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    out = bytearray(BITMAP_BITS // 8)
    for row in parts.collect():
        begin = (row["part"] - 1) * 4096
        out[begin:begin + 4096] = row["bits"]
    return bytes(out)


def probes(docs: DataFrame, bitmap: bytes, short: bytes, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, digest, size_class, minima, found): per document the admitted hashes, all and those to
    search by, which are its signature and whatever ``short`` admits."""

    def admits(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        bit = (hashes & np.uint64(BITMAP_BITS - 1)).astype(np.int64)
        return (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, short_bits = np.frombuffer(bitmap, np.uint8), np.frombuffer(short, np.uint8)
        for batch in batches:
            for part in textkernel.slices(batch, "text"):
                hashes, first = _shingled(part.column("text"))
                owner = np.repeat(np.arange(part.num_rows), np.diff(first))
                hit = np.unique(owner[admits(bits, hashes)])
                ids, classes, minima, found = [], [], [], []
                for i in hit.tolist():
                    own = np.unique(hashes[first[i]:first[i + 1]])
                    fresh = np.zeros(len(own), bool)
                    fresh[:1] = True
                    level = int(size_class(np.array([len(own)]))[0])
                    admitted = admits(bits, own)
                    smallest = admitted & ((minimum_from(own, fresh) <= level) | admits(short_bits, own))
                    ids.append(i)
                    classes.append(level)
                    found.append(own[admitted].view(np.int64))
                    minima.append(own[smallest].view(np.int64))
                digests = [hashlib.md5(part.column("text")[i].as_py().encode()).digest() for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(ids, pa.int64())), pa.array(digests, pa.binary()), pa.array(classes, pa.int32()),
                     pa.array(minima, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.int64()))],
                    names=["doc_id", "digest", "size_class", "minima", "found"])

    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(probe, f"doc_id {kind}, digest binary, size_class int, minima array<long>, found array<long>")


def _verified(docs: DataFrame, items: DataFrame, text: str, key: str, containment: float) -> DataFrame:
    """(doc_id, digest, item_id, n_shingles, n_found): a row for each leak of an item's row into a document's row."""
    index = written(item_index(items, containment=containment), "bench-index")
    bitmaps = _bitmap(index), _bitmap(index.where(_short(F.col("n_shingles"), containment)))
    probed = written(probes(docs, *bitmaps, text, key).withColumn("row", F.monotonically_increasing_id()), "bench-probes")
    signs = probed.select("row", "size_class", F.explode("minima").alias("hash"))
    fits = (F.col("size_class") >= F.col("from_class")) & (F.pow(F.lit(2.0), "size_class") >= containment * F.col("n_shingles"))
    candidates = signs.join(index, "hash").where(fits).select("row", "item_key").distinct()
    # written, so that a frequent item's rows are joined as they come and can be split
    whole = written(index.groupBy("item_key").agg(
        F.first("item_id").alias("item_id"), F.max("n_shingles").alias("n_shingles"), F.collect_set("hash").alias("shingles")), "bench-items")
    pairs = candidates.join(whole, "item_key").join(probed.select("row", "doc_id", "digest", "found"), "row")
    counts = pairs.select("doc_id", "digest", "item_id", "n_shingles", F.size(F.array_intersect("found", "shingles")).cast("long").alias("n_found"))
    return counts.where(F.col("n_found") >= containment * F.col("n_shingles"))


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) of every leaked item."""
    return _verified(docs, items, text, key, containment).groupBy("doc_id", "item_id").agg(
        F.max("n_shingles").alias("n_shingles"), F.max("n_found").alias("n_found"),
        F.max(F.col("n_found") / F.col("n_shingles")).alias("containment"))


def cleaned(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents into which no item leaks, with all their columns."""
    leaked = _verified(docs, items, text, key, CONTAINMENT).select("doc_id", "digest").distinct()
    rows = packed(docs, doc_id=F.col(f"`{key}`"), digest=_digest(text))
    return joined_on(rows, leaked, ("doc_id", "digest"), "left_anti").select(*unpacked(docs.columns))
