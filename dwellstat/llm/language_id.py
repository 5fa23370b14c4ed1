"""Language identification by rank-order n-gram profiles.

A profile is the list of the most frequent runs of one to ``LONGEST`` characters, most frequent
first. Texts are lower-cased, every stretch of other characters than letters becomes one blank, and
a blank is put before and after; a run of blanks alone does not count. The profile of a language is
made of all its documents; a document's profile is compared with each by the out-of-place measure:
for every run the distance between its two ranks, or ``PROFILE`` if the language lacks it. The
least distance wins; of equal ones the first language by code point.

Counts of a language are added up inside the tasks before the shuffle, so a frequent language costs
as many rows as a rare one. What is shipped to tasks is ``PROFILE`` numbers for each language value.

Cases: a null text, or one without a letter, is ``und`` with score 0; so is every text when nothing
could be learned. Null languages teach nothing, and neither do null texts. Texts are read whole, in
blocks. Repeated rows are predicted each; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dwellstat.llm import common, textkernel

LONGEST = 3
PROFILE = 400
#: Documents whose id's CRC-32 leaves this remainder by 3 are kept out of learning.
HELD_OUT = 1
#: Characters counted in one go.
BLOCK = 1 << 20
_BITS = 21  # a code point

common.by_value(__name__, textkernel.__name__)


def _letters(column: pa.Array) -> pa.Array:
    """Lower-case texts in which everything but letters is one blank, with a blank at both ends."""
    lowered = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    blanked = pc.replace_substring_regex(lowered, r"[^\p{L}]+", " ")
    blank, nothing = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    return pc.binary_join_element_wise(blank, pc.utf8_trim(blanked, " "), blank, nothing)


def _grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of a text and their counts. ``codes`` are code points, 32 for a blank."""
    found, counts = [], []
    for begin in range(0, len(codes), BLOCK):
        part = codes[begin:begin + BLOCK + LONGEST - 1].astype(np.int64)
        fresh = min(BLOCK, len(codes) - begin)
        run, runs = np.zeros(len(part), np.int64), []
        for n in range(1, LONGEST + 1):
            run = (run[:len(part) - n + 1] << _BITS) | part[n - 1:]
            runs.append(run[:fresh])
        own, seen = np.unique(np.concatenate(runs), return_counts=True)
        found.append(own)
        counts.append(seen)
    if len(found) > 1:
        own, at = np.unique(np.concatenate(found), return_inverse=True)
        found, counts = [own], [np.bincount(at, np.concatenate(counts), len(own)).astype(np.int64)]
    keep = found[0] != 32
    return found[0][keep], counts[0][keep]


def _code_points(column: pa.Array) -> Iterator[np.ndarray]:
    for text in _letters(column).to_pylist():
        yield np.frombuffer(text.encode("utf-32-le"), np.uint32)


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == HELD_OUT, F.lit(False))


def profiles(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, rank): the ``PROFILE`` most frequent runs of every language, from rank 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, dict[int, int]] = defaultdict(lambda: defaultdict(int))
        size = 0

        def emit() -> Iterator[pa.RecordBatch]:
            for name, seen in totals.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(seen), pa.string()), pa.array(list(seen), pa.int64()),
                                                  pa.array(list(seen.values()), pa.int64())], names=["lang", "gram", "n"])
            totals.clear()

        for batch in batches:
            for part in textkernel.slices(batch, "text"):
                for name in pc.unique(part.column("lang")).to_pylist():
                    own = part.column("text").filter(pc.equal(part.column("lang"), name))
                    grams = [_grams(c) for c in _code_points(own) if len(c) > 2]
                    if not grams:
                        continue
                    merged, at = np.unique(np.concatenate([g for g, _ in grams]), return_inverse=True)
                    sums = np.bincount(at, np.concatenate([n for _, n in grams]), len(merged)).astype(np.int64)
                    seen = totals[name]
                    for g, n in zip(merged.tolist(), sums.tolist(), strict=True):
                        seen[g] += n
                    size = sum(map(len, totals.values()))
                if size > 1_000_000:
                    yield from emit()
        yield from emit()

    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.select("lang", "gram", rank.alias("rank")).where(F.col("rank") <= PROFILE).withColumn("rank", F.col("rank") - 1)


def _distances(grams: np.ndarray, ranks: np.ndarray, learned: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Out-of-place distance of a document's profile to every language's."""
    out = np.zeros(len(learned))
    for i, (known, places) in enumerate(learned):
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        out[i] = np.where(known[at] == grams, np.abs(places[at] - ranks), PROFILE).sum()
    return out


def predicted(docs: DataFrame, learned: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score): the nearest language and one less the share of the largest distance."""
    table: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for row in learned.collect():  # PROFILE rows per language value
        table[row["lang"]].append((row["gram"], row["rank"]))
    names = sorted(table, key=lambda s: [ord(c) for c in s])
    known = []
    for name in names:
        pairs = np.array(sorted(table[name]), np.int64)
        known.append((pairs[:, 0], pairs[:, 1]))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textkernel.slices(batch, "text"):
                guesses, scores = [], []
                for codes in _code_points(part.column("text")):
                    if len(codes) <= 2 or not names:
                        guesses.append("und")
                        scores.append(0.0)
                        continue
                    grams, counts = _grams(codes)
                    order = np.lexsort((grams, -counts))[:PROFILE]
                    far = _distances(grams[order], np.arange(len(order)), known)
                    best = int(np.argmin(far))
                    guesses.append(names[best])
                    scores.append(1.0 - far[best] / (PROFILE * len(order)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(guesses, pa.string()), pa.array(scores, pa.float64())],
                                                 names=["doc_id", "lang_pred", "score"])

    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")


def identified(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learned from the documents that are not held out."""
    learned = profiles(docs.where(~held_out(key)), text, lang)
    return predicted(docs, learned, text, key).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
