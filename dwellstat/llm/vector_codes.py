"""Vector compression into one byte per part, with codebooks fitted by active-entry Lloyd rounds.

Vectors become whole numbers, so distances, means and ties are exact and independent of how rows are
dealt to tasks. A vector is cut into equal parts, each part position has its own codebook, and a
vector is stored as the index of the nearest entry of each part.

A round of Lloyd's method assigns every part to its nearest entry and moves the entries to the mean
of their parts. Every row carries, for each part, its entry and the exact distance to it. When the
entry of a part did not move in the last update, all distances to entries that stayed are as they
were, so only the moved entries are compared with the stored distance; a part whose own entry moved
scans the whole codebook. Equal distances go to the lower index in both cases.

Each round is written to the shared folder, so a lost executor costs a re-read of the last round.
Tasks add their parts up per entry before anything is shuffled, and what reaches the driver is the
codebooks: ``parts * entries`` rows whatever the size of the table.

Cases: rows are dropped whose vector is null, empty, or holds a null, a non-finite component or one of
2**15 and more (its squared distances do not fit a long), or whose length differs from that of the
first kept row by key, nulls last, then by value. A length that the parts do not divide is filled up
with zeros at the end. Fewer rows than entries make smaller codebooks; unused entries stay where they
are. Null keys and labels are values of their own; repeated rows stay; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellstat.llm import common
from dwellstat.llm.common import let, written

PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Components are multiplied by this and rounded down.
SCALE = 4096
LIMIT = 1 << 15
#: Rows compared with a codebook in one go.
BLOCK = 8192

common.by_value(__name__)


def whole_numbers(vector: Column, parts: int = PARTS) -> Column:
    """The vector in whole numbers, filled up to a multiple of ``parts``; null where it is not usable."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LIMIT))
    filled = let(F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("int")),
                 lambda v: F.concat(v, F.array_repeat(F.lit(0), F.pmod(-F.size(v), F.lit(parts)).cast("int"))))
    return F.when((F.size(vector) > 0) & ~bad, filled)


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distance of every point (a row) to every entry."""
    gaps = points[:, None, :] - entries[None, :, :]
    return np.einsum("nmw,nmw->nm", gaps, gaps)


def reassigned(points: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entries after an update in which only the ``moved`` entries changed place."""
    code, distance = code.copy(), distance.copy()
    stale = moved[code]
    if stale.any():
        full = distances(points[stale], entries)
        code[stale] = full.argmin(1)
        distance[stale] = full.min(1)
    active, fresh = np.flatnonzero(moved), np.flatnonzero(~stale)
    if len(active) and len(fresh):
        near = distances(points[fresh], entries[active])
        best = near.argmin(1)
        best_distance, best_code = near.min(1), active[best]
        closer = (best_distance < distance[fresh]) | ((best_distance == distance[fresh]) & (best_code < code[fresh]))
        code[fresh[closer]] = best_code[closer]
        distance[fresh[closer]] = best_distance[closer]
    return code, distance


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _lists(values: np.ndarray) -> pa.ListArray:
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(values).reshape(-1)))


def _assigned(rows: DataFrame, codebooks: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """The rows with the entry of each part and its distance, from those of the round before if there was one."""
    parts, _, width = codebooks.shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(begin, BLOCK)
                points = _matrix(batch.column("vector"), parts * width).reshape(-1, parts, width)
                code = np.zeros((len(points), parts), np.int64)
                distance = np.zeros((len(points), parts), np.int64)
                if moved is not None:
                    before = _matrix(batch.column("code"), parts), _matrix(batch.column("distance"), parts)
                for p in range(parts):
                    if moved is None:
                        near = distances(points[:, p], codebooks[p])
                        code[:, p], distance[:, p] = near.argmin(1), near.min(1)
                    else:
                        code[:, p], distance[:, p] = reassigned(points[:, p], codebooks[p], moved[p], before[0][:, p], before[1][:, p])
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("vector"),
                                                  _lists(code.astype(np.int32)), _lists(distance)],
                                                 names=["id", "label", "vector", "code", "distance"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(assign, f"id {kinds['id']}, label {kinds['label']}, vector array<int>, code array<int>, distance array<long>")


def _means(state: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks with every used entry at the rounded-down mean of its parts."""
    parts, entries, width = codebooks.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((parts, entries), np.int64)
        sums = np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            points = _matrix(batch.column("vector"), parts * width).reshape(-1, parts, width)
            code = _matrix(batch.column("code"), parts)
            for p in range(parts):
                counts[p] += np.bincount(code[:, p], minlength=entries)
                np.add.at(sums[p], code[:, p], points[:, p])
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]),
                                          _lists(sums[part, entry])], names=["part", "entry", "n", "sums"])

    partial = state.select("vector", "code").mapInArrow(add_up, "part int, entry int, n long, sums array<long>")
    totals = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
    out = codebooks.copy()
    for row in totals.collect():  # parts * entries rows at most
        out[row.part, row.entry] = np.array(row[3:], np.int64) // row.n
    return out


def fitted(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", parts: int = PARTS,
           entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((id, label, vector, code, distance), codebooks of shape parts x entries x width)."""
    numbers = whole_numbers(F.col(f"`{vector}`"), parts)
    rows = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").alias("label"), F.size(F.col(f"`{vector}`")).alias("size"),
                          numbers.alias("vector")).where("vector is not null")
    order = [F.col("id").asc_nulls_last(), F.col("vector")]
    one = rows.orderBy(*order).limit(1).collect()
    rows = rows.where(F.col("size") == (one[0].size if one else 0)).drop("size")
    first = rows.orderBy(*order).limit(entries).collect()
    width = len(one[0].vector) // parts if one else 1
    codebooks = np.array([r.vector for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    if not first:
        return _assigned(rows, np.zeros((parts, 1, width), np.int64), None), codebooks
    state = written(_assigned(rows, codebooks, None), "codes-assigned")
    for _ in range(rounds):
        after = _means(state, codebooks)
        moved = (after != codebooks).any(axis=2)
        codebooks = after
        if moved.any():
            state = written(_assigned(state, codebooks, moved), "codes-assigned")
    return state, codebooks


def codebook_digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()


def encoded(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", parts: int = PARTS,
            entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256): one row per kept vector.

    ``code`` has two hexadecimal digits per part (``entries`` is 256 at most), ``error`` is the squared
    distance to the decoded vector and ``label_error`` the sum of errors of the same label.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: entries must be between 1 and 256")
    state, codebooks = fitted(vectors, vector, key, label, parts, entries, rounds)
    code = F.lower(F.array_join(F.transform("code", lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")), ""))
    error = F.aggregate("distance", F.lit(0).cast("long"), lambda total, d: total + d)
    rows = state.select("id", "label", code.alias("code"), error.alias("error"))
    # written first, so that Spark can split a frequent label in the join back
    sums = written(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "codes-labels")
    return rows.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(key), "code", "error", "label_error", F.lit(codebook_digest(codebooks)).alias("codebooks_sha256"))
