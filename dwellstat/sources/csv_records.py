"""CSV whose cells may hold line breaks, read in splits.

Whether a line break ends a record depends on every quote before it in the file, so such files are
usually read by one task each. Here each line is first reduced to what it does to the two states a
line can begin in (outside or inside a quoted cell). Those effects are composed over the lines of a
split inside its task, and over the splits of a file in a window of one row per split. Most lines
with a quote leave one state whatever the state before, so only a split's first lines depend on the
splits before it: the others are put together in the task, and the few that are open or undecided
meet in a second, small step.

Rules for quotes: a cell is quoted when a quote is its first character; inside, two quotes stand for
one; any other quote is text. Lines end at ``\\n``, and a ``\\r`` before it is dropped unless it is
inside a cell. Blank lines between records are skipped. A cell that is never closed takes the rest of
the file.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# executors need no installed copy of this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: At a cell's first character, in an unquoted cell, in a quoted one, just behind a quote in it.
_FRESH, _PLAIN, _QUOTED, _BEHIND = range(4)


def _behind_text(state: int, kind: int) -> int:
    """State behind a stretch without quotes: nothing (0), ending in a comma (1), or other text (2)."""
    if kind == 0 or state == _QUOTED:
        return state
    return _FRESH if kind == 1 else _PLAIN


def _behind_quote(state: int) -> int:
    return {_FRESH: _QUOTED, _PLAIN: _PLAIN, _QUOTED: _BEHIND, _BEHIND: _QUOTED}[state]


#: Next pair of states (begun outside times 4 plus begun inside) by pair and kind of stretch, a quote following it.
_STEPS = [4 * _behind_quote(_behind_text(a, kind)) + _behind_quote(_behind_text(b, kind)) for a in range(4) for b in range(4) for kind in range(3)]


def line_effect(value: Column) -> Column:
    """What a line does: 2 if it leaves a quoted cell open when begun outside, plus 1 if when begun inside.

    So 1 keeps either state, 2 changes it, 0 and 3 end outside and inside whatever was before.
    """
    stretches = F.split(value, '"', -1)
    kinds = F.transform(F.slice(stretches, 1, F.size(stretches) - 1), lambda s: F.when(s == "", 0).when(s.endswith(","), 1).otherwise(2))
    steps = F.array(*[F.lit(s) for s in _STEPS])
    pair = F.aggregate(kinds, F.lit(4 * _FRESH + _QUOTED), lambda state, kind: F.get(steps, state * 3 + kind))
    left = 2 * (F.floor(pair / 4) == _QUOTED).cast("int") + (pair % 4 == _QUOTED).cast("int")
    return F.when(value.contains('"'), left).otherwise(1)


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    meta = F.col("_metadata")
    # the separator is given, or the reader would also end lines at a bare carriage return
    return spark.read.option("lineSep", "\n").text(path).select(
        meta.getField("file_path").alias("file"), meta.getField("file_block_start").alias("at"), "value")


def _after(effect: np.ndarray, inside: int) -> np.ndarray:
    """State behind each line, for the state before the first one."""
    place = np.arange(1, len(effect) + 1)
    fixed = (effect == 0) | (effect == 3)
    turns = np.cumsum(effect == 2)
    last = np.maximum.accumulate(np.where(fixed, place, 0))
    known = last > 0
    start = np.where(known, effect[last - 1] // 3, inside)
    return (start + turns - np.where(known, turns[last - 1], 0)) % 2


def _by_split(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """The rows of each split in a batch, in order."""
    if not batch.num_rows:
        return
    at, file = batch.column("at").to_numpy(), batch.column("file")
    other = np.ones(batch.num_rows, bool)
    other[1:] = at[1:] != at[:-1]
    if batch.num_rows > 1:
        other[1:] |= pc.not_equal(file.slice(1), file.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
    edges = np.append(np.flatnonzero(other), batch.num_rows)
    for begin, end in zip(edges[:-1], edges[1:]):
        yield file[int(begin)].as_py(), int(at[begin]), batch.slice(int(begin), int(end - begin))


def _split_effects(lines: DataFrame) -> DataFrame:
    """(file, at, effect): the effect of each split's lines together."""

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for file, at, part in _by_split(batch):
                effect = part.column("effect").to_numpy()
                if held and held[:2] != [file, at]:
                    yield row(held)
                    held = None
                outside, inside = (held[2] // 2, held[2] % 2) if held else (0, 1)
                held = [file, at, 2 * int(_after(effect, outside)[-1]) + int(_after(effect, inside)[-1])]
        if held:
            yield row(held)

    def row(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([found[0]]), pa.array([found[1]], pa.int64()), pa.array([found[2]], pa.int32())],
                                          names=["file", "at", "effect"])

    return lines.select("file", "at", line_effect(F.col("value")).alias("effect")).mapInArrow(compose, "file string, at long, effect int")


def _split_starts(effects: DataFrame) -> DataFrame:
    """(file, at, inside): whether a split begins inside a quoted cell, from the effects of those before it."""
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    effects = effects.withColumn("turns", F.sum((F.col("effect") == 2).cast("int")).over(Window.partitionBy("file").orderBy("at")))
    fixed = F.when(F.col("effect").isin(0, 3), F.struct(F.floor(F.col("effect") / 3).cast("int").alias("state"), "turns"))
    last = F.last(fixed, ignorenulls=True).over(before)
    turned = F.coalesce(F.last("turns").over(before), F.lit(0))
    state = F.when(last.isNull(), turned % 2).otherwise((last["state"] + turned - last["turns"]) % 2)
    return effects.select("file", "at", (state == 1).alias("inside"))


_PIECES = "file string, at long, place long, text string, known boolean, before0 int, before1 int, after0 int, after1 int, head boolean"


def _pieces(lines: DataFrame) -> DataFrame:
    """Whole records where a split decides them, and its other lines with both states before and behind them.

    ``place`` numbers the pieces of a split. A split decides from the first line on behind which both
    states are outside.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, place, states, held, headed = None, 0, (0, 1), [], False

        def out(texts: pa.Array, known: bool, before0, before1, after0, after1) -> pa.RecordBatch:
            nonlocal place, headed
            n = len(texts)
            head = np.zeros(n, bool)
            if not headed and split[1] == 0:
                full = next((i for i, t in enumerate(texts) if t.as_py().strip()), None)
                if full is not None:
                    head[full] = headed = True
            columns = [pa.array([split[0]] * n, pa.string()), pa.array(np.full(n, split[1])), pa.array(np.arange(place, place + n)),
                       texts.cast(pa.string()), pa.array(np.full(n, known))]
            columns += [pa.array(np.broadcast_to(np.asarray(x, np.int32), n)) for x in (before0, before1, after0, after1)] + [pa.array(head)]
            place += n
            return pa.RecordBatch.from_arrays(columns, names=["file", "at", "place", "text", "known", "before0", "before1", "after0", "after1", "head"])

        def rest() -> Iterator[pa.RecordBatch]:
            """A record that is still open where the split ends."""
            nonlocal held
            if held:
                yield out(pa.array(["\n".join(held)]), False, 0, 0, 1, 1)
                held = []

        for batch in batches:
            for file, at, part in _by_split(batch):
                if split != (file, at):
                    yield from rest()
                    split, place, states, headed = (file, at), 0, (0, 0) if at == 0 else (0, 1), False
                effect, value = part.column("effect").to_numpy(), part.column("value")
                after0, after1 = _after(effect, states[0]), _after(effect, states[1])
                before0, before1 = (np.append(s, a[:-1]) for s, a in zip(states, (after0, after1)))
                agreed = not held and states == (0, 0)
                decided = 0 if held or agreed else next(iter(np.flatnonzero((after0 == 0) & (after1 == 0)) + 1), len(effect))
                states = (int(after0[-1]), int(after1[-1]))
                if decided:
                    yield out(value.slice(0, decided), False, before0[:decided], before1[:decided], after0[:decided], after1[:decided])
                value, ends = value.slice(decided), np.flatnonzero(after0[decided:] == 0) + 1
                if not len(value):
                    continue
                if not len(ends):
                    held += value.to_pylist()
                    continue
                begins = np.append(0, ends[:-1])
                if held:
                    yield out(pa.array(["\n".join([*held, *value.slice(0, int(ends[0])).to_pylist()])]), True, 0, 0, 0, 0)
                    held, begins, ends = [], begins[1:], ends[1:]
                if len(ends):
                    first, last = int(begins[0]), int(ends[-1])
                    if last - first == len(ends):
                        whole = value.slice(first, last - first)
                    else:
                        offsets = pa.array(np.append(begins, last) - first, pa.int32())
                        whole = pc.binary_join(pa.ListArray.from_arrays(offsets, value.slice(first, last - first)), "\n")
                    yield out(whole, True, 0, 0, 0, 0)
                    begins = ends
                done = int(ends[-1]) if len(ends) else int(begins[-1]) if len(begins) else 0
                held = value.slice(done).to_pylist()
        yield from rest()

    return lines.select("file", "at", "value", line_effect(F.col("value")).alias("effect")).mapInArrow(cut, _PIECES)


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, at, place, text, head): every record, ordered by (at, place) in its file; ``head`` marks the first."""
    lines = _lines(spark, path)
    starts = _split_starts(_split_effects(lines)).where("inside").withColumnsRenamed({"file": "file_s", "at": "at_s"})
    pieces = _pieces(lines)
    whole = pieces.where("known").select("file", "at", "place", "text", "head")
    undecided = pieces.where("not known")
    # one row per split that begins inside a cell; Spark ships it or sorts by its size
    decided = undecided.join(starts, (F.col("file") == F.col("file_s")) & (F.col("at") == F.col("at_s")), "left").withColumns({
        "before": F.when(F.col("inside"), F.col("before1")).otherwise(F.col("before0")),
        "after": F.when(F.col("inside"), F.col("after1")).otherwise(F.col("after0"))})
    single = decided.where("before = 0 and after = 0").select("file", "at", "place", "text", "head")
    order = Window.partitionBy("file").orderBy("at", "place")
    parts = decided.where("before = 1 or after = 1").withColumn("record", F.sum((F.col("before") == 0).cast("long")).over(order))
    joined = parts.groupBy("file", "record").agg(
        F.min(F.struct("at", "place")).alias("first"), F.sort_array(F.collect_list(F.struct("at", "place", "text"))).alias("parts"),
        F.bool_or("head").alias("head"))
    stitched = joined.select("file", "first.at", "first.place", F.array_join(F.col("parts.text"), "\n").alias("text"), "head")
    found = whole.unionByName(single).unionByName(stitched)
    return found.withColumn("text", F.regexp_replace("text", "\r$", "")).where(F.trim("text") != "")


def headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, header): the first record of every file.

    A task stops at its file's header when it reads a split of one file only, so a large file is not
    scanned; splits other than the first hand over nothing.
    """
    lines = _lines(spark, path).where("at = 0")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held, done = None, [], False
        for batch in batches:
            for file, _, part in _by_split(batch):
                if split != file:
                    split, held, done = file, [], False
                if done:
                    continue
                after = _after(part.column("effect").to_numpy(), 1 if held else 0)
                value = part.column("value").to_pylist()
                for n, (text, inside) in enumerate(zip(value, after.tolist())):
                    if not held and not text.strip():
                        continue  # blank lines before the header
                    held.append(text)
                    if not inside:
                        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array(["\n".join(held)])], names=["file", "header"])
                        done = True
                        break

    return lines.select("file", "at", "value", line_effect(F.col("value")).alias("effect")).mapInArrow(first, "file string, header string")
