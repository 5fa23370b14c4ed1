"""Removal of byte strings that repeat across documents, by external induced suffix sorting.

Every byte covered by a string of ``LENGTH`` bytes that also starts in a document with a smaller id
is removed. A suffix array over all documents cannot be cut into shards, as equal strings would not
meet; so strings are first brought together by anchors:

1. The anchor of a ``LENGTH``-byte string is the leftmost of its ``GRAM``-byte runs with the least
   hash. It depends on the string alone, and neighbouring strings mostly share it, so a text has
   about one anchor per 16 bytes. Anchors that occur once only cannot belong to a repeated
   string; a bitmap tells the others. Its size follows their number, up to ``LARGEST`` bits
   (false positives only add work).
2. A repeated anchor stands for its context, the bytes around it that its strings can cover. Equal
   contexts are counted before the shuffle with the least and largest document. Contexts meet by
   anchor in shards.
3. Each shard sorts the suffixes of its contexts by induction: the order at one position follows
   from the order one byte further right by a stable distribution on the byte before. Tuples of
   context and common-prefix value pass through a bucket priority queue that spills to disk; the
   new common prefix of two neighbours is one more than the least value met between them, which a
   running minimum per byte carries across blocks. Memory is one byte and a bit per context and
   block, however many contexts the shard holds. Neighbours that share ``LENGTH`` bytes hold equal
   strings, and the least document among them decides.
4. Documents take their removed stretches and are cut.

Contexts are told apart by 96 bits of two hashes. Ids are whole numbers.

Cases: a null text counts as empty; texts below ``LENGTH`` bytes lose nothing; rows with equal ids
never remove each other's bytes; a null id comes after every other; very long texts are read in
blocks; an empty table gives no rows; other columns are ignored or kept.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellstat.llm import common, textkernel
from dwellstat.llm.common import written

LENGTH = 50
GRAM = 20
#: Bits of the bitmap per repeated anchor, and the most bits it may have (128 megabytes).
PER_ANCHOR, LARGEST = 16, 1 << 30
#: Groups of anchor hashes, as a power of two; 32 further bits tell hashes of a group apart.
GROUPS = 16
#: Tuples handled in one go, and tuples a queue holds in memory before it writes to disk.
BLOCK, HELD = 1 << 17, 1 << 22
#: Bytes of text whose anchors are found in one go.
STEP = 1 << 18
#: Contexts among which equal ones are merged before the shuffle.
GATHERED = 300_000
_SPAN = LENGTH - GRAM  # bytes of context before and after an anchor
_WIDTH = 2 * LENGTH - GRAM
_OUTSIDE = 255  # never a byte of UTF-8
_LAST = (1 << 63) - 1

common.by_value(__name__, textkernel.__name__)


def anchors(body: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (text index, anchor place, first and last string start, anchor hash) of the strings of all texts."""
    for begin in range(0, len(body), STEP):
        part = body[begin:begin + STEP + LENGTH - 1]
        starts = len(part) - LENGTH + 1
        if starts <= 0:
            return
        sums = textkernel.prefix_sums(part)
        at = np.arange(len(part) - GRAM + 1)
        value = textkernel.stretch(sums, at, at + GRAM)
        hashes, place, width = value, at.astype(np.int32), 1
        while width < _SPAN + 1:
            step = min(width, _SPAN + 1 - width)
            later = value[step:] < value[:-step]
            place = np.where(later, place[step:], place[:-step])
            value = np.where(later, value[step:], value[:-step])
            width += step
        owner = np.searchsorted(offsets, np.arange(begin, begin + starts), "right") - 1
        whole = np.flatnonzero(np.arange(begin, begin + starts) + LENGTH <= offsets[owner + 1])
        if not len(whole):
            continue
        chosen = place[whole]
        new = np.ones(len(whole), bool)
        new[1:] = chosen[1:] != chosen[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(whole)) - 1
        # least hashes crowd at the lower end, so they are scrambled once more
        yield owner[whole[first]], chosen[first].astype(np.int64) + begin, whole[first] + begin, whole[last] + begin, textkernel.mix64(hashes[chosen[first]])


def _rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    order = F.coalesce(F.col(key).cast("long"), F.lit(_LAST))
    return docs.select(order.alias("doc"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))


def _group(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - GROUPS)).astype(np.int64)


def _rest(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32 - GROUPS)).astype(np.uint32)


def _grouped(hashes: np.ndarray) -> pa.RecordBatch:
    """(part, hashes): sorted 48-bit hashes, a row per group with the lower 32 bits of its own."""
    group = (hashes >> np.uint64(32)).astype(np.int64)
    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    ends = (4 * np.append(heads, len(group))).astype(np.int32)
    rest = pa.py_buffer(hashes.astype(np.uint32).tobytes())
    return pa.RecordBatch.from_arrays(
        [pa.array(group[heads].astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(ends.tobytes()), rest])],
        names=["part", "hashes"])


def repeated_anchors(rows: DataFrame) -> DataFrame:
    """(part, hashes): the anchors that occur twice or more, as 48-bit hashes by group."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def emit() -> pa.RecordBatch:
            found, counts = np.unique(np.concatenate(held), return_counts=True)
            return _grouped(np.repeat(found, np.minimum(counts, 2)))

        for batch in batches:
            for part in textkernel.slices(batch, "text"):
                body, offsets = textkernel.utf8(part.column("text"))
                for owner, _, _, _, hashes in anchors(body, offsets):
                    hashes = hashes >> np.uint64(32 - GROUPS)
                    order = np.lexsort((hashes, owner))
                    owner, hashes = owner[order], hashes[order]
                    new = np.ones(len(owner), bool)
                    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
                    held.append(hashes[new])
                    size += int(new.sum())
                if size > 4_000_000:
                    yield emit()
                    held, size = [], 0
        if held:
            yield emit()

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by group, so only the last group of a batch goes on in the next."""
        rest = np.zeros(0, np.uint64)

        def again(hashes: np.ndarray) -> pa.RecordBatch:
            hashes = np.sort(hashes)
            return _grouped(np.unique(hashes[1:][hashes[1:] == hashes[:-1]]))

        for batch in batches:
            if not batch.num_rows:
                continue
            column, groups = batch.column("hashes"), batch.column("part").to_numpy().astype(np.uint64)
            ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
            own = np.frombuffer(column.buffers()[2], np.uint8)[ends[0]:ends[-1]].copy().view(np.uint32)
            hashes = np.concatenate([rest, (np.repeat(groups, np.diff(ends) // 4) << np.uint64(32)) | own.astype(np.uint64)])
            last = (hashes >> np.uint64(32)) == groups[-1]
            yield again(hashes[~last])
            rest = hashes[last]
        yield again(rest)

    schema = "part int, hashes binary"
    parts = rows.mapInArrow(collect, schema).repartition("part").sortWithinPartitions("part")
    return parts.mapInArrow(twice, schema)


def bitmap(repeated: DataFrame) -> bytes:
    """Bits set by the leading bits of the hashes, as many as their number asks for."""
    n = repeated.agg(F.sum(F.octet_length("hashes") / 4)).first()[0] or 0
    bits = 8 << GROUPS
    while bits < min(PER_ANCHOR * n, LARGEST):
        bits *= 2
    own = bits >> GROUPS  # bits of a group
    shift = np.uint32(32 - (own.bit_length() - 1))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for hashes in batch.column("hashes").to_pylist():
                chunk = np.zeros(own, bool)
                chunk[np.frombuffer(hashes, np.uint32) >> shift] = True
                out.append(np.packbits(chunk, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(out, pa.binary())], names=["part", "bits"])

    out = bytearray(bits >> 3)
    for r in repeated.mapInArrow(pack, "part int, bits binary").toLocalIterator():  # the bitmap's bounded size in all
        begin = r["part"] * (own >> 3)
        out[begin:begin + (own >> 3)] = r["bits"]
    return bytes(out)


def _known(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set."""
    own = (len(bits) << 3) >> GROUPS
    bit = _group(hashes) * own + (_rest(hashes) >> np.uint32(32 - (own.bit_length() - 1)))
    return ((bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)


def _pieces(part: pa.RecordBatch, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (text index, context start in the text, first and last string start, context bytes) of repeated anchors."""
    at = np.arange(_WIDTH)
    body, offsets = textkernel.utf8(part.column("text"))
    padded = np.concatenate([np.full(_SPAN, _OUTSIDE, np.uint8), body, np.full(LENGTH, _OUTSIDE, np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, _WIDTH)
    for owner, place, first, last, hashes in anchors(body, offsets):
        hit = np.flatnonzero(_known(hashes, bits))
        owner, place = owner[hit], place[hit]
        begin = place - _SPAN
        pieces = windows[place]
        # what no string of this anchor covers is blanked, so that contexts differ by their strings only
        low, high = first[hit] - begin, last[hit] - begin
        pieces[(at < low[:, None]) | (at >= high[:, None] + LENGTH)] = _OUTSIDE
        yield owner, begin - offsets[owner], low, high, pieces


def _binary(pieces: np.ndarray) -> pa.Array:
    ends = pa.py_buffer((np.arange(len(pieces) + 1, dtype=np.int32) * _WIDTH).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(pieces), [None, ends, pa.py_buffer(pieces.tobytes())])


def occurrences(rows: DataFrame, known) -> DataFrame:
    """(doc, row, start, low, high, context): a row per repeated anchor; ``start`` is where the context
    begins in the text and ``low`` and ``high`` the first and last string start within the context."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(known.value, np.uint8)
        for batch in batches:
            for part in textkernel.slices(batch, "text"):
                for owner, begin, low, high, pieces in _pieces(part, bits):
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc").take(pa.array(owner)), part.column("row").take(pa.array(owner)), pa.array(begin.astype(np.int32)),
                         pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), _binary(pieces)],
                        names=["doc", "row", "start", "low", "high", "context"])

    return rows.mapInArrow(cut, "doc long, row long, start int, low int, high int, context binary")


def contexts(rows: DataFrame, known) -> DataFrame:
    """(least, largest, low, high, context): the contexts with their least and largest document.

    Equal contexts of ``GATHERED`` neighbouring ones are one row, so a frequent passage shrinks before
    the shuffle; the shards merge what is left.
    """

    def merged(held: list[tuple]) -> pa.RecordBatch:
        docs, low, high, pieces = (np.concatenate(x) for x in zip(*held, strict=True))
        words = pieces.view(np.uint64)
        key = np.zeros(len(pieces), np.uint64)
        for j in range(words.shape[1]):
            key = textkernel.mix64(key ^ words[:, j])
        order = np.argsort(key, kind="stable")
        fresh = np.ones(len(order), bool)
        fresh[1:] = (words[order[1:]] != words[order[:-1]]).any(axis=1)
        head = np.flatnonzero(fresh)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.minimum.reduceat(docs[order], head)), pa.array(np.maximum.reduceat(docs[order], head)),
             pa.array(np.minimum.reduceat(low[order], head).astype(np.int32)), pa.array(np.maximum.reduceat(high[order], head).astype(np.int32)),
             _binary(pieces[order[head]])], names=["least", "largest", "low", "high", "context"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(known.value, np.uint8)
        held, size = [], 0
        for batch in batches:
            for part in textkernel.slices(batch, "text"):
                docs = part.column("doc").to_numpy()
                for owner, _, low, high, pieces in _pieces(part, bits):
                    if len(owner):
                        held.append((docs[owner], low, high, pieces))
                        size += len(owner)
                if size > GATHERED:
                    yield merged(held)
                    held, size = [], 0
        if held:
            yield merged(held)

    return rows.mapInArrow(gather, "least long, largest long, low int, high int, context binary")


class BucketQueue:
    """Priority queue of (context, common prefix) tuples ordered by byte and, within a byte, by arrival.

    Tuples beyond ``HELD`` go to a file that disappears with the task.
    """

    def __init__(self, folder: str) -> None:
        self.folder, self.file, self.held, self.written = folder, None, 0, 0
        self.buckets: list[list] = [[] for _ in range(256)]

    def push(self, byte: int, ids: np.ndarray, prefix: np.ndarray) -> None:
        self.buckets[byte].append((ids, prefix))
        self.held += len(ids)
        if self.held > HELD:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile(dir=self.folder)
        for bucket in self.buckets:
            for i, piece in enumerate(bucket):
                if len(piece) == 2:
                    self.file.write(piece[0].tobytes())
                    self.file.write(piece[1].tobytes())
                    bucket[i] = (self.written, len(piece[0]), None)
                    self.written += 5 * len(piece[0])
        self.held = 0

    def pieces(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for bucket in self.buckets:
            for piece in bucket:
                if len(piece) == 2:
                    yield piece
                else:
                    self.file.seek(piece[0])
                    raw = self.file.read(5 * piece[1])
                    yield np.frombuffer(raw, np.uint32, piece[1]), np.frombuffer(raw, np.uint8, piece[1], 4 * piece[1])

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The tuples in order, ``BLOCK`` or a few more at a time."""
        ids, prefixes, size = [], [], 0
        for i, p in self.pieces():
            ids.append(i)
            prefixes.append(p)
            size += len(i)
            if size >= BLOCK:
                yield np.concatenate(ids), np.concatenate(prefixes)
                ids, prefixes, size = [], [], 0
        if size:
            yield np.concatenate(ids), np.concatenate(prefixes)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _least_between(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least of values[begin..end], both included, for each pair."""
    levels = [values]
    while 2 << (len(levels) - 1) <= len(values):
        half = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    power = (np.frexp((end - begin + 1).astype(np.float64))[1] - 1)
    out = np.empty(len(begin), values.dtype)
    for k in np.unique(power):
        mine = np.flatnonzero(power == k)
        out[mine] = np.minimum(levels[k][begin[mine]], levels[k][end[mine] - (1 << int(k)) + 1])
    return out


def induce(queue: BucketQueue, column: np.ndarray, folder: str) -> BucketQueue:
    """The order one position to the left, from that of ``queue`` and the byte before each suffix."""
    out = BucketQueue(folder)
    since = np.full(256, 255, np.uint8)  # least common prefix met since the last tuple of each byte
    seen = np.zeros(256, bool)
    for ids, prefix in queue.blocks():
        byte = column[ids]
        order = np.argsort(byte, kind="stable")
        sorted_bytes = byte[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = sorted_bytes[1:] != sorted_bytes[:-1]
        before = np.empty(len(order), np.int64)
        before[1:] = order[:-1]
        before[fresh] = -1
        least = _least_between(prefix, before + 1, order)
        heads = np.flatnonzero(fresh)
        present = sorted_bytes[heads]
        least[heads] = np.minimum(least[heads], since[present])
        common_prefix = np.minimum(least, 254) + np.uint8(1)
        common_prefix[heads[~seen[present]]] = 0
        tails = np.append(heads[1:], len(order)) - 1
        since = np.minimum(since, prefix.min())
        behind = np.minimum.accumulate(np.append(prefix, np.uint8(255))[::-1])[::-1]
        since[present] = behind[order[tails] + 1]
        seen[present] = True
        moved = ids[order]
        for b, s, t in zip(present.tolist(), heads.tolist(), (tails + 1).tolist(), strict=True):
            out.push(b, moved[s:t], common_prefix[s:t])
    queue.close()
    return out


def least_documents(columns: np.ndarray, docs: np.ndarray, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """For every string start and context the least document with the same string, as (start, context),
    and the first context among those equal to each."""
    n = len(docs)
    shape = (_SPAN + 1, n)
    out = np.zeros(shape, np.int64) if n < 1 << 21 else np.memmap(tempfile.TemporaryFile(dir=folder), np.int64, "w+", shape=shape)
    same = np.zeros(n, np.uint32)
    queue = BucketQueue(folder)
    for begin in range(0, n, BLOCK):
        end = min(n, begin + BLOCK)
        queue.push(0, np.arange(begin, end, dtype=np.uint32), np.zeros(end - begin, np.uint8))
    for p in range(_WIDTH - 1, -1, -1):
        queue = induce(queue, np.ascontiguousarray(columns[:, p]), folder)
        if p > _SPAN:
            continue
        rest = (np.zeros(0, np.uint32), np.zeros(0, np.uint8))
        blocks = queue.blocks()
        block = next(blocks, None)
        while block is not None:
            following = next(blocks, None)
            ids, prefix = np.concatenate([rest[0], block[0]]), np.concatenate([rest[1], block[1]])
            heads = np.flatnonzero(prefix < LENGTH)
            if not len(heads) or heads[0]:
                heads = np.concatenate([[0], heads])
            if following is not None:  # the last run may go on in the next block
                cut = int(heads[-1])
                rest, ids, prefix, heads = (ids[cut:], prefix[cut:]), ids[:cut], prefix[:cut], heads[:-1]
            if len(ids):
                least = np.minimum.reduceat(docs[ids], heads)
                out[p, ids] = np.repeat(least, np.diff(np.append(heads, len(ids))))
                if p == 0:  # equal contexts share their whole width
                    leads = np.flatnonzero(prefix < _WIDTH)
                    same[ids] = np.repeat(np.minimum.reduceat(ids, leads), np.diff(np.append(leads, len(ids))))
            block = following
    queue.close()
    return out, same


def repeats(found: DataFrame) -> DataFrame:
    """(context_id, check, low, high, least): stretches of string starts of a context that begin in an earlier document.

    ``found`` are the contexts with their least and largest document.
    """

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            path, n, facts = os.path.join(folder, "contexts"), 0, []
            with open(path, "wb") as f:
                for batch in batches:
                    if batch.num_rows:
                        f.write(b"".join(batch.column("context").to_pylist()))
                        facts.append([batch.column(c).to_numpy() for c in ("context_id", "check", "least", "largest", "low", "high")])
                        n += batch.num_rows
            if not n:
                return
            ids, checks, least, largest, low, high = (np.concatenate(c) for c in zip(*facts, strict=True))
            columns = np.memmap(path, np.uint8, "r", shape=(n, _WIDTH))
            first, same = least_documents(columns, least, folder)
            # the facts of equal contexts go to the first of them
            most, begins, ends = largest.copy(), low.copy(), high.copy()
            np.maximum.at(most, same, largest)
            np.minimum.at(begins, same, low)
            np.maximum.at(ends, same, high)
            lead = same == np.arange(n, dtype=np.uint32)
            for begin in range(0, n, BLOCK):
                end = min(n, begin + BLOCK)
                mine = np.asarray(first[:, begin:end]).T
                starts = np.arange(_SPAN + 1)
                use = (starts >= begins[begin:end, None]) & (starts <= ends[begin:end, None]) & (mine < most[begin:end, None]) & lead[begin:end, None]
                change = np.ones(use.shape, bool)
                change[:, 1:] = (mine[:, 1:] != mine[:, :-1]) | ~use[:, :-1]
                row, col = np.nonzero(use & change)
                last = np.ones(use.shape, bool)
                last[:, :-1] = (mine[:, 1:] != mine[:, :-1]) | ~use[:, 1:]
                _, stop = np.nonzero(use & last)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[begin:end][row]), pa.array(checks[begin:end][row]), pa.array(col.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(mine[row, col])],
                    names=["context_id", "check", "low", "high", "least"])
            del columns, first

    dealt = found.repartition(F.substring("context", _SPAN + 1, GRAM))
    keyed = dealt.select(*_identity(), "least", "largest", "low", "high", "context")
    return keyed.mapInArrow(shard, "context_id long, check int, low int, high int, least long")


def _identity() -> list[Column]:
    return [F.xxhash64("context").alias("context_id"), F.hash("context").alias("check")]


def removed_spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc, row, spans): per document the (begin, end) of every covered stretch, not yet merged."""
    rows = _rows(docs, text, key)
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(bitmap(written(repeated_anchors(rows), "suffix-anchors")))
    earlier = written(repeats(contexts(rows, known)), "suffix-repeats")
    spots = occurrences(rows, known).select(*_identity(), "doc", "row", "start", F.col("low").alias("l"), F.col("high").alias("h"))
    hit = spots.join(earlier, ["context_id", "check"]).where("doc > least AND l <= high AND low <= h")
    span = F.struct((F.col("start") + F.greatest("l", "low")).alias("begin"), (F.col("start") + F.least("h", "high") + LENGTH).alias("end"))
    return hit.groupBy("doc", "row").agg(F.collect_list(span).alias("spans"))


def _cut(docs: DataFrame, text: str, key: str, with_text: bool) -> DataFrame:
    spans = written(removed_spans(docs, text, key), "suffix-spans").withColumnRenamed("row", "span_row")
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(text).alias("row"),
                       F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("order"))
    joined = rows.join(spans, (F.col("order") == F.col("doc")) & (F.col("row") == F.col("span_row")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]
        for batch in batches:
            out: list[tuple] = []
            for text_, ranges in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                body = text_.encode()
                kept, at, gone, runs, open_from = [], 0, 0, 0, 0
                for begin, end in sorted((r["begin"], r["end"]) for r in ranges or ()):
                    if begin > at or not runs:
                        kept.append(body[at:begin])
                        runs, open_from = runs + 1, begin
                        gone += end - begin
                        at = end
                    elif end > at:
                        gone += end - at
                        at = end
                kept.append(body[at:])
                rest = b"".join(kept)
                out.append((len(body), gone, runs, hashlib.sha256(rest).hexdigest(), *((rest.decode(errors="ignore"),) if with_text else ())))
            columns = list(zip(*out, strict=True)) if out else [[] for _ in names[1:]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]], names=names)

    kind = dict(docs.dtypes)[key]
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept string" if with_text else "")
    return joined.select("doc_id", "text", "spans").mapInArrow(cut, schema)


def report(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    return _cut(docs, text, key, False)


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """As ``report``, with the remaining text; bytes of characters that were cut in part are left out of it."""
    return _cut(docs, text, key, True)
