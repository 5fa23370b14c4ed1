"""Alignment of two tokenizers over the same texts, with corpus-wide counts of linked token ids.

Both tokenizers cut the bytes of a text. Offsets where both end a token part it into groups, and an
occurrence of either side is linked with those of the other whose bytes it shares. How often a pair
of ids is linked anywhere is counted outside memory:

1. A task encodes its texts and collects (pair, document, links) records. About every ``RUN_LINKS``
   links it sorts them by pair, deals them by a radix of the second side's id, and emits each part as
   a zstd run: one run with documents, one with the counts only.
2. Runs of counts are merged per part by a k-way heap merge over blocks, at most ``FAN_IN`` runs at a
   time and in several rounds when there are more. A task spills the runs it receives to its own
   temporary file, which ends with the task, and holds a block of each. Pairs come out ordered by the
   second side's id, so the highest count of an id is known when its last pair has passed.
3. The runs with documents meet the counted pairs of their part. Both are ordered alike, so a run is
   streamed against the blocks once and yields the contributions to its documents, which are sent
   back to them as two dense zstd columns.

A part holds the pairs of ``1 / PARTS`` of the second vocabulary: its size is bounded by the product
of the vocabularies and does not grow with the corpus. A frequent id or pair only adds a count per
run to the merge; its documents' records are dealt over as many salts as their number asks for. Each
step's rows pass through Spark's shuffle or the shared folder, so lost executors cost recomputing
their own tasks. The two vocabulary files go to the tasks by value (``FILE_BYTES`` at most).

Cases: a text that is null, empty, or not given back byte by byte by either tokenizer has no tokens:
zeros and an empty digest; strings of special tokens are plain text; null or repeated ids and
repeated rows are rows of their own; very long texts spread over several runs; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import os
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellstat.llm import common, textkernel
from dwellstat.llm.common import written

FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
PARTS = 64
RUN_LINKS = 1 << 21
#: Pairs in a block of a run, and runs merged at a time.
BLOCK, FAN_IN = 1 << 16, 64
#: Records of a part that one task matches with the counted pairs.
SALT_RECORDS = 1 << 23
FILE_BYTES = 1 << 26
#: Fixed value: the pattern by which byte-level vocabularies split texts into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
QUICK_CHARS = 50_000

common.by_value(__name__, textkernel.__name__)


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies print for each byte: itself if visible, else one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Aligner:
    """Both tokenizers, with the bytes of every id."""

    def __init__(self, byte_bpe: bytes, piece_bpe: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_str(byte_bpe.decode())
        self.a.encode_special_tokens = True
        self.quick = self._same_ids(json.loads(byte_bpe))
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_bpe)
        letters = _byte_letters()
        added = {t["id"] for t in json.loads(byte_bpe).get("added_tokens", [])}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for entry, i in self.a.get_vocab().items():
            self.bytes_a[i] = entry.encode() if i in added else bytes(letters[c] for c in entry)
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            as_byte = re.fullmatch(r"<0x([0-9A-F]{2})>", piece) if self.b.is_byte(i) else None
            self.bytes_b.append(bytes([int(as_byte[1], 16)]) if as_byte else piece.replace("▁", " ").encode())
        self.sizes_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.sizes_b = np.array([len(x) for x in self.bytes_b], np.int64)
        ids = range(max(len(self.bytes_a), len(self.bytes_b)))
        self.span = len(ids)
        self.printed = [f";{i}" for i in ids] + [f",{i}" for i in ids] + [f"|{i}" for i in ids]

    @staticmethod
    def _same_ids(described: dict):
        """A faster encoder with the same ids, if the vocabulary allows it: plain byte-level BPE merged in the order of ids."""
        vocabulary, letters = described["model"]["vocab"], _byte_letters()
        joined = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in described["model"]["merges"]]
        split = described.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not described.get("normalizer")
        if not plain or joined != sorted(joined) or described["model"].get("ignore_merges"):
            return None
        import tiktoken

        added = {t["content"] for t in described.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in entry): i for entry, i in vocabulary.items() if entry not in added}
        return tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def _side_a(self, texts: list[str]) -> list[list[int]]:
        # very long texts may exceed the quick encoder's stack
        quick = [self.quick is not None and len(t) < QUICK_CHARS for t in texts]
        slow = iter(self.a.encode_batch_fast([t for t, q in zip(texts, quick) if not q], add_special_tokens=False))
        return [self.quick.encode_ordinary(t) if q else next(slow).ids for t, q in zip(texts, quick)]

    def encode(self, texts: list[str | None]) -> tuple[list[int], list[list[int]], list[list[int]]]:
        """(indexes of texts that both sides give back, their ids on side A, on side B)."""
        filled = [i for i, t in enumerate(texts) if t]
        side_a = self._side_a([" " + texts[i] for i in filled])
        side_b = self.b.encode([texts[i] for i in filled], num_threads=1) if filled else []
        good = []
        for n, i in enumerate(filled):
            want = (" " + texts[i]).encode()
            if b"".join(map(self.bytes_a.__getitem__, side_a[n])) == want == b"".join(map(self.bytes_b.__getitem__, side_b[n])):
                good.append(n)
        return [filled[n] for n in good], [side_a[n] for n in good], [side_b[n] for n in good]

    def align(self, side_a: list[list[int]], side_b: list[list[int]]) -> tuple[dict[str, np.ndarray], list[str], np.ndarray, np.ndarray]:
        """(counts per text, digest of its groups, pair of every link, text of every link); texts have equal bytes on both sides.

        As both sides end every text at the same place, the texts are laid end to end and cut at once.
        A pair is the B id times 2**32 plus the A id.
        """
        n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (side_a, side_b))
        ids_a, ids_b = (np.fromiter(itertools.chain.from_iterable(side), np.int64, int(n.sum())) for side, n in ((side_a, n_a), (side_b, n_b)))
        ends_a, ends_b = np.cumsum(self.sizes_a[ids_a]), np.cumsum(self.sizes_b[ids_b])
        ends = np.zeros(int(ends_a[-1]) + 1, np.uint8)  # per byte: 1 where an A token ends, 2 for B, 4 for a text
        ends[ends_a] = 1
        ends[ends_b] |= 2
        ends[ends_a[np.cumsum(n_a) - 1]] |= 4
        cuts = np.flatnonzero(ends)
        at_a, at_b, at_text = (ends[cuts] & bit > 0 for bit in (1, 2, 4))
        at_both = at_a & at_b
        # how many ended before a cut is the number of the token, group or text that it lies in
        token_a, token_b, group, owner = (np.cumsum(x) - x for x in (at_a, at_b, at_both, at_text))
        pairs = ids_b[token_b] << 32 | ids_a[token_a]
        counts = {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(owner[at_both], minlength=len(n_a)), "n_links": np.bincount(owner, minlength=len(n_a))}
        # the groups in print: A ids behind ; and , then B ids behind | and ,
        group_a, group_b = group[at_a], group[at_b]
        before_b = np.concatenate([[0], np.cumsum(np.bincount(group_b))])
        upto_a = np.cumsum(np.bincount(group_a))
        first_a, first_b = np.diff(group_a, prepend=-1) > 0, np.diff(group_b, prepend=-1) > 0
        order = np.empty(len(ids_a) + len(ids_b), np.int64)
        order[np.arange(len(ids_a)) + before_b[group_a]] = ids_a + np.where(first_a, 0, self.span)
        order[np.arange(len(ids_b)) + upto_a[group_b]] = ids_b + np.where(first_b, 2 * self.span, self.span)
        digests, begin = [], 0
        for end in np.cumsum(n_a + n_b).tolist():
            printed = "".join(map(self.printed.__getitem__, order[begin:end].tolist()))
            digests.append(hashlib.sha256(printed[1:].encode()).hexdigest())
            begin = end
        return counts, digests, pairs, owner


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of numbers of one length as a zstd frame; the first one, ascending, as differences."""
    first, *rest = columns
    sizes = np.array([len(first), *[c.dtype.itemsize for c in rest]], np.int64)
    body = b"".join([len(sizes).to_bytes(8, "little"), sizes.tobytes(), np.diff(first, prepend=np.int64(0)).tobytes(), *[c.tobytes() for c in rest]])
    return zstandard.ZstdCompressor(level=3).compress(body)


def _unpack(data: bytes) -> list[np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(data)
    n_sizes = int.from_bytes(body[:8], "little")
    n, *widths = np.frombuffer(body, np.int64, n_sizes, 8).tolist()
    at = 8 + 8 * n_sizes
    out = [np.cumsum(np.frombuffer(body, np.int64, n, at))]
    at += 8 * n
    for width in widths:
        out.append(np.frombuffer(body, np.dtype(f"u{width}"), n, at))
        at += n * width
    return out


def _narrow(values: np.ndarray) -> np.ndarray:
    top = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _counted(pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order with the sums of their counts."""
    order = np.argsort(pairs, kind="stable")
    pairs, n = pairs[order], n[order]
    new = np.flatnonzero(np.diff(pairs, prepend=pairs[:1] - 1)) if len(pairs) else np.zeros(0, np.int64)
    return pairs[new], np.add.reduceat(n, new) if len(new) else n


class _Runs:
    """Links of a task's documents, emitted as sorted runs per part when enough have come together."""

    def __init__(self, first: int) -> None:
        self.pairs, self.rows, self.held, self.run = [], [], 0, first

    def add(self, pairs: np.ndarray, rows: np.ndarray) -> Iterator[tuple]:
        for begin in range(0, len(pairs), RUN_LINKS):
            piece = slice(begin, begin + RUN_LINKS)
            self.pairs.append(pairs[piece])
            self.rows.append(rows[piece])
            self.held += len(pairs[piece])
            if self.held >= RUN_LINKS:
                yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        """(part, run, row of its first document, kind, records or place, bytes)."""
        if not self.held:
            return
        pairs, rows = np.concatenate(self.pairs), np.concatenate(self.rows)
        self.pairs, self.rows, self.held = [], [], 0
        base, run = int(rows.min()), self.run
        self.run += 1
        part = (pairs >> 32) % PARTS
        order = np.lexsort((rows, pairs, part))
        part, pairs, rows = part[order], pairs[order], rows[order] - base
        new = np.ones(len(pairs), bool)
        new[1:] = (np.diff(pairs) != 0) | (np.diff(rows) != 0)
        begin = np.flatnonzero(new)
        n = np.diff(np.append(begin, len(pairs)))
        part, pairs, rows = part[begin], pairs[begin], rows[begin]
        edges = np.searchsorted(part, np.arange(PARTS + 1))
        for p in range(PARTS):
            here = slice(edges[p], edges[p + 1])
            if edges[p] < edges[p + 1]:
                yield p, run, base, "documents", int(edges[p + 1] - edges[p]), _pack(pairs[here], _narrow(rows[here]), _narrow(n[here]))
                distinct, total = _counted(pairs[here], n[here])
                for at in range(0, len(distinct), BLOCK):
                    yield p, run, base, "counts", at // BLOCK, _pack(distinct[at:at + BLOCK], _narrow(total[at:at + BLOCK]))


def _files(folder: str, names: tuple[str, ...]) -> list[bytes]:
    out = []
    for name in names:
        with open(os.path.join(folder, name), "rb") as f:
            out.append(f.read(FILE_BYTES + 1))
        if len(out[-1]) > FILE_BYTES:
            raise ValueError(f"{name} is too large to be sent to every task")
    return out


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def _encoded(docs: DataFrame, text: str, key: str, folder: str) -> DataFrame:
    """Rows of two sorts: one per document (``part`` null) and one per run of a part."""
    vocabularies = docs.sparkSession.sparkContext.broadcast(_files(folder, (BYTE_BPE, PIECE_BPE)))
    kind = dict(docs.dtypes)[key]
    schema = (f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
              "part int, run long, kind string, n long, data binary")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 40
        aligner, runs, id_type = Aligner(*vocabularies.value), _Runs(made), None

        def emit(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            for p, run, base, sort, n, data in found:
                blank = [pa.nulls(1, t) for t in (id_type, *[pa.int64()] * 4, pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array([base], pa.int64()), *blank, pa.array([p], pa.int32()), pa.array([run], pa.int64()), pa.array([sort]),
                                                  pa.array([n], pa.int64()), pa.array([data], pa.binary())], names=names)

        for batch in batches:
            id_type = batch.column("id").type
            for piece in textkernel.slices(batch, "text", 1 << 20):
                rows = made + np.arange(piece.num_rows, dtype=np.int64)
                made += piece.num_rows
                good, side_a, side_b = aligner.encode(piece.column("text").to_pylist())
                numbers = {k: np.zeros(piece.num_rows, np.int64) for k in _NUMBERS}
                digests = [""] * piece.num_rows
                pairs = owner = np.zeros(0, np.int64)
                if good:
                    counts, printed, pairs, owner = aligner.align(side_a, side_b)
                    for k in _NUMBERS:
                        numbers[k][good] = counts[k]
                    for i, digest in zip(good, printed):
                        digests[i] = digest
                    owner = rows[np.array(good)][owner]
                blank = [pa.nulls(piece.num_rows, t) for t in (pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(rows), piece.column("id"), *[pa.array(numbers[k]) for k in _NUMBERS],
                                                  pa.array(digests, pa.string()), *blank], names=names)
                yield from emit(runs.add(pairs, owner))
        yield from emit(runs.flush())

    names = ["row", "id", *_NUMBERS, "groups_sha256", "part", "run", "kind", "n", "data"]
    return docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(encode, schema)


def _by_group(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Consecutive rows of equal keys, from rows that come sorted by them."""
    rows = (row for batch in batches for row in batch.to_pylist())
    return itertools.groupby(rows, key=lambda row: tuple(row[k] for k in keys))


def _merged(runs: list[Iterator[list[np.ndarray]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct pairs of sorted runs, in order and with summed counts, a block of every run at a time.

    The heap holds the last pair of each run's block. Up to the least of them everything is at hand,
    so that much of each block is taken and summed before the next block of that run is read.
    """
    held, heap = {}, []
    for i, run in enumerate(runs):
        block = next(run, None)
        if block is not None:
            held[i] = block
            heapq.heappush(heap, (int(block[0][-1]), i))
    while heap:
        upto, i = heapq.heappop(heap)
        taken = []
        for j, (pairs, n) in held.items():
            cut = int(np.searchsorted(pairs, upto, "right"))
            taken.append((pairs[:cut], n[:cut]))
            held[j] = [pairs[cut:], n[cut:]]
        yield _counted(np.concatenate([t[0] for t in taken]), np.concatenate([t[1].astype(np.int64) for t in taken]))
        block = next(runs[i], None)
        if block is None:
            del held[i]  # nothing of it is left: its last pair was the bound
        else:
            held[i] = block
            heapq.heappush(heap, (int(block[0][-1]), i))


class _Spill:
    """Blocks of runs in a temporary file of the task."""

    def __init__(self, folder: str) -> None:
        self.file, self.places = tempfile.TemporaryFile(dir=folder), {}

    def put(self, run: int, data: bytes) -> None:
        self.places.setdefault(run, []).append((self.file.seek(0, os.SEEK_END), len(data)))
        self.file.write(data)

    def blocks(self, run: int) -> Iterator[list[np.ndarray]]:
        for at, size in self.places[run]:
            self.file.seek(at)
            yield _unpack(self.file.read(size))


def _with_best(merged: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Adds whether a pair has the highest count of its B id; the pairs of the last id wait for the next block."""
    waiting = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def judged(pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = pairs >> 32
        begin = np.flatnonzero(np.diff(ids, prepend=-1))
        top = np.repeat(np.maximum.reduceat(n, begin), np.diff(np.append(begin, len(ids))))
        return pairs, n, (n == top).astype(np.uint8)

    for pairs, n in merged:
        pairs, n = np.concatenate([waiting[0], pairs]), np.concatenate([waiting[1], n])
        cut = int(np.searchsorted(pairs >> 32, pairs[-1] >> 32)) if len(pairs) else 0
        waiting = pairs[cut:], n[cut:]
        if cut:
            yield judged(pairs[:cut], n[:cut])
    if len(waiting[0]):
        yield judged(*waiting)


def _merge_runs(runs: DataFrame, final: bool) -> DataFrame:
    """(part, run, seq, data): the runs (part, heap, run, seq, data) of each (part, heap) as one run."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            for (part, heap), rows in _by_group(batches, ("part", "heap")):
                spill = _Spill(folder)
                for row in rows:
                    spill.put(row["run"], row["data"])
                merged, seq = _merged([spill.blocks(r) for r in spill.places]), 0
                for columns in _with_best(merged) if final else merged:
                    for at in range(0, len(columns[0]), BLOCK):
                        pairs, n, *best = [c[at:at + BLOCK] for c in columns]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([part], pa.int32()), pa.array([heap], pa.int64()), pa.array([seq], pa.int64()),
                             pa.array([_pack(pairs, _narrow(n), *best)], pa.binary())], names=["part", "run", "seq", "data"])
                        seq += 1

    dealt = runs.repartition("part", "heap").sortWithinPartitions("part", "heap", "run", "seq")
    return dealt.mapInArrow(merge, "part int, run long, seq long, data binary")


def _pair_counts(runs: DataFrame) -> DataFrame:
    """(part, seq, data): blocks of (pair, count, best) in order, from runs (part, run, seq, data)."""
    while True:
        widest = runs.groupBy("part").agg(F.countDistinct("run").alias("n")).agg(F.max("n")).first()[0] or 0
        heaps = -(-widest // FAN_IN) if widest > 2 * FAN_IN else 1
        runs = written(_merge_runs(runs.withColumn("heap", F.pmod(F.xxhash64("run"), F.lit(heaps))), heaps == 1), "align-counts")
        if heaps == 1:
            return runs.select("part", "seq", "data")


def _contributions(records: DataFrame, counts: DataFrame) -> DataFrame:
    """(run, row, data): per run and part what its pairs give to each of its documents, numbered from ``row``."""
    sizes = records.groupBy("part").agg(F.sum("n").alias("n")).collect()  # a row per part
    salts = F.element_at(F.create_map(*[F.lit(x) for r in sizes for x in (r.part, -(-r.n // SALT_RECORDS))]), F.col("part"))
    left = counts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).select(
        "part", "salt", F.lit(0).alias("side"), F.col("seq").alias("place"), F.lit(None).cast("long").alias("row"), "data")
    right = records.select("part", F.pmod(F.xxhash64("run"), salts).alias("salt"), F.lit(1).alias("side"), F.col("run").alias("place"), "row", "data")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_group(batches, ("part", "salt")):
            counted: list[bytes] = []
            for row in rows:
                if row["side"] == 0:
                    counted.append(row["data"])  # compressed; bounded by the vocabularies
                    continue
                pairs, docs, n = _unpack(row["data"])
                docs, n = docs.astype(np.int64), n.astype(np.int64)
                best, total = np.zeros(int(docs.max()) + 1, np.int64), np.zeros(int(docs.max()) + 1, np.int64)
                done = 0
                for data in counted:
                    if done == len(pairs):
                        break
                    known, count, top = _unpack(data)
                    upto = int(np.searchsorted(pairs, known[-1], "right"))
                    at = np.searchsorted(known, pairs[done:upto])
                    here = docs[done:upto]
                    np.add.at(best, here, n[done:upto] * top[at])
                    np.add.at(total, here, n[done:upto] * count[at].astype(np.int64))
                    done = upto
                touched = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["place"]], pa.int64()), pa.array([row["row"]], pa.int64()),
                     pa.array([_pack(touched, _narrow(best[touched]), _narrow(total[touched]))], pa.binary())], names=["run", "row", "data"])

    dealt = left.unionByName(right).repartition("part", "salt").sortWithinPartitions("part", "salt", "side", "place")
    return dealt.mapInArrow(match, "run long, row long, data binary")


def _per_document(contributions: DataFrame) -> DataFrame:
    """(row, n_best, count_sum) from the contributions of all parts."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, base), rows in _by_group(batches, ("run", "row")):
            best, total = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for row in rows:
                docs, more_best, more_total = _unpack(row["data"])
                need = int(docs[-1]) + 1 - len(best)
                if need > 0:
                    best, total = (np.concatenate([x, np.zeros(need, np.int64)]) for x in (best, total))
                best[docs] += more_best.astype(np.int64)
                total[docs] += more_total.astype(np.int64)
            touched = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(touched + base), pa.array(best[touched]), pa.array(total[touched])],
                                             names=["row", "n_best", "count_sum"])

    parts = contributions.repartition("run").sortWithinPartitions("run").mapInArrow(add_up, "row long, n_best long, count_sum long")
    # a long document may lie in several runs
    return parts.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def aligned(docs: DataFrame, text: str = "text", key: str = "doc_id", folder: str = FOLDER) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): one row per document."""
    rows = written(_encoded(docs, text, key, folder), "align-runs")
    counts = _pair_counts(rows.where("kind = 'counts'").select("part", "run", F.col("n").alias("seq"), "data"))
    records = rows.where("kind = 'documents'").select("part", "run", "row", "n", "data")
    numbers = rows.where("part is null").select("row", "id", *_NUMBERS, "groups_sha256")
    if counts.isEmpty():
        back = docs.sparkSession.createDataFrame([], "row long, n_best long, count_sum long")
    else:
        back = _per_document(_contributions(records, counts))
    return numbers.join(back, "row", "left").select(
        F.col("id").alias(key), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0).cast("long")).alias("n_best"),
        F.coalesce("count_sum", F.lit(0).cast("long")).alias("count_sum"), "groups_sha256")


def pair_table(docs: DataFrame, text: str = "text", key: str = "doc_id", folder: str = FOLDER) -> DataFrame:
    """(a_id, b_id, count, best): every linked pair of ids with its count in the corpus."""
    rows = written(_encoded(docs, text, key, folder), "align-runs")
    counts = _pair_counts(rows.where("kind = 'counts'").select("part", "run", F.col("n").alias("seq"), "data"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data").to_pylist():
                pairs, n, best = _unpack(data)
                yield pa.RecordBatch.from_arrays([pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), pa.array((pairs >> 32).astype(np.int32)),
                                                  pa.array(n.astype(np.int64)), pa.array(best.astype(bool))], names=["a_id", "b_id", "count", "best"])

    return counts.select("data").mapInArrow(unpack, "a_id int, b_id int, count long, best boolean")
