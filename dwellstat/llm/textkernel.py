"""Words and shingles of a batch of texts as arrays of 64-bit hashes.

Works on the UTF-8 bytes of an Arrow string column in blocks of bounded size, so neither a batch of
many texts nor one very long text needs more than a few times ``BLOCK`` bytes beside its hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes looked at in one go.
BLOCK = 1 << 21
_ODD = 0x9E3779B97F4A7C15
_WRAP = (1 << 64) - 1


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    plain = np.ones(256, bool)  # everything but ASCII letters, digits and bytes of other code points
    plain[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
    codes = mix64(np.arange(1, 257, dtype=np.uint64))
    return space, plain, codes, np.arange(256, dtype=np.uint8)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finaliser of splitmix64)."""
    x = x + np.uint64(_ODD)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE, _BREAK, _CODES, _ = _tables()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x5851F42D4C957F2D
_UP: np.ndarray | None = None
_DOWN: np.ndarray | None = None


def _scales(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, grown as needed."""
    global _UP, _DOWN
    if _UP is None or len(_UP) < n:
        _UP, _DOWN = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
    return _UP, _DOWN


def utf8(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after another, and where each begins; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, budget: int = 2 * BLOCK) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about ``budget`` bytes; one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, begin = np.cumsum(lengths), 0
    while begin < len(lengths):
        done = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, done + budget, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def spans(body: np.ndarray, offsets: np.ndarray, alnum: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of whole words: (block start, block bytes, word starts, word ends within the block)."""
    breaks = _BREAK if alnum else _SPACE
    edge = np.zeros(len(body) + 1, bool)
    edge[offsets] = True
    begin = 0
    while begin < len(body):
        end = min(len(body), begin + BLOCK)
        while end < len(body):  # a block ends between words
            ahead = min(len(body), end + 4096)
            stops = np.flatnonzero(breaks[body[end:ahead]] | edge[end:ahead])
            if len(stops):
                end += int(stops[0])
                break
            end = ahead
        part = body[begin:end]
        inside = ~breaks[part]
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1] | edge[begin + 1:end]
        ends[:-1] &= ~inside[1:] | edge[begin + 1:end]
        yield begin, part, np.flatnonzero(starts), np.flatnonzero(ends) + 1
        begin = end


def prefix_sums(part: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any stretch of ``part`` follows; see ``stretch``."""
    up, _ = _scales(len(part) + 1)
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(_CODES[part] * up[:len(part)], out=sums[1:])
    return sums


def stretch(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes between each start and end, the same wherever the bytes stand."""
    _, down = _scales(len(sums))
    return mix64((sums[ends] - sums[starts]) * down[starts])


def words(body: np.ndarray, offsets: np.ndarray, alnum: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in order, and the number of words before each text begins."""
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for begin, part, starts, ends in spans(body, offsets, alnum):
        hashes.append(stretch(prefix_sums(part), starts, ends))
        places.append(starts + begin)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), offsets, "left")


def shingles(hashes: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``n`` words within a text, and the number of them before each text."""
    counts = np.diff(first)
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    rolled = hashes[:len(hashes) - n + 1].copy()
    for i in range(1, n):
        rolled *= np.uint64(_BASE)
        rolled += hashes[i:len(hashes) - n + 1 + i]
    owner = np.repeat(np.arange(len(counts)), counts)
    whole = owner[:len(rolled)] == owner[n - 1:]
    starts = np.zeros(len(first), np.int64)
    np.cumsum(np.maximum(counts - n + 1, 0), out=starts[1:])
    return mix64(rolled[whole]), starts
