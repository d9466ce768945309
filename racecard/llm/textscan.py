"""Words, lines and hashes of a batch of texts, found with numpy on the UTF-8 bytes.

A batch is one byte array and the offsets of its texts in it. Nothing here loops over
words or characters; memory is a small multiple of the batch, and a batch is cut into
chunks of a few MB (one text at least) before it is scanned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
SPAN_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _splitmix(n: int, seed: int) -> np.ndarray:
    """``n`` well mixed 64-bit values, the same in every process."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * BASE + np.uint64(seed))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values over all positions."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


BYTE_VALUES = _splitmix(256, 11)
FOLDED_VALUES = BYTE_VALUES.copy()
FOLDED_VALUES[65:91] = BYTE_VALUES[97:123]

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
IS_UPPER = np.zeros(256, bool)
IS_UPPER[65:91] = True
IS_DIGIT = np.zeros(256, bool)
IS_DIGIT[48:58] = True
IS_WORDLIKE = np.zeros(256, bool)
IS_WORDLIKE[48:58] = IS_WORDLIKE[65:91] = IS_WORDLIKE[97:123] = IS_WORDLIKE[128:] = True


def any_of(characters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters.encode())] = True
    return table


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with at most ``limit`` bytes of text, or one row."""
    data, offsets = buffer_of(batch.column(text))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset: column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[offsets[0]: offsets[-1]], offsets - offsets[0]


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, SPAN_BYTES + 1)
        up, down = np.full(n, BASE, np.uint64), np.full(n, BASE_INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray,
                values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """Hash of every span [start, end); spans are in order and don't overlap.

    A polynomial in each byte's place, from one running sum over the bytes; equal
    spans have equal hashes wherever they stand. ``values`` maps a byte (or any other
    small unit that ``data`` holds) to 64 bits.
    """
    out = np.empty(len(start), np.uint64)
    first = 0
    while first < len(start):
        last = int(np.searchsorted(end, start[first] + SPAN_BYTES, side="right"))
        last = max(last, first + 1)
        low, high = int(start[first]), int(end[last - 1])
        up, down = _power_tables(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(values[data[low:high]] * up[: high - low], out=sums[1:])
        s, e = start[first:last] - low, end[first:last] - low
        out[first:last] = (sums[e] - sums[s]) * down[s]
        first = last
    return mix(out + (end - start).astype(np.uint64))


class Words:
    """The words of a batch: maximal runs of bytes other than ASCII white space."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = False):
        self.data, self.offsets = data, offsets
        self.start, self.end = runs(~IS_SPACE[data], offsets)
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)
        self.hash = span_hashes(data, self.start, self.end, FOLDED_VALUES if fold else BYTE_VALUES)


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the maximal runs of ``mask``, cut where a text ends."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins, ends = mask.copy(), mask.copy()
    begins[1:] &= ~mask[:-1] | edge[1:-1]
    ends[:-1] &= ~mask[1:] | edge[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def counts_of(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many places of ``mask`` each text has."""
    return np.diff(np.searchsorted(np.flatnonzero(mask), offsets))


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of every window of ``size`` successive items inside one text."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    whole = np.ones(n, bool)
    for back in range(1, size):
        cut = first[(first >= back) & (first - back < n)] - back
        whole[cut] = False
    at = np.flatnonzero(whole)
    out = np.zeros(len(at), np.uint64)
    for place in range(size):
        out = out * BASE + hashes[at + place]
    return at, mix(out + np.uint64(size))


def within_text(doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within one text of the batch."""
    return mix(hashes ^ mix(doc.astype(np.uint64) * BASE + np.uint64(3)))


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(any, later): which items occur twice or more, and which are not the first of their kind."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = sorted_keys[1:] == sorted_keys[:-1]
    anywhere, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    anywhere[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return anywhere, later


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of the lines that hold at least one word."""
    breaks = np.flatnonzero(data == 10)
    start = np.concatenate([offsets[:-1], breaks + 1])
    order = np.argsort(start, kind="stable")
    start = start[order]
    of_break = np.searchsorted(offsets, breaks, side="right") - 1
    doc = np.concatenate([np.arange(len(offsets) - 1), of_break])[order]
    # The line that begins at a start ends at the next break of its text or at the text's end.
    following = np.searchsorted(breaks, start)
    padded = np.append(breaks, np.iinfo(np.int64).max)
    end = np.minimum(padded[following], offsets[doc + 1])
    keep = end > start
    start, end, doc = start[keep], end[keep], doc[keep]
    inside = np.flatnonzero(~IS_SPACE[data])
    holds = np.searchsorted(inside, end) > np.searchsorted(inside, start)
    return start[holds], end[holds], doc[holds]
