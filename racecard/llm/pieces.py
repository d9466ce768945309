"""Split texts before byte-level BPE, and remember the ids of pieces already encoded.

The split is the one of the public byte-level pattern (contractions, letters, numbers,
other symbols, white space; one blank may lead a piece). It is computed with numpy from
character classes for a whole batch at once instead of one regular-expression match per
piece. Distinct pieces are encoded once; a piece is known by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import tiktoken

from racecard.llm.textscan import _splitmix, span_hashes

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
CHUNK_CHARS = 1 << 21
LONG_PIECE = 256
APOSTROPHE, BLANK = 39, 32
#: fixed values: what may follow an apostrophe to form a contraction
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@cache
def classes() -> np.ndarray:
    """Class of every code point, in the Unicode version of the public encoder.

    The encoder skips what its pattern does not match, so a pattern of one class and a
    vocabulary of single bytes returns exactly the characters of that class.
    """
    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    single_bytes = {bytes([b]): b for b in range(256)}
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        matcher = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single_bytes, special_tokens={})
        found = bytes(matcher.encode_ordinary(every)).decode()
        table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return table


@cache
def point_values() -> np.ndarray:
    return _splitmix(0x110000, 29)


def split_points(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of every piece, in order; pieces cover all characters."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes()[points]
    opens = np.zeros(n + 1, bool)
    opens[offsets] = True
    space, blank = kind == SPACE, points == BLANK
    begins = opens[:n].copy()
    # A run of one class opens a piece, unless a blank before it leads the piece.
    changed = kind[1:] != kind[:-1]
    begins[1:] |= changed & (space[1:] | ~blank[:-1])
    # The last white space before other text stands apart from the white space before it.
    last = space.copy()
    last[:-1] &= ~space[1:] & ~opens[1:n]
    last[-1] = False
    begins |= last
    for at, length in _contractions(points, kind, blank, opens):
        for inside in range(1, length):
            begins[at + inside] = False
        stop = at + length
        begins[stop[stop < n]] = True
    start = np.flatnonzero(begins)
    return start, np.append(start[1:], n)


def _contractions(points, kind, blank, opens):
    n = len(points)
    at = np.flatnonzero(points == APOSTROPHE)
    before = np.maximum(at - 1, 0)
    at = at[opens[at] | ((kind[before] != OTHER) & ~blank[before])]
    for tail in CONTRACTIONS:
        fits = at[at + len(tail) < n]
        for place, letter in enumerate(tail, 1):
            fits = fits[(points[fits + place] == ord(letter)) & ~opens[fits + place]]
        yield fits, len(tail) + 1


class PieceEncoder:
    """Ids of texts, through ``encode`` for the pieces that were not seen lately.

    ``encode`` takes a list of pieces and returns (ids, counts). At most ``most`` pieces
    are remembered; beyond that, the memory starts anew, which only costs time.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 600_000):
        self.encode, self.most = encode, most
        self._forget()

    def _forget(self):
        self.keys = np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out, first, held = [], 0, 0
        for i, text in enumerate(texts):
            if held and held + len(text) > CHUNK_CHARS:
                out += self._chunk(texts[first:i])
                first, held = i, 0
            held += len(text)
        return out + self._chunk(texts[first:])

    def _chunk(self, texts: list[str]) -> list[np.ndarray]:
        whole = "".join(texts)
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=offsets[1:])
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        start, end = split_points(points, offsets)
        keys = span_hashes(points, start, end, point_values())
        for i in np.flatnonzero(end - start > LONG_PIECE):
            keys[i] = np.uint64(hash(whole[start[i]: end[i]]) & 0xFFFFFFFFFFFFFFFF)
        unique, where, back = np.unique(keys, return_index=True, return_inverse=True)
        place = self._places(unique, lambda i: whole[start[where[i]]: end[where[i]]])
        size = self.size[place][back]
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        index = np.repeat(self.at[place][back] - (stop - size), size) + np.arange(total)
        ids = self.ids[index]
        cuts = np.append(0, stop)[np.searchsorted(start, offsets)]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def _places(self, unique: np.ndarray, piece: Callable[[int], str]) -> np.ndarray:
        """Where each of the sorted keys is remembered, after encoding the new ones."""
        for _ in range(2):
            place = np.searchsorted(self.keys, unique)
            known = np.zeros(len(unique), bool)
            inside = place < len(self.keys)
            known[inside] = self.keys[place[inside]] == unique[inside]
            new = np.flatnonzero(~known)
            if len(self.keys) and len(self.keys) + len(new) > self.most:
                self._forget()
                continue
            break
        if len(new):
            ids, size = self.encode([piece(i) for i in new])
            at = len(self.ids) + np.cumsum(size) - size
            order = np.argsort(np.concatenate([self.keys, unique[new]]), kind="stable")
            self.keys = np.concatenate([self.keys, unique[new]])[order]
            self.at = np.concatenate([self.at, at])[order]
            self.size = np.concatenate([self.size, size])[order]
            self.ids = np.concatenate([self.ids, ids])
            place = np.searchsorted(self.keys, unique)
        return place
