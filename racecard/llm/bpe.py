"""Byte-level BPE in length-bucketed numpy matrices: encode and decode whole texts.

Pieces of similar length stand in one padded matrix of symbol ids, a row each. In every
round each row merges its leftmost pair of the lowest rank; ranks come from a hashed
table of pairs, merged rows are closed up, and rows without a pair to merge leave the
matrix. A piece above ``WIDEST`` bytes would need as many rounds as it has bytes; it goes
through a heap with the same choice of pairs, so the ids are the same.

Null and empty texts give no ids. Repeated rows give repeated results, and other columns
of the input are neither read nor returned.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from racecard.llm.pieces import PieceEncoder
from racecard.llm.textscan import chunks, mix

WIDEST = 1024
ROWS = 1 << 16
NO_PAIR = np.int32(2**31 - 1)


class PairTable:
    """(left id, right id) -> id of the merged symbol, by open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        keys = self._key(left, right)
        bits = max(4, int(len(keys) * 2).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NO_PAIR, np.int32)
        slot, waiting, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(waiting):
            free = waiting[self.keys[slot[waiting]] == -1]
            self.keys[slot[free]] = keys[free]  # of several in one slot, one stays
            placed = self.keys[slot[waiting]] == keys[waiting]
            self.values[slot[waiting[placed]]] = merged[waiting[placed]]
            waiting = waiting[~placed]
            slot[waiting] = (slot[waiting] + 1) & self.mask
            self.probes += 1

    @staticmethod
    def _key(left, right):
        return (left.astype(np.int64) << 32) | right.astype(np.int64)

    def _slot(self, keys):
        return (mix(keys.astype(np.uint64)) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, or ``NO_PAIR``; a negative id stands for no symbol."""
        out = np.full(len(left), NO_PAIR, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = self._key(left[todo], right[todo])
        slot = self._slot(keys)
        for _ in range(self.probes):
            held = self.keys[slot]
            hit = held == keys
            out[todo[hit]] = self.values[slot[hit]]
            go = ~hit & (held != -1)
            if not go.any():
                break
            todo, keys, slot = todo[go], keys[go], (slot[go] + 1) & self.mask
        return out


class BytePairCodec:
    """Encoder and decoder for a rank file's lines of ``base64(bytes) rank``."""

    def __init__(self, rank_lines: bytes):
        self.ranks = {base64.b64decode(token): int(rank)
                      for token, rank in (line.split() for line in rank_lines.splitlines() if line)}
        pairs = [(self.ranks[token[:cut]], self.ranks[token[cut:]], rank)
                 for token, rank in self.ranks.items() for cut in range(1, len(token))
                 if token[:cut] in self.ranks and token[cut:] in self.ranks]
        left, right, merged = np.array(pairs, np.int32).reshape(-1, 3).T
        self.pairs = PairTable(left, right, merged)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        by_rank = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            by_rank[rank] = token
        self.sizes = np.array([len(t) for t in by_rank], np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(by_rank), np.uint8)

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in order, number of ids of each)."""
        raw = [p.encode() for p in pieces]
        whole = np.array([self.ranks.get(r, -1) for r in raw], np.int32)
        length = np.array([len(r) for r in raw], np.int64)
        size = np.where(whole >= 0, 1, 0)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        todo = np.flatnonzero(whole < 0)
        width = 4
        while len(todo):
            if width > WIDEST:
                for i in todo:
                    ids = self._long(raw[i])
                    size[i] = len(ids)
                    done.append((np.array([i]), ids[None, :]))
                break
            fits = todo[length[todo] <= width]
            for at in range(0, len(fits), max(1, ROWS // width)):
                rows = fits[at: at + max(1, ROWS // width)]
                merged, counts = self._matrix([raw[i] for i in rows], width)
                size[rows] = counts
                done.append((rows, merged))
            todo = todo[length[todo] > width]
            width *= 2
        place = np.cumsum(size) - size
        ids = np.empty(int(size.sum()), np.int32)
        single = np.flatnonzero(whole >= 0)
        ids[place[single]] = whole[single]
        for rows, merged in done:
            inside = np.arange(merged.shape[1]) < size[rows][:, None]
            spots = place[rows][:, None] + np.arange(merged.shape[1])
            ids[spots[inside]] = merged[inside]
        return ids, size

    def _matrix(self, raw: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        padded = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raw), np.uint8).reshape(-1, width)
        count = np.array([len(r) for r in raw], np.int64)
        columns = np.arange(width)
        symbols = np.where(columns < count[:, None], self.byte_ids[padded], -1).astype(np.int32)
        ranks = np.full((len(raw), width), NO_PAIR, np.int32)
        ranks[:, :-1] = self.pairs.get(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(-1, width - 1)
        result = np.full_like(symbols, -1)
        live = np.arange(len(raw))
        while len(live):
            best = ranks.argmin(axis=1)  # the leftmost of equals
            lowest = ranks[np.arange(len(live)), best]
            over = lowest == NO_PAIR
            if over.any():
                result[live[over], : symbols.shape[1]] = symbols[over]
                live, symbols, ranks, best, lowest = (x[~over] for x in (live, symbols, ranks, best, lowest))
                if not len(live):
                    break
            each = np.arange(len(live))
            count[live] -= 1
            wide = max(2, int(count[live].max()))
            # Close up: everything after the merged pair moves one place to the left.
            take = np.arange(wide)
            take = np.minimum(take + (take > best[:, None]), symbols.shape[1] - 1)
            ends = np.arange(wide) < count[live][:, None]
            symbols = np.where(ends, np.take_along_axis(symbols, take, 1), -1)
            ranks = np.where(ends, np.take_along_axis(ranks, take, 1), NO_PAIR)
            symbols[each, best] = lowest  # the rank is the merged symbol's id
            after = np.minimum(best + 1, wide - 1)
            right = np.where(best + 1 < wide, symbols[each, after], -1)
            ranks[each, best] = self.pairs.get(lowest, right)
            before = np.flatnonzero(best > 0)
            ranks[before, best[before] - 1] = self.pairs.get(
                symbols[before, best[before] - 1], lowest[before])
        return result, count

    def _long(self, raw: bytes) -> np.ndarray:
        """The same merges for one long piece, lowest rank and then leftmost first, by a heap."""
        ids = self.byte_ids[np.frombuffer(raw, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pairs.get(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(rank, i, ids[i], ids[i + 1]) for i, rank in enumerate(first) if rank != NO_PAIR]
        heapq.heapify(heap)
        size, places, table = self.sizes, self.places, self.bytes

        def push(i: int) -> None:
            if i >= 0 and after[i] < n:
                a, b = ids[i], ids[after[i]]
                joined = (table[places[a]: places[a] + size[a]].tobytes()
                          + table[places[b]: places[b] + size[b]].tobytes())
                if (rank := self.ranks.get(joined)) is not None:
                    heapq.heappush(heap, (rank, i, a, b))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            push(i)
            push(before[i])
        return np.array([i for i in ids if i >= 0], np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.sizes[ids]
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(ids) else 0
        return self.bytes[np.repeat(self.places[ids] - (stop - size), size) + np.arange(total)].tobytes()


def _codec(rank_lines: bytes) -> tuple[BytePairCodec, PieceEncoder]:
    """One codec per worker process."""
    key = hashlib.sha256(rank_lines).digest()
    if key not in _codecs:
        codec = BytePairCodec(rank_lines)
        _codecs[key] = codec, PieceEncoder(codec.encode_pieces)
    return _codecs[key]


_codecs: dict[bytes, tuple[BytePairCodec, PieceEncoder]] = {}


def byte_pair_encode(docs: DataFrame, rank_file: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and the ids of each text as an array, with the text decoded from them again.

    ``rank_file`` is read on the driver (under 1 MB) and sent to the tasks.
    """
    return _mapped(docs, rank_file, text, key, "ids array<int>, decoded binary",
                   lambda codec, ids: (ids, codec.decode(ids)), [pa.list_(pa.int32()), pa.binary()])


def byte_pair_digest(docs: DataFrame, rank_file: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, the number of ids, and the SHA-256 of the ids and of the decoded bytes."""

    def digest(codec: BytePairCodec, ids: np.ndarray):
        return (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
                hashlib.sha256(codec.decode(ids)).hexdigest())

    return _mapped(docs, rank_file, text, key, "n_tokens bigint, ids_sha256 string, decoded_sha256 string",
                   digest, [pa.int64(), pa.string(), pa.string()])


def _mapped(docs, rank_file, text, key, schema, value, kinds) -> DataFrame:
    spark = docs.sparkSession
    with open(rank_file, "rb") as lines:
        sent = spark.sparkContext.broadcast(lines.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, encoder = _codec(sent.value)
        for batch in batches:
            for part in chunks(batch, "text"):
                texts = part.column("text").fill_null("").to_pylist()
                rows = [value(codec, ids) for ids in encoder.texts(texts)]
                columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), *columns],
                    names=["key", *(field.split()[0] for field in schema.split(", "))])

    kind = docs.schema[key].dataType.simpleString()
    return (docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
            .mapInArrow(encode, f"key {kind}, {schema}")
            .withColumnRenamed("key", key))
