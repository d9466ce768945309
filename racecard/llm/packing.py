"""Best-fit packing of token pieces into sequences, planned on the length histogram.

A pattern says how many pieces of each length share one sequence. The configuration
linear program asks for pattern multiplicities that cover the histogram with the fewest
sequences. It is solved by multiplicative weights: every length has a weight, an integer
knapsack (dynamic programming over the capacity) finds the pattern of most weight, and
the lengths that this pattern covers lose weight. The multiplicities are rounded down, and
the program is solved again for the histogram of what this leaves, until few pieces are left
or rounding leaves most of them; those, at most about the number of patterns times their
pieces whatever the corpus, are packed best-fit, longest first.

The histogram has one row per length, ``capacity`` rows at most, so planning takes the
same memory on the driver whatever the corpus. The plan goes back as one row per
(pattern, length), and every piece finds its sequence and offset by arithmetic on its
rank among the pieces of its length. Ranks come from counts per (task, length), so that
no length is ever gathered in one place.

The strings of the tokenizer file's added tokens are those tokens wherever they stand in a
text, as in the library's ``encode``. Null and empty texts still end in ``end_id`` and make one
piece of one token. Repeated rows are packed as often as they occur. No documents: no pieces.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from racecard.llm.pieces import PieceEncoder
from racecard.llm.textscan import chunks
from racecard.session import cut_lineage

CAPACITY = 1024
END_ID = 2
ROUNDS = 400
STEP = 0.1
RATE = 8.0
PATTERNS = 256
FEW_LEFT = 20_000


def priced(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack with repetition: the most price within each room, and the last length taken.

    ``price[l]`` is the price of length l, 0 for lengths that do not occur.
    """
    best = np.zeros(capacity + 1)
    taken = np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        value = price[1: room + 1] + best[room - 1:: -1] if room > 1 else price[1:2] + best[:1]
        at = int(value.argmax())
        if value[at] > best[room - 1]:
            best[room], taken[room] = value[at], at + 1
        else:
            best[room] = best[room - 1]
    return best, taken


def pattern_with(length: int, taken: np.ndarray, left: np.ndarray, capacity: int) -> dict[int, int]:
    """The dearest pattern that holds ``length``, cut to the pieces there are."""
    pattern = {length: 1}
    room = capacity - length
    while room > 0:
        size = int(taken[room])
        if not size:
            room -= 1
            continue
        if pattern.get(size, 0) < left[size]:
            pattern[size] = pattern.get(size, 0) + 1
        room -= size
    return pattern


#: A pattern: places in the list of lengths, and how many pieces of each. Few lengths share
#: a sequence, so thousands of patterns take little memory on the driver.
Pattern = tuple[np.ndarray, np.ndarray]


def size_of(pattern: Pattern, lengths: np.ndarray) -> int:
    return int(lengths[pattern[0]] @ pattern[1])


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS,
          step: float = STEP, rate: float = RATE) -> list[tuple[Pattern, float]]:
    """Fractional (pattern, multiplicity) that cover the histogram with few sequences.

    Multiplicative weights: the price of a length is its share of the capacity times
    exp(-rate * how much more of its demand is covered than of the average length's).
    Each round prices, for every length, the dearest pattern that holds it, and uses
    those within ``step`` of the dearest of all, together until one length has gained
    ``step`` of its demand. In the end the multiplicities are scaled to the demand.
    """
    demand = np.zeros(capacity + 1)
    demand[lengths] = counts
    covered = np.zeros(capacity + 1)
    found: dict[bytes, float] = {}
    mass = demand * np.arange(capacity + 1)
    for _ in range(rounds):
        ahead = covered - (covered * mass).sum() / mass.sum()
        price = np.where(demand > 0, np.arange(capacity + 1) / capacity * np.exp(-rate * ahead), 0.0)
        best, taken = priced(price, capacity)
        value = price[lengths] + best[capacity - lengths]
        chosen = lengths[value >= (1 - step) * value.max()]
        share = np.zeros(capacity + 1)
        patterns = []
        for length in chosen[np.argsort(covered[chosen])][:PATTERNS]:
            pattern = pattern_with(int(length), taken, demand, capacity)
            times = min(demand[size] / n for size, n in pattern.items())
            patterns.append((pattern, times))
            for size, n in pattern.items():
                share[size] += n * times / demand[size]
        scale = step / share.max()
        covered += share * scale
        for pattern, times in patterns:
            key = np.array(sorted(pattern.items()), np.int32).tobytes()
            found[key] = found.get(key, 0.0) + times * scale
    scale = 1 / max((covered * mass).sum() / mass.sum(), 1e-12)
    place = np.zeros(capacity + 1, np.int32)
    place[lengths] = np.arange(len(lengths))
    out = []
    for key, times in found.items():
        sizes, many = np.frombuffer(key, np.int32).reshape(-1, 2).T
        out.append(((place[sizes], many.astype(np.int64)), times * scale))
    return out


def rounded(lengths: np.ndarray, counts: np.ndarray, capacity: int,
            fractional: list[tuple[Pattern, float]], rounds: int = ROUNDS) -> list[tuple[Pattern, int]]:
    """Whole multiplicities that cover every piece exactly once.

    Every multiplicity is rounded down first, and the program solved again for what that leaves
    as long as this places half of it. The rest is completed in three ways, of which the
    one with fewest sequences stays.
    """
    left = counts.copy()
    plan: list[tuple[Pattern, int]] = []
    while True:
        before = left.sum()
        full = sorted(fractional, key=lambda x: (-size_of(x[0], lengths), -x[1], x[0][0].tobytes(), x[0][1].tobytes()))
        for pattern, times in full:
            _use(plan, left, pattern, int(np.floor(times)))
        if left.sum() <= FEW_LEFT or left.sum() > before / 2:
            break
        held = np.flatnonzero(left)
        again = solve(lengths[held], left[held], capacity, rounds)
        fractional = [((held[at].astype(np.int32), many), times) for (at, many), times in again]
    completions = []
    for first in ([p for p, _ in full if size_of(p, lengths) == capacity], []):
        rest, more = left.copy(), []
        for pattern in first:
            _use(more, rest, pattern)
        while rest.any():
            _use(more, rest, _fullest(lengths, rest, capacity))
        completions.append(more)
    completions.append(_best_fit(lengths, left, capacity))
    return plan + min(completions, key=lambda more: sum(times for _, times in more))


def _use(plan: list, left: np.ndarray, pattern: Pattern, times: int | None = None) -> None:
    """Take the pattern as often as ``left`` has its pieces, at most ``times``."""
    at, many = pattern
    most = int((left[at] // many).min())
    times = most if times is None else min(times, most)
    if times > 0:
        left[at] -= many * times
        plan.append((pattern, times))


def _pattern(held: dict[int, int]) -> Pattern:
    at, many = zip(*sorted(held.items()))
    return np.array(at, np.int32), np.array(many, np.int64)


def _best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Longest first, each into the fullest sequence that still has room."""
    by_room: dict[int, list[dict[int, int]]] = {}
    rooms = np.zeros(capacity + 1, np.int64)
    for at in range(len(lengths) - 1, -1, -1):
        size = int(lengths[at])
        for _ in range(int(left[at])):
            fits = np.flatnonzero(rooms[size:])
            room = int(fits[0]) + size if len(fits) else capacity
            held = by_room[room].pop() if len(fits) else {}
            rooms[room] -= bool(len(fits))
            held[at] = held.get(at, 0) + 1
            by_room.setdefault(room - size, []).append(held)
            rooms[room - size] += 1
    alike: dict[tuple, int] = {}
    for held in (held for group in by_room.values() for held in group):
        key = tuple(sorted(held.items()))
        alike[key] = alike.get(key, 0) + 1
    return [(_pattern(dict(key)), times) for key, times in alike.items()]


def _fullest(lengths: np.ndarray, left: np.ndarray, capacity: int) -> Pattern:
    """The longest piece left, and the pieces that best fill what it leaves free.

    Subset sums of the pieces left, longest first; each reachable sum remembers how it
    was reached first, so a length is never used more often than it occurs.
    """
    longest = int(np.flatnonzero(left)[-1])
    pattern = {longest: 1}
    room = capacity - int(lengths[longest])
    reached = np.zeros(room + 1, bool)
    reached[0] = True
    by = np.zeros(room + 1, np.int64)
    for at in range(longest, -1, -1):
        size, most = int(lengths[at]), int(left[at]) - (at == longest)
        if size > room or most <= 0 or reached[room]:
            continue
        # Sums of each residue class, in order; how many of this length a new sum has used.
        used = np.where(reached, 0, most + 1)
        for start in range(size, room + 1, size):
            stop = min(start + size, room + 1)
            ahead = used[start - size: stop - size] + 1
            part = used[start:stop]
            new = (part > 0) & (ahead <= most)
            part[new] = ahead[new]
            by[start:stop][new] = at
        reached |= (used <= most)
    filled = int(np.flatnonzero(reached)[-1])
    while filled > 0:
        at = int(by[filled])
        pattern[at] = pattern.get(at, 0) + 1
        filled -= int(lengths[at])
    return _pattern(pattern)


def slots(lengths: np.ndarray, plan: list[tuple[Pattern, int]]) -> list[tuple]:
    """One row per (pattern, length): where pieces of which ranks go."""
    rows, first_sequence = [], 0
    taken = np.zeros(len(lengths), np.int64)
    for pattern, times in plan:
        offset = 0
        for at, each in zip(pattern[0][::-1].tolist(), pattern[1][::-1].tolist()):
            size = int(lengths[at])
            rows.append((size, int(taken[at]), int(taken[at]) + each * times, each, offset, first_sequence))
            taken[at] += each * times
            offset += each * size
        first_sequence += times
    return rows


def token_pieces(docs: DataFrame, tokenizer_file: str, text: str = "text", key: str = "doc_id",
                 capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False, added: bool = True) -> DataFrame:
    """``key, piece, start, length, ids_crc32`` of every piece, and ``task, place`` for its rank.

    A text's ids and ``end_id`` are one piece if they fit in ``capacity``; longer ones are
    cut into pieces of ``capacity``, the first of which may be shorter. ``place`` numbers
    the pieces of one length within the task that made them. With ``ids``, the ids too. With
    ``added`` false the strings of added tokens are ordinary text.
    """
    spark = docs.sparkSession
    with open(tokenizer_file, "rb") as file:
        sent = spark.sparkContext.broadcast(file.read())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value, added)
        task = TaskContext.get().partitionId()
        place = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in chunks(batch, "text"):
                rows, row_of, held = [], [], []
                for i, tokens in enumerate(encoder.texts(part.column("text").fill_null("").to_pylist())):
                    tokens = np.append(tokens, end_id).astype("<u4")
                    stops = range((len(tokens) - 1) % capacity + 1, len(tokens) + 1, capacity)
                    start = 0
                    for number, stop in enumerate(stops):
                        own = tokens[start:stop]
                        rows.append((number, start, stop - start, zlib.crc32(own), task, int(place[stop - start])))
                        row_of.append(i)
                        place[stop - start] += 1
                        start = stop
                    held.append(tokens)
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]
                if ids:  # the pieces of a chunk, one behind the other, are its texts' ids
                    stops = np.cumsum([0, *(row[2] for row in rows)], dtype=np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(stops), pa.array(np.concatenate(held).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(pa.array(row_of)), *columns],
                    names=["key", "piece", "start", "length", "ids_crc32", "task", "place", "ids"][: len(columns) + 1])

    kind = docs.schema[key].dataType.simpleString()
    return (docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
            .mapInArrow(cut, f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, "
                             "task int, place bigint" + (", ids array<int>" if ids else ""))
            .withColumnRenamed("key", key))


def pack(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; needs ``length, task, place``.

    The pieces are written once: ranks and plan must come from the same task attempts.
    """
    pieces = cut_lineage(pieces)
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = cut_lineage(counts.select(
        "task", "length", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first_rank")))
    histogram = (firsts.groupBy("length").agg(F.sum("n").alias("n")).orderBy("length").collect())
    lengths = np.array([r["length"] for r in histogram], np.int64)
    demand = np.array([r["n"] for r in histogram], np.int64)
    plan = rounded(lengths, demand, capacity, solve(lengths, demand, capacity, rounds), rounds) if len(lengths) else []
    # At most one row per (pattern, length): bounded by the rounds and the capacity, not by the pieces.
    table = pieces.sparkSession.createDataFrame(
        slots(lengths, plan), "slot_length bigint, from_rank bigint, to_rank bigint, each bigint, "
                              "slot_offset bigint, first_sequence bigint")
    by_length = table.groupBy("slot_length").agg(F.sort_array(F.collect_list(
        F.struct("from_rank", "to_rank", "each", "slot_offset", "first_sequence"))).alias("slots"))
    ranked = (pieces.join(firsts.select("task", "length", "first_rank"), ["task", "length"])
              .withColumn("rank", F.col("first_rank") + F.col("place")))
    placed = ranked.join(F.broadcast(by_length), F.col("length") == F.col("slot_length"))
    slot = F.filter("slots", lambda s: (s["from_rank"] <= F.col("rank")) & (F.col("rank") < s["to_rank"]))[0]
    inside = F.col("rank") - F.col("slot.from_rank")
    return placed.withColumn("slot", slot).select(
        *[c for c in pieces.columns if c not in ("task", "place")],
        (F.col("slot.first_sequence") + F.floor(inside / F.col("slot.each"))).alias("sequence_id"),
        (F.col("slot.slot_offset") + (inside % F.col("slot.each")) * F.col("length")).alias("offset"))


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Visible Latin-1 characters stand for themselves, the other bytes for the code points
    from 256 on, in order.
    """
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: 256 + i for i, b in enumerate(hidden)}


class TokenEncoder:
    """Ids of texts in which the strings of added tokens stand for those tokens."""

    def __init__(self, pieces: PieceEncoder, added: dict[str, int]):
        self.pieces, self.added = pieces, added
        longest_first = sorted(added, key=lambda x: (-len(x), x))
        self.found = re.compile("|".join(map(re.escape, longest_first))) if added else None

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        if self.found is None:
            return self.pieces.texts(texts)
        parts, plan = [], []
        for text in texts:
            first, own = 0, []
            for match in self.found.finditer(text) if any(x in text for x in self.added) else ():
                own.append((len(parts), self.added[match.group()]))
                parts.append(text[first: match.start()])
                first = match.end()
            plan.append((own, len(parts)))
            parts.append(text[first:])
        ids = self.pieces.texts(parts)
        return [np.concatenate([x for at, token in own for x in (ids[at], [token])] + [ids[last]]).astype(np.int32)
                if own else ids[last] for own, last in plan]


_encoders: dict[tuple[int, bool], TokenEncoder] = {}


def _encoder(tokenizer_json: bytes, added: bool) -> TokenEncoder:
    """One encoder per worker process."""
    key = zlib.crc32(tokenizer_json), added
    if key not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task per core already
        from tokenizers import Tokenizer

        # Pieces are split already, so the tokenizer's model is asked for each piece alone.
        whole = Tokenizer.from_str(tokenizer_json.decode())
        model = whole.model
        tokens = {token.content: i for i, token in whole.get_added_tokens_decoder().items()} if added else {}
        shown = byte_letters()

        def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
            found = [[t.id for t in model.tokenize(p.encode().decode("latin-1").translate(shown))] for p in pieces]
            return (np.fromiter(chain.from_iterable(found), np.int32),
                    np.fromiter(map(len, found), np.int64, len(found)))

        _encoders[key] = TokenEncoder(PieceEncoder(encode), tokens)
    return _encoders[key]
