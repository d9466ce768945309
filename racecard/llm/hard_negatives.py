"""Hard-negative mining with segment summaries that bound every score.

A vector is cut into one, two, four, ... segments. Of every segment its mean and deviation are
stored. The part of an inner product that a segment of w components gives is w times the
product of the two means, plus or minus at most w times the product of the two deviations
(Cauchy and Schwarz), so a level's summaries bound the score from both sides, each level
closer than the one before. A pair is dropped at the first level whose bounds show that it
cannot be among the best; only pairs that pass every level are scored exactly, in integers.

Components are scaled and floored to integers. For every anchor, its positives are the best
other rows of its label, and for every positive the negatives are the best rows of another
label whose score lies between ``low`` and ``high`` percent of the positive's.

Rows are read by partitions, in blocks; anchors are held against them in blocks of at most
``ANCHOR_BYTES``, sent to all tasks, one block after the other. A task keeps the best few of
every anchor and returns only those, so what is shuffled is a few rows per anchor and task.
Each block's rows are written before the next block is begun.

Rows with a null id, label or vector, or with a null, NaN or infinite component, take no part.
Shorter vectors count as filled up with zeros. Equal scores rank by smaller id. Repeated rows
are rows of their own, as anchors too, but a row with the anchor's own id is never its
partner. Without rows or anchors the result is empty. Scores are 64-bit integers; vectors whose
products need more are not supported and wrap around. Columns other than id, vector and label
are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from racecard.session import cut_lineage

SCALE = 256
ANCHOR_BYTES = 32 << 20
ANCHORS_AT_ONCE = 256
PAIRS_AT_ONCE = 1 << 20
NARROWEST = 8  # components of the last level's segments
DENSE = 0.05  # above this share of pairs left, a level is computed for all pairs of a block
LEAST = np.iinfo(np.int64).min
EXACT = float(2 ** 53)


def levels(size: int) -> list[int]:
    """Numbers of segments, from one on, doubled while segments stay wide enough."""
    out = [1]
    while size >= 2 * out[-1] * NARROWEST:
        out.append(2 * out[-1])
    return out


def padded_size(size: int) -> int:
    """The least size of at least ``size`` that the last level divides."""
    last = levels(size)[-1]
    return max(-(-size // last) * last, 1)


def summaries(vectors: np.ndarray) -> np.ndarray:
    """Per row, level after level: the mean of every segment, then the deviation of every segment."""
    out = []
    for parts in levels(vectors.shape[1]):
        cut = vectors.reshape(len(vectors), parts, -1).astype(float)
        out += [cut.mean(axis=2), cut.std(axis=2)]
    return np.concatenate(out, axis=1)


def dense(column: pa.Array, size: int, kind: type) -> np.ndarray:
    """A list column as a matrix, shorter lists filled up with zeros."""
    flat, lengths = column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths == size).all():
        return flat.astype(kind, copy=False).reshape(-1, size)
    out = np.zeros((len(lengths), size), kind)
    out[np.arange(size) < lengths[:, None]] = flat
    return out


class Vectors:
    """Some rows: ids, labels, integer vectors and their summaries."""

    def __init__(self, ids, labels, vectors, summary):
        self.ids, self.labels, self.vectors, self.summary = ids, labels, vectors, summary
        self.floats = vectors.astype(float)
        self.largest = float(np.abs(self.floats).max(initial=0.0))

    @classmethod
    def of(cls, part: pa.RecordBatch | pa.Table, size: int) -> Vectors:
        column = lambda name: part.column(name).combine_chunks() if isinstance(part, pa.Table) else part.column(name)
        vectors = dense(column("vector"), size, np.int64)
        width = 2 * sum(levels(size))
        return cls(column("id").to_numpy(zero_copy_only=False), column("label").to_numpy(zero_copy_only=False), vectors,
                   dense(column("summary"), width, float))

    def rows(self, at) -> Vectors:
        return Vectors(self.ids[at], self.labels[at], self.vectors[at], self.summary[at])


def bounds(a: Vectors, b: Vectors, level: int, pairs: tuple[np.ndarray, np.ndarray] | None = None):
    """(lower, upper) bound of the scores of all pairs, or of the ``pairs`` given, from one level's summaries."""
    sizes = levels(a.vectors.shape[1])
    first, parts = 2 * sum(sizes[:level]), sizes[level]
    means, spreads = slice(first, first + parts), slice(first + parts, first + 2 * parts)
    width = a.vectors.shape[1] / parts
    if pairs is None:
        middle = a.summary[:, means] @ b.summary[:, means].T
        spread = a.summary[:, spreads] @ b.summary[:, spreads].T
    else:
        i, j = pairs
        middle = np.einsum("ij,ij->i", a.summary[i, means], b.summary[j, means])
        spread = np.einsum("ij,ij->i", a.summary[i, spreads], b.summary[j, spreads])
    # Room for the rounding of doubles, far below the distance of two integers that matter.
    spread = spread * width * (1 + 1e-9) + np.abs(middle) * width * 1e-9 + 1e-3
    return middle * width - spread, middle * width + spread


def exact(a: Vectors, b: Vectors, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The integer scores of the pairs."""
    i, j = pairs
    size = a.vectors.shape[1]
    if a.largest * b.largest * size < EXACT:  # then doubles hold every partial sum exactly
        if len(i) > DENSE * len(a.ids) * len(b.ids):
            return (a.floats @ b.floats.T)[i, j].astype(np.int64)
        return np.einsum("ij,ij->i", a.floats[i], b.floats[j]).astype(np.int64)
    return np.einsum("ij,ij->i", a.vectors[i], b.vectors[j])


class Best:
    """The best ``most`` (score, id) of every slot so far; equal scores by smaller id."""

    def __init__(self, slots: int, most: int):
        self.most = most
        self.score = np.full((slots, most), LEAST, np.int64)
        self.ids = np.zeros((slots, most), np.int64)
        self.filled = np.zeros(slots, np.int64)

    def least(self, slots) -> np.ndarray:
        """What a score must reach to enter each of the slots."""
        return np.where(self.filled[slots] < self.most, LEAST, self.score[slots, -1])

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(slot)
        if not len(touched):
            return
        held = np.arange(self.most) < self.filled[touched, None]
        slot = np.concatenate([slot, np.repeat(touched, self.filled[touched])])
        score = np.concatenate([score, self.score[touched][held]])
        ids = np.concatenate([ids, self.ids[touched][held]])
        order = np.lexsort((ids, ~score, slot))  # ~score: descending without overflow
        slot, score, ids = slot[order], score[order], ids[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        top = rank < self.most
        self.score[slot[top], rank[top]] = score[top]
        self.ids[slot[top], rank[top]] = ids[top]
        self.filled[touched] = np.minimum(np.bincount(slot)[touched], self.most)


def survivors(a: Vectors, b: Vectors, may: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of ``may`` that no level rules out; ``keep(anchors, lower, upper)`` says which pass."""
    pairs = None
    for level in range(len(levels(a.vectors.shape[1]))):
        if pairs is None:
            lower, upper = bounds(a, b, level)
            may &= keep(None, lower, upper, may)
            if np.count_nonzero(may) <= DENSE * may.size:
                pairs = np.nonzero(may)
        else:
            lower, upper = bounds(a, b, level, pairs)
            left = keep(pairs[0], lower, upper, None)
            pairs = pairs[0][left], pairs[1][left]
    return np.nonzero(may) if pairs is None else pairs


def best_positives(a: Vectors, b: Vectors, first: int, best: Best) -> None:
    """Add the rows ``b`` to the best positives of the anchors ``a``, which have slots from ``first`` on."""
    may = (a.labels[:, None] == b.labels) & (a.ids[:, None] != b.ids)
    slots = np.arange(first, first + len(a.ids))
    least = best.least(slots).astype(float)

    def keep(anchors, lower, upper, may):
        nonlocal least
        if anchors is not None:
            return upper >= least[anchors]
        if may.shape[1] > best.most:  # as many rows as are wanted score at least their lower bounds
            sure = np.where(may, lower, -np.inf)
            least = np.maximum(least, np.partition(sure, -best.most, axis=1)[:, -best.most])
        return upper >= least[:, None]

    i, j = survivors(a, b, may, keep)
    best.add(first + i, exact(a, b, (i, j)), b.ids[j])


def best_negatives(a: Vectors, b: Vectors, positive: np.ndarray, known: np.ndarray, first: int, best: Best,
                   low: int, high: int) -> None:
    """Add the rows ``b`` to the best negatives of every (anchor, positive) with the given scores."""
    each = positive.shape[1]
    may = (a.labels[:, None] != b.labels) & (a.ids[:, None] != b.ids)
    slots = (first + np.arange(len(a.ids)))[:, None] * each + np.arange(each)
    floor = np.maximum(best.least(slots).astype(float), positive * (low / 100) - 1e-3 * np.abs(positive) - 1)
    ceiling = positive * (high / 100) + 1e-3 * np.abs(positive) + 1

    def keep(anchors, lower, upper, may):
        at = (slice(None), None) if anchors is None else anchors
        fits = np.zeros(upper.shape, bool)
        for place in range(each):
            fits |= known[:, place][at] & (upper >= floor[:, place][at]) & (lower <= ceiling[:, place][at])
        return fits

    i, j = survivors(a, b, may, keep)
    score = exact(a, b, (i, j))
    for place in range(each):
        wanted = positive[i, place]
        fits = known[i, place] & (low * wanted <= 100 * score) & (100 * score <= high * wanted)
        fits &= score >= best.least(slots[i, place])
        best.add(slots[i[fits], place], score[fits], b.ids[j[fits]])


def prepared(vectors: DataFrame, key: str, vector: str, label: str, scale: int) -> tuple[DataFrame, int]:
    """The rows that take part, with integer vectors and segment summaries, written once; and the vectors' size."""
    x = F.col(vector)
    broken = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    rows = (vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & ~broken)
            .select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"),
                    F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("vector")))
    size = padded_size(rows.agg(F.max(F.size("vector"))).first()[0] or 1)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found = summaries(dense(part.column("vector"), size, np.int64))
            stops = pa.array(np.arange(0, found.size + 1, found.shape[1], np.int32))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(stops, pa.array(found.ravel()))],
                                             names=["id", "label", "vector", "summary"])

    return cut_lineage(rows.mapInArrow(summarise, "id bigint, label bigint, vector array<bigint>, summary array<double>")), size


def mine(vectors: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
         positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = SCALE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of every mined negative.

    ``anchors`` is a condition on ``id`` and ``label`` that says which rows are anchors.
    """
    spark = vectors.sparkSession
    rows, size = prepared(vectors, key, vector, label, scale)
    # Equal anchors have equal results: they are mined once and told ``n`` times.
    asked = cut_lineage(rows.where(anchors).groupBy("id", "label", "vector", "summary").agg(F.count("*").alias("n")))
    bytes_each = 8 * (2 * size + 2 * sum(levels(size)) + 4 * positives)
    blocks = -(-2 * asked.count() * bytes_each // ANCHOR_BYTES)
    block = F.pmod(F.xxhash64("id", "label", "vector"), F.lit(max(blocks, 1)))
    found = []
    for number in range(blocks):
        held = asked.where(block == number).orderBy("id", "label", "vector").toArrow()  # half of ANCHOR_BYTES, or so
        if held.num_rows:
            found.append(cut_lineage(_mine_block(spark, rows, held, size, positives, negatives, low, high)))
    shape = ("anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, "
             "negative_score bigint")
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], shape)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Vectors]:
    step = max(PAIRS_AT_ONCE // ANCHORS_AT_ONCE, 1)
    for batch in batches:
        for first in range(0, batch.num_rows, step):
            yield Vectors.of(batch.slice(first, step), size)


def _mine_block(spark, rows: DataFrame, held: pa.Table, size: int, positives: int, negatives: int, low: int,
                high: int) -> DataFrame:
    sent = spark.sparkContext.broadcast(held)
    cuts = range(0, held.num_rows, ANCHORS_AT_ONCE)

    def in_order(found: DataFrame, most: int) -> DataFrame:
        best = Window.partitionBy("slot").orderBy(F.col("score").desc(), "other")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)

    def flushed(best: Best) -> pa.RecordBatch:
        slot, place = np.nonzero(np.arange(best.most) < best.filled[:, None])
        return pa.RecordBatch.from_arrays(
            [pa.array(slot), pa.array(best.score[slot, place]), pa.array(best.ids[slot, place])],
            names=["slot", "score", "other"])

    def same_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, best = Vectors.of(sent.value, size), Best(sent.value.num_rows, positives)
        parts = [own.rows(slice(first, first + ANCHORS_AT_ONCE)) for first in cuts]
        for other in _blocks(batches, size):
            for first, part in zip(cuts, parts):
                best_positives(part, other, first, best)
        yield flushed(best)

    near = in_order(rows.mapInArrow(same_label, "slot bigint, score bigint, other bigint"), positives).toArrow()
    positive, ids = (np.zeros((held.num_rows, positives), np.int64) for _ in range(2))
    known = np.zeros((held.num_rows, positives), bool)
    at = near.column("slot").to_numpy(), near.column("rank").to_numpy() - 1
    positive[at], ids[at], known[at] = near.column("score").to_numpy(), near.column("other").to_numpy(), True
    wanted = spark.sparkContext.broadcast((positive, known))

    def other_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, some = wanted.value
        own, best = Vectors.of(sent.value, size), Best(score.size, negatives)
        parts = [own.rows(slice(first, first + ANCHORS_AT_ONCE)) for first in cuts]
        for other in _blocks(batches, size):
            for first, part in zip(cuts, parts):
                here = slice(first, first + len(part.ids))
                best_negatives(part, other, score[here], some[here], first, best, low, high)
        yield flushed(best)

    anchor, place = np.nonzero(known)
    slots = spark.createDataFrame(pa.table({  # one row per anchor of the block and positive
        "slot": anchor * positives + place, "anchor_id": held.column("id").to_numpy()[anchor], "positive_id": ids[anchor, place],
        "positive_score": positive[anchor, place], "n": held.column("n").to_numpy()[anchor]}))
    mined = in_order(rows.mapInArrow(other_label, "slot bigint, score bigint, other bigint"), negatives)
    told = mined.join(slots, "slot").select("*", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return told.select("anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score",
                       F.col("score").alias("negative_score"))
