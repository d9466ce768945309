"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes a row of shape features. Each feature has a lookup table over its
bins, learnt by cyclic boosting: in every round each feature in turn gets one shallow
tree on the gradient of the log loss, which is added to its table. Pairs of features
that explain most of what remains get tables over pairs of bins the same way. A score is
the sigmoid of a sum of table entries, so scoring is one addition per feature and pair.

The fit reads the texts of at most ``SAMPLE`` labelled ids outside the held-out part; every
whole text is scored in one pass. Labels, language, source and id are no features. Null and empty texts have all features 0 and are scored like any other text.
Without labels of both kinds, every score is the share of label 1 (one half if none).
Repeated rows get equal scores; other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from racecard.llm.samples import held_out, labelled_sample
from racecard.llm.textscan import (
    IS_DIGIT, IS_SPACE, IS_UPPER, IS_WORDLIKE, Words, any_of, buffer_of, chunks, counts_of, lines,
    repeated, runs, span_hashes, windows, within_text,
)

SAMPLE = 20_000
BINS = 32
PAIR_BINS = 8
ROUNDS = 150
PAIR_ROUNDS = 60
PAIRS = 8
RATE = 0.1
LEAVES = 3
FOLDS, FOLD = 3, 1

FEATURES = [
    "log_words", "word_length", "longest_word", "symbols", "pipes", "exclamations", "stops", "digits",
    "uppercase", "upper_words", "non_ascii", "mixed_words", "neighbours_equal", "repeated_windows",
    "repeated_pairs", "distinct_words", "equal_lines", "log_lines", "short_lines", "symbol_runs",
]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` per text; shares are of characters, words or lines."""
    words = Words(data, offsets)
    texts = len(offsets) - 1
    many = np.maximum(words.count, 1)
    size = np.maximum(np.diff(offsets), 1)

    def per_word(mask: np.ndarray) -> np.ndarray:
        return np.bincount(words.doc[mask], minlength=texts) / many

    def per_byte(mask: np.ndarray) -> np.ndarray:
        return counts_of(mask, offsets) / size

    length = words.end - words.start
    longest = np.zeros(texts, np.int64)
    np.maximum.at(longest, words.doc, np.minimum(length, 1000))
    upper_start = np.searchsorted(np.flatnonzero(IS_UPPER[data]), words.start)
    upper_end = np.searchsorted(np.flatnonzero(IS_UPPER[data]), words.end)
    letter = IS_WORDLIKE[data]
    symbol_places = np.flatnonzero(~letter & ~IS_SPACE[data])
    symbols_in = np.searchsorted(symbol_places, words.end) - np.searchsorted(symbol_places, words.start)
    equal = np.zeros(len(words.hash), bool)
    equal[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])

    def window_share(n: int) -> np.ndarray:
        at, hashes = windows(words.hash, words.first, n)
        _, later = repeated(within_text(words.doc[at], hashes))
        return np.bincount(words.doc[at[later]], minlength=texts) / many

    _, again = repeated(within_text(words.doc, words.hash))
    start, end, doc = lines(data, offsets)
    rows = np.maximum(np.bincount(doc, minlength=texts), 1)
    _, same = repeated(within_text(doc, span_hashes(data, start, end)))
    run_start, run_end = runs(~letter & ~IS_SPACE[data], offsets)
    wide = run_start[run_end - run_start >= 2]
    columns = [
        np.log1p(words.count),
        np.bincount(words.doc, length, texts) / many,
        longest,
        per_byte(any_of("#*$%&<>")[data]),
        per_byte(data == ord("|")),
        per_byte(data == ord("!")),
        per_byte(any_of(".,;:?")[data]),
        per_byte(IS_DIGIT[data]),
        per_byte(IS_UPPER[data]),
        per_word(upper_end - upper_start >= 2),
        per_byte(data >= 0x80),
        per_word(symbols_in >= 2),
        per_word(equal),
        window_share(3),
        window_share(2),
        1 - per_word(again),
        np.bincount(doc[same], minlength=texts) / rows,
        np.log1p(np.bincount(doc, minlength=texts)),
        np.bincount(doc[end - start < 30], minlength=texts) / rows,
        np.diff(np.searchsorted(wide, offsets)) / many,
    ]
    out = np.stack(columns, axis=1).astype(np.float32)
    out[words.count == 0] = 0
    return out


class AdditiveModel:
    """Cut points and tables; ``fit`` learns them, ``score`` adds table entries up."""

    def __init__(self, bias: float = 0.0):
        self.bias = bias
        self.cuts: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pair_cuts: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        self.bias = float(np.log(share / (1 - share)))
        if not len(y) or y.min() == y.max():
            return self
        n = x.shape[1]
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(n)]
        self.pair_cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for j in range(n)]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        bins = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)]
        total = np.full(len(y), self.bias)
        for _ in range(ROUNDS):
            for j in range(n):
                p = _sigmoid(total)
                g = np.bincount(bins[j], y - p, len(self.tables[j]))
                h = np.bincount(bins[j], p * (1 - p), len(self.tables[j]))
                step = RATE * _tree(g, h, LEAVES)
                self.tables[j] += step
                total += step[bins[j]]
        self._fit_pairs(x, y, total)
        return self

    def _fit_pairs(self, x, y, total):
        small = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.pair_cuts)]
        p = _sigmoid(total)
        gains = []
        for a, b in combinations(range(x.shape[1]), 2):
            cell = small[a] * PAIR_BINS + small[b]
            g = np.bincount(cell, y - p, PAIR_BINS**2)
            h = np.bincount(cell, p * (1 - p), PAIR_BINS**2)
            gains.append((float((g * g / (h + 5)).sum()), a, b))
        chosen = sorted(gains, reverse=True)[:PAIRS]
        tables = [np.zeros(PAIR_BINS**2) for _ in chosen]
        for _ in range(PAIR_ROUNDS):
            for table, (_, a, b) in zip(tables, chosen):
                cell = small[a] * PAIR_BINS + small[b]
                p = _sigmoid(total)
                g = np.bincount(cell, y - p, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
                h = np.bincount(cell, p * (1 - p), PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
                step = RATE * _quadrants(g, h).ravel()
                table += step
                total += step[cell]
        self.pairs = [(a, b, table) for table, (_, a, b) in zip(tables, chosen)]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[np.searchsorted(cuts, x[:, j], side="right")]
        if self.pairs:
            small = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.pair_cuts)]
            for a, b, table in self.pairs:
                total += table[small[a] * PAIR_BINS + small[b]]
        return _sigmoid(total)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Values per bin of a tree with few leaves, split where the gain is largest."""
    parts = [(0, len(g))]
    gs, hs = np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))

    def worth(a, b):
        return (gs[b] - gs[a]) ** 2 / (hs[b] - hs[a] + 1)

    while len(parts) < leaves:
        best = (1e-9, None, 0)
        for a, b in parts:
            if b - a > 1:
                at = np.arange(a + 1, b)
                gain = worth(a, at) + worth(at, b) - worth(a, b)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (float(gain[i]), (a, b), int(at[i]))
        if best[1] is None:
            break
        a, b = best[1]
        parts.remove((a, b))
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + 1)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values per pair of bins of the best tree that cuts both features once."""
    gs = np.zeros((len(g) + 1, len(g) + 1))
    hs = np.zeros_like(gs)
    gs[1:, 1:], hs[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b = np.meshgrid(np.arange(1, len(g)), np.arange(1, len(g)), indexing="ij")

    def of(s):
        low = s[a, b]
        left, top, every = s[a, -1], s[-1, b], s[-1, -1]
        return np.stack([low, left - low, top - low, every - left - top + low])

    gq, hq = of(gs), of(hs)
    i, j = np.unravel_index((gq**2 / (hq + 1)).sum(axis=0).argmax(), a.shape)
    value = gq[:, i, j] / (hq[:, i, j] + 1)
    out = np.empty_like(g)
    i, j = i + 1, j + 1
    out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = value
    return out


def feature_rows(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``features`` of every text."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                rows = features(*buffer_of(part.column("text")))
                flat = pa.array(rows.ravel(), pa.float32())
                places = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.ListArray.from_arrays(places, flat)], names=["key", "features"])

    kind = docs.schema[key].dataType.simpleString()
    return (docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
            .mapInArrow(measure, f"key {kind}, features array<float>").withColumnRenamed("key", key))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id",
        most: int = SAMPLE) -> AdditiveModel:
    """The model learnt from the texts of at most ``most`` labelled ids."""
    sample = labelled_sample(labels, "quality", most, FOLDS, FOLD)
    chosen = docs.select(F.col(key).alias("sample_id"), F.col(text).cast("string").alias("body")).join(
        F.broadcast(sample), "sample_id")  # ``most`` ids
    named = chosen.select(F.struct("sample_id", "label", F.xxhash64("body").alias("own")).alias("row"), "body")
    # One text of each id, whatever the tasks: the one of least hash.
    rows = feature_rows(named, "body", "row")
    found = (rows.groupBy(F.col("row.sample_id").alias("sample_id"))
             .agg(F.min(F.struct(F.col("row.own").alias("own"), F.col("row.label").alias("label"), "features")).alias("v"))
             .select("v.label", "v.features").collect())
    x = np.array([r["features"] for r in found], np.float32).reshape(-1, len(FEATURES))
    y = np.array([r["label"] for r in found], float)
    order = np.lexsort((*x.T, y))  # the same model whatever order the rows came in
    return AdditiveModel().fit(x[order], y[order])


def scores(texts: pa.Array, model: AdditiveModel) -> np.ndarray:
    return model.score(features(*buffer_of(texts)))


def quality_scores(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id",
                   threshold: float = 0.5, most: int = SAMPLE) -> DataFrame:
    """``key, held_out, score, predicted`` of every row."""
    model = fit(docs, labels, text, key, most)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(scores(part.column("text"), model))], names=["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return (docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
            .mapInArrow(score, f"key {kind}, score double")
            .select(F.col("key").alias(key), held_out("key", FOLDS, FOLD).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id",
              threshold: float = 0.5, most: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with its columns."""
    model = fit(docs, labels, text, key, most)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                yield part.filter(pa.array(scores(part.column(text), model) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
