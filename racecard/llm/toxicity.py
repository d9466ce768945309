"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words (runs of letters and digits, A-Z lower-cased) are known by a 32-bit hash. A word of
enough training texts has an embedding; a rarer one takes that of its longest beginning
(``BEGINNINGS`` bytes) that enough training texts have, which covers inflected forms; all
others share the zero vector. Filters of
widths 1, 2 and 3 slide over the whole text, each keeps its largest response, and a
logistic layer turns the responses into a score. The first coordinate of an embedding
starts as the word's log odds between toxic and other training texts; everything is then
trained by gradient steps through the positions that won the pooling.

The fit reads at most ``SAMPLE`` labelled ids outside the held-out part, one text each, whole
texts of any length: its words are counted on Spark, and the driver holds the sample's words as
four-byte rows of the embedding, with at most three successive words of no embedding, since more
change no response. Every text is scored once and whole. Labels, language, source and id
are no inputs of a score. A threshold per language (``flagged``) is calibrated on Spark by the
scores of all labelled rows outside the held-out part: on those that the fit did not read,
if enough of them are toxic, else on all. Only scores are joined with labels, never texts.
``predicted`` uses one threshold for all.

Null and empty texts have no words and are scored by the bias terms alone. Without
labels of both kinds, every score is the share of label 1 (0.5 / 1 if there are none).
Repeated rows get equal scores; of several texts of one id the fit reads the one of least hash.
Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from racecard.llm.samples import held_out, labelled_sample
from racecard.llm.textscan import FOLDED_VALUES, IS_WORDLIKE, buffer_of, chunks, mix, runs, span_hashes
from racecard.session import cut_lineage

SAMPLE = 6_000
FEWEST_TEXTS = 8
BEGINNINGS = (7, 6, 5, 4)
DIMENSIONS = 8
FILTERS = 6
WIDTHS = (1, 2, 3)
EPOCHS = 5
BATCH = 64
FOLDS, FOLD = 4, 2
THRESHOLD = 0.3
FEWEST_TOXIC = 20
SCORE_BINS = 10_000
PAD = max(WIDTHS) - 1
SLOT_BITS = 21


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of every word and of its beginnings, number of the first word of each text).

    A row per word: the word, then the beginnings of ``BEGINNINGS`` bytes, 0 where the
    word is no longer than that.
    """
    start, end = runs(IS_WORDLIKE[data], offsets)
    out = np.zeros((len(start), 1 + len(BEGINNINGS)), np.uint32)
    out[:, 0] = span_hashes(data, start, end, FOLDED_VALUES) >> np.uint64(32)
    for i, size in enumerate(BEGINNINGS, 1):
        longer = end - start > size
        out[longer, i] = mix(span_hashes(data, start[longer], start[longer] + size, FOLDED_VALUES)) >> np.uint64(32)
    return out, np.searchsorted(start, offsets)


class ConvolutionModel:
    """Embeddings by word hash, filters, and the logistic layer on their largest responses."""

    def __init__(self, share: float = 0.0):
        self.share, self.keys, self.seen = share, None, None

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """Embedding row of each word: its own, else its longest known beginning's, else none."""
        row = np.full(len(hashes), len(self.keys), np.int32)
        todo = np.arange(len(hashes))
        for unit in range(hashes.shape[1]):
            wanted = hashes[todo, unit]
            likely = np.flatnonzero(self._seen()[wanted >> np.uint32(32 - SLOT_BITS)])
            at = np.minimum(np.searchsorted(self.keys, wanted[likely]), len(self.keys) - 1)
            exact = self.keys[at] == wanted[likely]
            row[todo[likely[exact]]] = at[exact]
            left = np.ones(len(todo), bool)
            left[likely[exact]] = False
            todo = todo[left]
        return row

    def _seen(self) -> np.ndarray:
        """Whether any key begins with these bits; spares most unknown words the search."""
        if self.seen is None:
            self.seen = np.zeros(1 << SLOT_BITS, bool)
            self.seen[self.keys >> np.uint32(32 - SLOT_BITS)] = True
        return self.seen

    def __getstate__(self):
        return {**self.__dict__, "seen": None}

    def padded(self, row: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(embedding row per place, first place of each text); every text ends in ``PAD`` blanks."""
        texts = np.arange(len(first) - 1)
        out = np.full(len(row) + PAD * len(texts), len(self.keys))
        out[np.arange(len(row)) + PAD * np.repeat(texts, np.diff(first))] = row
        return out, first[:-1] + PAD * texts

    def responses(self, rows: np.ndarray, width: int) -> np.ndarray:
        """Every filter of this width at every place; blanks follow the last text."""
        each = self.embedding[rows]
        total = each @ self.filters[width][0] + self.offsets[width]
        for ahead in range(1, width):
            total[:-ahead] += each[ahead:] @ self.filters[width][ahead]
        return np.maximum(total, 0)

    def score(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.keys is None:
            return np.full(len(first) - 1, self.share)
        rows, begin = self.padded(self.rows(hashes), first)
        pooled = np.concatenate([np.maximum.reduceat(self.responses(rows, w), begin) for w in WIDTHS], axis=1)
        return 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.bias, -30, 30)))

    def fit(self, texts: list[np.ndarray], y: np.ndarray, seed: int = 5) -> ConvolutionModel:
        """Learn from texts given as word hashes."""
        distinct = [np.unique(t) for t in texts]
        keys, back = np.unique(np.concatenate(distinct) if distinct else np.zeros(0, np.uint32), return_inverse=True)
        toxic = np.repeat(y, [len(d) for d in distinct])
        if self.start(keys, np.bincount(back, minlength=len(keys)), np.bincount(back, toxic, len(keys)), y, seed):
            self.train([self.rows(t) for t in texts], y, seed)
        return self

    def start(self, keys: np.ndarray, many: np.ndarray, bad: np.ndarray, y: np.ndarray, seed: int = 5) -> bool:
        """Embeddings for the words of enough texts, and weights that begin near the log odds.

        ``keys`` are sorted; ``many`` and ``bad`` say in how many texts and toxic texts each is.
        """
        self.share = float((y.sum() + 0.5) / (len(y) + 1)) if len(y) else 0.5
        keep = (many >= FEWEST_TEXTS) & (keys != 0)
        if not len(y) or y.min() == y.max() or not keep.any():
            return False
        self.keys, many, bad = keys[keep], many[keep], bad[keep]
        prior = y.mean()
        odds = np.log((bad + 4 * prior) / (many - bad + 4 * (1 - prior))) - np.log(prior / (1 - prior))
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(0, 0.05, (len(self.keys) + 1, DIMENSIONS)).astype(np.float32)
        self.embedding[:-1, 0] = odds
        self.embedding[-1] = 0
        self.filters = {w: rng.normal(0, 0.1, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS}
        for w in WIDTHS:
            self.filters[w][:, 0, :2] = 1 / w
        self.offsets = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = np.full(FILTERS * len(WIDTHS), 0.1, np.float32)
        self.bias = np.array([np.log(prior / (1 - prior)) - 1], np.float32)
        return True

    def train(self, texts: list[np.ndarray], y: np.ndarray, seed: int = 5) -> None:
        """Gradient steps over texts given as embedding rows."""
        rng = np.random.default_rng(seed)
        square = {name: np.zeros_like(v) for name, v in self._weights().items()}
        for epoch in range(EPOCHS):
            rate = 0.05 / (1 + epoch)
            for batch in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
                self._step([texts[i] for i in batch], y[batch], rate, square)

    def shortened(self, rows: np.ndarray) -> np.ndarray:
        """The same text with at most ``max(WIDTHS)`` successive words of no embedding.

        Windows of unknown words alone give the same response wherever they stand.
        """
        known = rows < len(self.keys)
        order = np.arange(len(rows))
        last = np.maximum.accumulate(np.where(known, order, -1))
        return rows[known | (order - last <= max(WIDTHS))]

    def _weights(self) -> dict:
        return {"out": self.out, "bias": self.bias, "embedding": self.embedding,
                **{("f", w): self.filters[w] for w in WIDTHS}, **{("o", w): self.offsets[w] for w in WIDTHS}}

    def _step(self, texts: list[np.ndarray], y: np.ndarray, rate: float, square: dict) -> None:
        """One adaptive gradient step of the log loss on a few texts, given as embedding rows."""
        first = np.append(0, np.cumsum([len(t) for t in texts]))
        rows, begin = self.padded(np.concatenate(texts), first)
        ends = np.append(begin[1:], len(rows))
        pooled, winners = [], []
        for w in WIDTHS:
            response = self.responses(rows, w)
            won = np.stack([a + response[a:b].argmax(axis=0) for a, b in zip(begin, ends)])
            pooled.append(np.take_along_axis(response, won, 0))
            winners.append(won)
        layer = np.concatenate(pooled, axis=1)
        p = 1 / (1 + np.exp(-np.clip(layer @ self.out + self.bias, -30, 30)))
        error = ((p - y) / len(y)).astype(np.float32)
        grads = {"out": layer.T @ error + 1e-4 * self.out, "bias": error.sum(keepdims=True)}
        back = error[:, None] * self.out[None, :] * (layer > 0)
        touched, change = [], []
        for i, w in enumerate(WIDTHS):
            delta = back[:, i * FILTERS: (i + 1) * FILTERS]
            grads[("o", w)] = delta.sum(axis=0)
            grad = np.zeros_like(self.filters[w])
            for ahead in range(w):
                at = rows[np.minimum(winners[i] + ahead, len(rows) - 1)]
                grad[ahead] = np.einsum("nfd,nf->df", self.embedding[at], delta)
                touched.append(at.ravel())
                change.append((delta[:, :, None] * self.filters[w][ahead].T[None]).reshape(-1, DIMENSIONS))
            grads[("f", w)] = grad
        weights = self._weights()
        for name, grad in grads.items():
            square[name] += grad * grad
            weights[name] -= rate * grad / (np.sqrt(square[name]) + 1e-6)
        row, back_to = np.unique(np.concatenate(touched), return_inverse=True)
        grad = np.zeros((len(row), DIMENSIONS), np.float32)
        np.add.at(grad, back_to, np.concatenate(change))
        square["embedding"][row] += grad * grad
        self.embedding[row] -= rate * grad / (np.sqrt(square["embedding"][row]) + 1e-6)
        self.embedding[-1] = 0


def language_thresholds(scored: DataFrame, labels: DataFrame, key: str = "key", lang: str = "lang", most: int = SAMPLE,
                        fewest: int = FEWEST_TOXIC, label_key: str = "doc_id") -> dict[str, float]:
    """The threshold of best F1 of each language with enough toxic texts, over all labelled rows of ``scored``.

    The scores of each language and label are counted by bins of 1 / ``SCORE_BINS``, copies before
    the join with the labels.
    """
    every = (labels.select(F.col(label_key).alias("sample_id"), F.col("toxic").cast("int").alias("label"))
             .dropna().where(~held_out("sample_id", FOLDS, FOLD))
             .groupBy("sample_id").agg(F.max("label").alias("label")))
    read = labelled_sample(labels, "toxic", most, FOLDS, FOLD, label_key).select("sample_id", F.lit(True).alias("read"))
    marked = every.join(F.broadcast(read), "sample_id", "left")  # ``most`` ids
    place = F.least(F.floor(F.col("score") * SCORE_BINS), F.lit(SCORE_BINS - 1))
    alike = (scored.select(F.col(key).alias("sample_id"), F.col(lang).alias("lang"), place.alias("bin"))
             .dropna().groupBy("sample_id", "lang", "bin").agg(F.count("*").alias("copies")))
    unread = F.col("read").isNull()
    counts = alike.join(marked, "sample_id").groupBy("lang", "bin").agg(
        *[F.sum(F.when(rows, F.col("copies")).otherwise(F.lit(0))).alias(name) for name, rows in (
            ("n", F.lit(True)), ("toxic", F.col("label") == 1), ("n_unread", unread),
            ("toxic_unread", unread & (F.col("label") == 1)))])

    def best(group: pa.Table) -> pa.Table:
        group = group.sort_by([("bin", "descending")])
        place, n, toxic, n_unread, toxic_unread = (
            group.column(c).to_numpy() for c in ("bin", "n", "toxic", "n_unread", "toxic_unread"))
        if toxic_unread.sum() >= fewest:
            n, toxic = n_unread, toxic_unread
        if toxic.sum() < fewest:
            return pa.table({"lang": pa.array([], pa.string()), "threshold": pa.array([], pa.float64())})
        f1 = 2 * np.cumsum(toxic) / (np.cumsum(n) + toxic.sum())
        return pa.table({"lang": group.column("lang")[:1], "threshold": [place[f1.argmax()] / SCORE_BINS]})

    rows = counts.groupBy("lang").applyInArrow(best, "lang string, threshold double").collect()  # a row per language
    return {r["lang"]: r["threshold"] for r in rows}


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id",
        most: int = SAMPLE, label_key: str = "doc_id") -> ConvolutionModel:
    """The model, learnt from the texts of at most ``most`` labelled ids."""
    sample = labelled_sample(labels, "toxic", most, FOLDS, FOLD, label_key)
    texts = docs.select(F.col(key).alias("sample_id"), F.col(text).cast("string").alias("text"))
    hashed = texts.select("*", F.xxhash64("text").alias("own"))
    # One text of each id, whatever the tasks: the one of least hash.
    least = (hashed.join(F.broadcast(sample), "sample_id").groupBy("sample_id", "label")
             .agg(F.min("own").alias("own")))
    least = cut_lineage(least)
    chosen = (hashed.join(F.broadcast(least), ["sample_id", "own"])  # ``most`` ids
              .dropDuplicates(["sample_id"]).select("sample_id", "text", "label"))
    chosen = cut_lineage(chosen)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                hashes, first = word_hashes(*buffer_of(part.column("text")))
                distinct = [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:])]
                toxic = np.repeat(part.column("label").to_numpy(zero_copy_only=False), [len(d) for d in distinct])
                keys, back = np.unique(np.concatenate(distinct), return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.astype(np.int64)), pa.array(np.bincount(back, minlength=len(keys))),
                     pa.array(np.bincount(back, toxic, len(keys)).astype(np.int64))], names=["word", "many", "bad"])

    words = (chosen.mapInArrow(count, "word bigint, many bigint, bad bigint").groupBy("word")
             .agg(F.sum("many").alias("many"), F.sum("bad").alias("bad"))
             .where(F.col("many") >= FEWEST_TEXTS).orderBy("word").toArrow())
    y = chosen.select("sample_id", "label").toArrow()
    order = np.argsort([str(i) for i in y.column("sample_id").to_pylist()], kind="stable")
    known = y.column("label").to_numpy().astype(np.float32)[order]
    model = ConvolutionModel()
    keys, many, bad = (words.column(c).to_numpy() for c in ("word", "many", "bad"))
    if not model.start(keys.astype(np.uint32), many, bad, known):
        return model
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                hashes, first = word_hashes(*buffer_of(part.column("text")))
                rows = sent.value.rows(hashes)
                rows = [sent.value.shortened(rows[a:b]).tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([part.column("sample_id"), pa.array(rows, pa.binary())],
                                                 names=["sample_id", "rows"])

    kind = docs.schema[key].dataType.simpleString()
    found = chosen.mapInArrow(placed, f"sample_id {kind}, rows binary").toArrow()
    order = np.argsort([str(i) for i in found.column("sample_id").to_pylist()], kind="stable")
    rows = found.column("rows").to_pylist()
    model.train([np.frombuffer(rows[i], np.int32) for i in order], known)
    return model


def toxicity_scores(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id",
                    lang: str = "lang", threshold: float = THRESHOLD, most: int = SAMPLE) -> DataFrame:
    """``key, held_out, score, predicted`` of every row, and ``flagged`` by its language's threshold."""
    model = fit(docs, labels, text, key, most)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's words

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                value = sent.value.score(*word_hashes(*buffer_of(part.column("text"))))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("lang"), pa.array(value.astype(float))], names=["key", "lang", "score"])

    kind = docs.schema[key].dataType.simpleString()
    scored = cut_lineage(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"),
                                     F.col(lang).cast("string").alias("lang"))
                         .mapInArrow(score, f"key {kind}, lang string, score double"))
    limit = F.lit(threshold)
    if model.keys is not None:
        by_language = language_thresholds(scored, labels, most=most)
        pairs = [F.lit(x) for pair in sorted(by_language.items()) for x in pair]
        if pairs:
            limit = F.coalesce(F.element_at(F.create_map(*pairs), F.col("lang")), limit)
    return scored.select(F.col("key").alias(key), held_out("key", FOLDS, FOLD).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"), (F.col("score") >= limit).alias("flagged"))
