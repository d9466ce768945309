"""Draw the documents that look most like a target: importance resampling over hashed features.

Texts are split by the public tokenizers library, untrained: ASCII letters are lowered, and a
Split on a regular expression returns the words with their offsets. A feature is a run of
``shortest`` to ``longest`` consecutive words joined by one space: the window from the offset
where its first word begins to the one where its last word ends, in the text of all words
so joined. Its bucket is the CRC-32 of its bytes modulo ``buckets``.

All texts of the corpus are counted into one histogram and all target texts into another.
The gain of a bucket is the floor of 1000 times the log ratio of the two smoothed shares, a
document's weight the sum of its features' gains, and its score the weight plus Gumbel noise
from a hash of its id, so that the highest scores are a sample without replacement. Of the
documents with enough words, the best ``percent`` are drawn and ranked.

A text is split once: its histogram, at most one entry per bucket, is written and read again
for the weights. What is gathered from the corpus is two histograms of ``buckets`` rows, and
only these gains are sent to the tasks. Ranks are numbered by ranges of the score, so no task
sees all rows, and a row's place among equal ones spreads any number of copies.

Null, empty and wordless texts have no features and weight 0, and are not drawn. A null id is
hashed as an empty one and ranks behind others of its score. Repeated rows are drawn each on
its own; they share noise, score and, being equal, any order of their ranks. Without target
texts the gains compare with no counts at all; an empty corpus gives an empty result. Columns other than id
and text are left out, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from racecard.llm.textscan import chunks
from racecard.operators.skew import number_rows
from racecard.session import cut_lineage

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
FEWEST_WORDS = 20
HELD_FEATURES = 500_000
LOWERED = {upper: upper + 32 for upper in range(65, 91)}


class FeatureReader:
    """Buckets of the features of a text, through the library's pre-tokeniser."""

    def __init__(self, word: str, shortest: int, longest: int, buckets: int):
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        self.split = Split(Regex(word), "removed", invert=True)
        self.sizes, self.buckets = range(shortest, longest + 1), buckets
        self.known: dict[bytes, int] = {}

    def words(self, text: str) -> list[tuple[str, tuple[int, int]]]:
        """Every word of the lowered text, with its offsets there."""
        return self.split.pre_tokenize_str(text.translate(LOWERED))

    def features(self, text: str) -> tuple[int, np.ndarray]:
        """How many words a text has, and the bucket of each of its features."""
        words = [word.encode() for word, _ in self.words(text)]
        end = np.cumsum([len(word) + 1 for word in words], dtype=np.int64) - 1
        begin = (end - [len(word) for word in words]).tolist()
        end, joined, found = end.tolist(), b" ".join(words), []
        known = self.known
        for size in self.sizes:
            for first, last in zip(begin, end[size - 1:]):
                feature = joined[first:last]
                bucket = known.get(feature)
                if bucket is None:
                    if len(known) >= HELD_FEATURES:
                        known.clear()
                    bucket = known[feature] = zlib.crc32(feature) % self.buckets
                found.append(bucket)
        return len(words), np.array(found, np.int64)


def histograms(texts: DataFrame, text: str, key: str | None = None, word: str = WORD, shortest: int = 1,
               longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Per row: ``key`` if asked for, ``n_words, n_features``, and its filled buckets with their counts."""
    kept = [] if key is None else [key]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = FeatureReader(word, shortest, longest, buckets)
        for batch in batches:
            for part in chunks(batch, "text"):
                n_words, n_features, filled, counts = [], [], [], []
                for value in part.column("text").fill_null("").to_pylist():
                    n, found = reader.features(value)
                    own, many = np.unique(found, return_counts=True)
                    n_words.append(n)
                    n_features.append(len(found))
                    filled.append(own)
                    counts.append(many)
                stops = pa.array(np.cumsum([0, *map(len, filled)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*([part.column("key")] if kept else []), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()),
                     pa.ListArray.from_arrays(stops, pa.array(np.concatenate(filled), pa.int32())),
                     pa.ListArray.from_arrays(stops, pa.array(np.concatenate(counts), pa.int64()))],
                    names=[*(["key"] if kept else []), "n_words", "n_features", "filled", "counts"])

    kind = [f"key {texts.schema[key].dataType.simpleString()}"] if kept else []
    schema = ", ".join([*kind, "n_words bigint, n_features bigint, filled array<int>, counts array<bigint>"])
    found = (texts.select(*(F.col(c).alias("key") for c in kept), F.col(text).cast("string").alias("text"))
             .mapInArrow(read, schema))
    return found.withColumnRenamed("key", key) if kept else found


def _flat(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of every entry of the histograms of a batch."""
    filled, counts = part.column("filled"), part.column("counts")
    sizes = np.diff(filled.offsets.to_numpy())
    return np.repeat(np.arange(part.num_rows), sizes), filled.flatten().to_numpy(), counts.flatten().to_numpy()


def bucket_totals(found: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: the sum of all histograms, added up in each task before the shuffle."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            _, bucket, n = _flat(batch)
            np.add.at(total, bucket, n)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])

    return (found.select("filled", "counts").mapInArrow(add, "bucket int, n bigint")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * log ratio) of every bucket, from the two totals of at most ``buckets`` rows each."""
    held = []
    for totals in (corpus, target):
        counts = np.zeros(buckets, np.int64)
        rows = totals.toArrow()
        counts[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
        held.append(counts.tolist())
    whole, aimed = sum(held[0]) + buckets, sum(held[1]) + buckets
    return np.array([math.floor(1000 * math.log((t + 1) * whole / ((s + 1) * aimed))) for s, t in zip(*held)], np.int64)


def weights(found: DataFrame, gain: np.ndarray, key: str) -> DataFrame:
    """``key, n_words, n_features, weight``: the sum of the gains of each row's features."""
    sent = found.sparkSession.sparkContext.broadcast(gain)  # one value per bucket

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            row, bucket, n = _flat(part)
            weight = np.zeros(part.num_rows, np.int64)
            np.add.at(weight, row, sent.value[bucket] * n)
            yield pa.RecordBatch.from_arrays([part.column(c) for c in ("key", "n_words", "n_features")] + [pa.array(weight)],
                                             names=["key", "n_words", "n_features", "weight"])

    kind = found.schema[key].dataType.simpleString()
    return (found.select(F.col(key).alias("key"), "n_words", "n_features", "filled", "counts")
            .mapInArrow(add, f"key {kind}, n_words bigint, n_features bigint, weight bigint")
            .withColumnRenamed("key", key))


def resample(docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", shortest: int = 1,
             longest: int = 1, buckets: int = BUCKETS, percent: int = 10, fewest_words: int = FEWEST_WORDS,
             seed: str = "2024") -> DataFrame:
    """``key, n_features, weight, score, rank`` of every document; ``rank`` is null where not drawn."""
    asked = {"shortest": shortest, "longest": longest, "buckets": buckets}
    found = cut_lineage(histograms(docs, text, key, **asked))
    gain = gains(bucket_totals(found, buckets), bucket_totals(histograms(target, text, **asked), buckets), buckets)
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = cut_lineage(weights(found, gain, key).withColumns(
        {"score": (F.col("weight") + noise).cast("bigint"), "may": F.col("n_words") >= fewest_words}))
    eligible = F.col("may")
    most = scored.where(eligible).count() * percent // 100
    placed = scored.withColumn("place", F.monotonically_increasing_id())
    order = [F.col("score").desc(), F.col(key).asc_nulls_last(), F.col("n_features"), F.col("place")]
    numbered = number_rows(placed.where(eligible), "may", order, "rank", hot=[True])
    drawn = F.when(F.col("rank") <= most, F.col("rank")).cast("bigint").alias("rank")
    shown = [key, "n_features", "weight", "score"]
    return numbered.select(*shown, drawn).unionByName(
        scored.where(~eligible).select(*shown, F.lit(None).cast("bigint").alias("rank")))
