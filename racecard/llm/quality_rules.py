"""Quality rules: base statistics of every text, and an n-gram log-likelihood ratio.

Two multinomials over hashed n-grams (single tokens and pairs; a token is a run of letters
and digits or a run of other symbols) are counted over the corpus: one from trusted texts,
one from all texts. The score of a text is the mean over its n-grams of log p(trusted) -
log p(all), rounded to ``DIGITS`` places. Texts of at least ``threshold`` pass; there is no
sampling, so equal texts get equal verdicts.

Trusted texts are all those that the labels call good, and every n-gram of every text counts.
N-grams of one hash bucket share a counter. Their number grows with the corpus: it is the
power of two next above ``SPREAD`` times the square root of the bytes of text, so a text that
is four times as much has twice the counters. Two given n-grams share one with a chance of
one in the number of counters; with d distinct n-grams, a share of 1 - exp(-d / counters) of
them shares its counter with some other (``shared_counters`` measures it).

Tasks add up their own counts and return them as packed ranges of counters, each range is
added up as a stream, and the ratios are sent to the tasks, at most ``SENT`` of them at once.
Beyond that, each part of the counters is one more pass over the texts, whose sums per
distinct text are added by a join; scores are the same. No text is moved to meet its label as
long as the trusted ids take at most ``SENT_IDS`` (they are sent instead); beyond that, by
a join.

Null and empty texts have no words and fail the base rule, as does any text under 50
words. With no trusted text at all, both multinomials count as equal and only the base
rules decide. Repeated rows are judged alike, row by row; a row without an id matches no label.
Other columns, whatever their names, are kept by ``keep_good`` and left out by ``judge``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from racecard.llm.samples import unused_prefix
from racecard.llm.textscan import (
    BASE, IS_SPACE, IS_WORDLIKE, Words, any_of, buffer_of, chunks, counts_of, lines, mix, repeated,
    runs, span_hashes, windows, within_text,
)
from racecard.session import cut_lineage

SPREAD = 64
SENT = 1 << 24
SENT_IDS = 1 << 22
RANGE_BITS = 13
HELD_GRAMS = 1 << 19
SCANNED_BYTES = 1 << 19  # of text at a time: as n-grams a text takes many times its bytes
DIGITS = 9
THRESHOLD = -0.03
PRIOR = 50  # pseudo-counts per counter
FEWEST_WORDS = 50
MOST_REPEATED_PERCENT = 50
SYMBOLS = any_of("#*$%&|<>")

COLUMNS = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
           "n_repeat_words bigint")


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The five base counts of every text of a batch."""
    words = Words(data, offsets)
    texts = len(offsets) - 1
    following = counts_of((data & 0xC0) == 0x80, offsets)  # bytes inside a character
    start, end, doc = lines(data, offsets)
    _, later = repeated(within_text(doc, span_hashes(data, start, end)))
    at, hashes = windows(words.hash, words.first, 3)
    again, _ = repeated(within_text(words.doc[at], hashes))
    covered = np.zeros(len(words.hash), bool)
    for place in range(3):
        covered[at[again] + place] = True
    return {
        "n_words": words.count,
        "word_chars": np.bincount(words.doc, words.end - words.start, texts).astype(np.int64) - following,
        "n_symbols": counts_of(SYMBOLS[data], offsets),
        "n_dup_lines": np.bincount(doc[later], minlength=texts),
        "n_repeat_words": np.bincount(words.doc[covered], minlength=texts),
    }


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every single token and every pair of neighbours."""
    letters = IS_WORDLIKE[data]
    start, end = (np.concatenate(x) for x in zip(runs(letters, offsets), runs(~letters & ~IS_SPACE[data], offsets)))
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    hashes = span_hashes(data, start, end)
    doc = np.searchsorted(offsets, start, side="right") - 1
    pair = doc[1:] == doc[:-1]
    pairs = mix(hashes[:-1][pair] * BASE + hashes[1:][pair])
    return np.concatenate([doc, doc[1:][pair]]), np.concatenate([hashes, pairs])


def counters_for(size: int) -> int:
    """How many counters a corpus of ``size`` bytes of text has."""
    return max(1 << RANGE_BITS, 1 << math.ceil(math.log2(SPREAD * math.sqrt(max(size, 1)))))


def _bucket(hashes: np.ndarray, counters: int) -> np.ndarray:
    return (hashes & np.uint64(counters - 1)).astype(np.int64)


def _summed(bucket: np.ndarray, trusted: np.ndarray, every: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same counts with every bucket once, in order."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    return bucket[first], np.add.reduceat(trusted[order], first), np.add.reduceat(every[order], first)


def _marked(docs: DataFrame, labels: DataFrame, text: str, key: str, label_key: str):
    """``key, text, trusted``, and a broadcast of the sorted trusted ids where they are few enough (else None)."""
    good = (labels.where("quality = 1").select(F.col(label_key).cast("bigint").alias("key")).dropna().distinct())
    texts = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    ids = good.limit(SENT_IDS + 1).toArrow().column("key").to_numpy()
    if len(ids) <= SENT_IDS:
        return texts.withColumn("trusted", F.lit(False)), docs.sparkSession.sparkContext.broadcast(np.sort(ids))
    # Rows without an id match no label; they stay out of the join, where they would share a task.
    named = (texts.where("key is not null").join(good.withColumn("trusted", F.lit(True)), "key", "left")
             .withColumn("trusted", F.coalesce("trusted", F.lit(False))))
    return named.unionByName(texts.where("key is null").withColumn("trusted", F.lit(False))), None


def _packed(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Counts as one row per range of counters."""
    width = 1 << RANGE_BITS
    bucket, trusted, every = _summed(*map(np.concatenate, zip(*held)))
    part, first = np.unique(bucket >> RANGE_BITS, return_index=True)
    stops = pa.array(np.append(first, len(bucket)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(part), *(pa.ListArray.from_arrays(stops, pa.array(x)) for x in (
            (bucket & (width - 1)).astype(np.int16), trusted.astype(np.int32), every.astype(np.int32)))],
        names=["part", "at", "trusted", "every"])


def _counted(batches: Iterator[pa.RecordBatch], trusts: Callable, counters: int) -> Iterator[pa.RecordBatch]:
    """Packed counts of the texts of a task; ``trusts`` tells which rows of a batch are trusted."""
    held, size = [], 0
    for batch in batches:
        for part in chunks(batch, "text", SCANNED_BYTES):
            doc, hashes = grams(*buffer_of(part.column("text")))
            if not len(doc):
                continue
            held.append(_summed(_bucket(hashes, counters), trusts(part)[doc].astype(np.int64), np.ones(len(doc), np.int64)))
            size += len(held[-1][0])
            if size >= HELD_GRAMS:
                held = [_summed(*map(np.concatenate, zip(*held)))]
                if len(held[0][0]) >= HELD_GRAMS // 2:
                    yield _packed(held)
                    held = []
                size = sum(len(x[0]) for x in held)
    if held:
        yield _packed(held)


def gram_counts(docs: DataFrame, labels: DataFrame, counters: int, text: str = "text", key: str = "doc_id",
                label_key: str = "doc_id") -> DataFrame:
    """``part, trusted, every``: per range of counters, the counts in the trusted texts and in all texts."""
    texts, sent = _marked(docs, labels, text, key, label_key)
    width = 1 << RANGE_BITS

    def trusts(part: pa.RecordBatch) -> np.ndarray:
        if sent is None:
            return part.column("trusted").to_numpy(zero_copy_only=False)
        keys = part.column("key")
        wanted = keys.fill_null(0).to_numpy(zero_copy_only=False)
        place = np.searchsorted(sent.value, wanted)
        known = np.append(sent.value, 0)[place] == wanted
        return known & (place < len(sent.value)) & keys.is_valid().to_numpy(zero_copy_only=False)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _counted(batches, trusts, counters)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            stops = batch.column("at").offsets.to_numpy()
            at, trusted, every = (batch.column(c).values.to_numpy() for c in ("at", "trusted", "every"))
            for part, a, b in zip(batch.column("part").to_pylist(), stops[:-1], stops[1:]):
                held = total.setdefault(part, np.zeros((2, width), np.int64))
                held[0, at[a:b]] += trusted[a:b]
                held[1, at[a:b]] += every[a:b]
        for part, held in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), *(pa.array([x]) for x in held)],
                                             names=["part", "trusted", "every"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (texts.mapInArrow(count, "part bigint, at array<smallint>, trusted array<int>, every array<int>")
            .repartition(parts, "part")
            .mapInArrow(add, "part bigint, trusted array<bigint>, every array<bigint>"))


def shared_counters(distinct: int, counters: int) -> float:
    """The expected share of ``distinct`` n-grams that share their counter with another one."""
    return 1 - math.exp(-(distinct - 1) / counters) if distinct else 0.0


class Ratios:
    """log p(trusted) - log p(all) of every counter, read from the table of counts in parts.

    The share of a counter's occurrences that lies in trusted texts is taken as if ``PRIOR``
    more had the share of all: what few occurrences say little about scores near 0, at any
    corpus size.
    """

    def __init__(self, counts: DataFrame, counters: int):
        self.counts, self.counters, k = counts, counters, float(PRIOR)

        def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                trusted, every = (batch.column(c).flatten().to_numpy().reshape(-1, 1 << RANGE_BITS) for c in ("trusted", "every"))
                sums = [trusted.sum(axis=1), every.sum(axis=1), (every * trusted / (every + k)).sum(axis=1),
                        (every / (every + k)).sum(axis=1)]
                yield pa.RecordBatch.from_arrays([batch.column("part"), *map(pa.array, sums)],
                                                 names=["part", "trusted", "every", "own", "prior"])

        # One row per range of counters; added up exactly, so their order does not matter.
        rows = counts.mapInArrow(totals, "part bigint, trusted bigint, every bigint, own double, prior double").collect()
        self.trusted, self.every = (sum(r[c] for r in rows) for c in ("trusted", "every"))
        if self.trusted:
            self.share = self.trusted / self.every
            self.whole = (math.fsum(r["own"] for r in rows) + k * self.share * math.fsum(r["prior"] for r in rows)) / self.trusted

    def slices(self) -> Iterator[tuple[int, np.ndarray]]:
        """(first counter, values) of at most ``SENT`` successive counters each; nothing without trusted texts."""
        if not self.trusted:
            return
        width, most = 1 << RANGE_BITS, max(SENT >> RANGE_BITS, 1)
        share, whole = self.share, self.whole

        def ratios(trusted: np.ndarray, every: np.ndarray) -> np.ndarray:
            return np.log((trusted + PRIOR * share) / ((every + PRIOR) * share * whole)).astype(np.float32)

        def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = ratios(*(batch.column(c).flatten().to_numpy() for c in ("trusted", "every")))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("part"), pa.ListArray.from_arrays(batch.column("every").offsets, pa.array(found))],
                    names=["part", "values"])

        for first in range(0, self.counters >> RANGE_BITS, most):
            last = min(first + most, self.counters >> RANGE_BITS)
            held = np.repeat(ratios(np.zeros(1), np.zeros(1)), (last - first) * width)
            rows = (self.counts.where(F.col("part").between(first, last - 1))
                    .mapInArrow(values, "part bigint, values array<float>").toArrow())
            for part, own in zip(rows.column("part").to_pylist(), rows.column("values")):
                held[(part - first) * width: (part - first + 1) * width] = own.values.to_numpy()
            yield first * width, held


def text_sums(column: pa.Array, counters: int, first: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: how many n-grams it has, and the sum of the values of those whose counters are given."""
    doc, hashes = grams(*buffer_of(column))
    at = _bucket(hashes, counters) - first
    here = (at >= 0) & (at < len(values))
    return np.bincount(doc, minlength=len(column)), np.bincount(doc[here], values[at[here]], len(column)).astype(float)


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id",
          threshold: float = THRESHOLD) -> DataFrame:
    """``key``, the base counts, ``base_failed``, ``score`` and ``kept`` for every row."""
    return verdicts(docs, labels, text, key, threshold, kept=[key])


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns."""
    prefix = unused_prefix("_rules_", docs)
    return verdicts(docs, labels, text, key, prefix=prefix).where(f"`{prefix}kept`").select(*(f"`{c}`" for c in docs.columns))


def verdicts(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id",
             threshold: float = THRESHOLD, prefix: str = "", kept: list[str] | None = None) -> DataFrame:
    """The columns ``kept`` of ``docs`` (all by default), then the verdict's, their names after ``prefix``.

    A column of ``docs`` that has the name of one of the verdict's is left out.
    """
    kinds = f"{COLUMNS}, base_failed boolean".split(", ")
    found = [prefix + c.split()[0] for c in kinds]
    own = [c for c in kept or docs.columns if c not in [*found, f"{prefix}score", f"{prefix}kept"]]
    context = docs.sparkSession.sparkContext
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text).cast("string"))), F.lit(0))).first()[0]
    counters = counters_for(size)
    ratios = Ratios(cut_lineage(gram_counts(docs, labels, counters, text, key)), counters)
    sums = [(first, context.broadcast(values)) for first, values in ratios.slices()]
    here = unused_prefix("_gram_", docs)
    told = [f"{here}{c}" for c in ("row", "n", "sum")]
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    # A text that is returned is not sent to the tasks twice.
    read = text if text in own and fields[text] == "string" else f"{here}text"
    schema = ", ".join([f"`{c}` {fields[c]}" for c in own] + [f"`{prefix}{c.split()[0]}` {c.split()[1]}" for c in kinds]
                       + [f"`{told[0]}` bigint, `{told[1]}` bigint, `{told[2]}` double"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, read, SCANNED_BYTES):
                body = part.column(read)
                counts = base_counts(*buffer_of(body))
                n, total = text_sums(body, counters, *((sums[0][0], sums[0][1].value) if sums else (0, np.zeros(0))))
                failed = ((counts["n_words"] < FEWEST_WORDS)
                          | (100 * counts["n_repeat_words"] > MOST_REPEATED_PERCENT * counts["n_words"]))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in own), *(pa.array(v.astype(np.int64)) for v in counts.values()),
                     pa.array(failed), part.column(f"{here}row"), pa.array(n), pa.array(total)], names=[*own, *found, *told])

    body = F.col(text).cast("string")
    texts = docs.select(*(f"`{c}`" for c in own), *([] if read == text else [body.alias(read)]),
                        F.xxhash64(body).alias(f"{here}row"))
    judged = texts.mapInArrow(score, schema)
    total = F.col(f"`{told[2]}`")
    if len(sums) > 1:
        judged = judged.join(_further_sums(texts, read, here, counters, sums[1:]), told[0])
        total = total + F.col(f"`{here}more`")
    value = F.round(total / F.greatest(F.col(f"`{told[1]}`"), F.lit(1)), DIGITS)
    return judged.withColumn(f"{prefix}score", value).select(
        *(f"`{c}`" for c in own), *(f"`{c}`" for c in found), f"`{prefix}score`",
        (~F.col(f"`{prefix}base_failed`") & (F.col(f"`{prefix}score`") >= threshold)).alias(f"{prefix}kept"))


def _further_sums(texts: DataFrame, read: str, here: str, counters: int, sums: list) -> DataFrame:
    """Per hash of a text, the sum of its values in further parts of the counters, one pass over the texts each."""

    def passed(first, sent):
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch, read, SCANNED_BYTES):
                    _, total = text_sums(part.column(read), counters, first, sent.value)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(f"{here}row"), pa.array(np.full(len(total), first)), pa.array(total)],
                        names=[f"{here}row", "first", "total"])

        return add

    rows = reduce(DataFrame.unionByName, [
        texts.select(f"`{read}`", f"{here}row").mapInArrow(passed(*s), f"`{here}row` bigint, first bigint, total double")
        for s in sums])
    # Copies of a text have equal sums; one of them counts.
    return (rows.groupBy(f"{here}row", "first").agg(F.max("total").alias("total"))
            .groupBy(f"{here}row").agg(F.sum("total").alias(f"{here}more")))
