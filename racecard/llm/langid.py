"""Language of web pages by Bayesian fusion of four kinds of evidence.

* Text: hashed n-gram multinomials per language, counted over all documents with a known
  language. Their log likelihood is taken as if a text had at most ``TEXT_TOKENS`` n-grams,
  because neighbouring words are not independent.
* Declared language: the ``lang`` of the page's ``html`` tag.
* Address suffix: the last label of the host.
* Host: a prior that shrinks towards its domain's, which shrinks towards that of all pages.

How often each declared language and suffix goes with a language, and the host counts, are
sums of the text's posteriors, grouped over all pages. A page's own share is taken out of
its host's and domain's sums, so that it does not vouch for itself. Sums are of whole
shares of ``UNIT``, so they don't depend on the order of the rows; a posterior under one
share adds nothing to them.

Every language of the documents takes part. The counters of a language grow with the corpus:
they are the power of two next above ``SPREAD`` times the square root of the bytes of all
documents with a language, ``1 << RANGE_BITS`` at least. Log rates are sent to the tasks, at
most ``SENT`` of them at once (``L << RANGE_BITS`` with more than ``SENT >> RANGE_BITS``
languages); each further part is one more pass over the pages, added up per distinct text.
A page's posteriors are one number per language, so memory follows the number of languages.

Null or empty pages have no text, declaration or host and get the prior of all pages; a
null address has the empty host and suffix. Documents without a language are left out, and if
no document has one, every page is returned with null for its languages and probability. Ties
go to the first language by name. Repeated pages are each counted and returned; without pages
the result is empty. Columns other than id, address and markup are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from racecard.llm.quality_rules import grams
from racecard.llm.textscan import buffer_of, chunks
from racecard.session import cut_lineage

SPREAD = 4
RANGE_BITS = 13
SENT = 1 << 24
HELD_GRAMS = 1 << 20
TEXT_TOKENS = 20
PSEUDO = 0.5
UNIT = 1 << 26
HOST_WEIGHT = 5.0
DOMAIN_WEIGHT = 20.0
CHANNEL_WEIGHT = 2.0
NOT_TEXT = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>"


def page_parts(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key, host, domain, suffix, declared, text`` of every page."""
    markup = F.coalesce(F.col(html).cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))
    return pages.select(F.col(key).alias("key"), host.alias("host"), markup.alias("markup")).select(
        "key", "host", F.regexp_extract("host", r"[^.]+(\.[^.]+)?$", 0).alias("domain"),
        F.regexp_extract("host", r"[^.]*$", 0).alias("suffix"),
        F.lower(F.regexp_extract("markup", r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1)).alias("declared"),
        F.regexp_replace("markup", NOT_TEXT, " ").alias("text"))


def counters_for(size: int) -> int:
    """How many counters a language has in a corpus of ``size`` bytes of text."""
    return max(1 << RANGE_BITS, 1 << math.ceil(math.log2(SPREAD * math.sqrt(max(size, 1)))))


def _buckets(column: pa.Array, counters: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, counter) of every single token and every pair of neighbours."""
    doc, hashes = grams(*buffer_of(column))
    return doc, (hashes & np.uint64(counters - 1)).astype(np.int64)


def _summed(cell: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same counts with every cell once, in order."""
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    return cell[first], np.add.reduceat(n[order], first)


def language_counts(docs: DataFrame, languages: list[str], counters: int, text: str = "text",
                    lang: str = "lang") -> DataFrame:
    """``part, n``: n-gram counts over all documents, as arrays of ``1 << RANGE_BITS`` counters.

    The counters of a language follow those of the one before; parts without a count are left out.
    """
    width = 1 << RANGE_BITS

    def packed(cell: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        part, first = np.unique(cell >> RANGE_BITS, return_index=True)
        stops = pa.array(np.append(first, len(cell)).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [pa.array(part), pa.ListArray.from_arrays(stops, pa.array((cell & (width - 1)).astype(np.int16))),
             pa.ListArray.from_arrays(stops, pa.array(n))], names=["part", "at", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {name: i for i, name in enumerate(languages)}
        held, size = [], 0
        for batch in batches:
            for part in chunks(batch, "text"):
                doc, bucket = _buckets(part.column("text"), counters)
                if not len(doc):
                    continue
                own = np.array([place[x] for x in part.column("lang").to_pylist()], np.int64)
                held.append(_summed(own[doc] * counters + bucket, np.ones(len(doc), np.int64)))
                size += len(held[-1][0])
                if size >= HELD_GRAMS:
                    held = [_summed(*map(np.concatenate, zip(*held)))]
                    if len(held[0][0]) >= HELD_GRAMS // 2:
                        yield packed(*held.pop())
                    size = sum(len(x[0]) for x in held)
        if held:
            yield packed(*_summed(*map(np.concatenate, zip(*held))))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            stops = batch.column("at").offsets.to_numpy()
            at, n = (batch.column(c).values.to_numpy() for c in ("at", "n"))
            for part, a, b in zip(batch.column("part").to_pylist(), stops[:-1], stops[1:]):
                total.setdefault(part, np.zeros(width, np.int64))[at[a:b]] += n[a:b]
        for part, held in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([held])], names=["part", "n"])

    known = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    # A task that adds up holds 256 parts of 64 KB on average, whatever the number of languages.
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                len(languages) * (counters >> RANGE_BITS) >> 8)
    return (known.where(F.col("lang").isNotNull())
            .mapInArrow(count, "part bigint, at array<smallint>, n array<bigint>")
            .repartition(tasks, "part").mapInArrow(add, "part bigint, n array<bigint>"))


def rate_slices(counts: DataFrame, n: int, counters: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first counter, log rates of ``n`` languages and successive counters) in parts of ``SENT`` rates."""
    width, ranges = 1 << RANGE_BITS, counters >> RANGE_BITS
    language = F.floor(F.col("part") / ranges)
    whole = np.full(n, PSEUDO * counters)
    sums = counts.select(language.alias("at"), F.aggregate("n", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
    for r in sums.groupBy("at").agg(F.sum("n").alias("n")).collect():  # one row a language
        whole[r["at"]] += r["n"]

    def logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.log(batch.column("n").flatten().to_numpy() + PSEUDO).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), pa.FixedSizeListArray.from_arrays(pa.array(values), width).cast(pa.list_(pa.float32()))],
                names=["part", "logs"])

    most = max(SENT // (n * width), 1)
    for first in range(0, ranges, most):
        last = min(first + most, ranges)
        held = np.full((n, (last - first) * width), math.log(PSEUDO), np.float32)
        rows = (counts.where(F.pmod("part", F.lit(ranges)).between(first, last - 1))
                .mapInArrow(logs, "part bigint, logs array<float>").toArrow())
        for part, own in zip(rows.column("part").to_pylist(), rows.column("logs")):
            at = (part % ranges - first) * width
            held[part // ranges, at: at + width] = own.values.to_numpy()
        held -= np.log(whole)[:, None].astype(np.float32)
        yield first * width, held


def _likelihoods(parts: DataFrame, names: list[str], counters: int, first: int, rates) -> DataFrame:
    """``names``, the number of n-grams and, per language, the sum of those log rates that are given."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                doc, bucket = _buckets(part.column("text"), counters)
                many = np.bincount(doc, minlength=part.num_rows)
                here = (bucket >= first) & (bucket < first + rates.value.shape[1])
                doc, bucket = doc[here], bucket[here] - first
                score = np.stack([np.bincount(doc, rate[bucket], part.num_rows) for rate in rates.value], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), pa.array(many), pa.array(list(score.astype(float)), pa.list_(pa.float64()))],
                    names=[*names, "many", "score"])

    kinds = {f.name: f.dataType.simpleString() for f in parts.schema.fields}
    return parts.select(*names, "text").mapInArrow(
        judge, ", ".join(f"{c} {kinds[c]}" for c in names) + ", many bigint, score array<double>")


def text_posteriors(parts: DataFrame, counts: DataFrame, n: int, counters: int) -> DataFrame:
    """``parts`` without the text, with ``seen``: the posterior of each of ``n`` languages by the text alone."""
    names = [c for c in parts.columns if c != "text"]
    context = parts.sparkSession.sparkContext
    slices = [(first, context.broadcast(rates)) for first, rates in rate_slices(counts, n, counters)]
    texts = parts.withColumn("row", F.xxhash64("text"))
    scored = _likelihoods(texts, [*names, "row"], counters, *slices[0])
    if len(slices) > 1:
        further = reduce(DataFrame.unionByName, [
            _likelihoods(texts, ["row"], counters, *s).withColumn("first", F.lit(s[0])) for s in slices[1:]])
        # Copies of a text have equal sums, which the set keeps once: one array per slice.
        more = further.groupBy("row").agg(F.collect_set(F.struct("first", "score")).alias("more"))
        add = F.aggregate(F.sort_array("more"), F.col("score"), lambda done, x: F.zip_with(done, x["score"], lambda a, b: a + b))
        scored = scored.join(more, "row").withColumn("score", add)

    def posterior(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = batch.column("many").to_numpy()
            score = batch.column("score").flatten().to_numpy().reshape(-1, n)
            score = score * (np.minimum(many, TEXT_TOKENS) / np.maximum(many, 1))[:, None]
            score = np.exp(score - score.max(axis=1, keepdims=True))
            score /= score.sum(axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(list(score), pa.list_(pa.float64()))], names=[*names, "seen"])

    kinds = {f.name: f.dataType.simpleString() for f in parts.schema.fields}
    return scored.select(*names, "many", "score").mapInArrow(
        posterior, ", ".join(f"{c} {kinds[c]}" for c in names) + ", seen array<double>")


def sums_by(seen: DataFrame, column: str, name: str) -> DataFrame:
    """``column`` and, as ``at, n`` of the languages that have any, the whole shares of its rows."""
    shares = (seen.select(column, F.posexplode("seen").alias("at", "p"))
              .select(column, "at", F.floor(F.col("p") * UNIT).alias("n")).where("n > 0"))
    # At most one row per language is left of a group before its rows are listed.
    return (shares.groupBy(column, "at").agg(F.sum("n").alias("n"))
            .groupBy(column).agg(F.collect_list(F.struct("at", "n")).alias(name)))


def _spread_out(column: pa.Array, n: int) -> np.ndarray:
    """A row of ``n`` sums of posteriors for each list of ``at, n``."""
    stops = column.offsets.to_numpy()
    held = column.values.slice(stops[0], stops[-1] - stops[0])
    out = np.zeros((len(column), n))
    out[np.repeat(np.arange(len(column)), np.diff(stops)), held.field("at").to_numpy()] = held.field("n").to_numpy() / UNIT
    return out


def fused(seen: np.ndarray, sums: dict[str, np.ndarray], every: np.ndarray) -> np.ndarray:
    """Posterior of each language (columns) of each page (rows) by all evidence.

    ``every`` holds the posteriors' sums over all pages, ``sums`` those over the pages with
    the same host, domain, declaration or suffix, in whole shares.
    """
    own_share = np.floor(seen * UNIT) / UNIT
    others = {name: np.maximum(s - own_share, 0) for name, s in sums.items()}

    def shrunk(own: np.ndarray, above: np.ndarray, weight: float) -> np.ndarray:
        return (own + weight * above) / (own.sum(axis=1, keepdims=True) + weight)

    def channel(name: str) -> np.ndarray:
        share = sums[name].sum(axis=1, keepdims=True) / every.sum()
        return (others[name] + CHANNEL_WEIGHT * share) / (every + CHANNEL_WEIGHT)

    prior = shrunk(others["by_host"], shrunk(others["by_domain"], every / every.sum(), DOMAIN_WEIGHT), HOST_WEIGHT)
    score = np.maximum(seen, 1e-12) * prior * channel("by_declared") * channel("by_suffix")
    return score / score.sum(axis=1, keepdims=True)


def identify(pages: DataFrame, docs: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
             text: str = "text", lang: str = "lang") -> DataFrame:
    """``key, lang, probability, text_lang, declared`` of every page."""
    sizes = (docs.select(F.col(lang).cast("string").alias("lang"), F.octet_length(F.col(text).cast("string")).alias("size"))
             .where("lang is not null").groupBy("lang").agg(F.sum("size").alias("size")).collect())  # one row a language
    languages = sorted(r["lang"] for r in sizes)
    n, counters = len(languages), counters_for(sum(r["size"] or 0 for r in sizes))
    parts = page_parts(pages, key, url, html)
    if not n:
        return parts.select(F.col("key").alias(key), F.lit(None).cast("string").alias("lang"),
                            F.lit(None).cast("double").alias("probability"),
                            F.lit(None).cast("string").alias("text_lang"), "declared")
    counts = cut_lineage(language_counts(docs, languages, counters, text, lang))
    seen = cut_lineage(text_posteriors(parts, counts, n, counters))

    every = np.ones(n)
    for r in sums_by(seen.withColumn("all", F.lit(0)), "all", "sums").select(F.inline("sums")).collect():
        every[r["at"]] += r["n"] / UNIT
    groups = {"by_host": "host", "by_domain": "domain", "by_declared": "declared", "by_suffix": "suffix"}
    joined = seen
    for name, column in groups.items():
        joined = joined.join(sums_by(seen, column, name), column)
    rows = max(HELD_GRAMS // n, 1)

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(first, rows) for whole in batches for first in range(0, whole.num_rows, rows)):
            seen = batch.column("seen").flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            chance = fused(seen, {c: _spread_out(batch.column(c), n) for c in groups}, every)
            best, alone = chance.argmax(axis=1), seen.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array([languages[i] for i in best], pa.string()),
                 pa.array(chance[np.arange(len(best)), best]), pa.array([languages[i] for i in alone], pa.string()),
                 batch.column("declared")], names=["key", "lang", "probability", "text_lang", "declared"])

    kind = pages.schema[key].dataType.simpleString()
    return (joined.select("key", "declared", "seen", *groups)
            .mapInArrow(fuse, f"key {kind}, lang string, probability double, text_lang string, declared string")
            .withColumnRenamed("key", key))
