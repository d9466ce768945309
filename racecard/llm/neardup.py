"""Near duplicates: banded MinHash candidates, sequential Bayesian verification, exact check.

1. Every text becomes the set of its shingles (64-bit hashes of ``words`` successive words,
   A-Z lower-cased), its size, a hash of the set, and ``HASHES`` minima. Texts with equal
   sets are one class; only classes are compared.
2. Classes that agree in a band of ``ROWS_PER_BAND`` minima share a bucket. The number of
   bands follows from the threshold, so that a pair at the threshold shares no bucket with
   a chance under ``MISS``.
3. First, every class is compared with the least class of each of its buckets: one pair per
   class and bucket however large the bucket. The links found join most members of a
   bucket into one component. Then, in buckets that still hold several components, the
   classes of different components are compared; large buckets in blocks of bounded size,
   where a pair is also checked in full and only links leave the block. No pair of one
   component is compared again, and no bucket is cut.
4. A comparison reads the signatures in batches and stops as soon as the posterior chance
   that the similarity reaches the threshold (uniform prior, binomial matches) falls under
   a limit. The limit is set so that a pair at the threshold is stopped at any of the looks
   with a chance of at most ``MISS`` in all. Survivors are checked on the full shingle sets.
5. Links become components (``graph.components``), and each document gets the smallest
   id of its component.

A null or empty text has no shingles and is linked with nothing; a text with fewer words
than a shingle has its whole word sequence as the only one. Repeated rows, also of one id,
are each returned, with the same component if their texts are linked. An empty table gives
an empty result. Rows without an id are linked with nothing but rows of an equal set.
Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from racecard.llm.graph import components, first_labels
from racecard.llm.samples import unused_prefix
from racecard.llm.textscan import BASE, Words, _splitmix, buffer_of, chunks, mix, windows
from racecard.session import cut_lineage

WORDS = 5
THRESHOLD_PERCENT = 80
HASHES = 256
ROWS_PER_BAND = 6
MISS = 1e-5
STEP = 32
BLOCK = 1024
BLOCK_SHINGLES = 1 << 19
SMALL_BUCKET = 24
HOT_PARTS = 4
BITMAP_BITS = 1 << 23
FACTORS = (_splitmix(HASHES, 41) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def bands_for(threshold: float, rows: int = ROWS_PER_BAND, miss: float = MISS) -> int:
    """Bands that a pair at the threshold misses with a chance of at most ``miss``."""
    return min(HASHES // rows, ceil(log(miss) / log(1 - threshold**rows)))


def least_matches(threshold: float, miss: float = MISS) -> np.ndarray:
    """For every number of compared minima, the fewest matches that keep a pair.

    The limit of the posterior is halved until all looks together lose a pair at the
    threshold with a chance of at most ``miss``.
    """
    limit = miss
    while lost(threshold, needed := _above(threshold, limit)) > miss:
        limit /= 2
    return needed


def _above(threshold: float, limit: float) -> np.ndarray:
    """For every number of minima, the fewest matches whose posterior reaches ``limit``.

    With m of n matches the posterior of the similarity is Beta(m + 1, n - m + 1). Its mass
    above the threshold is the chance of at most m successes in n + 1 trials.
    """
    out = np.zeros(HASHES + 1, np.int64)
    for n in range(1, HASHES + 1):
        chance, mass, keep = (1 - threshold) ** (n + 1), 0.0, n + 1
        for m in range(n + 1):
            mass += chance
            if mass >= limit:
                keep = m
                break
            chance *= (n + 1 - m) / (m + 1) * threshold / (1 - threshold)
        out[n] = keep
    return out


def lost(similarity: float, needed: np.ndarray) -> float:
    """Chance that a pair is stopped at any look, from look to look by its number of matches."""
    step = np.array([comb(STEP, m) * similarity**m * (1 - similarity) ** (STEP - m) for m in range(STEP + 1)])
    alive, stopped = np.ones(1), 0.0
    for n in range(STEP, HASHES + 1, STEP):
        alive = np.convolve(alive, step)
        stopped += alive[: needed[n]].sum()
        alive[: needed[n]] = 0
    return float(stopped)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct shingles of every text, by text and hash."""
    words = Words(data, offsets, fold=True)
    at, hashes = windows(words.hash, words.first, size)
    doc = words.doc[at]
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for place in range(size - 1):
            has = words.count[short] > place
            whole[has] = whole[has] * BASE + words.hash[words.first[short[has]] + place]
        hashes = np.concatenate([hashes, mix(whole + words.count[short].astype(np.uint64))])
        doc = np.concatenate([doc, short])
    # Distinct within a text: the order is by text, then by a hash that differs between texts.
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[new], hashes[new]


def signatures(docs: DataFrame, text: str, key: str, words: int, bands: int) -> DataFrame:
    """``key, row, n_shingles, node, signature, bands``; the last three are null without shingles.

    ``row`` is a hash of the text, which tells rows of one id apart.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                doc, hashes = shingles(*buffer_of(part.column("text")), words)
                count = np.bincount(doc, minlength=part.num_rows)
                held = np.flatnonzero(count)
                first = np.searchsorted(doc, held)
                folded = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
                least = np.empty((len(held), HASHES), np.uint32)
                if len(held):
                    for i, factor in enumerate(FACTORS):
                        least[:, i] = np.minimum.reduceat(folded * factor, first)
                rows = least[:, : bands * ROWS_PER_BAND].astype(np.uint64).reshape(len(held), bands, ROWS_PER_BAND)
                buckets = np.zeros(rows.shape[:2], np.uint64)
                for i in range(ROWS_PER_BAND):
                    buckets = buckets * BASE + rows[:, :, i]
                buckets = mix(buckets + np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0xC2B2AE3D27D4EB4F))
                total = np.add.reduceat(mix(hashes + np.uint64(5)), first) if len(held) else hashes[:0]
                other = np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), first) if len(held) else hashes[:0]
                blank = np.ones(part.num_rows, bool)
                blank[held] = False
                place = np.zeros(part.num_rows, np.int64)
                place[held] = np.arange(len(held))
                small = (least >> np.uint32(16)).astype("<u2")

                def spread(values, kind):
                    return pa.array(values, kind).take(pa.array(place, mask=blank))

                sets = [total[i].tobytes() + other[i].tobytes() for i in range(len(held))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("row"), pa.array(count.astype(np.int64)), spread(sets, pa.binary()),
                     spread([row.tobytes() for row in small], pa.binary()),
                     spread(list(buckets.astype(np.int64)), pa.list_(pa.int64()))],
                    names=["key", "row", "n_shingles", "set_hash", "signature", "bands"])

    kind = docs.schema[key].dataType.simpleString()
    return (docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
            .select("key", "text", F.xxhash64("text").alias("row"))
            .mapInArrow(sign, f"key {kind}, row bigint, n_shingles bigint, set_hash binary, "
                              "signature binary, bands array<bigint>")
            .select("key", "row", "n_shingles", "signature", "bands",
                    F.when(F.col("n_shingles") > 0, F.xxhash64("n_shingles", "set_hash")).alias("node")))


def surviving(pairs: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``a, b`` of nodes whose signatures leave the threshold possible."""
    needed = least_matches(threshold)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, HASHES)
                           for c in ("sa", "sb"))
            live = np.arange(batch.num_rows)
            matches = np.zeros(batch.num_rows, np.int64)
            for n in range(STEP, HASHES + 1, STEP):
                matches[live] += (left[live, n - STEP: n] == right[live, n - STEP: n]).sum(axis=1)
                live = live[matches[live] >= needed[n]]
            yield batch.select(["a", "b"]).take(pa.array(live))

    return (pairs.join(signed.select(F.col("node").alias("a"), F.col("signature").alias("sa")), "a")
            .join(signed.select(F.col("node").alias("b"), F.col("signature").alias("sb")), "b")
            .select("a", "b", "sa", "sb").mapInArrow(compare, "a bigint, b bigint"))


def in_blocks(members: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components in large buckets.

    ``members`` has ``bucket, node, root, n, size``: how many classes and shingles the
    bucket holds. A bucket is dealt by hash into blocks of about ``BLOCK`` classes and
    ``BLOCK_SHINGLES`` shingles; every two blocks meet in one group, so a group is bounded
    whatever the bucket. A pair that shares several buckets is compared in its first one.
    """
    needed = least_matches(percent / 100)
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("size") / BLOCK_SHINGLES)).cast("int")
    dealt = (members.withColumn("blocks", blocks)
             .withColumn("own", F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"),
                     "own", "node", "root")
             .join(nodes.select("node", "signature", "bands"), "node").join(sets, "node"))

    def meet(group: pa.Table) -> pa.Table:
        node, root, own = (group.column(c).to_numpy() for c in ("node", "root", "own"))
        signature = np.frombuffer(b"".join(group.column("signature").to_pylist()), "<u2").reshape(-1, HASHES)
        bands = group.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        shingles = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        bucket, x, y = (group.column(c)[0].as_py() for c in ("bucket", "x", "y"))
        band = (bands[0] == bucket).argmax()
        found = []
        for i in np.flatnonzero(own == x):
            live = np.flatnonzero((own == y) & (root != root[i]) & ((x != y) | (node > node[i])))
            matches = np.zeros(len(node), np.int64)
            for n in range(STEP, HASHES + 1, STEP):
                if not len(live):
                    break
                matches[live] += (signature[live, n - STEP: n] == signature[i, n - STEP: n]).sum(axis=1)
                live = live[matches[live] >= needed[n]]
            live = live[(bands[live] == bands[i]).argmax(axis=1) == band]
            found += [(node[i], node[j]) for j in live if similar(shingles[i], shingles[j], percent)]
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return dealt.groupBy("bucket", "x", "y").applyInArrow(meet, "a bigint, b bigint")


def similar(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= ``percent`` * union, for arrays of distinct shingles."""
    if 100 * min(len(left), len(right)) < percent * max(len(left), len(right)):
        return False
    both = np.sort(np.concatenate([left, right]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def shingle_sets(docs: DataFrame, wanted: DataFrame, text: str, key: str, words: int) -> DataFrame:
    """``node, shingles`` of the nodes in ``wanted`` (``node, key, row``), read again from their texts.

    A text is found by its id and its own hash, as rows of one id may differ. Which rows to
    read is first narrowed by a bitmap of hashed pairs of fixed size; its false hits are
    dropped by the join that follows.
    """
    bit = F.pmod(F.xxhash64("key", "row"), F.lit(BITMAP_BITS))
    words_of_bits = (wanted.select(bit.alias("bit")).groupBy(F.shiftright("bit", 5).cast("int").alias("at"))
                     .agg(F.expr("bit_or(shiftleft(1L, cast(bit % 32 AS int)))").alias("bits"))
                     .collect())  # at most BITMAP_BITS / 32 rows
    bitmap = np.zeros(BITMAP_BITS // 32, np.uint32)
    bitmap[[r["at"] for r in words_of_bits]] = [r["bits"] for r in words_of_bits]
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("bit").to_numpy()
            hit = (sent.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1
            for part in chunks(batch.filter(pa.array(hit == 1)), "text"):
                doc, hashes = shingles(*buffer_of(part.column("text")), words)
                cuts = np.searchsorted(doc, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("row"),
                     pa.array([hashes[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())],
                    names=["key", "row", "shingles"])

    kind = docs.schema[key].dataType.simpleString()
    sets = (docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
            .select("key", "text", F.xxhash64("text").alias("row"))
            .select("key", "row", "text", bit.alias("bit")).mapInArrow(read, f"key {kind}, row bigint, shingles binary"))
    return wanted.join(sets, ["key", "row"]).groupBy("node").agg(F.first("shingles").alias("shingles"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= ``percent`` * union."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i, (a, b) in enumerate(zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist())):
                if similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent):
                    good.append(i)
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    return (pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("xa")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("xb")), "b")
            .select("a", "b", "xa", "xb").mapInArrow(check, "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS,
                    percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """``key, n_shingles, component_id, kept`` for every row of ``docs``."""
    found = grouped(docs, text, key, words, percent)
    own = F.coalesce("component_id", "key")
    return found.select(F.col("key").alias(key), "n_shingles", own.alias("component_id"),
                        F.col("key").eqNullSafe(own).alias("kept"))


def without_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS,
                            percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, and of its rows the least hash.

    A row without an id is taken only where its component has no id at all. Rows without
    shingles stay, once per id and text.
    """
    found = cut_lineage(grouped(docs, text, key, words, percent).select("key", "row", "root", "n_shingles"))
    prefix = unused_prefix("_near_", docs)
    row, kept_key, kept_row = (prefix + name for name in ("row", "kept_key", "kept_row"))
    linked = (found.where("n_shingles > 0").groupBy("root")
              .agg(F.min(F.struct(F.col("key").isNull().alias("unnamed"), "key", "row")).alias("least")))
    kept = (linked.select("least.key", "least.row")
            .unionByName(found.where("n_shingles = 0").select("key", "row")).distinct()
            .select(F.col("key").alias(kept_key), F.col("row").alias(kept_row)))
    return (docs.withColumn(row, F.xxhash64(F.col(text).cast("string")))
            .join(kept, F.col(key).eqNullSafe(F.col(kept_key)) & (F.col(row) == F.col(kept_row)), "left_semi")
            .dropDuplicates([key, row]).drop(row))


def _hot_buckets(shared: DataFrame) -> DataFrame:
    """``bucket`` of those that hold more than one part in ``HOT_PARTS`` per shuffle partition of all members.

    So they are at most ``HOT_PARTS`` per shuffle partition, and any other bucket fits a task.
    """
    parts = HOT_PARTS * int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = shared.agg(F.sum("n")).first()[0] or 0
    return shared.where(F.col("n") * parts > members).select("bucket")


def _with_bucket(rows: DataFrame, buckets: DataFrame, hot: DataFrame) -> DataFrame:
    """``rows`` joined with ``buckets``; those of hot buckets stay in their tasks, whatever their number."""
    cold = rows.join(F.broadcast(hot), "bucket", "left_anti").join(buckets, "bucket")
    few = buckets.join(F.broadcast(hot), "bucket", "left_semi")
    return cold.unionByName(rows.join(F.broadcast(few), "bucket"))


def grouped(docs: DataFrame, text: str, key: str, words: int, percent: int) -> DataFrame:
    """``key, row, n_shingles, root, component_id`` for every row; the last two are null without shingles.

    ``root`` tells components apart, also those without an id, whose ``component_id`` is null.
    """
    threshold = percent / 100
    signed = cut_lineage(signatures(docs, text, key, words, bands_for(threshold)))
    classes = (signed.where("node is not null").groupBy("node")
               .agg(F.min(F.when(F.col("key").isNotNull(), F.struct("key", "row"))).alias("least"))
               .select("node", "least.key", "least.row"))
    # One signed row per node: of the rows with the class's least id and text, any.
    nodes = cut_lineage(signed.join(classes, ["node", "key", "row"]).dropDuplicates(["node"])
                        .select("node", "key", "row", "n_shingles", "signature", "bands"))
    banded = nodes.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    shared = cut_lineage(banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1"))
    hot = _hot_buckets(shared)
    members = cut_lineage(_with_bucket(banded, shared, hot))

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()

    def sets_of(involved: DataFrame) -> DataFrame:
        return cut_lineage(shingle_sets(docs, nodes.select("node", "key", "row").join(involved, "node"), text, key, words))

    def possible(pairs: DataFrame) -> DataFrame:
        return cut_lineage(surviving(pairs, nodes, threshold).distinct())

    alive = possible(members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    first = cut_lineage(confirmed(alive, sets_of(ends(alive)), percent))
    roots = first_labels(first)
    # A bucket of two is done; so is one whose members are all known to be linked.
    rooted = (members.where("n > 2").join(roots, "node", "left")
              .select("bucket", "node", "n_shingles", "n", F.coalesce("root", "node").alias("root")))
    several = cut_lineage(rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"),
                                                       F.sum("n_shingles").alias("size"))
                          .where("lo <> hi").select("bucket", "size"))
    open_members = cut_lineage(_with_bucket(rooted, several, hot))
    small = open_members.where(F.col("n") <= SMALL_BUCKET)
    alive = possible(
        small.alias("l").join(small.alias("r"), "bucket").where("l.node < r.node and l.root <> r.root")
        .select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct())
    large = open_members.where(F.col("n") > SMALL_BUCKET)
    sets = sets_of(ends(alive).union(large.select("node")).distinct())
    second = cut_lineage(confirmed(alive, sets, percent).union(in_blocks(large, nodes, sets, percent)))
    final = components(first.union(second))
    least = (final.join(classes, "node").groupBy("root").agg(F.min("key").alias("component_id")))
    of_node = classes.join(final.join(least, "root").select("node", "root", "component_id"), "node", "left")
    by_node = of_node.select("node", F.coalesce("root", "node").alias("root"),
                             F.coalesce("component_id", "key").alias("component_id"))
    return (signed.select("key", "row", "n_shingles", "node").join(by_node, "node", "left")
            .select("key", "row", "n_shingles", "root", "component_id"))
