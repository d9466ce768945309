"""SimHash fingerprints of 128 bits, in DataFrame functions only.

Terms are the words of a text (runs of anything but ASCII white space, lower-cased). A
term's two 64-bit hashes vote on the bits, up for a one and down for a zero, with a weight
that grows with the term's length up to ``HEAVIEST``. Votes of two bits share one 64-bit
sum, so a text of any length is one aggregation of 64 sums, summed where its words are.

``near_pairs`` finds every fingerprint within ``RADIUS`` bits of a query's: the bits are
cut into ``BLOCKS`` blocks, of which ``BLOCKS - RADIUS`` must agree, and there is a table
for every choice of that many blocks, keyed by their bits. Equal fingerprints are one
row with a count, and a pair counts in the first table it agrees in only.

A null or empty text has no terms and the fingerprint 0. Equal texts have equal
fingerprints. Ids are integers; rows without one come last in the order of documents, and
rows of one id are ordered by a hash of their text. Repeated rows are kept. Columns other
than id and text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from racecard.session import cut_lineage

BITS = 128
HEAVIEST = 6
RADIUS = 6
BLOCKS = 8
QUERY_MODULUS = 100
CELL_BYTES = 4 << 20
ROW_BYTES = 256  # counted for a row besides its text
MOST_CELLS = 1 << 18
MOST_RANGES = 1 << 10
LANES = 0x0000000100000001
WORD_BREAK = r"[\x20\x09-\x0D]+"


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys, high, low``: the two halves of the fingerprint of each row, one per key."""
    terms = texts.select(*keys, F.explode_outer(F.split(F.lower(F.col(text)), WORD_BREAK)).alias("term"))
    hashed = terms.select(
        *keys, F.xxhash64("term").alias("h0"), F.xxhash64("term", F.lit(1)).alias("h1"),
        F.when(F.col("term") == "", 0).otherwise(F.least(F.length("term"), F.lit(HEAVIEST))).cast("bigint").alias("w"))
    sums = [F.sum(F.shiftright(h, i).bitwiseAND(F.lit(LANES)) * F.col("w")).alias(f"{h}_{i}")
            for h in ("h0", "h1") for i in range(32)]
    votes = hashed.groupBy(*keys).agg(F.sum("w").alias("weight"), *sums)

    def half(h: str) -> Column:
        def won(lane: Column) -> Column:
            return (lane * 2 > F.col("weight")).cast("bigint")

        bits = [F.shiftleft(won(F.col(f"{h}_{i}").bitwiseAND(F.lit(0xFFFFFFFF))), i) for i in range(32)]
        bits += [F.shiftleft(won(F.shiftrightunsigned(f"{h}_{i}", 32)), i + 32) for i in range(32)]
        return F.coalesce(reduce(lambda a, b: a.bitwiseOR(b), bits), F.lit(0).cast("bigint"))

    return votes.select(*keys, half("h0").alias("high"), half("h1").alias("low"))


def distance(a: str, b: str) -> Column:
    """Differing bits of two fingerprints, given the prefixes of their columns."""
    return (F.bit_count(F.col(f"{a}high").bitwiseXOR(F.col(f"{b}high")))
            + F.bit_count(F.col(f"{a}low").bitwiseXOR(F.col(f"{b}low"))))


def shown(high: Column, low: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def with_next(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, cell, place, text, next_text, copy``, where next is by descending id, around the end.

    Rows are ordered by id and hash of the text, and cut into successive cells of about
    ``CELL_BYTES`` of text, more beyond ``MOST_CELLS`` cells. Only ids, hashes and sizes are
    sorted to find the cuts, so neither uneven ids nor many rows of one id or without id make a
    cell large; equal rows alone stay together, and a longer text is in a cell of its own. The
    first row of the following cell is put after a cell's last one, marked ``copy``; so no task
    sees more than a cell, and texts are shuffled once.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    number = F.col(key).cast("bigint")
    rows = docs.select(number.alias("key"), body.alias("text"), F.struct(
        number.isNull().cast("int").alias("unnamed"), F.coalesce(F.bitwise_not(number), F.lit(0)).alias("id"),
        F.xxhash64(body).alias("hash")).alias("at"))
    celled = _in_cells(rows)
    heads = (celled.where("at = first").groupBy("cell").agg(F.first("key").alias("key"), F.first("at").alias("at"),
                                                            F.min("text").alias("text"), F.first("cells").alias("cells"))
             .select("key", "at", "text", F.pmod(F.col("cell") - 1, F.col("cells")).alias("cell"), F.lit(True).alias("copy")))
    every = celled.select("key", "at", "text", "cell", F.lit(False).alias("copy")).unionByName(heads)
    order = Window.partitionBy("cell").orderBy("copy", "at", "text")
    return every.select("key", "cell", F.row_number().over(order).alias("place"), "text",
                        F.lead("text").over(order).alias("next_text"), "copy")


def _in_cells(rows: DataFrame) -> DataFrame:
    """``rows`` (``at, text``) with their ``cell``, its ``first`` value of ``at``, and the number of ``cells``."""
    spark = rows.sparkSession
    ranges = min(MOST_RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    weighed = rows.select("at", (F.octet_length("text").cast("bigint") + ROW_BYTES).alias("size"))
    slim = cut_lineage(weighed.repartitionByRange(ranges, "at").withColumn("part", F.spark_partition_id()))
    share = max(CELL_BYTES, (slim.agg(F.sum("size")).first()[0] or 0) // MOST_CELLS + 1)
    so_far = F.sum("size").over(Window.partitionBy("part").orderBy("at")) - F.col("size")
    firsts = (slim.select("part", "at", F.floor(so_far / share).alias("number"))
              .groupBy("part", "number").agg(F.min("at").alias("at"))
              .groupBy("part").agg(F.sort_array(F.collect_set("at")).alias("firsts")))
    firsts = cut_lineage(firsts)  # a row per range, MOST_CELLS + MOST_RANGES values in all
    parts = sorted(firsts.select("part", F.get("firsts", F.lit(0)).alias("at"), F.size("firsts").alias("n")).collect(),
                   key=lambda r: r["at"])
    before = [sum(r["n"] for r in parts[:i]) for i in range(len(parts) + 1)]

    def values(kind: str, items: list) -> Column:
        return F.array(*[F.lit(x) for x in items]).cast(f"array<{kind}>")

    lowest = F.arrays_zip(*[values(kind, [r["at"][name] for r in parts]).alias(name)
                            for name, kind in (("unnamed", "int"), ("id", "bigint"), ("hash", "bigint"))])
    index = _last_at_most(lowest, F.col("at"), MOST_RANGES)
    placed = rows.withColumn("index", index).withColumn("part", F.get(values("int", [r["part"] for r in parts]), "index"))
    place = _last_at_most(F.col("firsts"), F.col("at"), MOST_CELLS)
    return (placed.join(F.broadcast(firsts), "part").withColumn("place", place)
            .select("key", "text", "at", (F.get(values("bigint", before), "index") + F.col("place")).alias("cell"),
                    F.get("firsts", "place").alias("first"), F.lit(before[-1]).cast("bigint").alias("cells")))


def _last_at_most(values: Column, sought: Column, most: int) -> Column:
    """Index of the last of the sorted ``values`` (``most`` at most) that is not above ``sought``, by halving."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(most.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(values, at + step) <= sought, at + step).otherwise(at))


def document_fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text keeps the first half of the characters (the larger, if they are odd)
    and goes on with the beginning of the next document's text, as much as was taken off.
    """
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    edited = with_next(docs, text, key).select(
        "key", "cell", "place", "copy", size.cast("bigint").alias("n_chars"), "text",
        F.when(F.col("copy"), F.lit("")).otherwise(
            F.concat(F.left("text", size - half), F.left("next_text", half))).alias("edited"))
    both = edited.select(
        "key", "cell", "place", "copy", "n_chars", F.unhex(F.sha2("edited", 256)).alias("sha"),
        F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("body")),
                          F.struct(F.lit(1).alias("which"), F.col("edited").alias("body")))).alias("version"))
    own = ["cell", "place", "key", "copy", "n_chars", "sha"]
    marks = fingerprints(both.select(*own, "version.which", "version.body"), [*own, "which"], "body")

    def of(which: int, half: str) -> Column:
        return F.max(F.when(F.col("which") == which, F.col(half)))

    paired = marks.groupBy(*own).agg(of(0, "high").alias("high"), of(0, "low").alias("low"),
                                     of(1, "high").alias("e_high"), of(1, "low").alias("e_low"))
    order = Window.partitionBy("cell").orderBy("place")
    found = paired.select("*", F.lead("high").over(order).alias("n_high"), F.lead("low").over(order).alias("n_low"))

    def likeness(other: str) -> Column:
        return 1 - distance("", other) / BITS

    return found.where("not copy").select(
        F.col("key").alias(key), "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"),
        shown(F.col("high"), F.col("low")).alias("fingerprint"),
        shown(F.col("e_high"), F.col("e_low")).alias("edited_fingerprint"),
        likeness("e_").alias("near_edited"), likeness("n_").alias("near_next"), "high", "low")


def _tables(blocks: int, radius: int) -> list[tuple[int, int]]:
    """The bits (of the high and the low half) that each table is keyed by."""
    width = BITS // blocks
    out = []
    for kept in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << width) - 1) << (b * width) for b in kept)
        halves = (mask >> 64, mask & ((1 << 64) - 1))
        out.append(tuple(h - (1 << 64) if h >> 63 else h for h in halves))
    return out


def near_pairs(queries: DataFrame, marks: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``q_high, q_low, high, low, many``: fingerprints within ``radius`` bits of each query's.

    ``queries`` and ``marks`` have ``high, low``; ``many`` is how many rows of ``marks``
    have that fingerprint.
    """
    masks = _tables(blocks, radius)

    def keyed(df: DataFrame) -> DataFrame:
        keys = F.array(*[F.xxhash64(F.lit(t), F.col("high").bitwiseAND(F.lit(a)), F.col("low").bitwiseAND(F.lit(b)))
                         for t, (a, b) in enumerate(masks)])
        return df.select("*", F.posexplode(keys).alias("number", "block_key"))

    sought = keyed(queries.select("high", "low").distinct()).select(
        F.col("high").alias("q_high"), F.col("low").alias("q_low"), "block_key", F.col("number").alias("q_number"))
    held = keyed(marks.groupBy("high", "low").agg(F.count("*").alias("many")))
    differing = F.array(*[
        F.col("high").bitwiseXOR(F.col("q_high")).bitwiseAND(F.lit(a)).bitwiseOR(
            F.col("low").bitwiseXOR(F.col("q_low")).bitwiseAND(F.lit(b))) for a, b in masks])
    return (held.join(sought, "block_key").where(F.col("number") == F.col("q_number"))
            .where(distance("", "q_") <= radius)
            .where(F.array_position(differing, F.lit(0).cast("bigint")) == F.col("number") + 1)
            .select("q_high", "q_low", "high", "low", "many"))


def near_counts(marked: DataFrame, key: str = "doc_id", modulus: int = QUERY_MODULUS,
                radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``marked`` with ``n_near``: how many other rows lie within ``radius`` bits of it.

    Asked for the rows whose id is divisible by ``modulus``, null for the others.
    """
    asked = F.col(key) % modulus == 0
    found = (near_pairs(marked.where(asked), marked, radius, blocks)
             .groupBy(F.col("q_high").alias("high"), F.col("q_low").alias("low")).agg(F.sum("many").alias("around"))
             .withColumn("asked", F.lit(True)))
    return (marked.withColumn("asked", F.coalesce(asked, F.lit(False))).join(found, ["high", "low", "asked"], "left")
            .select(*[c for c in marked.columns if c not in ("high", "low")],
                    F.when(F.col("asked"), F.col("around") - 1).alias("n_near")))


def fingerprint_report(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``document_fingerprints`` of every row, with ``n_near``."""
    return near_counts(cut_lineage(document_fingerprints(docs, text, key)), key)
