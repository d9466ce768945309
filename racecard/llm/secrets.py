"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Base kinds are three fixed patterns, matched leftmost and without overlap per kind. The
method adds spans of kind ``live``: long mixed runs outside base spans that look like
credentials and belong to few owners. For that, every candidate value (of base spans and
of such runs) is hashed and counted over the corpus by distinct repositories and distinct
owners. A value of more than ``MOST_OWNERS`` owners or ``MOST_REPOSITORIES`` repositories
is a widely copied example; one below both, of varied characters and without a
placeholder's words, is live-looking.

Positions are code points. Between them, ``split`` and ``regexp_extract_all`` give a
text's gaps and matches in turn, and positions are their running lengths. These, and which
runs touch a base span, come from scans by doubled steps: a text with m matches costs m log m.

Null and empty texts have no spans. Repeated rows are counted once per repository and
returned as often as they occur. A null owner or id counts as one more owner or
repository. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from racecard.session import cut_lineage

#: fixed values: the base patterns, in the order of their kinds
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_-]{20,}"
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|0123456789|abcdefgh"
LEAST_ASSIGNED = 6
MOST_OWNERS = 2
MOST_REPOSITORIES = 20
LEAST_DISTINCT_CHARACTERS = 8
KINDS = ("assign", "access", "hex", "live")


def running(items: Column, step) -> Column:
    """``items`` after steps of 1, 2, 4, ... places: ``step(item, before, after)`` merges an item's
    running values with those of the items that many places before and after it (null past an end)."""

    def widen(done: Column, reach: Column) -> Column:
        return F.when(reach < F.size(done), F.transform(
            done, lambda x, i: step(x, F.get(done, i - reach), F.get(done, i + reach)))).otherwise(done)

    return F.aggregate(F.array(*[F.lit(1 << power) for power in range(30)]), items, widen)


def spans_of(text: Column, pattern: str, kind: int, value_group: int = 0) -> Column:
    """Array of ``start, kind, end, value`` of the pattern's matches, empty without any."""
    found = F.transform(
        F.arrays_zip(
            F.split(text, pattern, -1).alias("gap"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)).alias("value")),
        lambda x: F.struct((F.length(x["gap"]) + F.length(x["whole"])).alias("end"),
                           F.length(x["whole"]).alias("size"), x["value"].alias("value")))
    # The text behind the last match is a gap alone and has no size.
    ended = running(F.filter(found, lambda x: x["size"].isNotNull()), lambda x, before, _: F.struct(
        (x["end"] + F.coalesce(before["end"], F.lit(0))).alias("end"), x["size"].alias("size"), x["value"].alias("value")))
    spans = F.transform(ended, lambda x: F.struct(
        (x["end"] - x["size"]).alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["value"].alias("value")))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>"))


def untouched(runs: Column, base: Column) -> Column:
    """Those ``runs`` that share no character with a span of ``base``.

    In order of starts, a run is touched if a base span before it ends, or the next one starts,
    inside it. Of spans with one start, base spans come first.
    """
    def is_base(x: Column) -> Column:
        return x["kind"] < len(KINDS) - 1

    def carried(x: Column, ended: Column, starts: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["value"].alias("value"),
                        ended.alias("ended"), starts.alias("starts"))

    every = F.transform(F.sort_array(F.concat(base, runs)),
                        lambda x: carried(x, F.when(is_base(x), x["end"]), F.when(is_base(x), x["start"])))
    known = running(every, lambda x, before, after: carried(
        x, F.greatest(x["ended"], before["ended"]), F.least(x["starts"], after["starts"])))
    free = F.filter(known, lambda x: ~is_base(x) & (F.coalesce(x["ended"], F.lit(0)) <= x["start"])
                    & (F.coalesce(x["starts"], x["end"]) >= x["end"]))
    left = F.transform(free, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"),
                                                x["value"].alias("value")))
    return F.when((F.size(runs) == 0) | (F.size(base) == 0), runs).otherwise(left)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", owner: str = "source",
         repository: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: its base spans and its candidates, without the text."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    slim = docs.select(
        F.col(key).alias("key"), F.col(owner).cast("string").alias("owner"),
        F.col(repository).cast("string").alias("repository"), body.alias("body"))
    slim = slim.select(
        "key", "owner", "repository",
        F.md5(F.concat_ws("\u0000", F.col("key").cast("string"), "body")).alias("row_hash"),
        F.filter(spans_of(F.col("body"), ASSIGN, 0, 2),
                 lambda s: F.length(s["value"]) >= LEAST_ASSIGNED).alias("assigned"),
        spans_of(F.col("body"), ACCESS, 1).alias("accessed"),
        spans_of(F.col("body"), HEX, 2).alias("hexed"),
        F.filter(spans_of(F.col("body"), RUN, 3),
                 lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")).alias("runs"))
    base = F.concat("assigned", "accessed", "hexed")
    return slim.select("key", "owner", "repository", "row_hash", "assigned", "accessed", "hexed",
                       F.sort_array(base).alias("base"), untouched(F.col("runs"), base).alias("runs"))


def ownership(scanned: DataFrame) -> DataFrame:
    """``value_hash, owners, repositories``: how widely every candidate value is copied.

    Values are made distinct per repository and owner before they are counted, so a value
    found everywhere is summed in every task first.
    """
    values = scanned.select("owner", "repository", F.explode(F.array_distinct(F.transform(
        F.concat("base", "runs"), lambda s: F.sha2(s["value"], 256)))).alias("value_hash"))
    return (values.groupBy("value_hash", "owner", "repository").agg(F.lit(1).alias("one"))
            .groupBy("value_hash", "owner").agg(F.count("*").alias("repositories"))
            .groupBy("value_hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories")))


def find_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", owner: str = "source",
                 repository: str = "doc_id", most_owners: int = MOST_OWNERS,
                 most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """Per row: counts of the base kinds, digest of the base spans, all spans, and verdicts.

    ``n_live`` counts candidates that look live, ``n_example`` those widely copied.
    """
    scanned = cut_lineage(scan(docs, text, key, owner, repository))
    spread = ownership(scanned)
    each = scanned.select("row_hash", F.explode(F.concat("base", "runs")).alias("span")).distinct()
    judged = (each.withColumn("value_hash", F.sha2("span.value", 256)).join(spread, "value_hash")
              .withColumn("example", (F.col("owners") > most_owners) | (F.col("repositories") > most_repositories))
              .withColumn("live", ~F.col("example") & ~F.col("span.value").rlike(PLACEHOLDER)
                          & (F.size(F.array_distinct(F.split("span.value", ""))) > LEAST_DISTINCT_CHARACTERS)))
    by_row = judged.groupBy("row_hash").agg(
        F.sum(F.col("live").cast("bigint")).alias("n_live"),
        F.sum(F.col("example").cast("bigint")).alias("n_example"),
        F.collect_list(F.when(F.col("live") & (F.col("span.kind") == 3), F.col("span"))).alias("added"))
    every = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "added")))
    return scanned.join(by_row, "row_hash", "left").select(
        F.col("key").alias(key),
        F.size("assigned").cast("bigint").alias("n_assign"), F.size("accessed").cast("bigint").alias("n_access"),
        F.size("hexed").cast("bigint").alias("n_hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(every).alias("spans"), F.coalesce("n_live", F.lit(0)).cast("bigint").alias("n_live"),
        F.coalesce("n_example", F.lit(0)).cast("bigint").alias("n_example"))
