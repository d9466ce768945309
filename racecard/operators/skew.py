"""Hot keys: find them, and number their rows without one task holding a whole group.

A key is hot if it alone holds more rows than a task should: more than one part of the
table in ``parts``, four per shuffle partition by default. So there are at most ``parts``
hot keys whatever the data, all of them are found, and no other key is larger than a
task's share. Which keys are hot never changes a result, only how it is computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from racecard.session import cut_lineage

PARTS_SETTING = "spark.racecard.hot.parts"
MOST_PARTS = 100_000
TRACKED_PER_PART = 8


def hot_values(df: DataFrame, key: str) -> list:
    """Every hot value of ``key``, from one pass over that column.

    Each task keeps a sketch of its frequent values, and only the sketches are merged. A
    sketch that tracks t values misplaces a count by less than rows / t at most, so the
    candidates are taken from half the share on, and counted exactly.
    """
    conf = df.sparkSession.conf
    parts = int(conf.get(PARTS_SETTING, str(4 * int(conf.get("spark.sql.shuffle.partitions")))))
    parts = min(parts, MOST_PARTS)
    tracked = min(1_000_000, max(1000, TRACKED_PER_PART * parts))
    # Frequent values by hash: the sketch then holds numbers, whatever the key's type.
    hashed = df.where(F.col(key).isNotNull()).select(key, F.xxhash64(key).alias("_hash"))
    found = hashed.agg(F.expr(f"approx_top_k(_hash, {2 * parts}, {tracked})").alias("top"), F.count("*").alias("n")).first()
    likely = [x["item"] for x in found["top"] or [] if x["count"] * parts * 2 > found["n"]]
    if not likely:
        return []
    counts = hashed.where(F.col("_hash").isin(likely)).groupBy(key).agg(F.count("*").alias("n"))
    return sorted(row[0] for row in counts.where(F.col("n") * parts > found["n"]).select(key).collect())


def split_hot(df: DataFrame, key: str, hot: list) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary keys (nulls included) and rows of hot keys (None if no key is hot)."""
    if not hot:
        return df, None
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return df.where(~is_hot), df.where(is_hot)


def place_in_order(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Spread the rows of a few hot keys over tasks by range of (key, order), and fix that spread.

    Adds ``_part``, and ``_before``: how many rows of the same key lie in earlier parts.
    ``order`` must be total within a key, or equal rows end up in one part. The
    per-part counts number at most hot keys x parts.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartitionByRange(parts, F.col(key), *order)
    placed = cut_lineage(spread.withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        placed.groupBy(key, "_part")
        .agg(F.count("*").alias("_n"))
        .select(key, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    return placed.join(before, [key, "_part"])


def number_rows(df: DataFrame, key: str, order: list[Column], name: str, hot: list) -> DataFrame:
    """``row_number`` within ``key``, exact also for keys too large for one task."""
    cold, big = split_hot(df, key, hot)
    numbered = cold.withColumn(
        name, F.row_number().over(Window.partitionBy(key).orderBy(*order))
    )
    if big is None:
        return numbered
    placed = place_in_order(big, key, order)
    local = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order))
    big = placed.withColumn(name, (local + F.col("_before")).cast("int")).drop("_part", "_before")
    return numbered.unionByName(big)
