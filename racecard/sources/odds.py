"""Live odds: parse the feed's JSON, keep the newest per runner, lay them over the entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from racecard.functions import clean

# States of a usable feed, the win market, and positions within an entry.
USABLE_STATUS = ["middle", "result", "yoso"]
WIN_MARKET = "1"
ODDS_AT, POPULARITY_AT, HORSE_AT, LEAST = 0, 2, 3, 4


# Only the win market is read; its entries stay as they are, whatever their shape.
_BODY = f"status string, data struct<odds: struct<`{WIN_MARKET}`: map<string, variant>>>"


def parse_live_odds(feed: DataFrame) -> DataFrame:
    """One row per runner and snapshot from ``race_id, as_of, body``.

    Works on a stream as on a table. ``pos`` is the entry's place in the feed. The body is parsed
    once, its entries as variants: another market, or an entry of another shape, takes no other
    runner away (``odd_entries`` lists the latter).
    """
    entries = _entries(feed).where(F.size("v") >= LEAST)
    value = {at: F.get("v", F.lit(at)).cast("string") for at in (HORSE_AT, ODDS_AT, POPULARITY_AT)}
    texts = F.struct(
        clean.horse_no_key(value[HORSE_AT]).alias("horse_no"),
        clean.strip(value[ODDS_AT]).alias("odds"),
        clean.strip(value[POPULARITY_AT]).alias("popularity"),
    )
    runners = entries.select("race_id", "status", "as_of", "pos", _once(texts).alias("t"))
    return runners.select("race_id", "t.*", "status", "as_of", "pos").where(
        F.col("odds").rlike("[0-9]") & F.col("popularity").rlike("[0-9]")
    )


def _once(value: Column) -> Column:
    """The same value, worked out once: conditions on it are not pushed down and computed anew."""
    return F.explode(F.array(value))


def odd_entries(feed: DataFrame) -> DataFrame:
    """Entries of usable snapshots that are no list of enough items, with their JSON text."""
    odd = _entries(feed).where(F.coalesce(F.size("v"), F.lit(0)) < LEAST)
    return odd.select("race_id", "as_of", "pos", "name", F.to_json("entry").alias("entry"))


def _entries(feed: DataFrame) -> DataFrame:
    """Every entry of the win market: its name and place, its variant, and that as a list if it is one."""
    parsed = feed.select("race_id", "as_of", _once(F.from_json("body", _BODY)).alias("b"))
    entries = parsed.where(F.col("b.status").isin(USABLE_STATUS)).select(
        "race_id", "as_of", "b.status", F.posexplode(F.col("b.data.odds")[WIN_MARKET]).alias("pos", "name", "entry")
    )
    return entries.select("*", _once(F.try_variant_get("entry", "$", "array<variant>")).alias("v"))


def latest_odds(snapshots: DataFrame, with_pos: bool = False) -> DataFrame:
    """The newest odds of each (race, horse number), on a table or on a stream.

    Of equal times the later place in the feed counts; ``with_pos`` keeps that place.

    A maximum keeps one row per runner while aggregating, so order of arrival does
    not matter and a runner with very many snapshots is reduced map-side.
    """
    newest = F.max(F.struct("as_of", "pos", "odds", "popularity")).alias("v")
    return snapshots.groupBy("race_id", "horse_no").agg(newest).select(
        "race_id", "horse_no", "v.odds", "v.popularity", "v.as_of", *(["v.pos"] if with_pos else [])
    )


def overlay_odds(entries: DataFrame, odds: DataFrame) -> DataFrame:
    """Entries with live odds and popularity where the feed has them.

    ``odds`` holds each (race, horse number) once, as ``latest_odds`` gives it.
    """
    live = odds.select(
        "race_id",
        F.col("horse_no").alias("_key"),
        F.col("odds").alias("_odds"),
        F.col("popularity").alias("_popularity"),
    )
    joined = entries.withColumn("_key", clean.horse_no_key("horse_no")).join(
        live, ["race_id", "_key"], "left"
    )
    live_or_own = {"odds": F.coalesce("_odds", "odds"), "popularity": F.coalesce("_popularity", "popularity")}
    return joined.withColumns(live_or_own).select(*entries.columns)
