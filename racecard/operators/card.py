"""Win probabilities, ranks, marks and summaries, for every race in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from racecard.functions import clean
from racecard.operators.skew import hot_values, place_in_order, split_hot


def odds_weight(c: Column | str = "odds") -> Column:
    """One over the odds; odds that do not parse, or are 0, count as 999."""
    odds = F.coalesce(clean.to_num(c), F.lit(999.0))
    return F.lit(1.0) / F.when(odds == 0, F.lit(999.0)).otherwise(odds)


def _order(weight: str) -> list[Column]:
    """Highest first, ties by horse number."""
    return [F.col(weight).desc_nulls_last(), clean.to_num("horse_no").asc_nulls_last(),
            F.col("horse_no").asc_nulls_last(), F.col("horse_id").asc_nulls_last()]


def _share(weight: Column, total: Column, count: Column) -> Column:
    return F.when(total > 0, weight / total * 100.0).otherwise(F.lit(100.0) / count)


def normalize(df: DataFrame, weight: str = "score", hot: list | None = None) -> DataFrame:
    """``probability``: the weight's share of its race times 100, equal if all weights are 0.

    ``rank_in_race`` comes from the same pass: one shuffle by race serves the sum, the
    count and the order. Races too large for one task are summed map-side and numbered
    over ranges instead. ``hot`` names them if the caller knows them already.
    """
    hot = hot_values(df, "race_id") if hot is None else hot
    cold, big = split_hot(df, "race_id", hot)
    race = Window.partitionBy("race_id")
    w = F.col(weight)
    ranked = cold.withColumns(
        {
            "probability": _share(w, F.sum(w).over(race), F.count("*").over(race)),
            "rank_in_race": F.row_number().over(race.orderBy(*_order(weight))),
        }
    )
    if big is None:
        return ranked
    placed = place_in_order(big, "race_id", _order(weight))
    # One row per hot race, so at most as many as there can be hot keys.
    totals = placed.groupBy("race_id").agg(F.sum(w).alias("_sum"), F.count("*").alias("_count"))
    local = F.row_number().over(Window.partitionBy("race_id", "_part").orderBy(*_order(weight)))
    big = placed.join(F.broadcast(totals), "race_id").withColumns(
        {
            "probability": _share(w, F.col("_sum"), F.col("_count")),
            "rank_in_race": (local + F.col("_before")).cast("int"),
        }
    )
    return ranked.unionByName(big.select(*ranked.columns))


def odds_probability(df: DataFrame, hot: list | None = None) -> DataFrame:
    """Probabilities without a model: each runner's share of inverse odds."""
    return normalize(df.withColumn("score", odds_weight()), "score", hot)


def race_card(ranked: DataFrame, not_yet_run: bool = False) -> DataFrame:
    """One line per runner: rank, mark, gate, name, probability, finish and odds as shown."""
    finish = F.col("finish") if "finish" in ranked.columns else F.lit(None).cast("string")
    return ranked.select(
        "race_id",
        "rank_in_race",
        clean.mark_of("rank_in_race").alias("mark"),
        clean.mark_class_of("rank_in_race").alias("mark_class"),
        clean.mark_label_of("rank_in_race").alias("label"),
        clean.gate_display("horse_no").alias("gate_no"),
        F.col("horse_name").alias("name"),
        "probability",
        clean.finish_display(finish, not_yet_run).alias("finish_shown"),
        clean.odds_display("odds").alias("odds_shown"),
    )


def recommendations(card: DataFrame) -> DataFrame:
    """The first four marked runners of each race."""
    return card.where((F.col("rank_in_race") <= 4) & (F.col("mark") != "-"))


def headline(card: DataFrame) -> DataFrame:
    """One row per race with its three best; a missing one is named 該当なし."""
    columns = []
    for role, mark in (("favorite", "◎"), ("rival", "○"), ("darkhorse", "▲")):
        for name, empty in (("name", "該当なし"), ("gate_no", ""), ("probability", 0.0)):
            best = F.max(F.when(F.col("mark") == mark, F.col(name)))
            columns.append(F.coalesce(best, F.lit(empty)).alias(f"{role}_{name}"))
    return card.groupBy("race_id").agg(*columns)


def order_for_display(card: DataFrame) -> DataFrame:
    """Races in order, each from the lowest probability up, as its bar chart wants them."""
    return card.orderBy("race_id", F.col("rank_in_race").desc())


def head(df: DataFrame, order: list[Column | str], n: int = 5) -> DataFrame:
    """The first ``n`` rows in an order, as a report shows them."""
    return df.orderBy(*order).limit(n)
