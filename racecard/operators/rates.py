"""Win and place rates of jockeys and trainers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from racecard.functions import clean


def _with_finish(runs: DataFrame) -> DataFrame:
    """The finish as a number, parsed once for all that is counted."""
    return runs.withColumn("_finish", clean.finish_num("finish"))


def _outcomes() -> list:
    finish = F.col("_finish")
    return [
        F.count(finish).alias("n"),
        F.count(F.when(finish == 1, 1)).alias("wins"),
        F.count(F.when(finish <= 3, 1)).alias("places"),
    ]


def rate_totals(runs: DataFrame, entity: str, days: DataFrame | None = None) -> DataFrame:
    """Per entity and day, its rates over all earlier days; 0 before its first result.

    Runs are first counted per entity and day, map-side; only those counts are
    scanned in order, at most one row per calendar day for any entity. A race without a
    date is one still to be run and comes after all others. ``days`` are further (entity, day) pairs to answer for, without a run of their own.
    """
    key = f"{entity}_id"
    daily = _with_finish(runs.where(F.col(key).isNotNull())).groupBy(key, "race_date").agg(*_outcomes())
    if days is not None:
        asked = days.where(F.col(key).isNotNull()).select(key, "race_date").distinct()
        daily = daily.unionByName(asked, allowMissingColumns=True)
        daily = daily.groupBy(key, "race_date").agg(
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "wins", "places")]
        )
    earlier = (
        Window.partitionBy(key).orderBy(F.asc_nulls_last("race_date")).rowsBetween(Window.unboundedPreceding, -1)
    )
    n = F.sum("n").over(earlier)
    return daily.select(
        key,
        "race_date",
        *[
            F.coalesce(F.try_divide(F.sum(c).over(earlier), n), F.lit(0.0)).alias(f"{entity}_{name}")
            for c, name in (("wins", "win_rate"), ("places", "place_rate"))
        ],
    )


def rates_asof(runs: DataFrame, entity: str, targets: DataFrame | None = None) -> DataFrame:
    """Runners with the entity's rates as of their race day; null without an id.

    ``targets`` are other runners than the ones counted, such as entries.
    """
    totals = rate_totals(runs, entity, targets)
    return with_totals(runs if targets is None else targets, totals, entity)


def with_totals(df: DataFrame, totals: DataFrame, entity: str) -> DataFrame:
    """Runners joined with ``rate_totals`` by entity and day."""
    out = [f"{entity}_win_rate", f"{entity}_place_rate"]
    rates = totals.select(F.col(f"{entity}_id").alias("_id"), F.col("race_date").alias("_day"), *out)
    kept = df.drop(*out)
    same = (kept[f"{entity}_id"] == F.col("_id")) & kept["race_date"].eqNullSafe(F.col("_day"))
    return kept.join(rates, same, "left").select(*[c for c in df.columns if c not in out], *out)


def career_rates(runs: DataFrame, entity: str) -> DataFrame:
    """One row per entity with its rates over all its runs, as a rate table holds them."""
    key = f"{entity}_id"
    return (
        _with_finish(runs.where(F.col(key).isNotNull()))
        .groupBy(F.col(key).alias("id"))
        .agg(*_outcomes(), F.max("race_date").cast("timestamp").alias("as_of"))
        .select(
            F.lit(entity).alias("entity_type"),
            "id",
            F.coalesce(F.try_divide("wins", "n"), F.lit(0.0)).alias("win_rate"),
            F.coalesce(F.try_divide("places", "n"), F.lit(0.0)).alias("place_rate"),
            "as_of",
        )
    )


def with_rates(df: DataFrame, rates: DataFrame, entity: str) -> DataFrame:
    """Runners with the entity's stored rates: 0 for an unknown id, null for no id.

    The rate table grows with the data, so it carries no broadcast hint; Spark
    broadcasts it when its measured size allows.
    """
    key = f"{entity}_id"
    out = {f"{entity}_win_rate": "win_rate", f"{entity}_place_rate": "place_rate"}
    of_entity = rates.where(F.col("entity_type") == entity).select(
        F.col("id").alias(key), *[F.col(c).alias(f"_{c}") for c in out.values()]
    )
    joined = df.drop(*out).join(of_entity, key, "left")
    kept = [c for c in df.columns if c not in out]
    return joined.select(
        *kept,
        *[
            F.when(F.col(key).isNotNull(), F.coalesce(F.col(f"_{c}"), F.lit(0.0))).alias(name)
            for name, c in out.items()
        ],
    )


def missing_ids(ids: DataFrame, rates: DataFrame, entity: str) -> DataFrame:
    """Ids that the rate table does not hold yet."""
    known = rates.where(F.col("entity_type") == entity).select("id")
    return ids.where(F.col("id").isNotNull()).join(known, "id", "left_anti")


def latest_rates(rates: DataFrame) -> DataFrame:
    """The newest row of each (entity type, id)."""
    values = [c for c in rates.columns if c not in ("entity_type", "id")]
    newest = F.max_by(F.struct(*values), F.col("as_of")).alias("v")
    return rates.groupBy("entity_type", "id").agg(newest).select("entity_type", "id", "v.*")
