"""Projections, renames, unions and distinct keys over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from racecard.functions import clean
from racecard.schema import ENRICHED_FEATURES, LEAK_COLUMNS, PREVIEW_COLUMNS

# Names that sources use for a field, and the field's name here.
SOURCE_NAMES = {
    "着順": "finish", "馬番": "horse_no", "馬名": "horse_name", "馬ID": "horse_id",
    "性齢": "sex_age", "斤量": "carried", "騎手": "jockey", "騎手ID": "jockey_id",
    "タイム": "time", "上り": "up_3f", "単勝": "odds", "単勝オッズ": "odds", "人気": "popularity",
    "馬体重": "body_weight", "調教師": "trainer", "調教師ID": "trainer_id", "着差": "margin",
    "win_odds": "odds",
}


def drop_if_present(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Without the named columns (by default the features that enriching recomputes)."""
    return df.drop(*(ENRICHED_FEATURES if columns is None else columns))


def preview(df: DataFrame) -> DataFrame:
    """The preview columns that the table has."""
    return df.select(*[c for c in PREVIEW_COLUMNS if c in df.columns])


def canonical(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Source column names replaced by this package's names."""
    names = SOURCE_NAMES if names is None else names
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns})


def drop_leaks(df: DataFrame) -> DataFrame:
    """Without identity text and columns known only after the race."""
    return df.drop(*LEAK_COLUMNS)


def with_defaults(df: DataFrame) -> DataFrame:
    """Columns that entry lists may lack, filled with their stand-ins."""
    missing = {
        name: F.lit(value)
        for name, value in (("finish", "0"), ("body_weight", clean.NO_WEIGHT))
        if name not in df.columns
    }
    return df.withColumns(missing) if missing else df


def finalize(df: DataFrame, keep: tuple[str, ...] = ("race_id", "is_win")) -> DataFrame:
    """Every other column as a double, null as 0."""
    return df.select(
        *[
            F.col(c) if c in keep else F.coalesce(clean.as_num(df, c), F.lit(0.0)).alias(c)
            for c in df.columns
        ]
    )


def align(df: DataFrame, features: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """The kept columns and the model's features in its order; an absent feature is 0."""
    present = set(df.columns)
    return df.select(
        *[c for c in keep if c in present],
        *[
            F.coalesce(clean.as_num(df, c), F.lit(0.0)).alias(c)
            if c in present
            else F.lit(0.0).alias(c)
            for c in features
        ],
    )


def union_batches(batches: list[DataFrame]) -> DataFrame:
    """Batches on top of one another by column name; a column some lack is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)


def lookup_pairs(df: DataFrame) -> DataFrame:
    """Distinct (horse, race) pairs with both ids present."""
    return df.select("horse_id", "race_id").dropna().distinct()


def lookup_ids(df: DataFrame, entity: str) -> DataFrame:
    """Distinct ids of an entity."""
    return df.select(clean.clean_id(f"{entity}_id").alias("id")).dropna().distinct()


def batch_summary(df: DataFrame) -> DataFrame:
    """Number of races and of runners.

    Counted per race first, map-side, so a race with very many rows costs one row.
    """
    per_race = df.groupBy("race_id").agg(F.count("*").alias("n"))
    return per_race.agg(
        F.count("race_id").alias("races"), F.coalesce(F.sum("n"), F.lit(0)).alias("runners")
    )


def new_races(batch: DataFrame, stored: DataFrame, hot: list | None = None) -> DataFrame:
    """Runners of races that are not stored yet; rows equal in every column count once.

    A null race id is a race like any other: once stored, it is not new again. With ``hot``, the ids
    of races too large for one task, the rows of all other races are dealt out by race once, which
    serves both to look the race up and to tell its rows apart.
    """
    known = stored.select(F.col("race_id").alias("_known")).distinct()

    def unknown(rows: DataFrame) -> DataFrame:
        return rows.join(known, rows["race_id"].eqNullSafe(known["_known"]), "left_anti").distinct()

    if hot is None:
        return unknown(batch)
    is_large = F.col("race_id").isNull() | F.col("race_id").isin(hot)
    dealt = batch.where(~is_large).repartition("race_id")
    small = dealt.join(known, dealt["race_id"] == known["_known"], "left_anti").distinct()
    return small.unionByName(unknown(batch.where(is_large)))


def fingerprint(columns: list[str]) -> Column:
    """128 bits that tell whole rows apart, null from blank included; equal rows have equal ones."""
    said = [F.coalesce(F.concat(F.length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")), F.lit("null"))
            for c in columns]
    return F.md5(F.concat_ws("|", *said))


def new_rows(batch: DataFrame, stored: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Like ``new_races`` by whole row: for streams that split a race over batches.

    Both sides carry the rows' ``fingerprint``; of the stored table nothing else is read. Rows that
    differ in any column are different rows, so a corrected row stays beside the older one.
    """
    held = stored.select(F.col(key).alias("_known"))
    return batch.join(held, F.col(key) == F.col("_known"), "left_anti").dropDuplicates([key])
