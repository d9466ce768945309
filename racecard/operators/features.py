"""From raw text to the model's feature table, the same way for training and scoring."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from racecard.functions import clean
from racecard.operators.frames import align, drop_leaks, finalize
from racecard.operators.medians import exact_median, median_by
from racecard.schema import FEATURES
from racecard.session import cut_large

# How each feature's gaps are filled, and with what if all are empty.
IMPUTATION = [
    ("age", "median", 3.0),
    ("horse_weight", "mean", 470.0),
    ("weight_change", "constant", 0.0),
    ("jockey_weight", "mean", 54.0),
    ("horse_number", "constant", 1.0),
    ("prev_rank", "mean", 8.0),
    ("avg_up_3f_3runs", "mean", 36.0),
    ("win_rate", "constant", 0.0),
    ("jockey_win_rate", "mean", 0.05),
    ("jockey_place_rate", "mean", 0.15),
    ("trainer_win_rate", "mean", 0.07),
    ("trainer_place_rate", "mean", 0.20),
    ("odds", "mean", 10.0),
    ("popularity", "mean", 8.0),
    ("prev_class", "constant", 0.0),
]
SEXES = ["セ", "牝", "牡"]

_PARSED = {
    "sex_age": {"sex": clean.sex_of, "age": clean.age_of},
    "body_weight": {"horse_weight": clean.body_weight, "weight_change": clean.weight_change},
    "carried": {"jockey_weight": clean.to_num},
    "horse_no": {"horse_number": clean.to_num},
    "odds": {"odds": clean.to_num},
    "popularity": {"popularity": clean.to_num},
}


def parse_features(df: DataFrame) -> DataFrame:
    """Raw text parsed into label, sex and numbers; gaps stay null.

    A raw column that the table lacks yields nothing, and its features are added by
    ``align``. Identity columns stay, so that runners can still be told apart.
    """
    made = {"is_win": clean.is_win("finish")} if "finish" in df.columns else {}
    for raw, outputs in _PARSED.items():
        if raw in df.columns:
            made.update({name: parse(raw) for name, parse in outputs.items()})
    numeric = [name for name, _, _ in IMPUTATION if name in df.columns and name not in made]
    made.update({name: clean.as_num(df, name) for name in numeric})
    return df.withColumns(made).drop("sex_age", "body_weight")


def impute_stats(parsed: DataFrame, by: str | None = None) -> DataFrame:
    """The fill value of every feature present, over the table or per value of ``by``.

    Means are one aggregation with map-side partials. Medians are found by counting, whatever the
    number of distinct values: over the table by passes of their own, so a table that is
    costly to compute should be stored first; per ``by`` as a join.
    """
    fills, medians = [], []
    for name, kind, constant in IMPUTATION:
        if name not in parsed.columns:
            continue
        if kind == "median":
            medians.append((name, constant))
            fill = F.lit(None if by else exact_median(parsed, name)).cast("double")
        else:
            fill = F.avg(name) if kind == "mean" else F.lit(None).cast("double")
        fills.append(F.coalesce(fill, F.lit(constant)).alias(name))
    if not by:
        return parsed.agg(*fills)
    stats = parsed.groupBy(by).agg(*fills)
    for name, constant in medians:
        own = median_by(parsed, by, name).select(F.col(by).alias("_by"), "median")
        filled = F.coalesce("median", F.lit(constant)).alias(name)
        stats = stats.join(own, F.col(by).eqNullSafe(F.col("_by")), "left").select(
            *[filled if c == name else F.col(c) for c in stats.columns])
    return stats


def impute(parsed: DataFrame, stats: DataFrame, by: str | None = None) -> DataFrame:
    """Gaps filled from ``stats``: one row as a scalar subquery, or joined on ``by``."""
    names = [name for name, _, _ in IMPUTATION if name in parsed.columns]
    values = F.struct(*[n for n in names if n in stats.columns]).alias("_fill")
    if by:
        filled = parsed.join(stats.select(by, values), by, "left")
    else:
        filled = parsed.withColumn("_fill", stats.select(values).scalar())
    constants = {name: constant for name, _, constant in IMPUTATION}
    columns = []
    for c in parsed.columns:
        if c in names:
            fill = [F.col("_fill")[c]] if c in stats.columns else []
            columns.append(F.coalesce(F.col(c), *fill, F.lit(constants[c])).alias(c))
        else:
            columns.append(F.col(c))
    return filled.select(*columns)


def one_hot_sex(df: DataFrame, vocab: list[str] | None = SEXES) -> DataFrame:
    """One 0/1 column per sex; ``vocab=None`` takes the sexes that occur."""
    if vocab is None:
        # One character each, so the list is bounded by the alphabet in use.
        vocab = sorted(r[0] for r in df.select("sex").dropna().distinct().collect())
    is_sex = {
        f"sex_{v}": F.coalesce(F.col("sex") == v, F.lit(False)).cast("double") for v in vocab
    }
    return df.withColumns(is_sex).drop("sex")


def encode(
    parsed: DataFrame, stats: DataFrame | None = None, by: str | None = None
) -> DataFrame:
    """Parsed columns filled and one-hot encoded.

    ``stats`` are the training table's fill values, and the result is one lazy plan.
    Without them the table's own are used, per race with ``by='race_id'``; the parsed
    table is then needed twice and is written once, so that what it was joined from
    is not computed again.
    """
    if stats is None:
        parsed = cut_large(parsed)
        stats = impute_stats(parsed, by)
    filled = impute(parsed, stats, by)
    return one_hot_sex(filled) if "sex" in filled.columns else filled


def preprocess(
    df: DataFrame, stats: DataFrame | None = None, by: str | None = None
) -> DataFrame:
    """Raw and enriched columns to ``race_id``, ``is_win`` and numeric features."""
    parsed = drop_leaks(parse_features(df)).drop("race_date", "race_name", "extract_status")
    return finalize(encode(parsed, stats, by))


def feature_table(
    df: DataFrame,
    stats: DataFrame | None = None,
    by: str | None = None,
    keys: tuple[str, ...] = ("race_id", "horse_no"),
    exclude: tuple[str, ...] = (),
) -> DataFrame:
    """Keys, label if known, and the model's features in its order."""
    parsed = parse_features(df)
    wanted = [f for f in FEATURES if f not in exclude]
    needed = [*keys, "is_win", "sex", *([by] if by else []), *wanted]
    parsed = parsed.select(*[c for c in dict.fromkeys(needed) if c in parsed.columns])
    return align(encode(parsed, stats, by), wanted, keep=(*keys, "is_win"))


def assemble(features: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Feature vector beside the other columns; an empty or non-finite value is an error."""
    names = [c for c in FEATURES if c in features.columns] if names is None else names
    return VectorAssembler(inputCols=names, outputCol="vector", handleInvalid="error").transform(
        features
    )
