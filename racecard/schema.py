"""Declared schemas. Every raw field is text; only our own keys are typed."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT = T.StringType()


def _texts(*names: str) -> list[T.StructField]:
    return [T.StructField(name, _TEXT) for name in names]


RESULTS = T.StructType(
    _texts(
        "race_id", "finish", "horse_no", "horse_name", "horse_id", "sex_age", "carried",
        "jockey", "jockey_id", "time", "up_3f", "odds", "popularity", "body_weight",
        "trainer", "trainer_id", "race_name",
    )
    + [T.StructField("race_date", T.DateType())]
)

ENTRIES = T.StructType(
    _texts(
        "race_id", "horse_no", "horse_name", "horse_id", "sex_age", "carried", "jockey",
        "jockey_id", "trainer", "trainer_id", "body_weight", "odds", "popularity",
    )
    + [T.StructField("race_date", T.DateType())]
)

HISTORY = T.StructType(
    [T.StructField("horse_id", _TEXT), T.StructField("hist_pos", T.IntegerType())]
    + _texts("race_id", "race_name", "finish", "up_3f")
    + [T.StructField("race_date", T.DateType())]
)

ENTITY_RATES = T.StructType(
    _texts("entity_type", "id")
    + [
        T.StructField("win_rate", T.DoubleType()),
        T.StructField("place_rate", T.DoubleType()),
        T.StructField("as_of", T.TimestampType()),
    ]
)

PAGES = T.StructType(
    _texts("kind", "key")
    + [
        T.StructField("fetched_at", T.TimestampType()),
        T.StructField("raw", T.BinaryType()),
    ]
)

ODDS_BODY = T.StructType(
    [
        T.StructField("status", _TEXT),
        T.StructField(
            "data",
            T.StructType(
                [
                    T.StructField(
                        "odds",
                        T.MapType(_TEXT, T.MapType(_TEXT, T.ArrayType(_TEXT))),
                    )
                ]
            ),
        ),
    ]
)

# The model's features, in the order the model expects them.
FEATURES = [
    "age", "horse_weight", "weight_change", "jockey_weight", "horse_number",
    "sex_セ", "sex_牝", "sex_牡",
    "prev_rank", "avg_up_3f_3runs", "win_rate",
    "jockey_win_rate", "jockey_place_rate", "trainer_win_rate", "trainer_place_rate",
    "prev_class", "odds", "popularity",
]

# Feature columns that are recomputed whenever a table is enriched.
ENRICHED_FEATURES = [
    "prev_rank", "avg_up_3f_3runs", "win_rate", "prev_class",
    "jockey_win_rate", "jockey_place_rate", "trainer_win_rate", "trainer_place_rate",
]

# Columns known only after the race, or text with no numeric meaning.
LEAK_COLUMNS = [
    "horse_name", "jockey", "jockey_id", "trainer", "trainer_id", "finish", "time", "up_3f",
    "margin", "time_seconds", "carried", "horse_no", "horse_id",
]

# The preview of a staged batch shows these columns.
PREVIEW_COLUMNS = [
    "race_id", "finish", "horse_no", "horse_name", "odds", "popularity", "time", "body_weight",
]
