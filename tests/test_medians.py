import random
import statistics

import pytest
from pyspark.sql import functions as F

from racecard.operators import medians
from racecard.operators.features import impute_stats


def table(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x double").repartition(4)


CASES = {
    "distinct": [random.Random(1).gauss(0, 1e6) for _ in range(5001)],
    "even": [random.Random(2).random() for _ in range(4000)],
    "outliers": [random.Random(3).random() for _ in range(3000)] + [1e300, -1e300, 1e-300],
    "one value holds half": [7.0] * 3000 + [float(i) for i in range(2500)],
    "two middles": [1.0] * 2000 + [2.0 + i for i in range(2000)],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_equals_statistics(spark, monkeypatch, name, accuracy):
    monkeypatch.setattr(medians, "FEW", 10)
    monkeypatch.setattr(medians, "ACCURACY", accuracy)
    values = CASES[name]
    assert medians.exact_median(table(spark, values), "x") == pytest.approx(statistics.median(values), rel=1e-12)


def test_nulls_nan_and_nothing(spark):
    assert medians.exact_median(table(spark, [None, float("nan")]), "x") is None
    assert medians.exact_median(table(spark, []), "x") is None
    assert medians.exact_median(table(spark, [None, 3.0, float("nan"), 1.0]), "x") == 2.0


def test_by_group_with_a_null_one(spark):
    rows = [(k, random.Random(i).choice([None, float("nan"), float(i % 13), i / 7])) for i, k in enumerate(["a", "b", None] * 90)]
    got = {r["k"]: r["median"] for r in medians.median_by(spark.createDataFrame(rows, "k string, x double"), "k", "x").collect()}
    for key in ("a", "b", None):
        assert got[key] == pytest.approx(statistics.median(x for k, x in rows if k == key and x is not None and x == x))


def test_imputation_needs_no_median_buffer(spark):
    df = spark.createDataFrame([("r", 3.0, 400.0), ("r", 5.0, None), (None, None, 500.0), ("s", None, None)],
                               "race_id string, age double, horse_weight double")
    for by in (None, "race_id"):
        stats = impute_stats(df, by)
        assert "median(" not in stats._jdf.queryExecution().executedPlan().toString()
    assert impute_stats(df).first().asDict() == {"age": 4.0, "horse_weight": 450.0}
    got = {r["race_id"]: (r["age"], r["horse_weight"]) for r in impute_stats(df, "race_id").collect()}
    assert got == {"r": (4.0, 400.0), None: (3.0, 500.0), "s": (3.0, 470.0)}
