import datetime as dt

import pytest
from pyspark.sql import functions as F

from racecard.operators import features as fe
from racecard.operators import frames
from racecard.functions import clean
from racecard.operators.history import past_features
from racecard.operators.rates import missing_ids, rate_totals, with_rates
from racecard.plans import queries_features  # noqa: F401  (importing a module registers its queries)
from racecard.plans.registry import QUERIES
from racecard.schema import FEATURES

RAW = "race_id string, horse_no string, finish string, sex_age string, body_weight string, " \
      "carried string, odds string, popularity string, prev_rank double"


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW)


def test_fill_values(spark):
    df = raw(spark, [
        ("a", "1", "1", "牡3", "計不", "▲55", "---", "1", None),
        ("a", "x", "2", "牝4", "480(+2)", "56", "4.0", None, None),
        ("b", "3", "中", "セ", "470", "54", "2.0", "3", None),
    ])
    parsed = fe.parse_features(df)
    stats = fe.impute_stats(parsed).first()
    assert stats.age == 3.5 and stats.horse_weight == 475.0 and stats.jockey_weight == 55.0
    assert stats.odds == 3.0 and stats.popularity == 2.0
    assert stats.prev_rank == 8.0 and stats.weight_change == 0.0 and stats.horse_number == 1.0
    by_race = {r.race_id: r for r in fe.impute_stats(parsed, "race_id").collect()}
    assert by_race["b"].age == 3.0 and by_race["a"].horse_weight == 480.0


def test_feature_table_has_all_features_in_order(spark):
    out = fe.feature_table(raw(spark, [("a", "1", "01", "牡3", "470", "55", "2.0", "1", 2.0)]))
    assert out.columns == ["race_id", "horse_no", "is_win", *FEATURES]
    row = out.first()
    assert row.is_win == 1 and row["sex_牡"] == 1.0 and row["sex_牝"] == 0.0 and row.trainer_win_rate == 0.0


def test_training_values_fill_scored_rows(spark):
    train = fe.parse_features(raw(spark, [("a", "1", "1", "牡3", "400", "50", "2.0", "1", 2.0)]))
    new = raw(spark, [("z", "1", "0", None, None, None, None, None, None)])
    row = fe.feature_table(new, fe.impute_stats(train)).first()
    assert (row.age, row.horse_weight, row.jockey_weight, row.odds, row.prev_rank) == (3.0, 400.0, 50.0, 2.0, 2.0)
    assert row["sex_牡"] == row["sex_牝"] == row["sex_セ"] == 0.0


def test_absent_columns_become_zero(spark):
    bare = spark.createDataFrame([("a", "1", "2.0")], "race_id string, horse_no string, odds string")
    row = fe.feature_table(frames.with_defaults(bare)).first()
    assert row.horse_weight == 470.0 and row.age == 0.0 and row.odds == 2.0 and row.is_win == 0


def test_excluded_features(spark):
    out = fe.feature_table(raw(spark, [("a", "1", "1", "牡3", "470", "55", "2.0", "1", 2.0)]), exclude=("odds",))
    assert "odds" not in out.columns and len(out.columns) == 20


def test_vector_rejects_gaps(spark):
    df = spark.createDataFrame([(1.0, None)], "age double, odds double")
    with pytest.raises(Exception):
        fe.assemble(df).collect()


def test_rates_unknown_and_null(spark):
    df = spark.createDataFrame([("j1",), ("j9",), (None,)], "jockey_id string")
    rates = spark.createDataFrame([("jockey", "j1", 0.2, 0.5), ("trainer", "j9", 0.9, 0.9)], "entity_type string, id string, win_rate double, place_rate double")
    got = {r.jockey_id: r.jockey_win_rate for r in with_rates(df, rates, "jockey").collect()}
    assert got == {"j1": 0.2, "j9": 0.0, None: None}
    ids = spark.createDataFrame([("j1",), ("j9",), (None,)], "id string")
    assert [r.id for r in missing_ids(ids, rates, "jockey").collect()] == ["j9"]


def test_new_races(spark):
    schema = "race_id string, horse_no string, finish string"
    stored = spark.createDataFrame([("a", "1", "1")], schema)
    batch = spark.createDataFrame([("a", "2", "1"), ("b", "1", "2"), ("b", "1", "1"), ("b", "2", None)], schema)
    got = [(r.race_id, r.horse_no, r.finish) for r in frames.new_races(batch, stored).collect()]
    assert sorted(got, key=repr) == [("b", "1", "1"), ("b", "1", "2"), ("b", "2", None)]
    summary = frames.batch_summary(batch).first()
    assert (summary.races, summary.runners) == (2, 4)


def test_canonical_union_preview(spark):
    a = spark.createDataFrame([("r", "1", "3.5")], ["race_id", "馬番", "単勝"])
    b = spark.createDataFrame([("s", "2")], ["race_id", "horse_no"])
    both = frames.union_batches([frames.canonical(a), b])
    assert both.columns == ["race_id", "horse_no", "odds"] and both.where(F.col("odds").isNull()).count() == 1
    assert frames.preview(both).columns == ["race_id", "horse_no", "odds"]
    assert frames.drop_leaks(both).columns == ["race_id", "odds"]
    assert frames.drop_if_present(both, ["odds", "absent"]).columns == ["race_id", "horse_no"]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_raw_text_is_parsed_once(spark):
    df = spark.createDataFrame([("202301010101", "1", dt.date(2023, 1, 1), "G1", "1", "2019000001", "00001", "34.5")],
                               "race_id string, horse_no string, race_date date, race_name string, finish string, "
                               "horse_id string, jockey_id string, up_3f string")
    plan = plan_of(past_features(df, hot=[]))
    assert plan.count("translate(finish") <= 2 and plan.count("^[0-9]{12}$") == 1
    plan = plan_of(rate_totals(df, "jockey"))
    assert plan.count("translate(finish") <= 2


def test_weight_and_change_come_from_one_pattern(spark):
    df = spark.createDataFrame([("\u30004(-1)",), (" 470\u2029",), ("4 7",)], "w string")
    both = df.select(clean.body_weight("w").alias("a"), clean.weight_change("w").alias("b"))
    assert [tuple(r) for r in both.collect()] == [(4.0, -1.0), (470.0, 0.0), (None, None)]
    assert "trim(" not in plan_of(both.sparkSession.range(1).select(F.lit("1").alias("w")).unionByName(df).select(clean.body_weight("w")))


def test_enriched_runs_are_computed_once_for_fills_by_race(spark):
    plan = plan_of(QUERIES["impute_by_race"](spark, "/root/testdata/sf0.001"))
    assert "l_orderkey" not in plan and "race_date" not in plan
