import random

import pytest
from pyspark.sql import functions as F

from racecard.operators import card, skew
from racecard.operators.evaluate import accuracy, roc_auc
from racecard.operators.split import stratified_split


def runners(spark, seed=0, races=6, hot=0):
    rnd = random.Random(seed)
    rows = []
    for race in range(races):
        size = hot if race == 0 and hot else rnd.randint(1, 9)
        for n in range(1, size + 1):
            rows.append((f"r{race}", str(n), f"h{race}-{n}", f"H{n}", rnd.choice(["1.5", "3.0", "3.0", "---", "0.0"]), rnd.choice([0.0, 0.1, 0.3])))
    return spark.createDataFrame(rows, "race_id string, horse_no string, horse_id string, horse_name string, odds string, score double")


def as_dict(df):
    return {(r.race_id, r.horse_no): (round(r.probability, 9), r.rank_in_race) for r in df.collect()}


def test_shares_and_ranks(spark):
    df = runners(spark)
    out = card.normalize(df)
    total = out.groupBy("race_id").agg(F.sum("probability").alias("s")).collect()
    assert all(r.s == pytest.approx(100.0) for r in total)
    for race in {r.race_id for r in total}:
        mine = sorted(df.where(F.col("race_id") == race).collect(), key=lambda r: (-r.score, int(r.horse_no)))
        ranks = {r.horse_no: r.rank_in_race for r in out.where(F.col("race_id") == race).collect()}
        assert [ranks[r.horse_no] for r in mine] == list(range(1, len(mine) + 1))


def test_hot_race_equals_plain_windows(spark, small_groups_are_hot):
    df = runners(spark, seed=5, hot=200)
    assert skew.hot_values(df, "race_id")
    assert as_dict(card.normalize(df)) == as_dict(card.normalize(df, hot=[]))
    order = [F.col("score").desc(), F.col("horse_no").cast("int")]
    hot = skew.hot_values(df, "race_id")
    numbered = skew.number_rows(df, "race_id", order, "n", hot)
    plain = skew.number_rows(df, "race_id", order, "n", [])
    key = ["race_id", "horse_no", "n"]
    assert sorted(map(tuple, numbered.select(key).collect())) == sorted(map(tuple, plain.select(key).collect()))


def test_hot_keys_are_those_above_their_share(spark, small_groups_are_hot):
    df = spark.range(5000).select(F.when(F.col("id") < 50, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    assert skew.hot_values(df, "k") == [-1]


def test_no_key_above_its_share_stays(spark):
    df = spark.range(6000).select((F.col("id") % 300).alias("k"))
    assert skew.hot_values(df, "k") == []


def test_more_than_a_thousand_hot_keys(spark):
    spark.conf.set(skew.PARTS_SETTING, "5000")
    try:
        df = spark.range(30000).select(F.when(F.col("id") < 24000, F.col("id") % 1200).otherwise(F.col("id")).alias("k"))
        assert skew.hot_values(df, "k") == list(range(1200))
    finally:
        spark.conf.unset(skew.PARTS_SETTING)


def test_zero_weights_share_equally(spark):
    df = spark.createDataFrame([("r", str(i), "h", 0.0) for i in range(4)], "race_id string, horse_no string, horse_id string, score double")
    assert {r.probability for r in card.normalize(df).collect()} == {25.0}


def test_inverse_odds(spark):
    df = spark.createDataFrame([("0.0",), ("---",), (None,), ("2.0",)], "odds string")
    got = [r[0] for r in df.select(card.odds_weight()).collect()]
    assert got == pytest.approx([1 / 999, 1 / 999, 1 / 999, 0.5])


def test_card_top_and_headline(spark):
    shown = card.race_card(card.odds_probability(runners(spark, seed=3)))
    rows = shown.collect()
    for race in {r.race_id for r in rows}:
        mine = sorted((r for r in rows if r.race_id == race), key=lambda r: r.rank_in_race)
        assert [r.mark for r in mine] == ["◎", "○", "▲", "△", "△", "-", "-", "-", "-"][: len(mine)]
        assert all(r.odds_shown != "999.0" for r in mine)
    assert card.recommendations(shown).groupBy("race_id").count().agg(F.max("count")).first()[0] <= 4
    heads = {r.race_id: r for r in card.headline(shown).collect()}
    small = [r for r in {x.race_id for x in rows} if sum(y.race_id == r for y in rows) == 1]
    for race in small:
        assert (heads[race].rival_name, heads[race].rival_gate_no, heads[race].rival_probability) == ("該当なし", "", 0.0)


def test_auc_and_accuracy(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (0, 0.1), (1, 0.6), (0, 0.2)], "is_win int, score double")
    # Pairs (winner, loser): 0.9 ties 0.9, beats two; 0.6 loses one, beats two.
    assert roc_auc(df).first()[0] == pytest.approx((0.5 + 2 + 2) / 6)
    assert accuracy(df).first()[0] == pytest.approx(4 / 5)
    assert roc_auc(df.where("is_win = 1")).first()[0] == 0.5


@pytest.mark.parametrize("unit", ["row", "race"])
def test_split_is_exact_and_stable(spark, unit):
    df = spark.range(1000).select(
        F.concat(F.lit("r"), F.col("id") / 10).alias("race_id"), F.col("id").cast("string").alias("horse_no"),
        (F.col("id") % 10 == 0).cast("int").alias("is_win"),
    )
    out = stratified_split(df, unit=unit)
    again = stratified_split(df.repartition(7), unit=unit)
    assert sorted(out.collect()) == sorted(again.collect())
    if unit == "row":
        counts = {(r.is_win, r.part): r["count"] for r in out.groupBy("is_win", "part").count().collect()}
        assert counts == {(1, "test"): 20, (1, "train"): 80, (0, "test"): 180, (0, "train"): 720}
    else:
        assert out.groupBy("race_id").agg(F.countDistinct("part").alias("n")).where("n > 1").count() == 0


def test_copies_stay_on_one_side(spark):
    df = spark.range(300).select(F.lit("r").alias("race_id"), F.lit("1").alias("horse_no"), F.lit(0).alias("is_win"))
    others = spark.range(700).select(F.lit("q").alias("race_id"), F.col("id").cast("string").alias("horse_no"), F.lit(0).alias("is_win"))
    out = stratified_split(df.unionByName(others))
    assert out.where("race_id = 'r'").select("part").distinct().count() == 1
    assert out.count() == 1000
