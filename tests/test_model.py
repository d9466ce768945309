from functools import partial

import pytest
from conftest import day
from pyspark.sql import functions as F

from racecard.operators import card
from racecard.plans import queries_model
from racecard.plans.model import drop_old_models, load_model, newest_model, predict, save_model, train, tree_nodes


@pytest.fixture(scope="module")
def planted(spark):
    """Races whose cheapest runner wins, mostly."""
    base = spark.range(1200).select((F.col("id") / 6).cast("int").alias("race"), (F.col("id") % 6 + 1).alias("no"))
    price = ((F.col("no") * 7 + F.col("race") * 5) % 6 + 1).cast("double")
    return base.select(
        F.format_string("202301%06d", "race").alias("race_id"),
        F.expr("date_add(date'2023-01-01', race)").alias("race_date"),
        F.col("no").cast("string").alias("horse_no"),
        F.format_string("%010d", (F.col("race") * 6 + F.col("no")) % 97).alias("horse_id"),
        F.format_string("%05d", F.col("no") % 3).alias("jockey_id"),
        F.format_string("%05d", F.col("no") % 4).alias("trainer_id"),
        F.concat(F.lit("馬"), "no").alias("horse_name"),
        F.lit("牡4").alias("sex_age"), F.lit("470(+2)").alias("body_weight"), F.lit("55").alias("carried"),
        F.lit("34.5").alias("up_3f"), F.lit("未勝利").alias("race_name"),
        price.cast("string").alias("odds"), price.cast("int").cast("string").alias("popularity"),
        F.when((price == 1) & (F.col("race") % 10 > 0), F.lit("1")).otherwise(F.lit("2")).alias("finish"),
    )


def test_train_store_predict(spark, planted, tmp_path):
    path = str(tmp_path / "model")
    done = train(planted, path, rounds=3)
    assert done.auc > 0.9 and done.accuracy > 0.9
    rows = {r.feature: r for r in done.importance.collect()}
    assert len(rows) == 18 and rows["odds"].gain + rows["popularity"].gain > 0.5
    assert rows["odds"].label == "単勝オッズ" and sum(r.splits for r in rows.values()) > 0

    model = load_model(spark, path)
    entries = planted.drop("finish", "up_3f", "race_name")
    out = predict(entries, planted, model)
    assert out.count() == 1200
    totals = out.groupBy("race_id").agg(F.sum("probability").alias("s")).collect()
    assert all(r.s == pytest.approx(100.0) for r in totals)
    best = out.where("rank_in_race = 1")
    assert best.where(F.col("odds") == "1.0").count() > 150
    shown = card.race_card(out, not_yet_run=True)
    assert shown.where("finish_shown <> '-'").count() == 0


def test_shuffled_labels_teach_nothing(spark, planted, tmp_path):
    noise = planted.withColumn("finish", F.when(F.xxhash64("race_id", "horse_no") % 6 == 0, F.lit("1")).otherwise(F.lit("2")))
    assert 0.3 < train(noise, str(tmp_path / "m"), rounds=2, unit="race").auc < 0.7


def test_a_save_that_fails_leaves_the_old_model(spark, planted, tmp_path, monkeypatch):
    path = str(tmp_path / "model")
    first = train(planted, path, rounds=1).model
    before = load_model(spark, path)
    fills = before.stats.collect()

    class Lost(Exception):
        pass

    class Broken:
        """A model whose fill values can't be written, after pipeline and trees were."""

        pipeline, trees, features = first.pipeline, first.trees, first.features

        class stats:
            sparkSession = spark

            class write:
                @staticmethod
                def mode(_):
                    raise Lost

    with pytest.raises(Lost):
        save_model(Broken, path)
    after = load_model(spark, path)
    assert after.pipeline.stages[-1].uid == before.pipeline.stages[-1].uid and after.features == before.features
    assert after.stats.collect() == fills
    for _ in range(3):
        newest = save_model(first, path)
    assert drop_old_models(spark, path) == 3 and newest_model(spark, path)[0] == newest
    assert load_model(spark, path).stats.collect() == fills


def test_predict_without_model(spark, planted):
    out = predict(planted.drop("finish"), planted)
    assert out.where("rank_in_race = 1 and odds <> '1.0'").count() == 0
    assert day(0) is not None


def test_registered_model_is_fitted_on_every_training_row(spark, tmp_path, monkeypatch):
    lines = spark.range(7500).select(
        F.expr("id div 3").alias("l_orderkey"), (F.col("id") * 7 % 250).alias("l_partkey"), (F.col("id") * 5 % 40).alias("l_suppkey"),
        (F.col("id") % 3 + 1).cast("int").alias("l_linenumber"), (F.col("id") % 50 + 1).cast("double").alias("l_quantity"),
        (F.col("id") * 37 % 1000).cast("double").alias("l_extendedprice"), F.lit("N").alias("l_returnflag"))
    orders = spark.range(2500).select(
        F.col("id").alias("o_orderkey"), F.expr("cast(date_add(date'1995-01-01', int(id % 900)) as timestamp)").alias("o_orderdate"),
        F.lit("4-NOT SPECIFIED").alias("o_orderpriority"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(queries_model, "train", partial(train, rounds=2))
    done, cards, stored = queries_model.trained(spark, str(tmp_path))
    seen = tree_nodes(spark, done.path).where("nodeData.id = 0").select("nodeData.rawCount").collect()
    in_train = stored.count() - done.test.count()
    assert in_train > 4000 and [r.rawCount for r in seen] == [in_train] * 2 and cards.count() == stored.count()
