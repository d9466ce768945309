"""From stored pages to features and cards, and inputs that the driver's tables lack."""

import json
import random

import pytest
from conftest import SF, day
from pyspark.sql import functions as F

from racecard import (
    append_results, extract_entries, extract_history, extract_results, load_model, load_pages, past_features, predict,
    race_card, train, with_race_facts,
)
from racecard.operators import card, frames, skew
from racecard.plans import derived_pages, queries_flow
from racecard.plans.runs import runs
from racecard.schema import RESULTS
from racecard.session import shared_folder
from racecard.sources import odds
from racecard.sources.tables import stored_results
from racecard.streaming.streams import latest_odds_stream, read_latest_odds


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages"))
    every = runs(spark, SF).cache()
    domestic = every.where(F.col("race_id").rlike("^[0-9]{12}$"))
    for made in (derived_pages.result_pages(domestic), derived_pages.entry_pages(domestic),
                 derived_pages.history_pages(every, [])):
        made.write.mode("append").parquet(path)
    return path


def test_documented_flow(spark, pages, tmp_path):
    loaded = load_pages(spark, pages)
    history = extract_history(loaded)
    append_results(with_race_facts(extract_results(loaded), history), str(tmp_path / "results"))
    results = stored_results(spark, str(tmp_path / "results"))
    assert results.where("race_date is null or race_name is null").count() == 0
    training = train(results, str(tmp_path / "model"), rounds=3)
    assert 0 <= training.auc <= 1
    model = load_model(spark, str(tmp_path / "model"))
    entries = extract_entries(loaded)
    card = race_card(predict(entries, history, model, results=results), not_yet_run=True)
    totals = card.groupBy("race_id").agg(F.sum("probability").alias("p"))
    assert totals.where("abs(p - 100) > 1e-6").count() == 0 and card.count() == entries.count()


def test_an_undated_race_comes_last(spark):
    schema = "race_id string, race_date date, horse_id string, horse_no string, finish string, up_3f string, race_name string"
    past = spark.createDataFrame([(f"20230101010{i}", day(i), "h", "1", str(i + 1), "35.0", "G1") for i in range(4)], schema)
    entry = spark.createDataFrame([("202309010101", None, "h", "1", None, None, None)], schema)
    row = past_features(entry, past).first()
    assert row["prev_rank"] == 4.0 and row["win_rate"] == 0.25
    known = with_race_facts(entry.withColumn("race_id", F.lit("202301010102")).drop("race_date"), past)
    assert past_features(known, past).first()["prev_rank"] == 2.0


def test_one_horse_with_many_races_on_one_day(spark, small_groups_are_hot):
    draw = random.Random(2)
    rows = [(f"2023010101{i:04d}"[:12], day(0), "h", str(i % 18), str(draw.randint(1, 9)), f"3{draw.randint(3, 9)}.0", "x")
            for i in draw.sample(range(3000), 99)]
    rows = [(f"202301{i:06d}", *r[1:]) for i, r in enumerate(rows)]
    schema = "race_id string, race_date date, horse_id string, horse_no string, finish string, up_3f string, race_name string"
    df = spark.createDataFrame(rows, schema).repartition(7)
    assert skew.hot_values(df, "horse_id") == ["h"]
    for order in ("time", "race_id"):
        hot = {r.race_id: tuple(r) for r in past_features(df, order=order).collect()}
        plain = {r.race_id: tuple(r) for r in past_features(df, order=order, hot=[]).collect()}
        assert hot == plain
    for i in (1, 50, 98):
        finishes = [int(r[4]) for r in rows[:i]]
        found = past_features(df).where(F.col("race_id") == rows[i][0]).first()
        assert found["prev_rank"] == finishes[-1] and found["win_rate"] == pytest.approx(finishes.count(1) / i)


def test_blank_numbers_and_null_ids_are_kept_once(spark, tmp_path):
    base = [("r1", n, f"horse {i}") for i, n in enumerate(["", "", None, None])] + [(None, "1", "stray")]
    batch = spark.createDataFrame(base, "race_id string, horse_no string, horse_name string")
    path = str(tmp_path / "results")
    append_results(batch, path)
    append_results(batch.unionByName(batch), path)
    assert stored_results(spark, path).count() == 5
    full = stored_results(spark, path).select(RESULTS.names)
    marked = full.withColumn("fingerprint", frames.fingerprint(RESULTS.names))
    assert frames.new_rows(marked.unionByName(marked), marked.limit(0)).count() == 5
    assert frames.new_rows(marked, marked).count() == 0


def body(entries, **more):
    return json.dumps({"status": "middle", "data": {"odds": {"1": entries, **more}}})


def test_odd_entries_and_markets_take_no_runner_away(spark):
    good = {"01": ["2.5", "0", "1", "1"], "02": ["9.0", "0", "2", "2"]}
    feed = spark.createDataFrame([
        ("a", 1, body({**good, "03": "scratched", "04": {"x": 1}, "05": None, "06": ["1"]})),
        ("b", 1, body(good, **{"2": "closed", "3": {"0102": 7}})), ("c", 1, "no json"), ("d", 1, None),
    ], "race_id string, as_of long, body string")
    found = odds.parse_live_odds(feed).groupBy("race_id").count().collect()
    assert {r["race_id"]: r["count"] for r in found} == {"a": 2, "b": 2}


def test_odd_entries_are_listed_and_the_feeds_order_counts(spark):
    feed = spark.createDataFrame([("a", 1, body({"z": ["3.5", 0, 4, "01"], "b": "scratched", "a": ["1.5", "0", "2", "1"], "c": ["1"]}))],
                                 "race_id string, as_of long, body string")
    rows = odds.parse_live_odds(feed).orderBy("pos").collect()
    assert [(r["horse_no"], r["odds"], r["popularity"], r["pos"]) for r in rows] == [("1", "3.5", "4", 0), ("1", "1.5", "2", 2)]
    assert odds.latest_odds(odds.parse_live_odds(feed)).first()["odds"] == "1.5"
    odd = odds.odd_entries(feed).orderBy("pos").collect()
    assert [(r["name"], r["entry"]) for r in odd] == [("b", '"scratched"'), ("c", '["1"]')]


def test_stream_breaks_ties_as_the_table_does(spark, tmp_path):
    schema = "race_id string, horse_no string, odds string, popularity string, as_of timestamp, pos int"
    snapshots = spark.createDataFrame(
        [("a", "1", "9.0", "1", None, 0), ("a", "1", "2.0", "1", None, 1)], schema).withColumn(
        "as_of", F.lit("2026-01-01").cast("timestamp"))
    for i in range(2):
        snapshots.where(F.col("pos") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(snapshots.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    latest_odds_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"), once=True).awaitTermination()
    want = odds.latest_odds(snapshots).collect()
    assert read_latest_odds(spark, str(tmp_path / "out")).collect() == want and want[0]["odds"] == "2.0"


def test_work_lies_below_the_named_folder(spark):
    folder = shared_folder(spark)
    assert folder.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert spark.sparkContext.applicationId in folder


def test_card_of_pages_parses_them_once(spark, monkeypatch):
    """Races are counted on the order lines; runs are computed once for all kinds of pages."""
    calls = []
    monkeypatch.setattr(card, "hot_values", lambda *_: calls.append("pages"))
    monkeypatch.setattr(queries_flow, "runs", lambda *_: runs(spark, SF).where("false"))  # lazy, for a count of hot races
    assert queries_flow.pages_to_card(spark, SF).count() > 5000
    assert calls == []
