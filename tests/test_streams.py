"""Streams that end their state and keep whole rows; stored tables by batch."""

import datetime as dt
import json
import random

from conftest import SF, day
from pyspark.sql import functions as F

from racecard.plans.runs import runs
from racecard.schema import RESULTS
from racecard.sources import odds, tables
from racecard.sources.tables import stored_results, stored_rows
from racecard.streaming.streams import ingest_stream, latest_odds_stream, merge_latest_odds, read_latest_odds

SNAPSHOTS = "race_id string, horse_no string, odds string, popularity string, as_of timestamp, pos int"
START = dt.datetime(2024, 1, 1)


def land(spark, folder, rows):
    spark.createDataFrame(rows, SNAPSHOTS).coalesce(1).write.mode("append").parquet(folder)


def run_odds(spark, base, **options):
    stream = spark.readStream.schema(SNAPSHOTS).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    query = latest_odds_stream(stream, f"{base}/out", f"{base}/ck", once=True, **options)
    query.awaitTermination()
    return query


def held(spark, base):
    found = spark.read.format("statestore").option("stateVarName", "newest").load(f"{base}/ck")
    return {(r["key"]["race_id"], r["key"]["horse_no"]) for r in found.collect()}


def test_odds_state_ends_with_the_race(spark, tmp_path):
    base, options = str(tmp_path), {"kept_for": "1 days", "lateness": "1 hours"}
    every = []
    for n in range(6):  # a race a day, each runner seen three times, out of order
        at = START + dt.timedelta(days=n)
        rows = [(f"race{n}", str(h), f"{h + s}.0", str(h), at + dt.timedelta(minutes=s), h) for s in (1, 2, 0) for h in range(1, 4)]
        every += rows
        land(spark, f"{base}/in", rows)
        run_odds(spark, base, **options)
        assert {race for race, _ in held(spark, base)} <= {f"race{n}", f"race{n - 1}"}
    assert len(held(spark, base)) <= 6
    land(spark, f"{base}/in", [("race5", "1", "99.0", "9", START + dt.timedelta(days=4, hours=23, minutes=50), 0)])
    run_odds(spark, base, **options)  # late, but not beyond the lateness: it loses to the newer one
    want = odds.latest_odds(spark.createDataFrame(every, SNAPSHOTS))
    assert sorted(read_latest_odds(spark, f"{base}/out").collect()) == sorted(want.collect())


def test_odds_of_any_order_equal_the_table(spark, tmp_path):
    draw = random.Random(4)
    rows = [(draw.choice(["a", "b", None]), draw.choice(["1", "2", None]), str(draw.randint(1, 9)), "1",
             draw.choice([None, START + dt.timedelta(seconds=draw.randint(0, 40))]), draw.randint(0, 3)) for _ in range(200)]
    for first in range(0, 200, 50):
        land(spark, f"{tmp_path}/in", rows[first:first + 50])
    run_odds(spark, str(tmp_path))
    want = odds.latest_odds(spark.createDataFrame(rows, SNAPSHOTS))
    assert sorted(map(repr, read_latest_odds(spark, f"{tmp_path}/out").collect())) == sorted(map(repr, want.collect()))


def test_batch_folders_are_merged(spark, tmp_path):
    base = str(tmp_path)
    for n in range(4):
        land(spark, f"{base}/in", [("a", str(h), f"{n}.5", "1", START + dt.timedelta(minutes=n), 0) for h in range(3 + n)])
    run_odds(spark, base)
    before = sorted(read_latest_odds(spark, f"{base}/out").collect())
    assert merge_latest_odds(spark, f"{base}/out") >= 4 and merge_latest_odds(spark, f"{base}/out") == 0
    assert sorted(read_latest_odds(spark, f"{base}/out").collect()) == before
    land(spark, f"{base}/in", [("a", "1", "7.5", "1", START + dt.timedelta(hours=1), 0)])
    run_odds(spark, base)
    assert merge_latest_odds(spark, f"{base}/out") >= 2
    assert read_latest_odds(spark, f"{base}/out").where("odds = '7.5'").count() == 1


def ingest(spark, base, name):
    landing = spark.readStream.schema(RESULTS).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    ingest_stream(landing, f"{base}/table", f"{base}/{name}", once=True).awaitTermination()


def test_ingest_keeps_rows_that_differ(spark, tmp_path):
    base = str(tmp_path)
    made = [("r1", None, "x", "1"), ("r1", None, "x", "2"), ("r1", "1", "corrected", "3"), ("r1", "1", "corrected", "4"),
            (None, "1", "stray", None), ("r1", "", None, None), ("r1", None, None, None)]
    rows = tables.conform(spark.createDataFrame(made, "race_id string, horse_no string, horse_name string, finish string"), RESULTS)
    for part in (rows, rows.unionByName(rows), rows.limit(3)):
        part.coalesce(1).write.mode("append").parquet(f"{base}/in")
    for name in ("a", "a", "b"):  # the same checkpoint again, then a new one
        ingest(spark, base, name)
        got = stored_results(spark, f"{base}/table").select("race_id", "horse_no", "horse_name", "finish").collect()
        assert sorted(map(repr, got)) == sorted(map(repr, spark.createDataFrame(made, "race_id string, horse_no string, horse_name string, finish string").collect()))


def test_a_replayed_batch_replaces_its_own(spark, tmp_path):
    """The batch is run again after its rows were written but before it was noted as done."""
    base = str(tmp_path)
    rows = runs(spark, SF).select(*RESULTS.names)
    rows.write.parquet(f"{base}/in")
    ingest(spark, base, "a")
    n = stored_results(spark, f"{base}/table").count()
    last = max((tmp_path / "a" / "commits").iterdir(), key=lambda p: int(p.name) if p.name.isdigit() else -1)
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    ingest(spark, base, "a")
    assert stored_results(spark, f"{base}/table").count() == n == rows.count()
    assert stored_rows(spark, f"{base}/table").select("fingerprint").distinct().count() == n


def test_index_knows_the_races_and_spares_the_runners(spark, tmp_path):
    path = str(tmp_path / "results")
    every = runs(spark, SF).select(*RESULTS.names)
    tables.append_results(every.where("race_date < '1996-01-01'"), path)
    known = tables.stored_races(every, path)
    read = [f for f in known.inputFiles() if path in f]
    assert read and all(f"{path}{tables.INDEX}/" in f for f in read)
    want = every.where("race_date < '1996-01-01'").select("race_id").distinct()
    assert known.exceptAll(want).count() == 0 and want.exceptAll(known).count() == 0
    tables.append_results(every, path)
    tables.append_results(every, path)
    got = stored_results(spark, path).select(*RESULTS.names)
    assert got.exceptAll(every).count() == 0 and every.exceptAll(got).count() == 0


def test_only_batches_with_a_race_of_the_new_rows_are_asked(spark, tmp_path):
    path, schema = str(tmp_path / "results"), "race_id string, horse_no string"
    held = {"a": [("202301010101", "1")], "b": [("202301010102", "1"), (None, "1")], "c": [("202401010101", "1")]}
    for name, rows in held.items():
        tables.write_results(spark.createDataFrame(rows, schema), path, name)

    def asked(*races):
        return tables.batches_with_races_of(spark.createDataFrame([(r, "2") for r in races], schema), path)

    assert asked("202301010101") == ["a"] and asked(None, "202401010101") == ["b", "c"]
    assert asked("202301010199") == [] and tables.batches_with_races_of(spark.createDataFrame([("x", "1")], schema), f"{path}-none") == []


def test_an_index_without_rows_hides_no_race(spark, tmp_path):
    path = str(tmp_path / "results")
    every = runs(spark, SF).select(*RESULTS.names)
    tables._write_batch(every.select("race_id").distinct(), f"{path}{tables.INDEX}", "crashed")
    tables.append_results(every, path)
    assert stored_results(spark, path).count() == every.count()


def test_rate_file_larger_than_a_split(spark, tmp_path):
    entries = {f"{i:05d}": {"jockey_win_rate": i / 1e5, "jockey_place_rate": 0.5} for i in range(20_000)}
    entries['a"b\\é'] = {"jockey_win_rate": 0.25}
    entries["none"] = {"jockey_win_rate": None}
    (tmp_path / "rates.json").write_text(json.dumps(entries, indent=1))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        found = tables.load_rate_map(spark, str(tmp_path / "rates.json"), "jockey")
        assert found.rdd.getNumPartitions() > 10
        got = {r["id"]: (r["win_rate"], r["place_rate"]) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {i: (r.get("jockey_win_rate") or 0.0, r.get("jockey_place_rate") or 0.0) for i, r in entries.items()}
