"""What steps leave behind on the disks."""

import os
import time

import pytest
from pyspark.sql import functions as F

from racecard.operators.frames import new_races
from racecard.plans.queries_flow import entries_to_features, pages_to_features
from racecard.plans.queries_model import feature_vectors
from racecard.schema import RESULTS
from racecard.session import shared_folder, staged
from racecard.sources.horse_states import ingest_with_features
from racecard.sources.tables import append_results, stored_results, write_results
from racecard.streaming.streams import ingest_stream


def shuffles(spark) -> int:
    """Shuffles whose files are kept."""
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    return env.mapOutputTracker().shuffleStatuses().size()


def settled(read, most: int) -> int:
    """What ``read`` gives once it is ``most`` or less; files are deleted in the background."""
    for _ in range(50):
        if read() <= most:
            break
        time.sleep(0.1)
    return read()


def tables(spark) -> set[str]:
    folder = shared_folder(spark).removeprefix("file:").replace("//", "/", 1)
    return {name for name in os.listdir(folder) if name.startswith("table-")}


@pytest.fixture
def offered(spark):
    """Races of three runners; every tenth row has no race id, and every row comes twice."""
    base = spark.range(300).select(
        F.when(F.col("id") % 10 > 0, F.format_string("2023%08d", F.expr("id div 3"))).alias("race_id"),
        (F.col("id") % 3).cast("string").alias("horse_no"), F.format_string("%010d", F.col("id") % 20).alias("horse_id"),
        F.lit("1").alias("finish"), F.expr("date_add(date'2023-01-01', int(id div 3))").alias("race_date"))
    return base.unionByName(base)


def test_staged_tables_leave_neither_files_nor_shuffles(spark):
    before, held = tables(spark), shuffles(spark)
    for _ in range(5):
        with staged(spark.range(1000).repartition(3)) as rows:
            assert rows.count() == 1000 and len(tables(spark) - before) == 1
    assert tables(spark) == before and settled(lambda: shuffles(spark), held + 2) <= held + 2


def test_appending_keeps_no_copy_of_the_batch(spark, offered, tmp_path):
    path, before, held = str(tmp_path / "results"), tables(spark), shuffles(spark)
    append_results(offered.where("race_date < '2023-02-01'"), path)
    append_results(offered, path)
    # The race without an id is stored by then, so its 20 later rows are not new.
    assert stored_results(spark, path).count() == 280 and tables(spark) == before
    # The small sets of names that are collected or broadcast may still be known.
    assert settled(lambda: shuffles(spark), held + 4) <= held + 4


def test_ingest_with_features_keeps_its_result_alone(spark, offered, tmp_path):
    before = tables(spark)
    out = ingest_with_features(offered, str(tmp_path / "results"), str(tmp_path / "states"))
    assert out.count() == 300 and len(tables(spark) - before) == 2  # the features, and the ids of late horses


def test_stream_keeps_no_rows_in_memory_or_on_disk(spark, offered, tmp_path):
    offered.select(*[F.col(c) if c in offered.columns else F.lit(None).cast("string").alias(c) for c in RESULTS.names]
                   ).repartition(4).write.parquet(f"{tmp_path}/landing")
    cached, before, most = spark.sparkContext._jsc.getPersistentRDDs, tables(spark), []
    for replay in ("a", "b"):
        landing = spark.readStream.schema(RESULTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/landing")
        ingest_stream(landing, f"{tmp_path}/table", f"{tmp_path}/{replay}", once=True).awaitTermination()
        most.append(settled(lambda: shuffles(spark), 10))
    assert stored_results(spark, f"{tmp_path}/table").count() == 300
    assert tables(spark) == before and settled(lambda: cached().size(), 0) == 0 and max(most) <= 10


@pytest.mark.parametrize("hot", [[], ["202300000001"]])
def test_races_dealt_out_once_are_the_same(spark, offered, tmp_path, hot):
    stored = offered.where("race_id < '202300000020'")
    found = new_races(offered, stored, hot=hot)
    assert sorted(found.collect(), key=str) == sorted(new_races(offered, stored).collect(), key=str)
    with_null = stored.unionByName(offered.where("race_id is null"))
    assert new_races(offered, with_null, hot=hot).where("race_id is null").count() == 0


def test_stored_fingerprints_are_of_the_rows(spark, offered, tmp_path):
    path = str(tmp_path / "results")
    write_results(offered, path)
    assert spark.read.parquet(path).select("fingerprint").distinct().count() == 300


@pytest.fixture
def race_tables(spark, tmp_path):
    """A folder of orders and lines that make 40 races of three runners."""
    spark.range(120).select(
        F.expr("id div 3").alias("l_orderkey"), (F.col("id") * 7 % 25).alias("l_partkey"), (F.col("id") * 5 % 9).alias("l_suppkey"),
        (F.col("id") % 3 + 1).cast("int").alias("l_linenumber"), (F.col("id") % 50 + 1).cast("double").alias("l_quantity"),
        (F.col("id") * 37 % 1000).cast("double").alias("l_extendedprice"), F.lit("N").alias("l_returnflag"),
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(40).select(
        F.col("id").alias("o_orderkey"), F.expr("cast(date_add(date'1995-01-01', int(id)) as timestamp)").alias("o_orderdate"),
        F.lit("4-NOT SPECIFIED").alias("o_orderpriority")).write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("query", [pages_to_features, entries_to_features])
def test_pages_are_parsed_before_their_rows_are_joined(spark, race_tables, query):
    out = query(spark, race_tables)
    # What parses a page stands in no plan that reads its rows several times.
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()
    # The order 0 is a race abroad, without a page.
    assert out.count() == out.select("race_id", "horse_no").distinct().count() == 117


def test_feature_vectors_build_the_runs_once(spark, race_tables):
    out = feature_vectors(spark, race_tables)
    assert "lineitem" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 120 * 18
