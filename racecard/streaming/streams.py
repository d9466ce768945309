"""The two feeds that keep arriving: odds snapshots and race results."""

from __future__ import annotations

import datetime as dt
import hashlib
import sys
import time
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from racecard.operators.frames import fingerprint, new_rows
from racecard.schema import RESULTS
from racecard.session import staged
from racecard.sources.odds import latest_odds
from racecard.sources.tables import batches_with_races_of, conform, in_seasons_of, stored_rows, write_results

# Workers get this module's functions with the job, whether or not the package is installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEPT_FOR, LATENESS = "2 days", "7 days"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_NEWEST = "at bigint, pos int, odds string, popularity string"  # time in microseconds
_CHANGED = f"race_id string, horse_no string, {_NEWEST}"


def _order(v: tuple) -> tuple:
    """Newest first means largest: by time, place in the feed, then text; a missing value comes before any."""
    return tuple((x is not None, x if x is not None else 0) for x in v)


class NewestOdds(StatefulProcessor):
    """The newest odds of one runner, and a timer on the feed's own clock that ends them.

    The state is one value per runner, set anew by every newer snapshot; its timer stands
    ``kept_for`` behind that snapshot. When the watermark has passed the timer, the race is
    over: value and timer are gone.
    """

    def __init__(self, kept_for: dt.timedelta):
        self.kept_ms = int(kept_for.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", _NEWEST)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fields = ("at", "pos", "odds", "popularity")
        best = max((tuple(row[f] for f in fields) for row in rows), key=_order)
        held = self.newest.get() if self.newest.exists() else None
        if held is not None and _order(tuple(held)) >= _order(best):
            return
        if held is not None:
            self.handle.deleteTimer(self._end(held[0]))
        self.newest.update(best)
        self.handle.registerTimer(self._end(best[0]))
        yield Row(race_id=key[0], horse_no=key[1], at=best[0], pos=best[1], odds=best[2], popularity=best[3])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.newest.clear()
        return iter(())

    def _end(self, at: int | None) -> int:
        # A snapshot without a time is the oldest of all: it ends with the watermark's first step.
        return self.kept_ms + (at // 1000 if at is not None else 0)

    def close(self) -> None:
        pass


def _seconds(spark: SparkSession, length: str) -> dt.timedelta:
    return spark.sql(f"SELECT INTERVAL '{length.split()[0]}' {length.split()[1]} AS d").first()["d"]


def latest_odds_stream(
    snapshots: DataFrame,
    path: str,
    checkpoint: str,
    once: bool = False,
    kept_for: str = KEPT_FOR,
    lateness: str = LATENESS,
) -> StreamingQuery:
    """Keep the newest odds per runner from a stream of parsed snapshots.

    State is one value per runner, which ends once the feed's clock (the newest time seen,
    less ``lateness``) is ``kept_for`` past the runner's newest snapshot; so state is as large as
    the races under way, however long the stream runs. A snapshot that is older than a runner's
    newest changes nothing; one more than ``lateness`` behind the whole feed is dropped, as Spark
    does with any late row, and counted in the query's progress.

    Each micro-batch writes the runners it changed into a folder named after the run and the
    batch, so a replayed batch replaces its own output and a new checkpoint never that of
    another run. ``merge_latest_odds`` turns many folders into one.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    spark = snapshots.sparkSession

    def write(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/run={run}/batch={batch_id}")

    newest = (
        snapshots.withColumn("as_of", F.col("as_of").cast("timestamp"))
        .select("race_id", "horse_no", "as_of", F.unix_micros("as_of").alias("at"), "pos", "odds", "popularity")
        .withWatermark("as_of", lateness)
        .groupBy("race_id", "horse_no")
        .transformWithState(NewestOdds(_seconds(spark, kept_for)), _CHANGED, "Update", "eventTime")
        .select("race_id", "horse_no", "odds", "popularity", F.timestamp_micros("at").alias("as_of"), "pos")
    )
    writer = newest.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    # Timers and values need the store on disk; a running stream keeps what it was started with.
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        spark.conf.set(PROVIDER, before)


def read_latest_odds(spark: SparkSession, path: str) -> DataFrame:
    """What the stream has found so far: the newest of all its batches."""
    return latest_odds(spark.read.parquet(path))


def merge_latest_odds(spark: SparkSession, path: str) -> int:
    """Turn the folders of finished batches into one; returns how many it replaced.

    The merged folder is complete before any other is deleted, and a runner that stands in
    both counts once, as the newest wins: whoever reads in between, or replays a batch after,
    finds the same odds.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = hadoop.Path(f"{path}/run=*/batch=*/_SUCCESS")
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [f.getPath().getParent() for f in files.globStatus(where) or []]
    if len(done) < 2:
        return 0
    merged = latest_odds(spark.read.option("basePath", path).parquet(*[str(d) for d in done]), with_pos=True)
    merged.write.mode("errorifexists").parquet(f"{path}/run=merged/batch={time.time_ns()}")
    for folder in done:
        files.delete(folder, True)
    return len(done)


def ingest_stream(
    results: DataFrame, path: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Append each row of a stream of results exactly once.

    A row is new unless a stored one is equal in every column, so a corrected row is kept beside
    the first. Rows are known by their stored fingerprints: no other column of the table is read,
    and only of the seasons of the batch and the stored batches that hold one of its races. Each micro-batch writes folders of its own, named after
    the checkpoint and the batch. Replaying a batch replaces them, and asks all others
    what is stored; a new checkpoint finds every row there already.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, batch_id: int) -> None:
        own = f"{run}-{batch_id}"
        rows = conform(batch, RESULTS)
        # Of the batch, as it comes, the ids are read once and the rows once.
        races = rows.select("race_id").distinct().persist()
        try:
            # Equal rows have equal race ids, so only batches with one of these races can hold a row.
            others = [name for name in batches_with_races_of(races, path) if name != own]
            stored = stored_rows(batch.sparkSession, path).where(F.col("batch").isin(others))
            held = in_seasons_of(races, stored.select("fingerprint", "season"))
            # Written twice, to the index and to the table, but found once.
            fresh = new_rows(rows.withColumn("fingerprint", fingerprint(RESULTS.names)), held)
            with staged(fresh.select(RESULTS.names)) as fresh:
                write_results(fresh, path, own)
        finally:
            races.unpersist()

    writer = (
        results.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
