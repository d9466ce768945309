"""Stored tables: results, enriched runs, rate tables, and the grid of race ids to fetch."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from racecard.operators.frames import canonical, fingerprint, new_races
from racecard.operators.rates import latest_rates, missing_ids
from racecard.operators.skew import hot_values
from racecard.schema import ENTITY_RATES, RESULTS
from racecard.session import free_shuffles, staged


#: What the index of race ids has behind the path of its table.
INDEX = "-races"


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order; absent ones are null, blank ids are null."""
    columns = []
    for field in schema.fields:
        if field.name not in df.columns:
            column = F.lit(None).cast(field.dataType)
        elif isinstance(field.dataType, T.DateType):
            column = F.col(field.name).try_cast("date")
        elif field.name.endswith("_id"):
            column = F.nullif(F.trim(F.col(field.name)), F.lit(""))
        else:
            column = F.col(field.name).cast(field.dataType)
        columns.append(column.alias(field.name))
    return df.select(*columns)


def load_results(spark: SparkSession, path: str, format: str = "csv") -> DataFrame:
    """A results table from CSV (UTF-8, with or without a byte order mark) or parquet.

    Every CSV field is read as text, so ``01`` stays ``01`` and a blank finish does
    not turn the others into ``1.0``.
    """
    if format == "csv":
        raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    else:
        raw = spark.read.format(format).load(path)
    return conform(canonical(raw), RESULTS)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A parquet table with a declared schema; empty if nothing was written there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        # Known to be empty while a plan is built, so that no join with it is run.
        return spark.createDataFrame([], schema).limit(0)


def _with_season(df: DataFrame) -> DataFrame:
    return df.withColumn("season", F.substring("race_id", 1, 4))


STORED = T.StructType([*RESULTS.fields, T.StructField("fingerprint", T.StringType()),
                       T.StructField("season", T.StringType()), T.StructField("batch", T.StringType())])
KEYS = T.StructType([T.StructField("race_id", T.StringType()), T.StructField("season", T.StringType()),
                     T.StructField("batch", T.StringType())])


def _write_batch(df: DataFrame, path: str, batch: str, **made: Column) -> None:
    """One batch's folders, each season's own; a repeated batch replaces them.

    Rebalancing splits a large season over several files and merges small ones, where
    a plain repartition by season would leave one task per season. Columns that are ``made`` of
    the others are added after it.
    """
    (
        _with_season(df)
        .hint("rebalance", "season")
        .withColumns({**made, "batch": F.lit(batch)})
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        # Readers that look for a race skip the files and row groups that lack it.
        .option("parquet.bloom.filter.enabled#race_id", "true")
        .partitionBy("season", "batch")
        .parquet(path)
    )


def write_results(df: DataFrame, path: str, batch: str | None = None) -> None:
    """Add runners to a stored table, laid out by season and ``batch`` (a new one by default).

    Writing the same batch again replaces what it wrote before. The race ids go to an index
    beside the table first: an index that names too much would hide a race, so a reader of
    the index (``stored_races``) ignores batches that the table does not have. The rows are read twice.
    """
    batch = batch or uuid.uuid4().hex
    rows = conform(df, RESULTS)
    _write_batch(rows.select("race_id").distinct(), f"{path}{INDEX}", batch)
    _write_batch(rows, path, batch, fingerprint=fingerprint(RESULTS.names))
    free_shuffles(df.sparkSession)


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    """The stored table with the fingerprint and the batch of each row."""
    return read_or_empty(spark, path, STORED)


def stored_results(spark: SparkSession, path: str) -> DataFrame:
    return stored_rows(spark, path).select(*RESULTS.names, "season")


def in_seasons_of(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """What is stored of the batch's own seasons, the season of a null id included.

    Spark prunes the other seasons' folders by the batch's list while the join runs.
    """
    named = _with_season(batch).select("season").distinct()
    dated = stored.join(named.dropna(), "season", "left_semi")
    undated = stored.where("season is null").select(*dated.columns)
    return dated.unionByName(undated)


def stored_races(batch: DataFrame, path: str) -> DataFrame:
    """The race ids stored in the batch's seasons, from the index: one row per race and batch, no runner.

    A season of a batch whose index was written but whose rows were not has no folder in the table;
    the folders are listed, no file is read.
    """
    spark = batch.sparkSession
    half = sorted(_folders(spark, f"{path}{INDEX}") - _folders(spark, path))
    index = read_or_empty(spark, f"{path}{INDEX}", KEYS)
    folder = F.concat_ws("/", F.coalesce("season", F.lit("")), "batch")
    kept = index.where(~folder.isin(half)) if half else index
    return in_seasons_of(batch, kept).select("race_id")


def batches_with_races_of(batch: DataFrame, path: str) -> list[str]:
    """Names of the stored batches that may hold rows of the batch's races, from the index.

    The index is written before the rows, so no batch that holds one is missing.
    """
    races = batch.select(F.col("race_id").alias("_race")).distinct()
    index = in_seasons_of(batch, read_or_empty(batch.sparkSession, f"{path}{INDEX}", KEYS))
    found = index.join(races, F.col("race_id").eqNullSafe(F.col("_race")), "left_semi").select("batch").distinct()
    return sorted(row["batch"] for row in found.collect())  # one name a batch


def _folders(spark: SparkSession, path: str) -> set[str]:
    """``season/batch`` of every folder of a table, by their names; a null season's is empty."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = hadoop.Path(f"{path}/season=*/batch=*")
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []
    names = [str(f.getPath()).rsplit("/season=", 1)[1].split("/batch=") for f in found]
    return {f"{'' if season == '__HIVE_DEFAULT_PARTITION__' else season}/{batch}" for season, batch in names}


@contextmanager
def staged_new_races(batch: DataFrame, path: str) -> Iterator[DataFrame]:
    """The batch's races that are not stored yet, each row once, on disk until the block ends.

    The batch is staged, as it is read twice and may come straight from pages. Which races
    are stored is asked of the index of race ids; no stored runner is read. Each step is a job of its
    own, so that the shuffle files of one are gone before the next.
    """
    with ExitStack() as kept:
        with staged(conform(batch, RESULTS)) as rows:
            new = new_races(rows, stored_races(rows, path), hot=hot_values(rows, "race_id"))
            fresh = kept.enter_context(staged(new))
        yield fresh


def append_results(batch: DataFrame, path: str) -> None:
    """Append the races of a batch that are not stored yet; create the table if absent."""
    with staged_new_races(batch, path) as fresh:
        write_results(fresh, path)


def save_enriched(df: DataFrame, base: str) -> str:
    """Write a joined feature table as a new version and return its path.

    A version is never overwritten, so a plan that still reads an older one is safe. It
    is listed once it is complete, so a failed write is never loaded.
    """
    version = time.time_ns()
    path = f"{base}/data/version={version}"
    df.write.mode("errorifexists").parquet(path)
    listed = df.sparkSession.createDataFrame([(version, path)], "version long, path string")
    listed.write.mode("append").parquet(f"{base}/versions")
    return path


def load_enriched(spark: SparkSession, base: str) -> DataFrame:
    """The newest complete version of an enriched table."""
    listed = spark.read.parquet(f"{base}/versions")
    return spark.read.parquet(listed.agg(F.max_by("path", "version")).first()[0])


def load_rate_map(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """Rates kept as one JSON object per file: id to an object of its win and place rate.

    The file is read as records that end where an entry's object does, so that Spark splits
    a file of any size by byte ranges and no task holds an object whole. An entry that is not
    of this shape is left out; a rate that is missing or null is 0.
    """
    names = [f"{entity}_win_rate", f"{entity}_place_rate"]
    records = spark.read.option("lineSep", "}").text(path).withColumn(
        "as_of", F.col("_metadata.file_modification_time")
    )
    entry = r'"((?:[^"\\]|\\.)*)"\s*:\s*(\{[^{]*)$'
    # The id is JSON text too, so its escapes are read as the rates are.
    found = records.select(
        "as_of",
        F.get_json_object(F.concat(F.lit('{"id":"'), F.regexp_extract("value", entry, 1), F.lit('"}')), "$.id").alias("id"),
        F.regexp_extract("value", entry, 2).alias("rates"),
    ).where("rates != ''")
    values = F.from_json(F.concat("rates", F.lit("}")), "map<string,double>")
    return found.withColumn("rates", values).select(
        F.lit(entity).alias("entity_type"),
        "id",
        F.coalesce(F.col("rates")[names[0]], F.lit(0.0)).alias("win_rate"),
        F.coalesce(F.col("rates")[names[1]], F.lit(0.0)).alias("place_rate"),
        F.col("as_of").cast("timestamp").alias("as_of"),
    )


def load_entity_rates(spark: SparkSession, path: str) -> DataFrame:
    """The newest rates of each entity."""
    return latest_rates(read_or_empty(spark, path, ENTITY_RATES))


def upsert_entity_rates(rates: DataFrame, path: str, refresh: bool = False) -> None:
    """Append rates of ids not held yet, or of all given ids with ``refresh``."""
    new = conform(rates, ENTITY_RATES)
    if not refresh:
        held = read_or_empty(rates.sparkSession, path, ENTITY_RATES)
        parts = [
            missing_ids(new.where(F.col("entity_type") == e), held, e) for e in ("jockey", "trainer")
        ]
        new = parts[0].unionByName(parts[1])
    new.select(ENTITY_RATES.names).write.mode("append").parquet(path)


def race_id_grid(meetings: DataFrame, days: int = 2, races: int = 3) -> DataFrame:
    """Race ids of the given meetings: every day times every race, numbered from 1.

    ``meetings`` has ``year``, ``venue`` and ``meeting`` as text.
    """
    day = F.explode(F.sequence(F.lit(1), F.lit(days))).alias("day")
    race = F.explode(F.sequence(F.lit(1), F.lit(races))).alias("race")
    two = "%02d"
    return (
        meetings.select("year", "venue", "meeting", day)
        .select("year", "venue", "meeting", "day", race)
        .select(
            F.concat(
                "year", "venue", "meeting",
                F.format_string(two, "day"), F.format_string(two, "race"),
            ).alias("race_id")
        )
    )
