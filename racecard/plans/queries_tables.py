"""Queries for ingest, stored tables, streams and page extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from racecard.functions import clean
from racecard.operators import frames
from racecard.operators.history import horse_state, merge_states
from racecard.operators.rates import career_rates, with_rates
from racecard.plans import derived_pages as pages_of
from racecard.plans.queries_features import CAREER, PAST_COLUMNS
from racecard.plans.registry import query, r6, rounded, work_path
from racecard.plans.runs import hot_horses, page_parts, runs, stored_runs
from racecard.plans.runs_sql import FINISH, PAST, RUNS
from racecard.schema import RESULTS
from racecard.sources import page_sql, pages, tables
from racecard.sources.horse_states import ingest_with_features, load_horse_states, save_horse_states
from racecard.streaming import streams

KEY = ["race_id", "horse_no"]
# What is taken to be stored already, where a query needs a stored part.
STORED_UNTIL = "1998-01-01"
RAW = ["race_id", "horse_no", "finish", "horse_name", "horse_id", "sex_age", "carried", "jockey",
       "jockey_id", "time", "up_3f", "odds", "popularity", "body_weight", "trainer", "trainer_id"]


def stored_part(all_runs):
    return all_runs.where(F.col("race_date") < STORED_UNTIL)


@query(RUNS + f"SELECT {', '.join(RAW)} FROM runs WHERE race_date >= DATE '{STORED_UNTIL}'")
def new_races(spark, sf):
    """All runners offered, twice over, against the races stored so far."""
    all_runs = runs(spark, sf).select(*RAW, "race_date")
    offered = frames.union_batches([all_runs, all_runs])
    return frames.new_races(offered, stored_part(all_runs)).select(*RAW)


@query(RUNS + "SELECT DISTINCT horse_id, race_id FROM runs")
def lookup_pairs(spark, sf):
    return frames.lookup_pairs(runs(spark, sf))


@query(RUNS + "SELECT DISTINCT trainer_id AS id FROM runs")
def lookup_ids(spark, sf):
    return frames.lookup_ids(runs(spark, sf), "trainer")


@query(RUNS + "SELECT count(DISTINCT race_id) AS races, count(*) AS runners FROM runs")
def batch_summary(spark, sf):
    return frames.batch_summary(runs(spark, sf))


@query(
    RUNS + """SELECT race_id, horse_no, finish, odds FROM runs
    UNION ALL SELECT race_id, horse_no, NULL AS finish, odds FROM runs"""
)
def union_batches(spark, sf):
    """Results and entry lists of all races in one table; entries have no finish."""
    results = runs(spark, sf).select("race_id", "horse_no", "finish", "odds")
    entries = runs(spark, sf).select("odds", "race_id", "horse_no")
    return frames.union_batches([results, entries])


@query(
    RUNS + """SELECT DISTINCT substr(race_id, 1, 8) || lpad(CAST(d AS VARCHAR), 2, '0')
      || lpad(CAST(r AS VARCHAR), 2, '0') AS race_id
    FROM runs, range(1, 3) days(d), range(1, 4) races(r) WHERE race_id[1] <> 'X'"""
)
def race_id_grid(spark, sf):
    """The first days and races of every meeting that the runs name."""
    parts = clean.race_parts("race_id")
    meetings = runs(spark, sf).select(parts.alias("p")).where("p is not null")
    return tables.race_id_grid(meetings.select("p.year", "p.venue", "p.meeting").distinct())


@query(RUNS + f"SELECT {', '.join(RAW)}, CAST(race_date AS VARCHAR) AS race_date FROM runs")
def append_results(spark, sf):
    """Stored races first, then everything offered again: each runner is held once."""
    path = work_path(spark, "results")
    all_runs = stored_runs(spark, sf)
    tables.append_results(stored_part(all_runs), path)
    tables.append_results(all_runs, path)
    return rounded(tables.stored_results(spark, path).select(*RAW, "race_date"))


@query(PAST + f"SELECT race_id, horse_no, horse_id, {r6(*PAST_COLUMNS)} FROM with_past")
def past_features_ingested(spark, sf):
    """Features of every run as it is ingested, in batches by date, from the states of the horses alone."""
    results, states = work_path(spark, "kept"), work_path(spark, "states")
    all_runs = stored_runs(spark, sf)
    bounds = ["0001-01-01", "1994-01-01", "1996-06-01", "9999-12-31"]
    found = [
        ingest_with_features(all_runs.where(F.col("race_date").between(first, F.date_sub(F.lit(last).cast("date"), 1))), results, states)
        for first, last in zip(bounds, bounds[1:])
    ]
    return rounded(frames.union_batches(found).select(*KEY, "horse_id", *PAST_COLUMNS))


@query(PAST.rstrip() + f""", latest_first AS (
      SELECT *, row_number() OVER (PARTITION BY horse_id ORDER BY race_date DESC, race_id DESC) AS nth FROM typed WHERE dom)
    SELECT horse_id, CAST(count(fin) AS BIGINT) AS n, CAST(count(CASE WHEN fin = 1 THEN 1 END) AS BIGINT) AS won,
      max(CASE WHEN nth = 1 THEN fin END) AS last_finish, max(CASE WHEN nth = 1 THEN cls END) AS last_class,
      round(list_avg((list(up ORDER BY race_date DESC, race_id DESC) FILTER (up IS NOT NULL))[1:3]), 6) AS mean_up
    FROM latest_first GROUP BY horse_id""")
def horse_states(spark, sf):
    """The state of every horse with domestic runs, merged from two batches and stored."""
    path = work_path(spark, "states")
    all_runs = stored_runs(spark, sf)
    parts = [horse_state(all_runs.where(F.col("race_date") < STORED_UNTIL)), horse_state(all_runs.where(F.col("race_date") >= STORED_UNTIL))]
    save_horse_states(merge_states(frames.union_batches(parts)), path)
    ups = F.transform("ups", lambda u: u["up"])
    mean = F.try_divide(F.aggregate(ups, F.lit(0.0), lambda a, b: a + b), F.size(ups))
    return rounded(load_horse_states(spark, path).where("last is not null").select(
        "horse_id", "n", "won", F.col("last.finish").alias("last_finish"), F.col("last.cls").alias("last_class"),
        mean.alias("mean_up")))


_BLANKED = f"""CASE WHEN horse_no IN ('2', '3') THEN '' WHEN horse_no = '4' THEN NULL ELSE horse_no END"""


@query(RUNS + f"SELECT {', '.join(c for c in RAW if c != 'horse_no')}, {_BLANKED} AS horse_no FROM runs")
def append_blank_numbers(spark, sf):
    """Runners whose numbers are partly blank or missing, offered twice: each is stored once."""
    path = work_path(spark, "blanks")
    blanked = stored_runs(spark, sf).withColumn("horse_no", F.expr(_BLANKED))
    tables.append_results(stored_part(blanked), path)
    tables.append_results(frames.union_batches([blanked, blanked]), path)
    return tables.stored_results(spark, path).select(*RAW)


@query(RUNS + f"SELECT {', '.join(c for c in RAW if c != 'horse_no')}, {_BLANKED} AS horse_no FROM runs")
def ingest_blank_numbers(spark, sf):
    """The same through the ingest stream, from two replays."""
    base = work_path(spark, "blanks")
    runs(spark, sf).withColumn("horse_no", F.expr(_BLANKED)).select(*RESULTS.names).write.parquet(f"{base}/landing")
    for replay in ("a", "b"):
        landing = spark.readStream.schema(RESULTS).parquet(f"{base}/landing")
        streams.ingest_stream(
            landing, f"{base}/table", f"{base}/checkpoint-{replay}", once=True
        ).awaitTermination()
    return tables.stored_results(spark, f"{base}/table").select(*RAW)


@query(RUNS + f"SELECT {', '.join(RAW)}, CAST(race_date AS VARCHAR) AS race_date FROM runs")
def results_csv(spark, sf):
    """Runs written as CSV under their source names and loaded back as text."""
    path = work_path(spark, "csv")
    named = {new: old for old, new in frames.SOURCE_NAMES.items() if not old.isascii()}
    runs(spark, sf).withColumnsRenamed(named).write.option("header", True).csv(path)
    return rounded(tables.load_results(spark, path).select(*RAW, "race_date"))


@query(
    CAREER + """SELECT race_id, horse_no, jockey_id, round(win_rate, 6) AS jockey_win_rate,
    round(place_rate, 6) AS jockey_place_rate FROM runs JOIN jockey_career ON jockey_id = id"""
)
def enriched_versions(spark, sf):
    """An enriched table saved twice; the newest version is what is loaded."""
    base = work_path(spark, "enriched")
    all_runs = runs(spark, sf)
    first = all_runs.select(*KEY, "jockey_id")
    tables.save_enriched(first, base)
    rated = frames.drop_if_present(first)
    tables.save_enriched(with_rates(rated, career_rates(all_runs, "jockey"), "jockey"), base)
    return rounded(tables.load_enriched(spark, base))


@query(
    CAREER + """SELECT 'jockey' AS entity_type, id, round(win_rate, 6) AS win_rate,
      round(place_rate, 6) AS place_rate, epoch_us(as_of::TIMESTAMP) // 1000000 AS at FROM jockey_career
    UNION ALL SELECT 'trainer', id, round(win_rate, 6), round(place_rate, 6),
      epoch_us(as_of::TIMESTAMP) // 1000000 FROM trainer_career"""
)
def rate_store(spark, sf):
    """Rates known up to a date are stored, the rest added, then all refreshed; newest read back."""
    path = work_path(spark, "rates")
    all_runs = stored_runs(spark, sf, "jockey_id", "trainer_id", "finish", "race_date")
    for source, refresh in ((stored_part(all_runs), False), (all_runs, False), (all_runs, True)):
        for entity in ("jockey", "trainer"):
            tables.upsert_entity_rates(career_rates(source, entity), path, refresh)
    held = tables.load_entity_rates(spark, path)
    return rounded(
        held.select("entity_type", "id", "win_rate", "place_rate", F.unix_seconds("as_of").alias("at"))
    )


@query(RUNS + f"SELECT {', '.join(RAW)}, CAST(race_date AS VARCHAR) AS race_date FROM runs")
def ingest_stream(spark, sf):
    """All runs through the ingest stream twice, from two replays of the same files."""
    base = work_path(spark, "ingest")
    runs(spark, sf).select(*RESULTS.names).write.parquet(f"{base}/landing")
    for replay in ("a", "b"):
        landing = spark.readStream.schema(RESULTS).option("maxFilesPerTrigger", 4)
        streams.ingest_stream(
            landing.parquet(f"{base}/landing"), f"{base}/table", f"{base}/checkpoint-{replay}", once=True
        ).awaitTermination()
    return rounded(tables.stored_results(spark, f"{base}/table").select(*RAW, "race_date"))


@query(RUNS + f"""SELECT {', '.join(c for c in RAW if c != 'finish')}, finish FROM runs
    UNION ALL SELECT {', '.join(c for c in RAW if c != 'finish')}, '失' AS finish FROM runs WHERE horse_no = '1'""")
def ingest_corrected(spark, sf):
    """Runs, then the first gate of every race again with another finish: both rows stay, replays add none."""
    base = work_path(spark, "corrected")
    all_runs = stored_runs(spark, sf).select(*RESULTS.names)
    all_runs.write.parquet(f"{base}/landing")
    corrected = all_runs.where("horse_no = '1'").withColumn("finish", F.lit("失"))
    corrected.write.mode("append").parquet(f"{base}/landing")
    for replay in ("a", "b"):
        landing = spark.readStream.schema(RESULTS).option("maxFilesPerTrigger", 8)
        streams.ingest_stream(
            landing.parquet(f"{base}/landing"), f"{base}/table", f"{base}/checkpoint-{replay}", once=True
        ).awaitTermination()
    return tables.stored_results(spark, f"{base}/table").select(*RAW)


@query(
    RUNS + f"SELECT {', '.join(c for c in RAW if c != 'up_3f')}, coalesce(up_3f, '') AS up_3f FROM runs"
)
def extract_results(spark, sf):
    return pages.extract_results(pages_of.result_pages(runs(spark, sf), page_parts(spark, sf)))


_DECLARED = RUNS + """SELECT race_id, horse_no, horse_name, horse_id, sex_age, carried, jockey, jockey_id,
    trainer, trainer_id, CASE WHEN body_weight = '計不' THEN '470(0)' ELSE body_weight END AS body_weight,
    CASE WHEN odds = '---' THEN '999.0' ELSE odds END AS odds, popularity FROM runs"""


@query(_DECLARED)
def extract_entries(spark, sf):
    return pages.extract_entries(pages_of.entry_pages(runs(spark, sf), page_parts(spark, sf)))


@query(_DECLARED)
def entries_by_sql(spark, sf):
    """The rows of entry pages by SQL alone, over the table function that lists a page's rows."""
    page_sql.register_pages(spark, pages_of.entry_pages(runs(spark, sf), page_parts(spark, sf)), "entry_pages")
    return spark.sql(r"""
      WITH listed AS (
        SELECT p.key, r.row_class, filter(r.cells, c -> NOT c.th) AS cells
        FROM entry_pages p, LATERAL page_rows(p.kind, p.raw) r WHERE contains(r.table_class, 'shutuba_table')),
      texts AS (
        SELECT key, transform(cells, c -> nullif(regexp_replace(c.text, r'^\s+|\s+$', ''), '')) AS t,
          transform(cells, c -> coalesce(c.href, '')) AS h
        FROM listed WHERE contains(row_class, 'HorseList') AND size(cells) >= 8)
      SELECT key AS race_id, t[1] AS horse_no, t[3] AS horse_name, t[4] AS sex_age, t[5] AS carried, t[6] AS jockey,
        t[7] AS trainer, regexp_extract(h[3], r'/horse/([0-9]{10})', 1) AS horse_id,
        regexp_extract(h[6], r'/jockey/([0-9]{5})', 1) AS jockey_id,
        regexp_extract(h[7], r'/trainer/([0-9]{5})', 1) AS trainer_id, coalesce(get(t, 8), '470(0)') AS body_weight,
        CASE WHEN get(t, 9) RLIKE '[0-9]' THEN t[9] ELSE '999.0' END AS odds,
        CASE WHEN get(t, 10) RLIKE '[0-9]' THEN t[10] ELSE '99' END AS popularity
      FROM texts""")


@query(
    RUNS + """SELECT horse_id, CASE WHEN race_id[1] <> 'X' THEN race_id END AS race_id, race_name, finish,
    coalesce(up_3f, '') AS up_3f, CAST(race_date AS VARCHAR) AS race_date,
    CAST((row_number() OVER (PARTITION BY horse_id ORDER BY race_date, race_id) - 1) % 32 AS INT) AS hist_pos
    FROM runs"""
)
def extract_history(spark, sf):
    stored = pages_of.history_pages(runs(spark, sf), hot_horses(spark, sf), page_parts(spark, sf))
    # Rows without the cells of a run (here the short row each page ends with) have none of these.
    found = pages.extract_history(stored)
    return rounded(found.where("race_name is not null or finish is not null or race_date is not null"))


def _printed(test: str) -> str:
    tenths = f"count(CASE WHEN {test} THEN 1 END) * 1000 // greatest(count({FINISH}), 1)"
    return f"round(({tenths}) / 10.0 / 100, 6)"


_PRINTED = " UNION ALL ".join(
    f"SELECT '{e}' AS entity_type, {e}_id AS id, 'ok' AS extract_status, "
    f"{_printed(FINISH + ' = 1')} AS win_rate, {_printed(FINISH + ' <= 3')} AS place_rate "
    f"FROM runs GROUP BY {e}_id"
    for e in ("jockey", "trainer")
)


@query(RUNS + _PRINTED)
def extract_rates(spark, sf):
    all_runs = runs(spark, sf)
    stored = frames.union_batches([pages_of.career_pages(all_runs, e) for e in ("jockey", "trainer")])
    found = pages.extract_entity_rates(stored)
    return rounded(found.select("entity_type", "id", "extract_status", "win_rate", "place_rate"))


@query(RUNS + _PRINTED)
def page_files(spark, sf):
    """Career pages kept as loose files, one per page, and read back by their paths."""
    base, all_runs = work_path(spark, "files"), stored_runs(spark, sf, "jockey_id", "trainer_id", "finish")
    made = frames.union_batches([pages_of.career_pages(all_runs, e) for e in ("jockey", "trainer")])
    # As text the bytes of a page are written as they are, with a line end behind them.
    made.select("kind", "key", F.col("raw").cast("string").alias("value")).write.partitionBy("kind", "key").text(base)
    found = pages.extract_entity_rates(pages.load_page_files(spark, base))
    return rounded(found.select("entity_type", "id", "extract_status", "win_rate", "place_rate"))
