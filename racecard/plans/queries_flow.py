"""The documented flow from stored pages to features and cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from racecard.functions import clean
from racecard.operators import card
from racecard.operators.history import with_race_facts
from racecard.plans import derived_pages as pages_of
from racecard.plans.model import enrich, predict
from racecard.plans.registry import query, r6, rounded, work_path
from racecard.plans.runs import hot_horses, hot_races, large_orders, page_parts, runs
from racecard.plans.runs_sql import DOMESTIC, ENRICHED, RUNS, WEIGHTED
from racecard.session import cut_large, free_shuffles, staged
from racecard.sources import pages, tables

KEY = ["race_id", "horse_no"]
# What the rates of jockeys and trainers are counted on.
COUNTED = ["race_date", "finish", "jockey_id", "trainer_id"]
FEATURES = ["prev_rank", "avg_up_3f_3runs", "win_rate", "prev_class", "jockey_win_rate", "jockey_place_rate",
            "trainer_win_rate", "trainer_place_rate"]


def domestic_only(sql: str) -> str:
    """The same tables from domestic runs alone: only their races have result and entry pages."""
    head = RUNS.rstrip().replace("), runs AS (", "), every_run AS (")
    return head + f", runs AS (SELECT * FROM every_run WHERE {DOMESTIC})" + sql[len(RUNS.rstrip()):]


def stored_pages(spark, sf, path):
    """Result, entry and history pages rendered from the runs, stored as bytes and loaded again."""
    parts = page_parts(spark, sf)
    with staged(runs(spark, sf)) as every:
        domestic = every.where(clean.is_domestic("race_id"))
        made = {"result": pages_of.result_pages(domestic, parts), "entry": pages_of.entry_pages(domestic, parts),
                "history": pages_of.history_pages(every, hot_horses(spark, sf), parts)}
        # A folder per kind: whoever reads one kind gets its files dealt to all tasks, not a few files among others.
        for kind, rows in made.items():
            rows.drop("kind").write.option("compression", "zstd").parquet(f"{path}/kind={kind}")
            free_shuffles(spark)
    return pages.load_pages(spark, path)


def extracted(spark, sf, base):
    """Results stored with the dates and names that the history pages give, and the history."""
    loaded = stored_pages(spark, sf, f"{base}/pages")
    # Read for the facts of races and for the careers, parsed once.
    history = cut_large(pages.extract_history(loaded).where("race_date is not null"))
    tables.append_results(with_race_facts(pages.extract_results(loaded), history), f"{base}/results")
    return tables.stored_results(spark, f"{base}/results"), history, loaded


@query(domestic_only(ENRICHED) + f"SELECT race_id, horse_no, CAST(race_date AS VARCHAR) AS race_date, race_name, "
       f"{r6(*FEATURES)} FROM enriched")
def pages_to_features(spark, sf):
    """Features of every stored runner; pages are all that is read."""
    results, history, _ = extracted(spark, sf, work_path(spark, "flow"))
    out = enrich(results, history, results=results, hot=hot_horses(spark, sf))
    return rounded(out.select(*KEY, "race_date", "race_name", *FEATURES))


@query(domestic_only(ENRICHED) + f"""SELECT race_id, horse_no, {r6(*FEATURES[:4])} FROM enriched""")
def entries_to_features(spark, sf):
    """The careers of declared runners, whose pages carry no date, from history pages."""
    loaded = stored_pages(spark, sf, f"{work_path(spark, 'flow')}/pages")
    # Each kind of page is read for the careers and for the rates of both entities, parsed once.
    history = cut_large(pages.extract_history(loaded).where("race_date is not null"))
    entries = cut_large(pages.extract_entries(loaded))
    dates = history.where("race_id is not null").groupBy("race_id").agg(F.max("race_date").alias("race_date"))
    results = cut_large(pages.extract_results(loaded).join(dates, "race_id").select(*COUNTED))
    out = enrich(entries, history, hot=hot_horses(spark, sf), results=results)
    return rounded(out.select(*KEY, *FEATURES[:4]))


@query(domestic_only(WEIGHTED) + "SELECT race_id, horse_no, CAST(rank_in_race AS INT) AS rank_in_race, "
       "round(probability, 6) AS probability FROM ranked")
def pages_to_card(spark, sf):
    """Cards of all races straight from entry pages, by their odds."""
    loaded = stored_pages(spark, sf, f"{work_path(spark, 'flow')}/pages")
    history = pages.extract_history(loaded).where("race_date is not null")
    # Races are counted on the runs, so that the pages are parsed once.
    out = predict(pages.extract_entries(loaded), history, hot=hot_races(runs(spark, sf), large_orders(spark, sf)))
    return rounded(out.select(*KEY, "rank_in_race", "probability"))
