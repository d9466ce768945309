"""Queries for probabilities, cards, odds and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from racecard.functions import clean
from racecard.operators import card, evaluate
from racecard.plans.model import predict
from racecard.plans.registry import query, rounded, work_path
from racecard.plans.runs import hot_races, large_orders, runs, table
from racecard.plans.runs_sql import FEED, RUNS, WEIGHTED
from racecard.sources import odds as feed
from racecard.streaming import streams

KEY = ["race_id", "horse_no"]
CARD = "round(probability, 6) AS probability"


def runs_and_hot(spark, sf):
    """The runs, and those races too large for one task."""
    large = large_orders(spark, sf)
    all_runs = runs(spark, sf, large)
    return all_runs, hot_races(all_runs, large)


def ranked(spark, sf):
    all_runs, hot = runs_and_hot(spark, sf)
    return card.odds_probability(all_runs, hot)


def odds_feed(spark, sf):
    """The event table as odds snapshots: ``race_id, as_of`` and a JSON body per event."""
    return as_feed(table(spark, sf, "events"))


def as_feed(events):
    numbers = {"click": "01", "view": "02", "purchase": "03", "signup": "04", "error": "05"}
    by_type = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])
    cents = F.round(F.col("value") * 100).cast("bigint")
    price = F.when(F.col("event_id") % 13 == 0, F.lit("---")).otherwise(
        F.concat(F.expr("cast(cast(round(value * 100) as bigint) div 100 as string)"), F.lit("."),
                 F.lpad((cents % 100).cast("string"), 2, "0"))
    )
    status = (
        F.when(F.col("event_id") % 10 == 0, F.lit("none"))
        .when(F.col("event_id") % 2 == 0, F.lit("middle"))
        .otherwise(F.lit("result"))
    )
    entry = F.array(
        price, F.lit("0"), F.get_json_object("props", "$.k"),
        F.element_at(by_type, F.col("event_type")),
    )
    market = F.create_map(F.lit("1"), F.create_map(F.lit("1"), entry))
    body = F.to_json(F.struct(status.alias("status"), F.struct(market.alias("odds")).alias("data")))
    return events.select(
        F.col("user_id").cast("string").alias("race_id"),
        F.col("ts").cast("timestamp").alias("as_of"),
        body.alias("body"),
    )


@query(WEIGHTED + f"SELECT race_id, horse_no, {CARD}, rank_in_race FROM ranked")
def odds_probability(spark, sf):
    return rounded(ranked(spark, sf).select(*KEY, "probability", "rank_in_race"))


@query(
    RUNS.rstrip() + """, labelled AS (
      SELECT race_id, horse_no, CASE WHEN finish = '1' THEN 1.0 ELSE 0.0 END AS score FROM runs
    ) SELECT race_id, horse_no, round(CASE WHEN sum(score) OVER w > 0
        THEN score / sum(score) OVER w * 100 ELSE 100.0 / count(*) OVER w END, 6) AS probability,
      CAST(row_number() OVER (PARTITION BY race_id ORDER BY score DESC, CAST(horse_no AS INT)) AS INT)
        AS rank_in_race
    FROM labelled WINDOW w AS (PARTITION BY race_id)"""
)
def share_of_race(spark, sf):
    """Share of a 0/1 weight: races whose weights are all 0 are shared equally."""
    all_runs, hot = runs_and_hot(spark, sf)
    weighted = all_runs.withColumn("score", clean.is_win("finish").cast("double"))
    out = card.normalize(weighted, "score", hot)
    return rounded(out.select(*KEY, "probability", "rank_in_race"))


@query(WEIGHTED + f"SELECT * REPLACE ({CARD}) FROM card")
def race_card(spark, sf):
    return rounded(card.race_card(ranked(spark, sf)))


@query(WEIGHTED + f"SELECT * REPLACE ({CARD}, '-' AS finish_shown) FROM card")
def race_card_upcoming(spark, sf):
    """The card of races not yet run: finishes stay hidden."""
    all_runs, hot = runs_and_hot(spark, sf)
    out = predict(all_runs.drop("finish", "time", "up_3f"), all_runs, hot=hot)
    return rounded(card.race_card(out, not_yet_run=True))


@query(WEIGHTED + f"SELECT * REPLACE ({CARD}) FROM card WHERE rank_in_race <= 4")
def top4(spark, sf):
    return rounded(card.recommendations(card.race_card(ranked(spark, sf))))


_BEST = ", ".join(
    f"coalesce(max(CASE WHEN mark = '{mark}' THEN {name} END), {empty}) AS {role}_{name}"
    if name != "probability"
    else f"round(coalesce(max(CASE WHEN mark = '{mark}' THEN {name} END), {empty}), 6) AS {role}_{name}"
    for role, mark in (("favorite", "◎"), ("rival", "○"), ("darkhorse", "▲"))
    for name, empty in (("name", "'該当なし'"), ("gate_no", "''"), ("probability", "0.0"))
)


@query(WEIGHTED + f"SELECT race_id, {_BEST} FROM card GROUP BY race_id")
def headline(spark, sf):
    return rounded(card.headline(card.race_card(ranked(spark, sf))))


@query(WEIGHTED + f"SELECT * REPLACE ({CARD}) FROM card ORDER BY race_id, rank_in_race DESC")
def display_order(spark, sf):
    return rounded(card.order_for_display(card.race_card(ranked(spark, sf))))


@query(WEIGHTED + f"SELECT * REPLACE ({CARD}) FROM card ORDER BY probability DESC, race_id, rank_in_race LIMIT 20")
def head(spark, sf):
    """The twenty surest runners of all races."""
    order = [F.col("probability").desc(), F.col("race_id"), F.col("rank_in_race")]
    return rounded(card.head(card.race_card(ranked(spark, sf)), order, 20))


_LABELLED = WEIGHTED.rstrip() + """, labelled AS (
  SELECT CASE WHEN finish = '1' THEN 1 ELSE 0 END AS is_win, score FROM weighted
)
"""


def _labelled(spark, sf):
    return runs(spark, sf).select(
        clean.is_win("finish").alias("is_win"), card.odds_weight().alias("score")
    )


@query(
    _LABELLED + "SELECT round(avg(CASE WHEN (score > 0.5) = (is_win = 1) THEN 1.0 ELSE 0.0 END), 6) "
    "AS accuracy FROM labelled"
)
def accuracy(spark, sf):
    return rounded(evaluate.accuracy(_labelled(spark, sf)))


@query(
    _LABELLED.rstrip() + """, per_score AS (
      SELECT score, count(*) FILTER (is_win = 1) AS pos, count(*) FILTER (is_win = 0) AS neg
      FROM labelled GROUP BY score
    ), below AS (
      SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        AS neg_below FROM per_score
    ) SELECT round(sum(pos * (neg_below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM below"""
)
def roc_auc(spark, sf):
    return rounded(evaluate.roc_auc(_labelled(spark, sf)))


@query(FEED + "SELECT race_id, horse_no, odds, popularity, status, CAST(epoch_us(ts) AS BIGINT) AS at "
       "FROM snapshots")
def live_odds(spark, sf):
    parsed = feed.parse_live_odds(odds_feed(spark, sf))
    return parsed.select(
        *KEY, "odds", "popularity", "status", F.unix_micros("as_of").alias("at")
    )


_LATEST = FEED + "SELECT race_id, horse_no, odds, popularity, epoch_us(ts) AS at FROM latest"


@query(_LATEST)
def odds_latest(spark, sf):
    latest = feed.latest_odds(feed.parse_live_odds(odds_feed(spark, sf)))
    return latest.select(*KEY, "odds", "popularity", F.unix_micros("as_of").alias("at"))


@query(_LATEST)
def odds_latest_stream(spark, sf):
    """The same table from a stream over the events, run until it has caught up, its folders then merged."""
    schema = table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    base = work_path(spark, "odds")
    streams.latest_odds_stream(
        feed.parse_live_odds(as_feed(events)), f"{base}/latest", f"{base}/checkpoint", once=True
    ).awaitTermination()
    streams.merge_latest_odds(spark, f"{base}/latest")
    latest = streams.read_latest_odds(spark, f"{base}/latest")
    return latest.select(*KEY, "odds", "popularity", F.unix_micros("as_of").alias("at"))


_RUNS_INNER = RUNS.strip().removeprefix("WITH ")


@query(
    FEED.rstrip() + ", " + _RUNS_INNER + """
    SELECT runs.race_id, runs.horse_no, coalesce(latest.odds, runs.odds) AS odds,
      coalesce(latest.popularity, runs.popularity) AS popularity
    FROM runs LEFT JOIN latest ON latest.horse_no = runs.horse_no
      AND latest.race_id = CAST(CAST(right(runs.race_id, 6) AS BIGINT) AS VARCHAR)"""
)
def odds_overlay(spark, sf):
    """Every runner with the feed's odds where it has them; the feed names a race by its number."""
    number = F.substring("race_id", -6, 6).cast("bigint").cast("string")
    entries = runs(spark, sf).select(
        number.alias("race_id"), F.col("race_id").alias("full_id"), "horse_no", "odds", "popularity"
    )
    latest = feed.latest_odds(feed.parse_live_odds(odds_feed(spark, sf)))
    return feed.overlay_odds(entries, latest).select(
        F.col("full_id").alias("race_id"), "horse_no", "odds", "popularity"
    )
