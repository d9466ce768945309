"""Spark-native race-result analytics: ingest, point-in-time features, win model, race cards."""

from racecard.operators.card import headline, normalize, odds_probability, race_card, recommendations
from racecard.operators.features import feature_table, preprocess
from racecard.operators.history import past_features, with_race_facts
from racecard.operators.rates import rates_asof, with_rates
from racecard.plans.model import enrich, load_model, predict, save_model, train
from racecard.session import build_session
from racecard.sources.odds import latest_odds, overlay_odds, parse_live_odds
from racecard.sources.page_sql import register_pages
from racecard.sources.pages import (
    extract_entity_rates, extract_entries, extract_history, extract_results, load_page_files, load_pages,
)
from racecard.sources.tables import append_results, load_results, race_id_grid
from racecard.streaming.streams import ingest_stream, latest_odds_stream

__all__ = [
    "append_results", "build_session", "enrich", "extract_entity_rates", "extract_entries",
    "extract_history", "extract_results", "feature_table", "headline", "ingest_stream",
    "latest_odds", "latest_odds_stream", "load_model", "load_page_files", "load_pages", "load_results", "normalize",
    "odds_probability", "overlay_odds", "parse_live_odds", "past_features", "predict",
    "preprocess", "race_card", "race_id_grid", "rates_asof", "recommendations", "register_pages", "save_model",
    "train", "with_race_facts", "with_rates",
]
