"""The shape of the plans that matter at scale."""

import pytest
from conftest import SF

import __spark_entry__ as contract
from racecard.operators import card
from racecard.operators.history import past_features
from racecard.plans.runs import runs
from racecard.schema import RESULTS
from racecard.sources.tables import stored_results, write_results


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "results")
    write_results(runs(spark, SF).select(*RESULTS.names), path)
    return stored_results(spark, path)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("order", ["time", "race_id"])
def test_past_features_shuffle_once(stored, order):
    text = plan(past_features(stored, order=order, hot=[]))
    assert text.count("Exchange hashpartitioning") == 1 and text.count("Sort [") == 1
    assert "Join" not in text


def test_card_shuffles_once(stored):
    text = plan(card.race_card(card.odds_probability(stored, hot=[])))
    assert text.count("Exchange") == 1 and "Python" not in text


def test_scans_read_only_what_is_needed(stored):
    text = plan(past_features(stored, hot=[]).select("race_id", "horse_id", "prev_rank"))
    schema = text[text.index("ReadSchema"):]
    assert "jockey" not in schema and "body_weight" not in schema


def test_seasons_are_pruned(stored):
    text = plan(stored.where("season = '1997'"))
    assert "PartitionFilters: [isnotnull(season" in text


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_no_query_joins_without_a_key(spark, name):
    if name in ("train_metrics", "importance", "scored"):
        pytest.skip("fits a model while the plan is built")
    text = plan(contract.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
