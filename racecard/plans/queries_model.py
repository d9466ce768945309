"""Queries for the fitted model. Trees are not SQL, but what must hold for any trees is."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from racecard.operators import card
from racecard.operators.features import assemble, feature_table
from racecard.plans.model import enrich, load_model, predict, train, tree_nodes
from racecard.plans.queries_features import ALL_FEATURES, ENRICHED_FROM
from racecard.plans.registry import query, rounded, work_path
from racecard.plans.runs import hot_horses, stored_runs
from racecard.plans.runs_sql import FILLED, RUNS
from racecard.schema import FEATURES

_trained: dict[tuple, tuple] = {}


def trained(spark, sf):
    """A model trained on all runs, once per session and folder, the scored cards, and the runs as stored."""
    key = spark.sparkContext.applicationId, sf
    if key not in _trained:
        stored, horses = stored_runs(spark, sf, *ENRICHED_FROM, "horse_name"), hot_horses(spark, sf)
        path = work_path(spark, "model")
        done = train(stored, path, hot_horses=horses)
        entries = stored.drop("finish", "up_3f", "race_name")
        cards = card.race_card(predict(entries, stored, load_model(spark, path), hot_horses=horses), not_yet_run=True)
        _trained[key] = done, cards, stored
    return _trained[key]


@query()
def train_metrics(spark, sf):
    """Train on all runs; accuracy and AUC on the held-out part."""
    done = trained(spark, sf)[0]
    return done.test.agg(
        F.count("*").alias("test_rows"),
        F.lit(done.accuracy).alias("accuracy"),
        F.lit(done.auc).alias("auc"),
        F.lit(len(done.model.features)).alias("features"),
    )


@query(RUNS + """, labelled AS (SELECT CASE WHEN finish = '1' THEN 1 ELSE 0 END AS is_win FROM runs)
    SELECT is_win, count(*) AS in_all, CAST(round(count(*) * 0.2) AS BIGINT) AS in_test FROM labelled GROUP BY is_win""")
def train_split(spark, sf):
    """How many rows of each label the split of the trained model put aside."""
    done, _, stored = trained(spark, sf)
    labels = stored.select(F.when(F.col("finish") == "1", 1).otherwise(0).alias("is_win"))
    held = done.test.groupBy("is_win").agg(F.count("*").alias("in_test"))
    return labels.groupBy("is_win").agg(F.count("*").alias("in_all")).join(held, "is_win")


@query("SELECT true AS auc_agrees, true AS accuracy_agrees, true AS rows_agree")
def train_auc(spark, sf):
    """The stored AUC and accuracy against Spark ML's own evaluators on the stored scores."""
    done = trained(spark, sf)[0]
    judged = done.test.select(F.col("is_win").cast("double").alias("label"), array_to_vector(F.array(1 - F.col("score"), "score")).alias("raw"),
                              (F.col("score") > 0.5).cast("double").alias("prediction"))
    auc = BinaryClassificationEvaluator(rawPredictionCol="raw", numBins=0).evaluate(judged)
    accuracy = MulticlassClassificationEvaluator(metricName="accuracy").evaluate(judged)
    return done.test.agg(
        F.lit(abs(auc - done.auc) < 1e-9).alias("auc_agrees"),
        F.lit(abs(accuracy - done.accuracy) < 1e-9).alias("accuracy_agrees"),
        (F.count("*") == F.count("score")).alias("rows_agree"),
    )


@query()
def importance(spark, sf):
    done = trained(spark, sf)[0]
    return done.importance


@query("SELECT unnest([" + ", ".join(f"'{f}'" for f in FEATURES) + "]) AS feature, 1.0 AS gains")
def importance_features(spark, sf):
    """Every feature of the model once, and the sum of all gains."""
    done = trained(spark, sf)[0]
    total = done.importance.agg(F.round(F.sum("gain"), 6).alias("gains"))
    return done.importance.select("feature", total.scalar().alias("gains"))


@query("SELECT unnest([" + ", ".join(f"'{f}'" for f in FEATURES) + "]) AS feature, true AS splits_agree, true AS gain_agrees")
def importance_splits(spark, sf):
    """Splits per feature against those that the trees print, and gains against the stored nodes' own."""
    done = trained(spark, sf)[0]
    model = load_model(spark, done.path)
    # One line a split; the text is bounded by rounds and depth.
    printed = Counter(re.findall(r"If \(feature (\d+) ", model.trees.toDebugString))
    # A feature's gain is that of its splits, each times the rows it saw, as a share of all.
    nodes = tree_nodes(spark, done.path).select("nodeData.gain", "nodeData.rawCount", F.col("nodeData.split.featureIndex").alias("i"))
    total = nodes.where("i >= 0").groupBy("i").agg(F.sum(F.col("gain") * F.col("rawCount")).alias("g"))
    by_feature = {r["i"]: r["g"] for r in total.collect()}  # one row per feature
    whole = sum(by_feature.values()) or 1.0
    expected = spark.createDataFrame(
        [(name, printed[str(i)], by_feature.get(i, 0.0) / whole) for i, name in enumerate(model.features)],
        "feature string, printed int, expected double")
    return done.importance.join(expected, "feature").select(
        "feature", (F.col("splits") == F.col("printed")).alias("splits_agree"),
        (F.abs(F.col("gain") - F.col("expected")) < 1e-6).alias("gain_agrees"))


@query()
def scored(spark, sf):
    """Every runner's card from a model that was stored and loaded again."""
    return rounded(trained(spark, sf)[1])


@query(RUNS + """SELECT race_id, count(*) AS runners, 100.0 AS total, 1 AS favorites,
    least(count(*), 5) AS marked, count(*) AS last_rank FROM runs GROUP BY race_id""")
def scored_races(spark, sf):
    """What holds for every race of the scored cards."""
    cards = trained(spark, sf)[1]
    return cards.groupBy("race_id").agg(
        F.count("*").alias("runners"), F.round(F.sum("probability"), 6).alias("total"),
        F.count(F.when(F.col("mark") == "◎", 1)).alias("favorites"),
        F.count(F.when(F.col("mark") != "-", 1)).alias("marked"),
        F.max("rank_in_race").cast("bigint").alias("last_rank"),
    )


@query(FILLED + "SELECT race_id, horse_no, unnest(range(" + str(len(FEATURES)) + ")) AS place, unnest(["
       + ", ".join(f"round({f}, 6)" for f in ALL_FEATURES) + "]) AS value FROM feature_rows")
def feature_vectors(spark, sf):
    """The assembled feature vector of every run, an entry per row."""
    table = feature_table(enrich(stored_runs(spark, sf, *ENRICHED_FROM), hot=hot_horses(spark, sf)))
    vectors = assemble(table).select("race_id", "horse_no", F.posexplode(vector_to_array("vector")).alias("place", "value"))
    return rounded(vectors.withColumn("place", F.col("place").cast("bigint")))
