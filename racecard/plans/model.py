"""Train, store and apply the win model, for every race in one job."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from racecard.functions import clean
from racecard.operators import card, evaluate
from racecard.operators.features import feature_table, impute_stats, parse_features
from racecard.operators.frames import drop_if_present, with_defaults
from racecard.operators.history import past_features, with_race_facts
from racecard.operators.rates import rate_totals, with_rates, with_totals
from racecard.operators.split import stratified_split
from racecard.schema import FEATURES
from racecard.session import cut_large, cut_lineage, use_checkpoints
from racecard.sources.odds import overlay_odds

# How the trees are grown.
ROUNDS, STEP, DEPTH, LEAST_PER_LEAF, SEED = 100, 0.1, 5, 2, 42


@dataclass
class WinModel:
    """A fitted pipeline, the fill values of its training table, and its feature order."""

    pipeline: PipelineModel
    stats: DataFrame

    @property
    def features(self) -> list[str]:
        return self.pipeline.stages[0].getInputCols()

    @property
    def trees(self):
        return self.pipeline.stages[-1]


def enrich(
    runs: DataFrame,
    history: DataFrame | None = None,
    rates: DataFrame | None = None,
    order: str = "time",
    hot: list | None = None,
    results: DataFrame | None = None,
) -> DataFrame:
    """Runners with past features and jockey and trainer rates.

    ``history`` holds the horses' careers, without it the runs are their own; dates and
    names of races that the runs lack come from it. Rates are as of each race, counted from
    ``results`` (by default the history if it names jockeys, else the runs); with ``rates``
    they are looked up in that table instead. ``hot`` names horses too large for one task.
    """
    runs = drop_if_present(runs)
    if history is not None:
        runs = with_race_facts(runs, history)
    if results is None:
        results = history if history is not None and "jockey_id" in history.columns else runs
    out = past_features(runs, history, order, hot=hot)
    for entity in ("jockey", "trainer"):
        if rates is not None:
            out = with_rates(out, rates, entity)
        elif results is runs:
            # Counted on the runs themselves, so that the counts need none of the windows above.
            out = with_totals(out, rate_totals(runs, entity), entity)
        else:
            out = with_totals(out, rate_totals(results, entity, days=runs), entity)
    return out


def fit(features: DataFrame, names: list[str] | None = None, rounds: int = ROUNDS) -> PipelineModel:
    """Gradient-boosted trees on a feature table with an ``is_win`` label."""
    names = [c for c in FEATURES if c in features.columns] if names is None else names
    trees = GBTClassifier(
        featuresCol="vector",
        labelCol="is_win",
        maxIter=rounds,
        stepSize=STEP,
        maxDepth=DEPTH,
        minInstancesPerNode=LEAST_PER_LEAF,
        seed=SEED,
        checkpointInterval=10,
    )
    use_checkpoints(features.sparkSession)
    assembler = VectorAssembler(inputCols=names, outputCol="vector", handleInvalid="error")
    return Pipeline(stages=[assembler, trees]).fit(features)


def score(features: DataFrame, model: PipelineModel) -> DataFrame:
    """``score``: the probability of winning, for every row."""
    scored = model.transform(features)
    return scored.withColumn("score", vector_to_array("probability")[1]).drop(
        "vector", "rawPrediction", "probability", "prediction"
    )


VERSIONS = "version long, path string, features array<string>"


def save_model(model: WinModel, path: str) -> str:
    """Store a new version of the model and return its path.

    A version holds the pipeline, its trees as a table of nodes, and the fill values of its
    training table. It is listed, with its feature order, once all of it is written: a save that
    fails half-way leaves the model before it in place, and a reader never meets a pipeline
    with another one's fill values.
    """
    spark = model.stats.sparkSession
    version = time.time_ns()
    folder = f"{path}/data/version={version}"
    model.pipeline.write().save(f"{folder}/pipeline")
    model.trees.write().save(f"{folder}/trees")
    model.stats.write.mode("errorifexists").parquet(f"{folder}/stats")
    listed = spark.createDataFrame([(version, folder, model.features)], VERSIONS)
    listed.coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return folder


def newest_model(spark: SparkSession, path: str) -> tuple[str, list[str]]:
    """Path and features of the newest complete version."""
    listed = spark.read.schema(VERSIONS).parquet(f"{path}/versions")
    return listed.agg(F.max_by(F.struct("path", "features"), "version").alias("v")).select("v.*").first()


def load_model(spark: SparkSession, path: str) -> WinModel:
    """The newest complete version."""
    folder, features = newest_model(spark, path)
    model = WinModel(PipelineModel.load(f"{folder}/pipeline"), spark.read.parquet(f"{folder}/stats"))
    if model.features != features:
        raise ValueError(f"{folder} holds another model than the one listed")
    return model


def drop_old_models(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete all but the newest ``keep`` versions' folders, unlisted ones older than these too."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = hadoop.Path(f"{path}/data/version=*")
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listed = [r["version"] for r in spark.read.schema(VERSIONS).parquet(f"{path}/versions").collect()]  # a row a save
    oldest = min(sorted(listed, reverse=True)[:keep])
    old = [f.getPath() for f in files.globStatus(where) or [] if int(f.getPath().getName().split("=")[1]) < oldest]
    for folder in old:
        files.delete(folder, True)
    return len(old)


def tree_nodes(spark: SparkSession, path: str) -> DataFrame:
    """The stored nodes of a saved model's trees, of the newest version."""
    return spark.read.parquet(f"{newest_model(spark, path)[0]}/trees/data")


@dataclass
class Training:
    """What training leaves behind; the tables are lazy."""

    model: WinModel
    test: DataFrame
    accuracy: float
    auc: float
    importance: DataFrame
    path: str


def train(
    runs: DataFrame,
    path: str,
    rounds: int = ROUNDS,
    history: DataFrame | None = None,
    rates: DataFrame | None = None,
    unit: str = "row",
    exclude: tuple[str, ...] = (),
    hot_horses: list | None = None,
    results: DataFrame | None = None,
) -> Training:
    """Enrich, split, fill, fit, evaluate and store.

    The split is counted on the runs themselves. The parsed and split table is written once to the shared folder: everything after
    reads it, and the many passes of the fit never recompute the joins and windows.
    Fill values come from the training part alone and are stored with the model. The trees
    are fitted on every row of it.
    """
    spark = runs.sparkSession
    labels = runs.select("race_id", "horse_no", clean.is_win("finish").alias("is_win"))
    parsed = parse_features(enrich(runs, history, rates, hot=hot_horses, results=results))
    keep = ["race_id", "horse_no", "is_win", "sex", *FEATURES]
    parsed = parsed.select(*[c for c in keep if c in parsed.columns])
    table = cut_large(stratified_split(parsed, unit=unit, counted_on=labels))
    in_train = F.col("part") == "train"
    stats = cut_lineage(impute_stats(table.where(in_train)))
    features = feature_table(table, stats, keys=("race_id", "horse_no", "part"), exclude=exclude)
    pipeline = fit(features.where(in_train), rounds=rounds)
    model = WinModel(pipeline, stats)
    save_model(model, path)
    test = score(features.where(~in_train), pipeline)
    scored = cut_large(test.select("race_id", "horse_no", "is_win", "score"))
    return Training(
        model,
        scored,
        evaluate.accuracy(scored).first()[0],
        evaluate.roc_auc(scored).first()[0],
        evaluate.importance(model.trees, model.features, spark, tree_nodes(spark, path)),
        path,
    )


def predict(
    entries: DataFrame,
    history: DataFrame,
    model: WinModel | None = None,
    rates: DataFrame | None = None,
    odds: DataFrame | None = None,
    hot: list | None = None,
    hot_horses: list | None = None,
    results: DataFrame | None = None,
) -> DataFrame:
    """Every entry with ``score``, ``probability`` and ``rank_in_race``.

    With a model the score is its probability, on features filled as in training;
    without one it is the inverse of the odds. ``history`` holds the horses' careers and
    ``results`` past runs with their jockeys and trainers, as in ``enrich``.
    """
    runners = with_defaults(entries if odds is None else overlay_odds(entries, odds))
    if model is None:
        return card.odds_probability(runners, hot)
    # Races are counted on the entries themselves, before any join or scoring.
    hot = card.hot_values(entries, "race_id") if hot is None else hot
    shown = runners.columns
    kept = runners.withColumn("_shown", F.struct(*shown))
    enriched = enrich(kept, history, rates, hot=hot_horses, results=results)
    features = feature_table(enriched, model.stats, keys=("_shown",))
    scored = score(features, model.pipeline).select("_shown.*", "score")
    return card.normalize(scored, "score", hot)
