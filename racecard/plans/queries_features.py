"""Queries for past features, rates, imputation and the feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from racecard.functions import clean
from racecard.operators import features as fe
from racecard.operators import frames
from racecard.operators.history import past_features, with_past
from racecard.operators.history import past_only as before
from racecard.operators.medians import exact_median, median_by
from racecard.operators.rates import career_rates, missing_ids as ids_without_rates
from racecard.operators.rates import rates_asof, with_rates
from racecard.operators.split import stratified_split
from racecard.plans.model import enrich
from racecard.plans.registry import query, r6, rounded
from racecard.plans.runs import hot_horses, runs, stored_runs
from racecard.plans.runs_sql import (
    CLASS, DOMESTIC, ENRICHED, FILLED, FINISH, PARSED, PAST, RUNS, fills, num,
)
from racecard.plans.runs_sql import rates_asof as rates_asof_sql
from racecard.schema import FEATURES
from racecard.session import cut_large, cut_lineage

KEY = ["race_id", "horse_no"]
# What enriching and parsing read of a run.
ENRICHED_FROM = [
    *KEY, "race_date", "race_name", "finish", "horse_id", "jockey_id", "trainer_id", "up_3f",
    "sex_age", "body_weight", "carried", "odds", "popularity",
]
PAST_COLUMNS = ["prev_rank", "avg_up_3f_3runs", "win_rate", "prev_class"]
IMPUTED = [name for name, _, _ in fe.IMPUTATION]
ALL_FEATURES = [f'"{f}"' if not f.isascii() else f for f in FEATURES]

CAREER = RUNS.rstrip() + "".join(
    f""", {e}_career AS (
  SELECT {e}_id AS id, coalesce(count(CASE WHEN {FINISH} = 1 THEN 1 END) / nullif(count({FINISH}), 0), 0)
      AS win_rate,
    coalesce(count(CASE WHEN {FINISH} <= 3 THEN 1 END) / nullif(count({FINISH}), 0), 0) AS place_rate,
    max(race_date) AS as_of
  FROM runs GROUP BY ALL
)"""
    for e in ("jockey", "trainer")
) + "\n"


@query(PAST + f"SELECT race_id, horse_no, horse_id, {r6(*PAST_COLUMNS)} FROM with_past")
def past_features_time(spark, sf):
    out = past_features(runs(spark, sf), hot=hot_horses(spark, sf))
    return rounded(out.select(*KEY, "horse_id", *PAST_COLUMNS))


@query(
    RUNS.rstrip() + f""", typed AS (
      SELECT *, {FINISH} AS fin, {num("up_3f")} AS up, {CLASS} AS cls, {DOMESTIC} AS dom FROM runs
    ), pairs AS (
      SELECT t.race_id, t.horse_no, t.horse_id, p.race_date, p.race_id AS past_id, p.fin, p.up, p.cls
      FROM typed t LEFT JOIN typed p
        ON p.horse_id = t.horse_id AND p.dom AND p.race_id < t.race_id
    )
    SELECT race_id, horse_no, horse_id,
      arg_max({{'f': fin}}, race_date::VARCHAR || past_id).f AS prev_rank,
      round(list_avg(arg_max(up, race_date::VARCHAR || past_id, 3) FILTER (up IS NOT NULL)), 6)
        AS avg_up_3f_3runs,
      round(coalesce(count(CASE WHEN fin = 1 THEN 1 END) / nullif(count(fin), 0), 0), 6) AS win_rate,
      arg_max(cls, race_date::VARCHAR || past_id) AS prev_class
    FROM pairs GROUP BY ALL"""
)
def past_features_race_id(spark, sf):
    out = past_features(runs(spark, sf), order="race_id", hot=hot_horses(spark, sf))
    return rounded(out.select(*KEY, "horse_id", *PAST_COLUMNS))


@query(
    PAST + f"""SELECT race_id, horse_no, horse_id, {r6(*PAST_COLUMNS)} FROM with_past"""
)
def past_features_joined(spark, sf):
    """Features computed against a separate history table, kept, then joined back by (race, horse)."""
    all_runs = stored_runs(spark, sf)
    entries = all_runs.drop("finish", "time", "up_3f", "race_name")
    kept = past_features(entries, history=all_runs, hot=hot_horses(spark, sf))
    return rounded(with_past(entries, kept).select(*KEY, "horse_id", *PAST_COLUMNS))


@query(
    RUNS + f"""SELECT race_id, horse_no, trainer_id FROM runs JOIN (
      SELECT trainer_id, max(race_id) AS current FROM runs WHERE {DOMESTIC} GROUP BY trainer_id
    ) USING (trainer_id) WHERE {DOMESTIC} AND race_id < current"""
)
def past_only(spark, sf):
    """Runs of each trainer before its last race id."""
    all_runs = runs(spark, sf).select(*KEY, "trainer_id")
    last = all_runs.where(clean.is_domestic("race_id")).groupBy("trainer_id").agg(
        F.max("race_id").alias("current")
    )
    return all_runs.join(last, "trainer_id").where(before("race_id", "current")).select(
        *KEY, "trainer_id"
    )


def _rated(entity: str) -> list[str]:
    return [f"{entity}_id", "race_date", "finish"]


def _asof(entity: str):
    names = [f"{entity}_win_rate", f"{entity}_place_rate"]

    def run(spark, sf):
        out = rates_asof(stored_runs(spark, sf, *KEY, *_rated(entity)), entity)
        return rounded(out.select(*KEY, f"{entity}_id", *names))

    run.__name__ = f"{entity}_rates_asof"
    sql = RUNS.rstrip() + ", " + rates_asof_sql(entity, "runs", "rated")
    return query(sql + f" SELECT race_id, horse_no, {entity}_id, {r6(*names)} FROM rated")(run)


def _career(entity: str):
    names = [f"{entity}_win_rate", f"{entity}_place_rate"]

    def run(spark, sf):
        all_runs = stored_runs(spark, sf, *KEY, *_rated(entity))
        out = with_rates(all_runs, career_rates(all_runs, entity), entity)
        return rounded(out.select(*KEY, f"{entity}_id", *names))

    run.__name__ = f"{entity}_rates_career"
    return query(
        CAREER + f"SELECT race_id, horse_no, {entity}_id, round(win_rate, 6) AS {names[0]}, "
        f"round(place_rate, 6) AS {names[1]} FROM runs JOIN {entity}_career ON {entity}_id = id"
    )(run)


jockey_rates_asof, trainer_rates_asof = _asof("jockey"), _asof("trainer")
jockey_rates_career, trainer_rates_career = _career("jockey"), _career("trainer")


@query(
    CAREER.rstrip() + """, held AS (SELECT * FROM jockey_career WHERE win_rate > 0.25)
    SELECT DISTINCT jockey_id AS id FROM runs
    WHERE jockey_id NOT IN (SELECT id FROM held)"""
)
def missing_ids(spark, sf):
    all_runs = runs(spark, sf)
    held = career_rates(all_runs, "jockey").where("win_rate > 0.25")
    return ids_without_rates(frames.lookup_ids(all_runs, "jockey"), held, "jockey")


@query(
    ENRICHED + f"""SELECT race_id, horse_no, {r6(*PAST_COLUMNS, "jockey_win_rate",
    "jockey_place_rate", "trainer_win_rate", "trainer_place_rate")} FROM enriched"""
)
def enriched(spark, sf):
    out = enrich(stored_runs(spark, sf, *ENRICHED_FROM), hot=hot_horses(spark, sf))
    return rounded(
        out.select(
            *KEY, *PAST_COLUMNS,
            "jockey_win_rate", "jockey_place_rate", "trainer_win_rate", "trainer_place_rate",
        )
    )


@query(PARSED + f"SELECT {r6(*IMPUTED)} FROM (SELECT {fills()} FROM parsed)")
def impute_stats(spark, sf):
    parsed = fe.parse_features(enrich(runs(spark, sf).select(*ENRICHED_FROM), hot=hot_horses(spark, sf)))
    return rounded(fe.impute_stats(cut_lineage(parsed.select(*IMPUTED))))


@query(RUNS.rstrip() + f""", numbers AS (
      SELECT race_id, {num("odds")} + (CAST(horse_id AS BIGINT) * 64 + CAST(horse_no AS BIGINT)) / 1048576.0::DOUBLE AS x FROM runs)
    SELECT 'all' AS scope, round(median(x), 6) AS median FROM numbers
    UNION ALL SELECT race_id, round(median(x), 6) FROM numbers GROUP BY race_id HAVING count(x) > 0""")
def exact_medians(spark, sf):
    """Median of nearly as many distinct numbers as there are runs: of the table, and of every race."""
    spread = (F.col("horse_id").cast("bigint") * 64 + F.col("horse_no").cast("bigint")) / 1048576.0
    numbers = cut_lineage(runs(spark, sf).select("race_id", (clean.to_num("odds") + spread).alias("x")))
    whole = spark.createDataFrame([("all", exact_median(numbers, "x"))], "scope string, median double")
    return rounded(whole.unionByName(median_by(numbers, "race_id", "x").withColumnRenamed("race_id", "scope")))


@query(
    PARSED + f""", fill AS (SELECT {fills("race_id")} FROM parsed GROUP BY race_id)
    SELECT parsed.race_id, parsed.horse_no,
      {", ".join(f"round(coalesce(parsed.{n}, fill.{n}), 6) AS {n}" for n in IMPUTED)}
    FROM parsed JOIN fill USING (race_id)"""
)
def impute_by_race(spark, sf):
    parsed = fe.parse_features(enrich(stored_runs(spark, sf, *ENRICHED_FROM), hot=hot_horses(spark, sf)))
    # Read for the means, for the medians and to be filled.
    parsed = cut_large(parsed.select(*KEY, *IMPUTED))
    filled = fe.impute(parsed, fe.impute_stats(parsed, "race_id"), "race_id")
    return rounded(filled.select(*KEY, *IMPUTED))


@query(
    RUNS + """SELECT race_id, horse_no, CAST(sex_age LIKE 'セ%' AS DOUBLE) AS "sex_セ",
    CAST(sex_age LIKE '牝%' AS DOUBLE) AS "sex_牝", CAST(sex_age LIKE '牡%' AS DOUBLE) AS "sex_牡" FROM runs"""
)
def one_hot(spark, sf):
    sexes = runs(spark, sf).select(*KEY, clean.sex_of("sex_age").alias("sex"))
    return fe.one_hot_sex(sexes)


@query(
    RUNS + """SELECT race_id, horse_no, CAST(sex_age LIKE 'セ%' AS DOUBLE) AS "sex_セ",
    CAST(sex_age LIKE '牝%' AS DOUBLE) AS "sex_牝", CAST(sex_age LIKE '牡%' AS DOUBLE) AS "sex_牡" FROM runs"""
)
def one_hot_observed(spark, sf):
    sexes = runs(spark, sf).select(*KEY, clean.sex_of("sex_age").alias("sex"))
    return fe.one_hot_sex(sexes, vocab=None)


@query(FILLED + f"SELECT race_id, horse_no, is_win, {r6(*ALL_FEATURES)} FROM feature_rows")
def feature_matrix(spark, sf):
    return rounded(fe.feature_table(enrich(runs(spark, sf).select(*ENRICHED_FROM), hot=hot_horses(spark, sf))))


@query(
    FILLED + f"SELECT race_id, is_win, {r6(*ALL_FEATURES)} FROM feature_rows"
)
def preprocessed(spark, sf):
    return rounded(fe.preprocess(enrich(runs(spark, sf).select(*ENRICHED_FROM), hot=hot_horses(spark, sf))))


@query(
    RUNS.rstrip() + f""", typed AS (
      SELECT race_id, horse_no, CASE WHEN finish = '1' THEN 1 ELSE 0 END AS is_win,
        {num("odds")} AS odds, {num("popularity")} AS popularity FROM runs
    )
    SELECT race_id, horse_no, is_win, {", ".join(
        f"CAST(0 AS DOUBLE) AS {f}" for f in ALL_FEATURES if f not in ("odds", "popularity"))},
      round(coalesce(odds, (SELECT avg(odds) FROM typed)), 6) AS odds, popularity FROM typed"""
)
def aligned(spark, sf):
    """A table with only odds and popularity, brought to the model's eighteen features."""
    bare = runs(spark, sf).select("race_id", F.col("horse_no").alias("_no"), "finish", "odds", "popularity")
    parsed = fe.parse_features(bare)
    filled = fe.impute(parsed, fe.impute_stats(parsed)).withColumnRenamed("_no", "horse_no")
    return rounded(frames.align(filled, FEATURES, keep=(*KEY, "is_win")))


@query(
    RUNS + """SELECT race_id, horse_no, '0' AS finish, body_weight, 'entry' AS kind FROM runs
    UNION ALL SELECT race_id, horse_no, finish, '470(0)', 'result' FROM runs"""
)
def entry_defaults(spark, sf):
    """A table without finishes and one without weights: what a table has stays."""
    entries = runs(spark, sf).select(*KEY, "body_weight", F.lit("entry").alias("kind"))
    results = runs(spark, sf).select(*KEY, "finish", F.lit("result").alias("kind"))
    return frames.union_batches([frames.with_defaults(entries), frames.with_defaults(results)])


@query(
    RUNS + f"SELECT race_id, coalesce({num('odds')}, 0.0) AS odds, "
    f"coalesce({num('finish')}, 0.0) AS finish, "
    f"coalesce({num('up_3f')}, 0.0) AS up_3f FROM runs"
)
def finalized(spark, sf):
    text = runs(spark, sf).select("race_id", "odds", "finish", "up_3f")
    return frames.finalize(text)


@query(
    RUNS + "SELECT race_id, CAST(race_date AS VARCHAR) AS race_date, race_name, sex_age, odds, "
    "popularity, body_weight FROM runs"
)
def without_leaks(spark, sf):
    stale = past_features(runs(spark, sf), hot=hot_horses(spark, sf))
    return rounded(frames.drop_leaks(frames.drop_if_present(stale)))


_LABEL_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in clean.FEATURE_LABELS.items())


@query(
    PARSED + f""", fill AS (SELECT {fills()} FROM parsed)
    SELECT feature, CASE feature {_LABEL_CASES} ELSE feature END AS label, round(value, 6) AS value
    FROM (UNPIVOT fill ON {", ".join(IMPUTED)} INTO NAME feature VALUE value)"""
)
def feature_labels(spark, sf):
    """Fill value of every feature of the whole table, with its display label."""
    parsed = fe.parse_features(enrich(stored_runs(spark, sf, *ENRICHED_FROM), hot=hot_horses(spark, sf)))
    stats = fe.impute_stats(cut_lineage(parsed.select(*IMPUTED)))
    long = stats.unpivot([], IMPUTED, "feature", "value")
    return rounded(long.select("feature", clean.feature_label("feature").alias("label"), "value"))


_CUT = """SELECT *, row_number() OVER (PARTITION BY is_win ORDER BY md5(concat_ws('|', '42', {key})))
          <= round(count(*) OVER (PARTITION BY is_win) * 0.2) AS in_test FROM {source}"""


@query(
    RUNS.rstrip() + f""", labelled AS (
      SELECT race_id, horse_no, CASE WHEN finish = '1' THEN 1 ELSE 0 END AS is_win FROM runs
    ) SELECT race_id, horse_no, is_win, CASE WHEN in_test THEN 'test' ELSE 'train' END AS part
    FROM ({_CUT.format(key="race_id, horse_no", source="labelled")})"""
)
def split(spark, sf):
    labelled = stored_runs(spark, sf, *KEY, "finish").select(*KEY, clean.is_win("finish").alias("is_win"))
    return stratified_split(labelled)


@query(
    RUNS.rstrip() + f""", labelled AS (
      SELECT race_id, horse_no, CASE WHEN finish = '1' THEN 1 ELSE 0 END AS is_win FROM runs
    ), races AS (SELECT race_id, max(is_win) AS is_win FROM labelled GROUP BY race_id)
    SELECT labelled.race_id, horse_no, labelled.is_win,
      CASE WHEN in_test THEN 'test' ELSE 'train' END AS part
    FROM labelled JOIN ({_CUT.format(key="race_id", source="races")}) c USING (race_id)"""
)
def split_by_race(spark, sf):
    labelled = stored_runs(spark, sf, *KEY, "finish").select(*KEY, clean.is_win("finish").alias("is_win"))
    return stratified_split(labelled, unit="race")
