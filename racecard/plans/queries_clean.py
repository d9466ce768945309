"""Queries for the column functions, over every row of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from racecard.functions import clean
from racecard.operators import frames
from racecard.plans.registry import query, rounded
from racecard.plans.runs import runs, table
from racecard.plans.runs_sql import CLASS, CLASS_CORRECTED, FINISH, RUNS, num
from racecard.sources.pages import page_links as links_of

KEY = ["race_id", "horse_no"]


@query(
    RUNS + "SELECT race_id, horse_no, CAST(race_date AS VARCHAR) AS race_date, race_name, finish, "
    "horse_name, horse_id, sex_age, carried, jockey, jockey_id, time, up_3f, odds, popularity, "
    "body_weight, trainer, trainer_id FROM runs"
)
def race_runs(spark, sf):
    return rounded(runs(spark, sf))


@query(
    RUNS + f"""SELECT race_id, horse_no, {num("carried")} AS jockey_weight,
    {num("horse_no")} AS horse_number, {num("odds")} AS odds_number,
    {num("popularity")} AS popularity_number, {num("up_3f")} AS up_3f_number,
    {num("finish")} AS finish_as_number FROM runs"""
)
def clean_numeric(spark, sf):
    named = {
        "carried": "jockey_weight", "horse_no": "horse_number", "odds": "odds_number",
        "popularity": "popularity_number", "up_3f": "up_3f_number", "finish": "finish_as_number",
    }
    return runs(spark, sf).select(*KEY, *[clean.to_num(c).alias(n) for c, n in named.items()])


@query(RUNS + f"SELECT race_id, horse_no, {FINISH} AS finish_number FROM runs")
def finish_num(spark, sf):
    return runs(spark, sf).select(*KEY, clean.finish_num("finish").alias("finish_number"))


@query(
    RUNS + "SELECT race_id, horse_no, CASE WHEN trim(finish) IN ('1', '01') THEN 1 ELSE 0 END "
    "AS is_win FROM runs"
)
def win_label(spark, sf):
    return runs(spark, sf).select(*KEY, clean.is_win("finish").alias("is_win"))


@query(
    RUNS + "SELECT race_id, horse_no, substr(sex_age, 1, 1) AS sex, "
    "TRY_CAST(substr(sex_age, 2) AS DOUBLE) AS age FROM runs"
)
def sex_age(spark, sf):
    return runs(spark, sf).select(
        *KEY, clean.sex_of("sex_age").alias("sex"), clean.age_of("sex_age").alias("age")
    )


@query(
    RUNS + """SELECT race_id, horse_no,
    TRY_CAST(nullif(regexp_extract(body_weight, '^([0-9]+)', 1), '') AS DOUBLE) AS horse_weight,
    TRY_CAST(nullif(regexp_extract(body_weight, '[(]([-+]?[0-9]+)[)]', 1), '') AS DOUBLE)
      AS weight_change FROM runs"""
)
def body_weight(spark, sf):
    return runs(spark, sf).select(
        *KEY,
        clean.body_weight("body_weight").alias("horse_weight"),
        clean.weight_change("body_weight").alias("weight_change"),
    )


@query(
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
    CASE WHEN l_discount = 0 THEN 0.0 ELSE round(
      (CAST(round(l_discount * 100) AS INT) || '.' || CAST(CAST(l_quantity AS INT) % 10 AS VARCHAR))::DOUBLE
      / 100, 6) END AS fraction FROM lineitem"""
)
def percent(spark, sf):
    points = F.round(F.col("l_discount") * 100).cast("int").cast("string")
    tenth = (F.col("l_quantity").cast("int") % 10).cast("string")
    text = F.when(F.col("l_discount") == 0, F.lit("-")).otherwise(
        F.concat(points, F.lit("."), tenth, F.lit("%"))
    )
    return rounded(
        table(spark, sf, "lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
            clean.percent(text).alias("fraction"),
        )
    )


@query(RUNS + f"SELECT race_id, horse_no, {CLASS} AS class_code FROM runs")
def race_class(spark, sf):
    return runs(spark, sf).select(*KEY, clean.race_class("race_name").alias("class_code"))


# Words of race names, and the class that each stands for.
CLASS_NAMES = {"G1": 9, "Ｇ２": 8, "J.G3": 7, "オープン": 6, "1600万下": 5, "2勝クラス": 4, "500万": 3, "未勝利": 2,
               "新馬": 1, "特別": 0, "listed": 6, "ＧⅠ": 9}


@query(
    RUNS + f"""SELECT race_id, horse_no, CAST(list_extract({[float(c) for c in CLASS_NAMES.values()]},
    CAST(horse_id AS INT) % {len(CLASS_NAMES)} + 1) AS DOUBLE) AS class_code FROM runs"""
)
def race_class_words(spark, sf):
    """Names of several words, with each class among them."""
    words = F.array(*[F.lit(w) for w in CLASS_NAMES])
    word = F.element_at(words, F.col("horse_id").cast("int") % len(CLASS_NAMES) + 1)
    name = F.concat(F.lit("第"), "horse_no", F.lit("回 "), word, F.lit(" 記念"))
    return runs(spark, sf).select(*KEY, clean.race_class(name).alias("class_code"))


@query(RUNS + f"SELECT race_id, horse_no, {CLASS_CORRECTED} AS class_code FROM runs")
def race_class_corrected(spark, sf):
    code = clean.race_class("race_name", mode="corrected")
    return runs(spark, sf).select(*KEY, code.alias("class_code"))


@query(
    RUNS + """SELECT race_id, horse_no, CASE WHEN odds = '---' THEN '999.0' ELSE odds END AS odds,
    CASE WHEN finish = '中' THEN '99' ELSE finish END AS popularity,
    coalesce(up_3f, '470(0)') AS body_weight FROM runs"""
)
def sentinel_defaults(spark, sf):
    # Finish and last-3F text have the gaps that popularity and weight have in an entry list.
    return runs(spark, sf).select(
        *KEY,
        clean.default_odds("odds").alias("odds"),
        clean.default_popularity("finish").alias("popularity"),
        clean.default_weight("up_3f").alias("body_weight"),
    )


@query(
    RUNS + """SELECT race_id, horse_no, horse_no AS from_padded,
    CASE WHEN CAST(horse_no AS INT) % 3 = 2 THEN 'A0' || horse_no ELSE horse_no END AS from_text FROM runs"""
)
def horse_no_key(spark, sf):
    """Numbers padded, spaced, or behind a letter, which is no number."""
    third = F.col("horse_no").cast("int") % 3
    text = F.when(third == 0, F.concat(F.lit("00"), "horse_no")).when(
        third == 1, F.concat(F.lit("  "), "horse_no", F.lit(" "))).otherwise(F.concat(F.lit("A0"), "horse_no"))
    return runs(spark, sf).select(
        *KEY,
        clean.horse_no_key(F.concat(F.lit(" 0"), "horse_no")).alias("from_padded"),
        clean.horse_no_key(text).alias("from_text"),
    )


@query(
    RUNS + """SELECT race_id, horse_no, regexp_matches(race_id, '^[0-9]{12}$') AS domestic,
    CASE WHEN race_id[1] <> 'X' THEN substr(race_id, 1, 4) END AS year,
    CASE WHEN race_id[1] <> 'X' THEN substr(race_id, 5, 2) END AS venue,
    CASE WHEN race_id[1] <> 'X' THEN substr(race_id, 7, 2) END AS meeting,
    CASE WHEN race_id[1] <> 'X' THEN substr(race_id, 9, 2) END AS day,
    CASE WHEN race_id[1] <> 'X' THEN substr(race_id, 11, 2) END AS race FROM runs"""
)
def race_parts(spark, sf):
    return runs(spark, sf).select(
        *KEY, clean.is_domestic("race_id").alias("domestic"), clean.race_parts("race_id").alias("p")
    ).select(*KEY, "domestic", "p.*")


@query(
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
    lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS jockey_id,
    CASE WHEN l_returnflag <> 'R' THEN CAST(l_partkey AS VARCHAR) END AS horse_id FROM lineitem"""
)
def clean_id(spark, sf):
    # Ids as a number column leaves them: no leading zeros, a ``.0`` tail, ``nan`` for none.
    as_number = F.concat(F.col("l_suppkey").cast("string"), F.lit(".0"))
    or_nan = F.when(F.col("l_returnflag") == "R", F.lit("nan")).otherwise(
        F.concat(F.lit(" "), F.col("l_partkey").cast("string"))
    )
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        clean.clean_id(as_number, 5).alias("jockey_id"),
        clean.clean_id(or_nan).alias("horse_id"),
    )


@query(
    """WITH hrefs AS (
      SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS found FROM pages
    ), links AS (
      SELECT page_id, unnest(found) AS href, CAST(unnest(range(len(found))) AS INT) AS link_no FROM hrefs
    )
    SELECT page_id, link_no, href, regexp_extract(href, '/horse/([0-9]{10})', 1) AS horse_id,
      regexp_extract(href, '(?:id=|/jockey/|/jockey/result/recent/)([0-9]{5})', 1) AS jockey_id,
      regexp_extract(href, '(?:id=|/trainer/|/trainer/result/recent/)([0-9]{5})', 1) AS trainer_id,
      regexp_extract(href, '/race/([0-9]{12})', 1) AS race_id FROM links"""
)
def page_links(spark, sf):
    return links_of(table(spark, sf, "pages"))


@query(
    RUNS + """SELECT race_id, horse_no, horse_no AS gate_shown,
    CASE WHEN odds = '---' THEN '-' ELSE odds END AS odds_shown, finish AS finish_shown,
    CASE WHEN race_date > DATE '2000-01-01' THEN '-' ELSE finish END AS finish_if_run FROM runs"""
)
def display_cols(spark, sf):
    return runs(spark, sf).select(
        *KEY,
        clean.gate_display("horse_no").alias("gate_shown"),
        clean.odds_display(clean.default_odds("odds")).alias("odds_shown"),
        clean.finish_display("finish").alias("finish_shown"),
        clean.finish_display("finish", F.col("race_date") > "2000-01-01").alias("finish_if_run"),
    )


@query(
    f"""SELECT doc_id, md5(trim(regexp_replace(text, '{clean.SPACE}+', ' ', 'g'))) AS squashed,
    md5(regexp_replace(text, '{clean.SPACE}+', '', 'g')) AS without_space FROM documents"""
)
def squash_names(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id",
        F.md5(clean.squash("text")).alias("squashed"),
        F.md5(clean.norm_header("text")).alias("without_space"),
    )


@query(
    RUNS + "SELECT race_id, finish, horse_no, horse_name, odds, popularity, time, body_weight FROM runs"
)
def preview_columns(spark, sf):
    named = {new: old for old, new in frames.SOURCE_NAMES.items() if not old.isascii()}
    as_read = runs(spark, sf).withColumnsRenamed(named)
    return frames.preview(frames.canonical(as_read))


@query(
    RUNS + """SELECT race_id, horse_no, 'finish' AS wanted,
    CASE CAST(horse_no AS INT) % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE -1 END AS at_finish,
    CASE CAST(horse_no AS INT) % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS at_up,
    CASE CAST(horse_no AS INT) % 3 WHEN 1 THEN 3 ELSE -1 END AS at_margin FROM runs"""
)
def header_positions(spark, sf):
    """Header rows that differ from runner to runner, spaced as pages space them."""
    third = F.col("horse_no").cast("int") % 3
    name = F.col("horse_name")
    headers = F.transform(
        F.when(third == 0, F.array(F.lit("着 順"), name, F.lit(" 上り3F")))
        .when(third == 1, F.array(name, F.lit("上が り"), F.lit("着順"), F.lit("着差 ")))
        .otherwise(F.array(F.lit("上り"), name)),
        clean.norm_header,
    )
    return runs(spark, sf).withColumn("headers", headers).select(
        *KEY,
        F.lit("finish").alias("wanted"),
        F.coalesce(clean.resolve_header("headers", ["着順"]), F.lit(-1)).alias("at_finish"),
        clean.resolve_header("headers", ["上り", "上がり"]).alias("at_up"),
        F.coalesce(clean.resolve_header("headers", ["着差"]), F.lit(-1)).alias("at_margin"),
    )
