"""The ``runs`` table as DuckDB SQL, and the texts that the checks of several queries share."""

from racecard.operators.features import IMPUTATION

RUNS = """
WITH once AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag,
         l_extendedprice AS price, CAST(l_quantity AS BIGINT) AS quantity,
         lpad(CAST(l_partkey AS VARCHAR), 10, '0') AS horse_id,
         lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS jockey_id
  FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey
                             ORDER BY l_extendedprice DESC, l_suppkey, l_linenumber) = 1
), numbered AS (
  SELECT *,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, horse_id, jockey_id) AS gate,
         row_number() OVER (PARTITION BY l_orderkey
                            ORDER BY price DESC, horse_id, jockey_id, l_linenumber) AS rk
  FROM once
), priced AS (
  SELECT *, CASE WHEN l_returnflag = 'R' AND gate = 5 THEN NULL
                 ELSE 10 + ((l_partkey * 7 + l_suppkey * 13) % 300 // 10) * 10
                      + (l_partkey * 7 + l_suppkey * 13) % 10 END AS tenths
  FROM numbered
), runs AS (
  SELECT
    CASE WHEN l_orderkey % 97 = 0 THEN 'X' || lpad(CAST(l_orderkey AS VARCHAR), 9, '0')
         ELSE CAST(year(o_orderdate) AS VARCHAR) || lpad(CAST(l_orderkey % 10 + 1 AS VARCHAR), 2, '0')
              || lpad(CAST(l_orderkey AS VARCHAR), 6, '0') END AS race_id,
    CAST(o_orderdate AS DATE) AS race_date,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '天皇賞(G1)' WHEN '2' THEN '京王杯(GII)'
         WHEN '3' THEN '3勝クラス' WHEN '4' THEN '3歳未勝利' WHEN '5' THEN '2歳新馬' END AS race_name,
    CASE WHEN l_returnflag = 'R' AND gate = 7 THEN '中'
         WHEN l_returnflag = 'R' AND gate = 6 THEN CAST(rk AS VARCHAR) || '(降)'
         ELSE CAST(rk AS VARCHAR) END AS finish,
    CAST(gate AS VARCHAR) AS horse_no,
    'Horse ' || horse_id AS horse_name,
    horse_id,
    CASE l_partkey % 3 WHEN 0 THEN '牡' WHEN 1 THEN '牝' ELSE 'セ' END
      || CAST(2 + l_partkey % 7 AS VARCHAR) AS sex_age,
    CASE WHEN l_suppkey % 11 = 0 THEN '▲55' ELSE CAST(52 + l_suppkey % 7 AS VARCHAR) END AS carried,
    'Jockey ' || jockey_id AS jockey,
    jockey_id,
    '1:' || lpad(CAST(quantity AS VARCHAR), 2, '0') AS time,
    CASE WHEN l_returnflag = 'N' AND gate = 1 THEN NULL
         ELSE CAST(33 + quantity // 10 AS VARCHAR) || '.' || CAST(quantity % 10 AS VARCHAR) END AS up_3f,
    CASE WHEN tenths IS NULL THEN '---'
         ELSE CAST(tenths // 10 AS VARCHAR) || '.' || CAST(tenths % 10 AS VARCHAR) END AS odds,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY coalesce(tenths, 9990), gate) AS VARCHAR)
      AS popularity,
    CASE WHEN l_returnflag = 'A' AND l_linenumber = 4 THEN '計不'
         ELSE CAST(400 + l_partkey % 120 AS VARCHAR) || '('
              || CASE WHEN l_suppkey % 21 - 10 > 0 THEN '+' ELSE '' END
              || CAST(l_suppkey % 21 - 10 AS VARCHAR) || ')' END AS body_weight,
    'Trainer ' || lpad(CAST(l_partkey % 50 AS VARCHAR), 5, '0') AS trainer,
    lpad(CAST(l_partkey % 50 AS VARCHAR), 5, '0') AS trainer_id
  FROM priced JOIN orders ON l_orderkey = o_orderkey
)
"""

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def num(column: str) -> str:
    """SQL for the number a text holds, else null."""
    return (
        f"CASE WHEN regexp_matches(trim({column}), '{NUMBER}') "
        f"THEN TRY_CAST(trim({column}) AS DOUBLE) END"
    )


FINISH = "TRY_CAST(nullif(regexp_replace(finish, '[^0-9]', '', 'g'), '') AS DOUBLE)"
DOMESTIC = "regexp_matches(race_id, '^[0-9]{12}$')"
# The races of the fixture have five names; their class as plain substrings, and as whole words.
CLASS = """CAST(CASE WHEN contains(race_name, 'G1') OR contains(race_name, 'GI') THEN 9.0
 WHEN contains(race_name, 'G2') THEN 8.0 WHEN contains(race_name, '3勝クラス') THEN 5.0
 WHEN contains(race_name, '未勝利') THEN 2.0 WHEN contains(race_name, '新馬') THEN 1.0 ELSE 0.0 END AS DOUBLE)"""
CLASS_CORRECTED = """CAST(CASE WHEN regexp_matches(race_name, '(^|[^A-Z]|J)(G1|GI)([^0-9IV]|$)') THEN 9.0
 WHEN regexp_matches(race_name, '(^|[^A-Z]|J)(G2|GII)([^0-9IV]|$)') THEN 8.0
 WHEN contains(race_name, '3勝クラス') THEN 5.0 WHEN contains(race_name, '未勝利') THEN 2.0
 WHEN contains(race_name, '新馬') THEN 1.0 ELSE 0.0 END AS DOUBLE)"""

# Features of every run as of its race, by date.
PAST = RUNS.rstrip() + f""", typed AS (
  SELECT *, {FINISH} AS fin, {num("up_3f")} AS up, {CLASS} AS cls, {DOMESTIC} AS dom FROM runs
), past AS (
  SELECT *, last_value(CASE WHEN dom THEN {{'fin': fin, 'cls': cls}} END IGNORE NULLS) OVER w AS last_run,
    list(up) FILTER (WHERE dom AND up IS NOT NULL) OVER w AS ups,
    coalesce(sum(CASE WHEN dom AND fin = 1 THEN 1 ELSE 0 END) OVER w, 0) AS wins,
    coalesce(sum(CASE WHEN dom AND fin IS NOT NULL THEN 1 ELSE 0 END) OVER w, 0) AS valid
  FROM typed
  WINDOW w AS (PARTITION BY horse_id ORDER BY race_date, race_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), with_past AS MATERIALIZED (
  SELECT * EXCLUDE (fin, up, cls, dom, last_run, ups, wins, valid),
    last_run.fin AS prev_rank, list_avg(ups[-3:]) AS avg_up_3f_3runs,
    CASE WHEN valid > 0 THEN wins / valid ELSE 0.0 END AS win_rate, last_run.cls AS prev_class
  FROM past
)
"""


def rates_asof(entity: str, source: str, name: str) -> str:
    """SQL for a table ``name`` = ``source`` with an entity's rates as of each day."""
    return f"""{name}_daily AS (
  SELECT {entity}_id, race_date, count({FINISH}) AS n,
    count(CASE WHEN {FINISH} = 1 THEN 1 END) AS wins, count(CASE WHEN {FINISH} <= 3 THEN 1 END) AS places
  FROM {source} GROUP BY ALL
), {name}_totals AS (
  SELECT {entity}_id, race_date,
    coalesce(CASE WHEN sum(n) OVER w > 0 THEN sum(wins) OVER w / sum(n) OVER w END, 0.0)
      AS {entity}_win_rate,
    coalesce(CASE WHEN sum(n) OVER w > 0 THEN sum(places) OVER w / sum(n) OVER w END, 0.0)
      AS {entity}_place_rate
  FROM {name}_daily
  WINDOW w AS (PARTITION BY {entity}_id ORDER BY race_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), {name} AS (
  SELECT * FROM {source} JOIN {name}_totals USING ({entity}_id, race_date)
)"""


ENRICHED = (
    PAST.rstrip() + ", " + rates_asof("jockey", "with_past", "with_jockey")
    + ", " + rates_asof("trainer", "with_jockey", "enriched") + "\n"
)

# Raw text parsed to label and numbers, with gaps left empty.
PARSED = ENRICHED.rstrip() + f""", parsed AS MATERIALIZED (
  SELECT race_id, horse_no, race_date,
    CASE WHEN trim(finish) IN ('1', '01') THEN 1 ELSE 0 END AS is_win,
    substr(sex_age, 1, 1) AS sex, {num("substr(sex_age, 2)")} AS age,
    TRY_CAST(nullif(regexp_extract(body_weight, '^([0-9]+)', 1), '') AS DOUBLE) AS horse_weight,
    TRY_CAST(nullif(regexp_extract(body_weight, '[(]([-+]?[0-9]+)[)]', 1), '') AS DOUBLE) AS weight_change,
    {num("carried")} AS jockey_weight, {num("horse_no")} AS horse_number,
    prev_rank, avg_up_3f_3runs, win_rate,
    jockey_win_rate, jockey_place_rate, trainer_win_rate, trainer_place_rate,
    {num("odds")} AS odds, {num("popularity")} AS popularity, prev_class
  FROM enriched
)
"""


def fills(group: str = "") -> str:
    """Select list of fill values; SQL for one row, or for one per ``group``."""
    items = []
    for name, kind, constant in IMPUTATION:
        value = {"mean": f"avg({name})", "median": f"median({name})"}.get(kind, "NULL")
        items.append(f"CAST(coalesce({value}, {constant}) AS DOUBLE) AS {name}")
    return ", ".join(([group] if group else []) + items)


FILLED = PARSED.rstrip() + f""", fill AS (SELECT {fills()} FROM parsed), filled AS (
  SELECT parsed.race_id, parsed.horse_no, is_win, sex,
    {", ".join(f"coalesce(parsed.{n}, fill.{n}) AS {n}" for n, _, _ in IMPUTATION)}
  FROM parsed, fill
), feature_rows AS (
  SELECT race_id, horse_no, is_win, {", ".join(n for n, _, _ in IMPUTATION)},
    CAST(sex = 'セ' AS DOUBLE) AS "sex_セ", CAST(sex = '牝' AS DOUBLE) AS "sex_牝",
    CAST(sex = '牡' AS DOUBLE) AS "sex_牡"
  FROM filled
)
"""

# Weight of a runner without a model: one over the odds.
WEIGHTED = RUNS.rstrip() + f""", weighted AS (
  SELECT *, 1.0 / coalesce(nullif({num("odds")}, 0), 999.0) AS score FROM runs
), ranked AS (
  SELECT *, score / sum(score) OVER (PARTITION BY race_id) * 100 AS probability,
    CAST(row_number() OVER (PARTITION BY race_id ORDER BY score DESC, CAST(horse_no AS INT)) AS INT)
      AS rank_in_race
  FROM weighted
), card AS (
  SELECT race_id, rank_in_race,
    CASE rank_in_race WHEN 1 THEN '◎' WHEN 2 THEN '○' WHEN 3 THEN '▲' WHEN 4 THEN '△'
      WHEN 5 THEN '△' ELSE '-' END AS mark,
    CASE rank_in_race WHEN 1 THEN 'favorite' WHEN 2 THEN 'rival' WHEN 3 THEN 'darkhorse'
      WHEN 4 THEN 'wildcard' WHEN 5 THEN 'wildcard' ELSE 'none' END AS mark_class,
    CASE rank_in_race WHEN 1 THEN '本命 (Favorite)' WHEN 2 THEN '対抗 (Rival)'
      WHEN 3 THEN '単穴 (Dark Horse)' WHEN 4 THEN '連下 (Wildcard)' WHEN 5 THEN '連下 (Wildcard)'
      ELSE '' END AS label,
    horse_no AS gate_no, horse_name AS name, probability, finish AS finish_shown, odds AS odds_shown
  FROM ranked
)
"""

# The odds feed: what its JSON says, after the filters on status and digits.
FEED = """
WITH cents AS (
  SELECT *, CAST(round(value * 100) AS BIGINT) AS c,
    CASE event_type WHEN 'click' THEN '1' WHEN 'view' THEN '2' WHEN 'purchase' THEN '3'
      WHEN 'signup' THEN '4' WHEN 'error' THEN '5' END AS horse_no
  FROM events
), snapshots AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS race_id, horse_no,
    CAST(c // 100 AS VARCHAR) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS odds,
    json_extract_string(props, '$.k') AS popularity,
    CASE WHEN event_id % 2 = 0 THEN 'middle' ELSE 'result' END AS status, ts
  FROM cents WHERE event_id % 10 <> 0 AND event_id % 13 <> 0
), latest AS (
  SELECT race_id, horse_no, odds, popularity, ts FROM snapshots
  QUALIFY row_number() OVER (PARTITION BY race_id, horse_no ORDER BY ts DESC, odds DESC, popularity DESC) = 1
)
"""
