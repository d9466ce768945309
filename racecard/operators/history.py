"""What was known about a horse before each of its races.

For every runner: finish and class of its most recent earlier race, mean of its
three most recent last-3-furlong times, and career win rate, from domestic races
only. "Earlier" is by date (``order='time'``) or by the text of the race id
(``order='race_id'``, which is not calendar order); "most recent" is by date in
both.

One scan over each horse's races in order carries everything, so there is no
self-join and no pair of races is ever formed. Horses too large for one task are
cut into ranges of that order; each piece is scanned alone and then given what the
earlier pieces add up to.

A run without a date takes that of its race in the history. A race that no history
knows is one still to be run: it comes after every dated run, in the order of ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from racecard.functions import clean
from racecard.operators.skew import hot_values
from racecard.session import cut_lineage

OUTPUTS = ["prev_rank", "avg_up_3f_3runs", "win_rate", "prev_class"]
_ADDED = ["_c_n", "_c_won", "_c_last", "_c_up"]
_TIMES = ["_up1", "_up2", "_up3"]
_SCAN = ["_n", "_won", "_last", *_TIMES]


def past_only(race_id: Column | str, current: Column | str) -> Column:
    """Domestic race with an id before the current one; without a current id, any race."""
    race_id, current = (F.col(c) if isinstance(c, str) else c for c in (race_id, current))
    no_current = F.coalesce(clean.strip(current) == "", F.lit(True))
    return no_current | (clean.is_domestic(race_id) & (race_id < clean.strip(current)))


def _contributions(df: DataFrame, mode: str) -> DataFrame:
    """What each row adds to the horse's later races; foreign races add nothing."""
    # Parsed in a step of their own, as each is used more than once.
    parsed = {"_finish": clean.finish_num("finish"), "_up": clean.to_num("up_3f"), "_counts": clean.is_domestic("race_id")}
    finish, up, counts = (F.col(c) for c in parsed)
    when_where = [F.col("race_date").alias("d"), F.col("race_id").alias("r")]
    return df.withColumns(parsed).withColumns(
        {
            "_c_n": F.when(counts & finish.isNotNull(), 1).otherwise(0),
            "_c_won": F.when(counts & (finish == 1), 1).otherwise(0),
            "_c_last": F.when(
                counts,
                F.struct(
                    *when_where,
                    finish.alias("finish"),
                    clean.race_class("race_name", mode).alias("cls"),
                ),
            ),
            "_c_up": F.when(counts & up.isNotNull(), F.struct(*when_where, up.alias("up"))),
        }
    ).drop(*parsed)


def _both(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def _scan(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Totals over the earlier rows of each group.

    The three latest times need no growing list: what the running maximum loses is
    the input of the running second, and what that loses of the running third. All
    windows share one partitioning and one sort.
    """
    earlier = (
        Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    df = df.withColumns(
        {
            "_n": F.coalesce(F.sum("_c_n").over(earlier), F.lit(0)),
            "_won": F.coalesce(F.sum("_c_won").over(earlier), F.lit(0)),
            "_last": F.max("_c_last").over(earlier),
            "_up1": F.max("_c_up").over(earlier),
        }
    )
    df = df.withColumn("_lost1", _both(F.col("_c_up"), F.col("_up1")))
    df = df.withColumn("_up2", F.max("_lost1").over(earlier))
    df = df.withColumn("_lost2", _both(F.col("_lost1"), F.col("_up2")))
    df = df.withColumn("_up3", F.max("_lost2").over(earlier))
    return df.drop("_lost1", "_lost2")


def _carried(rows: DataFrame) -> DataFrame:
    """For each piece of a hot horse, the totals over its earlier pieces.

    Sums and the latest race are aggregated map-side, and the three latest times of
    a piece are found with a group limit that also works before the shuffle. A hot
    horse has at most one piece per shuffle partition, so the scan over pieces is small.
    """
    keys = ["horse_id", "_piece"]
    totals = rows.groupBy(*keys).agg(
        F.sum("_c_n").alias("_c_n"), F.sum("_c_won").alias("_c_won"), F.max("_c_last").alias("_c_last")
    )
    newest = Window.partitionBy(*keys).orderBy(F.col("_c_up").desc())
    times = (
        rows.where(F.col("_c_up").isNotNull())
        .select(*keys, "_c_up", F.row_number().over(newest).alias("_i"))
        .where("_i <= 3")
    )
    first = totals.withColumn("_i", F.lit(0)).withColumn("_c_up", F.lit(None).cast(times.schema["_c_up"].dataType))
    pieces = first.unionByName(times, allowMissingColumns=True)
    scanned = _scan(pieces, ["horse_id"], [F.col("_piece"), F.col("_i")])
    return scanned.where("_i = 0").select(*keys, *[F.col(c).alias("_before" + c) for c in _SCAN])


def _mean_of(times: list[Column]) -> Column:
    known = sum((F.when(t.isNotNull(), 1).otherwise(0) for t in times), F.lit(0))
    total = sum((F.coalesce(t["up"], F.lit(0.0)) for t in times), F.lit(0.0))
    return F.try_divide(total, known)


def with_race_facts(rows: DataFrame, history: DataFrame) -> DataFrame:
    """``rows`` with date and name of each race where they lack them, from any horse's history.

    Horses' career pages name the date of every domestic race they ran, by its id.
    """
    named = [c for c in ("race_date", "race_name") if c in history.columns]
    facts = (
        history.where(clean.is_domestic("race_id"))
        .groupBy("race_id")
        .agg(*[F.max(c).alias(f"_{c}") for c in named])
    )
    known = {c: F.coalesce(F.col(c), F.col(f"_{c}")) if c in rows.columns else F.col(f"_{c}") for c in named}
    return rows.join(facts, "race_id", "left").withColumns(known).drop(*[f"_{c}" for c in named])


def past_features(
    targets: DataFrame,
    history: DataFrame | None = None,
    order: str = "time",
    class_mode: str = "contains",
    hot: list | None = None,
    state: DataFrame | None = None,
) -> DataFrame:
    """``targets`` with the four features of each runner as of its race.

    ``history`` is the table of past runs; without it the targets are their own
    history. A run never counts towards its own race, nor a race towards itself.
    Runners without a horse id share no history with one another. ``hot`` names the
    horses too large for one task; without it one pass over the id column finds them.
    ``state`` (a table of ``horse_state``) holds what came before all the rows given.
    """
    if order not in ("time", "race_id"):
        raise ValueError(f"unknown order {order!r}")
    if state is not None and order != "time":
        raise ValueError("a state holds what came before by date")
    kept = [c for c in targets.columns if c not in OUTPUTS]
    targets = targets.select(*kept)
    if history is None:
        rows = _contributions(targets, class_mode).withColumn("_target", F.lit(True))
    else:
        past = _contributions(history.where(F.col("horse_id").isNotNull()), class_mode)
        past = past.select("horse_id", "race_id", "race_date", *_ADDED)
        rows = targets.withColumn("_target", F.lit(True)).unionByName(
            past.withColumn("_target", F.lit(False)), allowMissingColumns=True
        )

    if hot is None:
        hot = hot_values(targets if history is None else history, "horse_id")
    steps = [F.asc_nulls_last("race_date"), F.col("race_id")] if order == "time" else [F.col("race_id")]
    # Targets come before past runs of the same race, so a race never sees itself.
    steps = steps + ([F.col("_target").desc()] if history is not None else [])
    # Runners without an id are scattered, each a group of its own.
    own_hash = F.xxhash64(*[c for c in ("race_id", "horse_no") if c in kept])
    is_hot = F.coalesce(F.col("horse_id").isin(hot), F.lit(False))
    whole = F.when(F.col("horse_id").isNull(), own_hash).otherwise(F.lit(0).cast("bigint"))
    if hot:
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranged = rows.where(is_hot).repartitionByRange(parts, F.col("horse_id"), *steps)
        big = cut_lineage(ranged.withColumn("_piece", F.spark_partition_id().cast("bigint")))
        rows = rows.where(~is_hot).withColumn("_piece", whole).unionByName(big)
    else:
        rows = rows.withColumn("_piece", whole)
    scanned = _scan(rows, ["horse_id", "_piece"], steps).where("_target")

    # What came before: in the same piece, in the horse's earlier pieces, and in the state.
    parts = [""]
    if hot:
        scanned = scanned.join(_carried(rows.where(is_hot)), ["horse_id", "_piece"], "left")
        parts.append("_before")
    if state is not None:
        held = [F.col(c).alias("_state" + t) for c, t in zip(("n", "won", "last"), _SCAN)]
        ups = [F.get("ups", F.lit(i)).alias("_state" + t) for i, t in enumerate(_TIMES)]
        scanned = scanned.join(state.select("horse_id", *held, *ups), "horse_id", "left")
        parts.append("_state")
    runs, wins = (sum((F.coalesce(part + c, F.lit(0)) for part in parts), F.lit(0)) for c in ("_n", "_won"))
    last, mean = F.col("_last"), _mean_of([F.col(c) for c in _TIMES])
    if len(parts) > 1:
        last = F.greatest(*[part + "_last" for part in parts])
        newest = F.sort_array(F.array_compact(F.array(*[part + c for part in parts for c in _TIMES])), asc=False)
        merged = _mean_of([F.get(newest, F.lit(i)) for i in range(3)])
        alone = F.coalesce(*[part + "_up1" for part in parts[1:]]).isNull()
        mean = F.when(alone, mean).otherwise(merged)
    known_horse = F.col("horse_id").isNotNull()
    return scanned.select(
        *kept,
        F.when(known_horse, last["finish"]).alias("prev_rank"),
        F.when(known_horse, mean).alias("avg_up_3f_3runs"),
        F.when(known_horse & (runs > 0), wins / runs).otherwise(F.lit(0.0)).alias("win_rate"),
        F.when(known_horse, last["cls"]).alias("prev_class"),
    )


STATE = ["horse_id", "n", "won", "last", "ups", "upto"]


def horse_state(results: DataFrame, class_mode: str = "contains") -> DataFrame:
    """What a horse's later races need to know of its races so far, one row per horse.

    Counts of its runs and wins, its latest race, its three latest times (newest first), and
    how far the state reaches. States of different races of a horse add up (``merge_states``),
    so a state is kept up to date without its races.
    """
    rows = _contributions(results.where(F.col("horse_id").isNotNull()), class_mode)
    own = rows.select(
        "horse_id", F.col("_c_n").alias("n"), F.col("_c_won").alias("won"), F.col("_c_last").alias("last"), "_c_up",
        F.struct(F.col("race_date").alias("d"), F.col("race_id").alias("r")).alias("upto"),
    )
    totals = _added_up(own)
    newest = Window.partitionBy("horse_id").orderBy(F.col("_c_up").desc())
    # The group limit works before the shuffle too, so a horse with very many races costs three rows a task.
    times = own.where(F.col("_c_up").isNotNull()).select(
        "horse_id", "_c_up", F.row_number().over(newest).alias("_i")).where("_i <= 3")
    ups = times.groupBy("horse_id").agg(F.sort_array(F.collect_list("_c_up"), asc=False).alias("ups"))
    return totals.join(ups, "horse_id", "left").select(STATE)


def _added_up(rows: DataFrame) -> DataFrame:
    return rows.groupBy("horse_id").agg(
        F.sum("n").cast("bigint").alias("n"), F.sum("won").cast("bigint").alias("won"),
        F.max("last").alias("last"), F.max("upto").alias("upto"),
    )


def merge_states(states: DataFrame) -> DataFrame:
    """One row per horse out of several (a union of states), each of different races."""
    ups = F.sort_array(F.flatten(F.collect_list(F.coalesce("ups", F.array()))), asc=False)
    merged = states.groupBy("horse_id").agg(
        F.sum("n").cast("bigint").alias("n"), F.sum("won").cast("bigint").alias("won"), F.max("last").alias("last"),
        F.max("upto").alias("upto"), F.slice(ups, 1, 3).alias("ups"),
    )
    return merged.withColumn("ups", F.when(F.size("ups") > 0, F.col("ups"))).select(STATE)


def out_of_order(targets: DataFrame, state: DataFrame) -> DataFrame:
    """Ids of the horses that have a dated target no later than what their state reaches."""
    reached = state.select("horse_id", F.col("upto").alias("_upto"))
    at = F.struct(F.col("race_date").alias("d"), F.col("race_id").alias("r"))
    early = targets.select("horse_id", at.alias("_at")).where("_at.d is not null").join(reached, "horse_id")
    return early.where("_at <= _upto").select("horse_id").distinct()


def with_past(df: DataFrame, past: DataFrame) -> DataFrame:
    """Runners joined with features kept in a table of their own, one row per (race, horse)."""
    return df.drop(*OUTPUTS).join(
        past.select("race_id", "horse_id", *OUTPUTS), ["race_id", "horse_id"], "left"
    ).withColumn("win_rate", F.coalesce("win_rate", F.lit(0.0)))
