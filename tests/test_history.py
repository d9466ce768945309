import random

import pytest
from conftest import day
from pyspark.sql import functions as F

from racecard.operators.history import OUTPUTS, past_features, past_only
from racecard.operators.rates import rates_asof

SCHEMA = "race_id string, race_date date, horse_id string, horse_no string, jockey_id string, " \
         "finish string, up_3f string, race_name string"
NAMES = ["天皇賞(G1)", "3勝クラス", "未勝利", "新馬", None]


def make_runs(seed: int, rows: int, hot_share: float = 0.0):
    rnd = random.Random(seed)
    out, seen = [], set()
    while len(out) < rows:
        horse = "0000000001" if rnd.random() < hot_share else f"{rnd.randint(2, 12):010d}"
        on = rnd.randint(0, 40)
        venue = rnd.randint(1, 10)
        race = f"2023{venue:02d}{on:02d}{rnd.randint(1, 99):04d}" if rnd.random() > 0.1 else f"X{rnd.randint(0, 10**8):09d}"
        if (race, horse) in seen:
            continue
        seen.add((race, horse))
        out.append((
            race, day(on), horse if rnd.random() > 0.05 else None, str(len(out)),
            f"{rnd.randint(1, 3):05d}", rnd.choice(["1", "2", "3", "中", "4(降)", None]),
            rnd.choice(["33.5", "34.1", "35.0", None, "x"]), rnd.choice(NAMES),
        ))
    return out


def brute(rows, order):
    """The four features of each row, straight from their definition."""
    codes = {"天皇賞(G1)": 9.0, "3勝クラス": 5.0, "未勝利": 2.0, "新馬": 1.0, None: 0.0}
    number = {"1": 1.0, "2": 2.0, "3": 3.0, "4(降)": 4.0}
    out = {}
    for r in rows:
        race, on, horse, no = r[:4]
        key = (lambda q: (q[1], q[0])) if order == "time" else (lambda q: q[0])
        past = [q for q in rows if horse and q[2] == horse and not q[0].startswith("X") and key(q) < key(r)]
        past.sort(key=lambda q: (q[1], q[0]), reverse=True)
        ups = [float(q[6]) for q in past if q[6] not in (None, "x")][:3]
        finishes = [number[q[5]] for q in past if q[5] in number]
        out[(race, no)] = (
            number.get(past[0][5]) if past else None,
            round(sum(ups) / len(ups), 6) if ups else None,
            round(finishes.count(1.0) / len(finishes), 6) if finishes else 0.0,
            codes[past[0][7]] if past else None,
        )
    return out


def features(df):
    return {
        (r.race_id, r.horse_no): tuple(
            round(r[c], 6) if r[c] is not None else None for c in OUTPUTS
        )
        for r in df.collect()
    }


@pytest.mark.parametrize("order", ["time", "race_id"])
def test_equals_brute_force(spark, order):
    rows = make_runs(1, 300)
    assert features(past_features(spark.createDataFrame(rows, SCHEMA), order=order)) == brute(rows, order)


@pytest.mark.parametrize("order", ["time", "race_id"])
@pytest.mark.parametrize("separate", [False, True])
def test_hot_horses_equal_brute_force(spark, small_groups_are_hot, order, separate):
    rows = make_runs(2, 400, hot_share=0.4)
    df = spark.createDataFrame(rows, SCHEMA)
    out = past_features(df, history=df if separate else None, order=order)
    assert features(out) == brute(rows, order)


def test_one_named_hot_horse(spark):
    rows = make_runs(3, 300, hot_share=0.5)
    out = past_features(spark.createDataFrame(rows, SCHEMA), hot=["0000000001"])
    assert features(out) == brute(rows, "time")


def test_no_later_race_changes_a_feature(spark):
    rows = make_runs(4, 200)
    cut = day(20)
    before = features(past_features(spark.createDataFrame(rows, SCHEMA)))
    changed = [r if r[1] <= cut else (*r[:5], "1", "99.9", "新馬") for r in rows]
    kept = [r for r in rows if r[1] <= cut]
    for other in (changed, kept):
        after = features(past_features(spark.createDataFrame(other, SCHEMA)))
        for r in kept:
            assert after[(r[0], r[3])] == before[(r[0], r[3])]


def test_edges(spark):
    rows = [
        ("202301010101", day(0), "h", "1", "j", "1", "34.0", "GIII"),
        ("202301010201", day(1), "h", "1", "j", "2", None, "新馬"),
        ("X00000001", day(2), "h", "1", "j", "1", "10.0", "天皇賞(G1)"),
        ("202301010301", day(3), "h", "1", "j", "中", "36.0", "未勝利"),
        ("202301010401", day(4), "h", "1", "j", "3", "38.0", "未勝利"),
        ("202301010501", day(5), "h", "1", "j", "3", None, "未勝利"),
        ("202301010601", day(6), "h", "1", "j", "3", "40.0", "未勝利"),
    ]
    got = features(past_features(spark.createDataFrame(rows, SCHEMA)))
    assert got[("202301010101", "1")] == (None, None, 0.0, None)  # first race
    assert got[("202301010301", "1")] == (2.0, 34.0, 0.5, 1.0)  # the foreign race is ignored
    assert got[("202301010401", "1")] == (None, 35.0, 0.5, 2.0)  # newest has no numeric finish
    assert got[("202301010601", "1")] == (3.0, 36.0, 0.25, 2.0)  # three newest times that exist


def test_runners_without_id_stay_apart(spark):
    rows = [(f"20230101010{i}", day(i), None, str(n), "j", "1", "34.0", "新馬") for i in (1, 2) for n in (1, 2)]
    out = past_features(spark.createDataFrame(rows, SCHEMA))
    assert out.count() == 4
    assert set(features(out).values()) == {(None, None, 0.0, None)}


def test_past_only(spark):
    df = spark.createDataFrame(
        [("202301010101", "202301010102"), ("202301010102", "202301010102"), ("X1", "202301010102"), ("X1", " ")],
        "a string, b string",
    )
    assert [r[0] for r in df.select(past_only("a", "b")).collect()] == [True, False, False, True]


def test_rates_exclude_the_same_day(spark):
    rows = [
        ("202301010101", day(0), "a", "1", "j", "1", None, None),
        ("202301010102", day(0), "b", "1", "j", "5", None, None),
        ("202301010201", day(1), "a", "1", "j", "3", None, None),
        ("202301010202", day(1), "b", "1", None, "1", None, None),
        ("202301010301", day(2), "b", "1", "j", "中", None, None),
    ]
    out = rates_asof(spark.createDataFrame(rows, SCHEMA), "jockey").orderBy("race_id").collect()
    got = [(r.jockey_win_rate, r.jockey_place_rate) for r in out]
    assert got == [(0.0, 0.0), (0.0, 0.0), (0.5, 0.5), (None, None), (pytest.approx(1 / 3), pytest.approx(2 / 3))]


def test_rates_for_other_targets(spark):
    rows = [("202301010101", day(0), "a", "1", "j", "1", None, None)]
    history = spark.createDataFrame(rows, SCHEMA)
    targets = history.select(
        F.lit("202301010901").alias("race_id"), F.lit(day(9)).alias("race_date"),
        F.explode(F.array(F.lit("j"), F.lit("k"))).alias("jockey_id"),
    )
    got = {r.jockey_id: r.jockey_win_rate for r in rates_asof(history, "jockey", targets).collect()}
    assert got == {"j": 1.0, "k": None} or got == {"j": 1.0, "k": 0.0}
