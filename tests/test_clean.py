import pytest

from racecard.functions import clean


@pytest.mark.parametrize(
    "make, text, want",
    [
        (clean.to_num, "57", 57.0), (clean.to_num, " 12 ", 12.0), (clean.to_num, "1e3", 1000.0),
        (clean.to_num, "　12", 12.0), (clean.to_num, ".5", 0.5), (clean.to_num, "-3.", -3.0),
        (clean.to_num, "1,234", None), (clean.to_num, "▲55", None), (clean.to_num, "", None),
        (clean.to_num, "1d", None), (clean.to_num, None, None), (clean.to_num, "1 2", None),
        (clean.finish_num, "2(降)", 2.0), (clean.finish_num, "中", None), (clean.finish_num, "１着", 1.0),
        (clean.finish_num, None, None), (clean.finish_num, "9" * 400, float("inf")),
        (clean.is_win, "1", 1), (clean.is_win, " 01 ", 1), (clean.is_win, "10", 0),
        (clean.is_win, "1(降)", 0), (clean.is_win, None, 0),
        (clean.sex_of, "牡4", "牡"), (clean.age_of, "牡4", 4.0), (clean.sex_of, "セ10", "セ"),
        (clean.age_of, "セ10", 10.0), (clean.sex_of, "牝", "牝"), (clean.age_of, "牝", None),
        (clean.sex_of, None, None), (clean.age_of, None, None), (clean.sex_of, "", None),
        (clean.body_weight, "444(-4)", 444.0), (clean.weight_change, "444(-4)", -4.0),
        (clean.body_weight, "470 (+2)x", 470.0), (clean.weight_change, "470 (+2)x", 2.0),
        (clean.body_weight, "470", 470.0), (clean.weight_change, "470", 0.0),
        (clean.body_weight, "計不", None), (clean.weight_change, "計不", None),
        (clean.body_weight, "470kg", None), (clean.weight_change, "470kg", None),
        (clean.percent, "19.5%", 0.195), (clean.percent, "-", 0.0), (clean.percent, None, 0.0),
        (clean.percent, "1.2.3", 0.0),
        (clean.race_class, "天皇賞(G1)", 9.0), (clean.race_class, "GII", 9.0), (clean.race_class, "ＧⅡ", 8.0),
        (clean.race_class, "オープン", 6.0), (clean.race_class, "1500万下", 3.0), (clean.race_class, "新馬", 1.0),
        (clean.race_class, "3歳未勝利", 2.0), (clean.race_class, "lady's cup g3", 7.0),
        (clean.race_class, "J.G1", 9.0), (clean.race_class, "1600万下", 5.0), (clean.race_class, None, 0.0),
        (clean.race_class, "ｇ１", 9.0), (clean.race_class, "何か Ｌ 杯", 6.0), (clean.race_class, "何か Ｌ ", 0.0),
        (clean.default_odds, "---", "999.0"), (clean.default_odds, "3.5", "3.5"), (clean.default_odds, None, "999.0"),
        (clean.default_popularity, "**", "99"), (clean.default_weight, " ", "470(0)"),
        (clean.default_weight, None, "470(0)"),
        (clean.horse_no_key, "05", "5"), (clean.horse_no_key, "A1", "A1"), (clean.horse_no_key, " 5 ", "5"),
        (clean.horse_no_key, "5.0", "5.0"),
        (clean.clean_id, "nan", None), (clean.clean_id, "", None), (clean.clean_id, "1096.0", "1096"),
        (clean.squash, " a 　 b\n", "a b"), (clean.norm_header, "着 順　", "着順"),
        (clean.horse_id_of, "https://x/horse/2019105219/", "2019105219"), (clean.horse_id_of, "/horse/1", ""),
        (clean.jockey_id_of, "/jockey/result/recent/01096/", "01096"), (clean.jockey_id_of, "?id=01096", "01096"),
        (clean.trainer_id_of, "/trainer/01167/", "01167"), (clean.race_id_of, "/race/202305020411/", "202305020411"),
        (clean.is_domestic, "202305020411", True), (clean.is_domestic, "2023A5020411", False),
        (clean.is_domestic, None, False),
        (clean.feature_label, "odds", "単勝オッズ"), (clean.feature_label, "other", "other"),
        (clean.gate_display, "05", "5"), (clean.gate_display, "A", "A"),
        (clean.odds_display, "999.0", "-"), (clean.odds_display, "", "-"), (clean.odds_display, "3.5", "3.5"),
        (clean.finish_display, "2", "2"),
    ],
)
def test_value(one, make, text, want):
    assert one(text, make) == (pytest.approx(want) if isinstance(want, float) else want)


@pytest.mark.parametrize(
    "name, want",
    [("GII", 8.0), ("GIII", 7.0), ("GI", 9.0), ("1500万下", 0.0), ("500万下", 3.0), ("G10", 0.0),
     ("TOPAZ", 0.0), ("XX OP", 6.0), ("J.G2", 8.0)],
)
def test_corrected_class(one, name, want):
    assert one(name, lambda c: clean.race_class(c, mode="corrected")) == want


def test_id_width(one):
    assert one("1096.0", lambda c: clean.clean_id(c, 5)) == "01096"
    assert one("123456", lambda c: clean.clean_id(c, 5)) == "123456"
    assert one("A12", lambda c: clean.clean_id(c, 5)) == "A12"


def test_race_parts(one):
    parts = one("202305020411", clean.race_parts)
    assert tuple(parts) == ("2023", "05", "02", "04", "11")
    assert one("X0000", clean.race_parts) is None


def test_hidden_finish_and_marks(one, spark):
    assert one("2", lambda c: clean.finish_display(c, True)) == "-"
    ranks = spark.range(1, 8)
    marks = [r[0] for r in ranks.select(clean.mark_of("id")).collect()]
    assert marks == ["◎", "○", "▲", "△", "△", "-", "-"]


def test_headers_by_alias_order(spark):
    df = spark.createDataFrame([(["着差", "着順", "オッズ"],)], "h array<string>")
    at = lambda *words: df.select(clean.resolve_header("h", list(words))).first()[0]
    assert (at("着順"), at("着"), at("単勝", "オッズ"), at("人気")) == (1, 0, 2, None)
    assert df.select(clean.exact_header("h", "着順")).first()[0] == 1
