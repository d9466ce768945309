"""Column functions that turn raw page text into typed values.

Each takes a column (or its name) and returns a column built from Spark's own
functions, so it stays inside code generation and works in any select or filter.
None of them throws under ANSI mode: text that does not parse becomes null.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as white space in page text (Unicode, full-width space included).
SPACE = (
    r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
SPACES = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
PLAIN_NUMBER = r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
DOMESTIC_RACE = "^[0-9]{12}$"

# Link patterns that carry an id.
HORSE_LINK = r"/horse/([0-9]{10})"
JOCKEY_LINK = r"(?:id=|/jockey/|/jockey/result/recent/)([0-9]{5})"
TRAINER_LINK = r"(?:id=|/trainer/|/trainer/result/recent/)([0-9]{5})"
RACE_LINK = r"/race/([0-9]{12})"

# Class code and the words that mean it, tested in this order.
RACE_CLASS_WORDS = [
    (9.0, ["G1", "GI", "Ｇ１", "ＧⅠ", "J.G1", "J.GI"]),
    (8.0, ["G2", "GII", "Ｇ２", "ＧⅡ", "J.G2", "J.GII"]),
    (7.0, ["G3", "GIII", "Ｇ３", "ＧⅢ", "J.G3", "J.GIII"]),
    (6.0, ["OP", "オープン", "LISTED", " Ｌ ", "(L)"]),
    (5.0, ["3勝クラス", "1600万下", "1600万"]),
    (4.0, ["2勝クラス", "1000万下", "1000万"]),
    (3.0, ["1勝クラス", "500万下", "500万"]),
    (2.0, ["未勝利"]),
    (1.0, ["新馬"]),
]

# Words with and without upper and lower case; all classes of the former come first.
_CASED = [(code, words) for code, words in RACE_CLASS_WORDS if any(w.upper() != w.lower() for w in words)]
_UNCASED = RACE_CLASS_WORDS[len(_CASED):]

# The same classes as whole words: GII is no longer read as GI, nor 1500万 as 500万.
RACE_CLASS_PATTERNS = [
    (9.0, r"(^|[^A-Z]|J)(G1|GI|Ｇ１|ＧⅠ)([^0-9IV０-９ⅠⅡⅢ]|$)"),
    (8.0, r"(^|[^A-Z]|J)(G2|GII|Ｇ２|ＧⅡ)([^0-9IV０-９ⅠⅡⅢ]|$)"),
    (7.0, r"(^|[^A-Z]|J)(G3|GIII|Ｇ３|ＧⅢ)([^0-9IV０-９ⅠⅡⅢ]|$)"),
    (6.0, r"(^|[^A-Z])OP([^A-Z]|$)|オープン|LISTED| Ｌ |\(L\)"),
    (5.0, r"3勝クラス|(^|[^0-9])1600万"),
    (4.0, r"2勝クラス|(^|[^0-9])1000万"),
    (3.0, r"1勝クラス|(^|[^0-9])500万"),
    (2.0, "未勝利"),
    (1.0, "新馬"),
]

# What stands in for a missing price, popularity or body weight.
NO_ODDS = "999.0"
NO_POPULARITY = "99"
NO_WEIGHT = "470(0)"

# Display label of each feature.
FEATURE_LABELS = {
    "age": "年齢",
    "sex_牡": "性別: 牡",
    "sex_牝": "性別: 牝",
    "sex_セ": "性別: セ",
    "horse_weight": "馬体重 (kg)",
    "weight_change": "体重増減",
    "time_seconds": "走破タイム (秒)",
    "up_3f": "上り3ハロン (秒)",
    "jockey_weight": "斤量 (kg)",
    "horse_number": "馬番",
    "prev_rank": "前走着順",
    "avg_up_3f_3runs": "過去3走平均上り3F",
    "win_rate": "通算勝率",
    "jockey_win_rate": "騎手勝率",
    "jockey_place_rate": "騎手複勝率",
    "trainer_win_rate": "調教師勝率",
    "trainer_place_rate": "調教師複勝率",
    "prev_class": "前走クラス",
    "odds": "単勝オッズ",
    "popularity": "人気順",
}

# Mark, class and label of the first five of a race.
MARKS = [
    (1, "◎", "favorite", "本命 (Favorite)"),
    (2, "○", "rival", "対抗 (Rival)"),
    (3, "▲", "darkhorse", "単穴 (Dark Horse)"),
    (4, "△", "wildcard", "連下 (Wildcard)"),
    (5, "△", "wildcard", "連下 (Wildcard)"),
]
NO_MARK = ("-", "none", "")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Text without white space at either end."""
    return F.trim(_col(c), F.lit(SPACES))


def squash(c: Column | str) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(_col(c), f"{SPACE}+", " "))


def norm_header(c: Column | str) -> Column:
    """Header text without any white space."""
    return F.regexp_replace(_col(c), SPACE, "")


def _some(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def ascii_digits(c: Column | str) -> Column:
    """Full-width digits as ASCII digits."""
    return F.translate(_col(c), "０１２３４５６７８９", "0123456789")


def to_num(c: Column | str) -> Column:
    """Number if the whole text is one, else null (Java's ``1d`` is not a number here)."""
    raw = _col(c).cast("string")
    text = strip(raw)
    # Trimming by a list of characters is slow, so only text that is no number as it stands is trimmed.
    return F.when(raw.rlike(PLAIN_NUMBER), raw.try_cast("double")).when(text.rlike(NUMBER), text.try_cast("double"))


def as_num(df: DataFrame, name: str) -> Column:
    """A column of ``df`` as a number: parsed if it is text, as it is (NaN as null) if not."""
    if isinstance(df.schema[name].dataType, T.NumericType):
        value = F.col(name).cast("double")
        return F.when(~F.isnan(value), value)
    return to_num(name)


def finish_num(c: Column | str) -> Column:
    """Finish position from the digits of the text: ``2(降)`` is 2, ``中`` is null."""
    digits = _some(F.regexp_replace(ascii_digits(c), "[^0-9]", ""))
    return F.when(_col(c).rlike(r"\A[0-9]+\z"), _col(c).try_cast("double")).otherwise(digits.try_cast("double"))


def is_win(c: Column | str) -> Column:
    """1 if the text is exactly ``1`` or ``01``, else 0."""
    return F.coalesce(_col(c).rlike(rf"\A{SPACE}*0?1{SPACE}*\z"), F.lit(False)).cast("int")


def sex_of(c: Column | str) -> Column:
    return _some(F.substring(_col(c), 1, 1))


def age_of(c: Column | str) -> Column:
    return to_num(_col(c).substr(F.lit(2), F.length(_col(c))))


# Weight and change, or a weight that stands alone.
_WEIGHT = rf"\A{SPACE}*([0-9]+)(?:\s*\(([-+]?[0-9]+)\)|{SPACE}*\z)"


def body_weight(c: Column | str) -> Column:
    """Weight from ``444(-4)`` or ``444``, else null."""
    return _some(F.regexp_extract(_col(c), _WEIGHT, 1)).try_cast("double")


def weight_change(c: Column | str) -> Column:
    """Change from ``444(-4)``; 0 if the weight stands alone, else null."""
    change = _some(F.regexp_extract(_col(c), _WEIGHT, 2)).try_cast("double")
    return F.coalesce(change, F.when(F.regexp_extract(_col(c), _WEIGHT, 1) != "", F.lit(0.0)))


def percent(c: Column | str) -> Column:
    """Fraction from the first run of digits and dots; 0 if there is none."""
    return F.coalesce(to_num(F.regexp_extract(_col(c), "([0-9.]+)", 1)) / F.lit(100.0), F.lit(0.0))


def race_class(c: Column | str, mode: str = "contains") -> Column:
    """Class code 0-9 of a race name.

    ``contains`` tests plain substrings, so an ASCII ``GII`` scores as ``GI``;
    ``corrected`` tests whole words. Case does not matter in either. One pattern per
    class keeps the name from being upper-cased once per word; words without upper and lower
    case need no pattern, and one that holds all other words tells whether theirs are tried.
    """
    name = strip(c)
    if mode == "contains":
        patterns = [(code, "|".join(map(re.escape, words))) for code, words in _CASED]
        found = [F.when(name.rlike(f"(?iu){pattern}"), F.lit(code)) for code, pattern in patterns]
        cased = F.when(_col(c).rlike("(?iu)" + "|".join(pattern for _, pattern in patterns)), F.coalesce(*found))
        plain = [F.when(reduce(or_, (_col(c).contains(w) for w in words)), F.lit(code)) for code, words in _UNCASED]
        # A null name matches nothing and ends at 0.
        return F.coalesce(cased, *plain, F.lit(0.0))
    if mode == "corrected":
        patterns = RACE_CLASS_PATTERNS
    else:
        raise ValueError(f"unknown mode {mode!r}")
    # A null name matches no pattern and ends at 0.
    found = [F.when(name.rlike(f"(?iu){pattern}"), F.lit(code)) for code, pattern in patterns]
    return F.coalesce(*found, F.lit(0.0))


def _has_digit(c: Column) -> Column:
    return F.coalesce(ascii_digits(c).rlike("[0-9]"), F.lit(False))


def default_odds(c: Column | str) -> Column:
    return F.when(_has_digit(_col(c)), _col(c)).otherwise(F.lit(NO_ODDS))


def default_popularity(c: Column | str) -> Column:
    return F.when(_has_digit(_col(c)), _col(c)).otherwise(F.lit(NO_POPULARITY))


def default_weight(c: Column | str) -> Column:
    return F.coalesce(_some(strip(c)), F.lit(NO_WEIGHT))


def horse_no_key(c: Column | str) -> Column:
    """``05`` and ``5`` are one key; text that is no integer is kept, stripped."""
    text = strip(c)
    whole = F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint").cast("string"))
    return F.coalesce(whole, text)


def clean_id(c: Column | str, width: int | None = None) -> Column:
    """Entity id without a ``.0`` tail; blank and ``nan`` are null.

    With ``width``, zeros that were lost by reading ids as numbers are put back.
    """
    first = strip(F.split_part(_col(c), F.lit("."), F.lit(1)))
    known = ~first.isin("", "nan")
    if width is None:
        return F.when(known, first)
    short = first.rlike(f"^[0-9]{{1,{width - 1}}}$")
    return F.when(short, F.lpad(first, width, "0")).when(known, first)


def horse_id_of(c: Column | str) -> Column:
    return F.regexp_extract(_col(c), HORSE_LINK, 1)


def jockey_id_of(c: Column | str) -> Column:
    return F.regexp_extract(_col(c), JOCKEY_LINK, 1)


def trainer_id_of(c: Column | str) -> Column:
    return F.regexp_extract(_col(c), TRAINER_LINK, 1)


def race_id_of(c: Column | str) -> Column:
    return F.regexp_extract(_col(c), RACE_LINK, 1)


def is_domestic(c: Column | str) -> Column:
    """True for a 12-digit race id; false for null."""
    return F.coalesce(_col(c).rlike(DOMESTIC_RACE), F.lit(False))


def race_parts(c: Column | str) -> Column:
    """Year, venue, meeting, day and race number of a 12-digit race id, else null."""
    text = _col(c)
    parts = F.struct(
        F.substring(text, 1, 4).alias("year"),
        F.substring(text, 5, 2).alias("venue"),
        F.substring(text, 7, 2).alias("meeting"),
        F.substring(text, 9, 2).alias("day"),
        F.substring(text, 11, 2).alias("race"),
    )
    return F.when(is_domestic(text), parts)


def resolve_header(headers: Column | str, aliases: list[str]) -> Column:
    """Zero-based position of the first header that contains an alias, aliases in order; else null."""
    found = [
        F.nullif(
            F.array_position(F.transform(_col(headers), lambda h: h.contains(alias)), True),
            F.lit(0).cast("long"),
        )
        for alias in aliases
    ]
    return (F.coalesce(*found) - 1).cast("int")


def exact_header(headers: Column | str, name: str) -> Column:
    """Zero-based position of the header that is exactly ``name``, else null."""
    at = F.array_position(_col(headers), F.lit(name))
    return (F.nullif(at, F.lit(0).cast("long")) - 1).cast("int")


def feature_label(c: Column | str) -> Column:
    """Display label of a feature, or its own name."""
    pairs = [F.lit(text) for item in FEATURE_LABELS.items() for text in item]
    return F.coalesce(F.create_map(*pairs)[_col(c)], _col(c))


def gate_display(c: Column | str) -> Column:
    """Horse number as an integer's text if it is all digits, else as it stands."""
    text = _col(c)
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint").cast("string")).otherwise(text)


def odds_display(c: Column | str) -> Column:
    text = _col(c)
    return F.when(text.isNull() | text.isin(NO_ODDS, "999", ""), F.lit("-")).otherwise(text)


def finish_display(c: Column | str, not_yet_run: Column | bool = False) -> Column:
    hidden = F.lit(not_yet_run) if isinstance(not_yet_run, bool) else not_yet_run
    return F.when(hidden, F.lit("-")).otherwise(F.coalesce(_col(c), F.lit("-")))


def _by_rank(rank: Column | str, item: int) -> Column:
    cases = [F.when(_col(rank) == row[0], F.lit(row[item])) for row in MARKS]
    return F.coalesce(*cases, F.lit(NO_MARK[item - 1]))


def mark_of(rank: Column | str) -> Column:
    return _by_rank(rank, 1)


def mark_class_of(rank: Column | str) -> Column:
    return _by_rank(rank, 2)


def mark_label_of(rank: Column | str) -> Column:
    return _by_rank(rank, 3)
