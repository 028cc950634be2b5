import pytest
from pyspark.sql import functions as F

from idsync.functions import dates, text


def values(spark, fn, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "fn, given, wanted",
    [
        (text.clean_spaces, ["  a b\t", None, ""], ["a b", None, ""]),
        (text.remove_accents, [" Łódź Straße ", "Müller", "Жук", None], ["Lodz Strasse", "Muller", "Zhuk", None]),
        (text.non_word_chars, ["a-_b..c", "‍", None], ["a b c", " ", None]),
        (text.double_spaces, ["a   b", None], ["a b", None]),
        (text.womens_suffixes, ["Alpha Women's", "Beta, Women", "Gamma WFC", "Delta Ladies", "Women", None], ["Alpha", "Beta", "Gamma", "Delta", "Women", None]),
        (text.youth_suffixes, ["Alpha Under-19", "Beta U21", "Gamma Sub-17", "Delta U-23", None], ["Alpha", "Beta", "Gamma", "Delta", None]),
        (text.common_suffixes, ["Alpha FC", "Beta U19", "Gamma SC Women", "Alpha FC SC"], ["Alpha", "Beta", "Gamma", "Alpha FC"]),
        (text.common_prefixes, ["FC Alpha", "1. Beta", "Olympique de Gamma"], ["Alpha", "Beta", "Gamma"]),
        (text.normalize, [" Émile-Ô'Brien ", "ÅB", None], ["emile o brien", "ab", None]),
        (text.normalize_team_names, ["FC Zürich Women", None], ["zurich", None]),
    ],
)
def test_text(spark, fn, given, wanted):
    assert values(spark, fn, given) == wanted


def test_kana_and_hangul(spark):
    assert values(spark, lambda c: text.remove_accents(c, kana_hangul=True), ["サボナ", "김", "é", None]) == ["sabona", "gim", "e", None]


def test_ngrams(spark):
    assert values(spark, text.ngrams, ["ab.cd", "ab", "", None, "aaaa"]) == [["abc", "bcd"], [], [], [], ["aaa", "aaa"]]
    with pytest.raises(ValueError):
        text.ngrams(F.col("x"), 0)


def test_token_set(spark):
    assert values(spark, text.token_set, ["a b a", "", None]) == [["a", "b"], [""], None]


def test_dates(spark):
    given = ["2026-01-21", "01-21-2026", "21-01-2026", "Jan 21, 2026", "January 21, 2026", "2026-01-21T10:00Z", "2026-01-21T10:00:00.000Z", "test", "", None, "1970-01-01"]
    assert [str(x) if x else None for x in values(spark, dates.parse_date, given)] == ["2026-01-21"] * 7 + [None, None, None, "1970-01-01"]
    assert values(spark, dates.is_valid_date, ["2026-01-21", "1970-01-01", "test"]) == [True, False, False]
    assert values(spark, lambda c: dates.shift_date(c, -1), ["2024-03-01", None]) == ["2024-02-29", None]
    assert values(spark, dates.swap_month_day, ["2024-03-01"]) == ["2024-01-03"]
    assert values(spark, dates.parse_date, ["01-02-2026"])[0].month == 1
