import math
from datetime import date, datetime

from helpers import column
from pyspark.sql import functions as F

from oreline.functions import codes, logic, parsing, text


def test_whitespace_is_every_unicode_space():
    assert set(text.WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_strip_removes_all_unicode_space_from_both_ends(spark):
    values = ["  a b ", "\t\n a ", "　x y ", text.WHITESPACE, "", None]
    assert column(spark, values, text.strip) == [v if v is None else v.strip() for v in values]


def test_slices(spark):
    values = ["AC-HE-HL-U509", "AB", "", None]
    assert column(spark, values, lambda x: text.first_chars(x, 5)) == ["AC-HE", "AB", "", None]
    assert column(spark, values, lambda x: text.without_first(x, 6)) == ["HL-U509", "", "", None]
    assert column(spark, ["a-b-c"], lambda x: text.swap(x, "-", "_")) == ["a_b_c"]
    assert column(spark, ["AW-00011000"], lambda x: text.remove(x, "-")) == ["AW00011000"]


def test_prefix_is_dropped_once(spark):
    values = ["NASAW00011000", "AW00011000", "NASNASx", "nasx", "NAS", None]
    expected = ["AW00011000", "AW00011000", "NASx", "nasx", "", None]
    assert column(spark, values, lambda x: text.drop_prefix(x, "NAS")) == expected


def test_compact_dates(spark):
    values = [
        "20240105", "0", "5489", "2024010a", "00000000", "20240230", "2024-1-5", "", None,
        "16000101", "99991231", " 2024010", "+2024010", "2024015 ", "00000101", "202401055",
    ]
    expected = [
        date(2024, 1, 5), None, None, None, None, None, None, None, None,
        date(1600, 1, 1), date(9999, 12, 31), None, None, None, None, None,
    ]
    assert column(spark, values, parsing.parse_compact_date) == expected


def test_dates(spark):
    values = [
        "2024-01-05", " 2024-1-6\t", "2024-01-07 10:00:00", "2024-02-30", "05/01/2024", "x", "", None,
    ]
    days = [date(2024, 1, 5), date(2024, 1, 6), date(2024, 1, 7), None, None, None, None, None]
    assert column(spark, values, parsing.parse_date) == days
    moments = column(spark, values, parsing.parse_moment)
    assert moments[2] == datetime(2024, 1, 7, 10)
    assert [m and m.date() for m in moments] == days


def test_dates_in_declared_formats(spark):
    values = ["2024-01-05", "05/01/2024", "20240107", "15-Jan-2024", "01/15/2024", "x", " ", None]
    formats = ("iso", "dd/MM/yyyy", "yyyyMMdd", "dd-MMM-yyyy")
    days = [date(2024, 1, 5), date(2024, 1, 5), date(2024, 1, 7), date(2024, 1, 15), None, None, None, None]
    assert column(spark, values, lambda c: parsing.parse_date(c, formats)) == days
    lost = [False, False, False, False, True, True, False, False]
    assert column(spark, values, lambda c: parsing.unreadable_date(c, formats)) == lost
    assert column(spark, values, parsing.unreadable_date)[1] is True


def test_numbers(spark):
    values = [
        "12", " 12 ", "\t7\n", "-3.5", "+5", ".5", "5.", "1e5", "0", "-0",
        "", " ", None, "abc", "NaN", "nan", "1.0d", "1f", "0x10", "1_000", "1 2", "--1", ".", "e5",
    ]
    expected = [12, 12, 7, -3.5, 5, 0.5, 5, 100000, 0, 0] + [None] * 14
    assert column(spark, values, parsing.parse_number) == expected
    infinite = column(spark, ["inf", "-Infinity", "+INF"], parsing.parse_number)
    assert infinite == [math.inf, -math.inf, math.inf]


def test_code_labels(spark):
    values = ["M", " s", "S ", "f ", "\tF", "R", "t", "MALE ", " female", "X", "", None]

    def labelled(labels):
        return column(spark, values, lambda x: codes.label(x, labels))

    na = "n/a"
    assert labelled(codes.MARITAL_STATUS) == ["Married", "Single", "Single"] + [na] * 9
    assert labelled(codes.CRM_GENDER) == ["Male", na, na, "Female", "Female"] + [na] * 7
    assert labelled(codes.PRODUCT_LINE) == [
        "Mountain", "Other Sales", "Other Sales", na, na, "Road", "Touring", na, na, na, na, na,
    ]
    assert labelled(codes.ERP_GENDER) == [
        "Male", na, na, "Female", "Female", na, na, "Male", "Female", na, na, na,
    ]


def test_country(spark):
    values = ["US", " usa ", "de", "", "  ", None, " France ", "united states", "Usa"]
    expected = [
        "United States", "United States", "Germany", "n/a", "n/a", "n/a", "France",
        "united states", "United States",
    ]
    assert column(spark, values, codes.country_name) == expected


def test_known_value_wins(spark):
    rows = [("Male", "Female"), ("n/a", "Female"), ("n/a", None), ("n/a", "n/a"), ("Female", None)]
    df = spark.createDataFrame(rows, "a string, b string").coalesce(1)
    got = [r[0] for r in df.select(codes.prefer_known(F.col("a"), F.col("b"))).collect()]
    assert got == ["Male", "Female", "n/a", "n/a", "Female"]


def test_future_days_are_nulled(spark):
    today = F.lit(date(2025, 6, 1))
    days = [date(2025, 5, 31), date(2025, 6, 1), date(2025, 6, 2), None]
    got = column(spark, days, lambda x: codes.past_or_null(x, today), "date")
    assert got == [date(2025, 5, 31), date(2025, 6, 1), None, None]


def test_comparisons_with_missing_operands(spark):
    rows = [(1.0, 1.0), (1.0, 2.0), (None, 1.0), (1.0, None), (None, None)]
    df = spark.createDataFrame(rows, "a double, b double").coalesce(1)
    a, b = F.col("a"), F.col("b")
    got = df.select(logic.differs(a, b).alias("d"), logic.holds(a < b).alias("h")).collect()
    assert [r["d"] for r in got] == [False, True, True, True, True]
    assert [r["h"] for r in got] == [False, True, False, False, False]
