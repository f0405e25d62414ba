import datetime as dt

import pytest
from pyspark.sql import functions as F

from lotframe import functions as fx


def values(spark, inputs, expression, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [row[0] for row in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_numbers(spark):
    texts = ["1,234.5", "$5", "(3)", "5%", "-", "", " 7 ", "1e3", "5d", "nan", "0x10", ".5", "-2.", None, "1_000"]
    lenient = [1234.5, None, None, None, None, None, 7.0, 1000.0, None, None, None, 0.5, -2.0, None, None]
    assert values(spark, texts, fx.lenient_number) == lenient
    assert values(spark, texts, fx.strict_number) == [None, *lenient[1:]]
    assert values(spark, ["inf", "-Infinity"], fx.strict_number) == [float("inf"), float("-inf")]


def test_dates(spark):
    texts = ["10/02/2025", "2025-01-05", "13/02/2025", "1/5/24", "2024-01-01 15:00:00", "Jan 5, 2024", "20240105",
             "02/30/2024", "later", None]
    expected = [dt.datetime(2025, 10, 2), dt.datetime(2025, 1, 5), dt.datetime(2025, 2, 13), dt.datetime(2024, 1, 5),
                dt.datetime(2024, 1, 1, 15), dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 5), None, None, None]
    assert values(spark, texts, fx.lenient_date) == expected


def test_more_date_spellings(spark):
    at = dt.datetime
    spelled = {
        "12/31/2024 12:00:00 AM": at(2024, 12, 31), "15-Jan-24": at(2024, 1, 15), "15-Jan-95": at(1995, 1, 15), "2/29/96": at(1996, 2, 29), "1/5/68": at(2068, 1, 5), "Jan 15 2020": at(2020, 1, 15),
        "2020-1-5 10:00": at(2020, 1, 5, 10), "January 5, 2020 10:00": at(2020, 1, 5, 10), "20200115 10:00": at(2020, 1, 15, 10),
        "\u00a010/02/2025\t": at(2025, 10, 2), "jan. 5, 2020": at(2020, 1, 5), "5 MARCH 2020": at(2020, 3, 5),
        "1/5/2020 1:02:03 pm": at(2020, 1, 5, 13, 2, 3), "1/5/2020 13:00 PM": None, "1/5/2020 25:00": None, "15.01.2020": at(2020, 1, 15),
        "2024-01-01T15:00:00": at(2024, 1, 1, 15), "12:30": None, "": None,
    }
    assert values(spark, list(spelled), fx.lenient_date) == list(spelled.values())
    assert values(spark, ["\u00a05\u2003", "5"], fx.strict_number) == [5.0, 5.0]


def test_years(spark):
    as_of = F.lit("2024-01-03").cast("date")
    texts = ["2024-01-01 15:00:00", "2024-01-01", "2024-01-04", "2024-01-03 12:00:00"]
    found = values(spark, texts, lambda x: F.round(fx.years_held(x.cast("timestamp"), as_of) * 365.25, 6))
    assert found == [1, 2, -1, -1]
    end = F.lit("2024-01-03 10:00:00").cast("timestamp")
    spans = values(spark, texts, lambda x: F.round(fx.years_between(x.cast("timestamp"), end) * 365.25, 6))
    assert spans == [1, 2, None, None]


@pytest.mark.parametrize(
    "initial, final, years, expected",
    [
        (1000.0, 1500.0, 3.0, 0.1447142426),
        (10000.0, 16105.10, 5.0, 0.10),
        (0.0, 1.0, 1.0, None),
        (1.0, 0.0, 1.0, None),
        (1.0, 1.0, 0.0, None),
        (-1.0, 1.0, 1.0, None),
        (1e-300, 1e300, 1e-3, None),
        (None, 1.0, 1.0, None),
    ],
)
def test_cagr(spark, initial, final, years, expected):
    row = spark.createDataFrame([(initial, final, years)], "i double, f double, y double")
    found = row.select(fx.cagr(F.col("i"), F.col("f"), F.col("y"))).first()[0]
    assert found == (None if expected is None else pytest.approx(expected, abs=1e-9))


def test_cagr_of_text(spark):
    row = spark.createDataFrame([("1,000", " 1500 ", "3")], "i string, f string, y string")
    assert row.select(fx.cagr_from_text(*map(F.col, "ify"))).first()[0] == pytest.approx(0.1447142426)


def test_headers_and_blanks(spark):
    assert values(spark, ["  Cost_-/Basis  ", "_x", "Qty\u00a0 #", "Value ($)"], fx.normalise_header) == [
        "cost basis", " x", "qty #", "value ($)",
    ]
    assert values(spark, ["", " \t", "\u00a0", "a", None], fx.is_blank) == [True, True, True, False, True]
    assert values(spark, ["NaN", " nan ", "", "banana", None], fx.nan_to_null) == [None, None, None, "banana", None]
    assert values(spark, ["  ", " a "], fx.blank_to_null) == [None, " a "]
    assert values(spark, ["1/2/2020", "01/02/20", "x1/2/2020"], fx.is_us_date) == [True, False, False]
    assert values(spark, [" Cash Equivalent ", "cashier"], fx.is_category_heading) == [True, False]


def test_broker(spark):
    paths = ["/in/ML_10022025.csv", "file:/a b/CW-1.xls", "x/plain.csv", "x/_1.csv", "C:\\in\\ET_1.csv", ".hidden"]
    assert values(spark, paths, fx.broker_from_path) == ["ML", "CW-1", "plain", None, "ET", ".hidden"]
