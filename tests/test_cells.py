"""Cell functions against given pairs and against the standard library."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from limewash.functions import headers, text
from limewash.functions.dates import add_dates
from limewash.functions.numbers import add_number_text, to_loose_number, to_number, word_numbers


def apply(frame, values, build):
    df = frame(v=values)
    return [r[0] for r in build(df).select("out").collect()]


def numbers(frame, values, **options):
    return apply(frame, values, lambda df: add_number_text(df, {"out": F.col("v")}, **options))


def dates(frame, values):
    got = apply(frame, values, lambda df: add_dates(df, {"out": F.col("v")}))
    return [g and g.date() for g in got]


def test_trim_keeps_nulls_and_strips_unicode_space(frame):
    values = ["  x  ", "y", None, " a b ", "\x1cz\n", "", "é "]
    got = apply(frame, values, lambda df: df.select(text.trim(F.col("v")).alias("out")))
    assert got == [v if v is None else v.strip() for v in values]


def test_null_like_text(frame):
    values = ["", "  ", "None", "N/A", "ok", " n.a. ", "#N/A", "-", "Not Applicable", "nap", "NULLS", "-1", None]
    got = apply(frame, values, lambda df: df.select(text.null_if_sentinel(F.col("v")).alias("out")))
    assert got == [None, None, None, None, "ok", None, None, None, None, "nap", "NULLS", "-1", None]


@pytest.mark.parametrize("value, expected", [
    ("Ab3d", "Ab3d"), (" 57 ", "57"), ("$ 2.468,7", "2468.7"), ("y", "y"), ("$ 6o1,204,99l", "601204991"),
    ("$ 908", "908"), ("512.306", "512306"), ("4.6.", "4.6"), ("07.3", "7.3"), ("009", "9"), ("0", "0"),
    ("1,234.56", "1234.56"), ("1.234,56", "1234.56"), ("9,.0", "9.0"), ("8,9f", "8.9"), ("8..8", "8.8"),
    ("++8.7", "8.7"), ("1e-0", "1"), ("12:30", "12.30"), ("12%", "12"), ("thirty", "30"),
    ("SIXTY THOUSAND", "60000"), ("f", "f"), ("$", "$"), ("Il B4 mare", "Il B4 mare"),
    # signs survive, and text that only looks like digits is left alone
    ("-5 ", "-5"), ("-1,234.5", "-1234.5"), ("10-20", "10-20"), ("24/7", "24/7"),
    ("192.168.0.1", "192.168.0.1"), ("2020-01-05", "2020-01-05"),
])
def test_number_ladder(frame, value, expected):
    assert numbers(frame, [value]) == [expected]


def test_number_ladder_dot_option(frame):
    assert numbers(frame, ["3.142", "0.125"], dot3=False) == ["3.142", "0.125"]
    assert numbers(frame, ["3.142", "0.125"]) == ["3142", "125"]


def test_number_parser_is_guarded(frame):
    values = ["7f", "5d", "nan", "1e3", " 12 ", "+5", ".5", "5.", "1,5", None, "0x10", "-3"]
    got = apply(frame, values, lambda df: df.select(to_number(F.col("v")).alias("out")))
    assert got == [None, None, None, 1000.0, 12.0, 5.0, 0.5, 5.0, None, None, None, -3.0]
    loose = apply(frame, ["1,234", "1 000"], lambda df: df.select(to_loose_number(F.col("v")).alias("out")))
    assert loose == [1234.0, 1000.0]


def test_word_numbers(frame):
    values = ["forty", "Nine Thousand", "one", "forty-two", "7 forty", None]
    got = apply(frame, values, lambda df: df.select(word_numbers(F.col("v")).alias("out")))
    assert got == ["40", "9000", "one", "forty-two", "7 forty", None]


def test_int_like(frame):
    values = ["178c", "m90", "90", "inf", "Infinity", "ab1", "1a2", " ", None, "0012"]
    got = apply(frame, values, lambda df: df.select(text.int_like_text(F.col("v")).alias("out")))
    assert got == ["178", "90", "90", None, None, "ab1", "1a2", None, None, "0012"]


def test_dates_in_every_form(frame):
    pairs = {
        "2020-1-5": (2020, 1, 5), "2020.01.05": (2020, 1, 5), "05-01-2020": (2020, 1, 5), "05-13-2020": (2020, 5, 13),
        "2020/1/5": (2020, 1, 5), "05/01/2020": (2020, 1, 5), "5/13/2020": (2020, 5, 13), "5 Jan 2020": (2020, 1, 5),
        "5 jan 20": (2020, 1, 5), "Jan 5 2020": (2020, 1, 5), "JAN 5 69": (1969, 1, 5), "January 5 2020": (2020, 1, 5),
        "April 5, 2018": (2018, 4, 5), "5 January 2020": (2020, 1, 5), "12 31 2020": (2020, 12, 31),
        "31 12 2020": (2020, 12, 31), "05-01-20": (2020, 1, 5), "05-01-69": (1969, 1, 5), "05-01-68": (2068, 1, 5),
        "20200220": (2020, 2, 20), "01152020": (2020, 1, 15), "2020": (2020, 1, 1), "42": (2042, 1, 1),
        "5th of March 2020": (2020, 3, 5), " 5 - 1 - 2020 ": (2020, 1, 5),
    }
    assert dates(frame, list(pairs)) == [dt.date(*p) for p in pairs.values()]


def test_impossible_dates_are_null(frame):
    values = ["1984-02-34", "1976-13-24", "2021-02-29", "20210230", "Apr 5, 2018", "5 march 20", "Sept 5 2020",
              "12:30", "", None, "1", "0000", "2020-01-05 10:00:00", "2020-01/05"]
    assert dates(frame, values) == [None] * len(values)


# The accepted date forms in the order they are tried.
FORMS = (
    "%Y-%m-%d", "%Y.%m.%d", "%d-%m-%Y", "%m-%d-%Y", "%Y/%m/%d", "%d/%m/%Y", "%m/%d/%Y", "%d %b %Y", "%d %b %y",
    "%b %d %Y", "%b %d %y", "%B %d %Y", "%B %d, %Y", "%d %B %Y", "%m %d %Y", "%d %m %Y", "%d-%m-%y", "%m-%d-%y",
    "%Y%m%d", "%m%d%Y", "%Y", "%y",
)


def first_form(value):
    for form in FORMS:
        try:
            return dt.datetime.strptime(value, form).date()
        except ValueError:
            continue
    return None


LENIENT = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@LENIENT
@given(st.lists(st.from_regex(r"[0-9]{1,8}|[0-9]{1,4}[-/. ][0-9]{1,2}[-/. ][0-9]{1,4}", fullmatch=True), min_size=40, max_size=80))
def test_date_order_equals_trying_the_forms(frame, values):
    assert dates(frame, values) == [first_form(v) for v in values]


@LENIENT
@given(st.lists(st.text(st.sampled_from("aZé'-. 1ßǆσ中́"), max_size=8), min_size=30, max_size=60))
def test_title_case_equals_python(frame, values):
    got = apply(frame, values, lambda df: df.select(text.title_case(F.col("v")).alias("out")))
    assert got == [v.title() for v in values]


def test_headers():
    assert headers.clean_headers(["Yeer", "Citty"]) == ["Year", "City"]
    assert headers.clean_headers([" customer  id ", "Descripción"]) == ["Customer Id", "Descripcion"]
    assert headers.clean_headers(["Rate", "Gender"]) == ["Date", "Gender"]
    assert headers.clean_headers(["Rate"], fix_spelling=False) == ["Rate"]
    assert headers.clean_headers(["name", "Name", ""]) == ["name", "Name", ""]
