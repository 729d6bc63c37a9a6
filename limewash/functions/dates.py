"""Dates written as text.

A fixed list of accepted forms is tried in a fixed order; an impossible calendar date is
null, never "corrected". Day comes first with dashes and slashes, month first with spaces.
Two-digit years pivot at 69 (69 is 1969, 68 is 2068).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limewash.functions.constants import MONTHS
from limewash.functions.staging import Cells
from limewash.functions.text import trim

_LONG = "|".join(MONTHS)
_SHORT = "|".join(month[:3] for month in MONTHS)
_ANY = f"{_LONG}|{_SHORT}"
_MONTH_CODES = "".join(month[:3] for month in MONTHS)
_MM = r"(1[0-2]|0[1-9]|[1-9])"
_DD = r"(3[01]|[12]\d|0[1-9]|[1-9])"

# Accepted date shapes on lower-case text with single spaces.
MAYBE_DATE = rf"^(?=\s*(?:\d|(?i:{_SHORT})))(?=.*[\sA-Za-z])[\sA-Za-z0-9,./-]*$"
DIGITS_AND_MARKS = r"^(?:\d{1,4}[-./]\d{1,2}[-./]\d{1,4}|\d{2}|\d{4}|\d{6,8})$"
YEAR_FIRST = r"^\d{4}([-./])\d{1,2}\1\d{1,2}$"
MARKED = r"^(\d{1,2})([-/])(\d{1,2})\2(\d{4})$"
SPACED = r"^(\d{1,2}) (\d{1,2}) (\d{4})$"
NAMED = rf"^(?:\d{{1,2}} (?:{_ANY}) \d{{4}}|(?:{_ANY}) \d{{1,2}} \d{{4}}|(?:{_LONG}) \d{{1,2}}, \d{{4}})$"
COMPACT = r"^\d{6,8}$"
SHORT_YEAR = rf"^(\d{{1,2}}-\d{{1,2}}-|\d{{1,2}} (?:{_SHORT}) |(?:{_SHORT}) \d{{1,2}} |)(\d{{2}})$"
ANY_SHAPE = "|".join([YEAR_FIRST.replace(r"\1", "[-./]"), MARKED.replace(r"\2", "[-/]"), SPACED, NAMED, COMPACT, r"^\d{4}$"])
FEW_DIGITS = r"^\d{1,7}$"


def tidy_date_text(c: Column) -> Column:
    """Single spaces, no ordinal endings, no "of", no spaces around dashes."""
    s = F.regexp_replace(trim(c), r"(?U)\s+", " ")
    s = F.replace(s, F.lit(" of "), F.lit(" "))
    s = F.regexp_replace(s, r"(?i)(\d+)(st|nd|rd|th)\b", "$1")
    s = F.regexp_replace(s, r"\s*-\s*", "-")
    return F.btrim(F.regexp_replace(s, r"\s+", " "))


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", year, month, day)


def _compact_first(s: Column) -> Column:
    return F.regexp_replace(s, rf"^(\d{{4}}){_MM}{_DD}$", "$1-$2-$3")


def _compact_second(s: Column) -> Column:
    return F.regexp_replace(s, rf"^{_MM}{_DD}(\d{{4}})$", "$3-$1-$2")


def _calendar(candidate: Column) -> Column:
    """A date from ``yyyy-[m]m-[d]d`` text; null for other text or an impossible day."""
    well_formed = (F.substr(candidate, F.lit(5), F.lit(1)) == "-") & (candidate >= "0001")
    return F.when(well_formed, candidate.try_cast("date"))


def digits_as_date(c: Column) -> Column:
    """Date for text made of digits only (``20200220``, ``01152020``, ``2020``, ``20``)."""
    year = F.when(F.length(c) == 2, F.concat(F.when(c >= "69", "19").otherwise("20"), c))
    year = F.when(F.length(c) == 4, c).otherwise(year)
    return F.when(
        c.rlike(COMPACT), F.coalesce(_calendar(_compact_first(c)), _calendar(_compact_second(c)))
    ).otherwise(_calendar(F.concat(year, F.lit("-01-01"))))


def add_dates(
    df: DataFrame, cells: Mapping[str, Column], *, trimmed: bool = False
) -> DataFrame:
    """Add (or replace) one TIMESTAMP_NTZ column per entry, null where the text is no date."""
    work = Cells(df, "date", cells)

    def tidy(i: int) -> Column:
        t = work.get("trimmed", i)
        return F.when(t.rlike(DIGITS_AND_MARKS), t).when(
            t.rlike(MAYBE_DATE) & t.rlike(r"\d"), F.lower(tidy_date_text(t))
        )

    def expand(i: int) -> Column:
        s = work.get("tidy", i)
        century = F.when(F.right(s, F.lit(2)) >= "69", "19").otherwise("20")
        body = F.left(s, F.length(s) - 2)
        return F.when(s.rlike(SHORT_YEAR), F.concat(body, century, F.right(s, F.lit(2)))).when(
            s.rlike(ANY_SHAPE), s
        )

    def shapes(i: int, marked: str, spaced: str, compact) -> Column:
        s = work.get("full", i)
        return (
            F.when(s.rlike(MARKED), F.regexp_replace(s, MARKED, marked))
            .when(s.rlike(SPACED), F.regexp_replace(s, SPACED, spaced))
            .when(s.rlike(COMPACT), compact(s))
        )

    def first(i: int) -> Column:
        s = work.get("full", i)
        month_code = F.regexp_extract(s, f"({_SHORT})", 1)
        month = ((F.instr(F.lit(_MONTH_CODES), month_code) + 2) / 3).cast("int").cast("string")
        named = _date(F.right(s, F.lit(4)), month, F.regexp_extract(s, r"\d{1,2}", 0))
        return (
            F.when(s.rlike(YEAR_FIRST), F.translate(s, "./", "--"))
            .when(s.rlike(NAMED), named)
            .when(s.rlike(r"^\d{4}$"), F.concat(s, F.lit("-01-01")))
            .otherwise(shapes(i, "$4-$3-$1", "$3-$1-$2", _compact_first))
        )

    def parsed(i: int) -> Column:
        other = shapes(i, "$4-$1-$3", "$3-$2-$1", _compact_second)
        date = F.coalesce(_calendar(work.get("first", i)), _calendar(other))
        return date.cast("timestamp_ntz")

    work.step("trimmed", lambda i: work.get("in", i) if trimmed else trim(work.get("in", i)))
    work.step("tidy", tidy).step("full", expand).step("first", first)
    return work.finish(parsed)
