"""What each text column holds, judged from the shares of its values.

``column_evidence`` counts, in one pass over all text columns, everything the decisions need.
Removing the letters of int-like columns comes before the other detectors and changes what they
see; so each count exists twice, ``_0`` for the values as they are and ``_1`` for the values after
that removal, and ``decide`` picks the branch that applies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limewash.functions import constants as K
from limewash.functions.dates import FEW_DIGITS, add_dates, digits_as_date
from limewash.functions.numbers import SIMPLE, add_number_text, is_fraction, is_number, to_loose_number
from limewash.functions.text import int_like_digits, is_int_like, null_if_sentinel, trim
from limewash.operators.melting import frequencies, melt, text_columns, tidy_values

SHORT_VALUE = 12
SAME, DIGITS, GONE = "same", "digits", "gone"


def column_evidence(
    df: DataFrame, columns: Sequence[str] | None = None, *, dot3: bool = True
) -> DataFrame:
    """One row of counts per text column, from a single read. Every value is judged once, and counts for
    all cells that hold it."""
    cells = melt(df, list(columns if columns is not None else text_columns(df)))
    cells = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("t", trim(F.col("value")))
    cells = cells.withColumn("v", null_if_sentinel(F.col("t"), F.col("t")))
    v, w, number = F.col("v"), F.col("w"), F.col("number")
    simple, dotted, il = F.col("simple"), F.col("dotted"), F.col("il")
    cells = cells.select(
        "column",
        "n",
        "v",
        (F.col("t") != F.col("value")).alias("trimmed"),
        (F.col("t").isNotNull() & v.isNull()).alias("nulled"),
        v.rlike(SIMPLE).alias("simple"),
        F.contains(v, F.lit(".")).alias("dotted"),
    )
    cells = cells.withColumn("il", F.when(simple, ~dotted).otherwise(is_int_like(v)))
    # plain numbers need no ladder, and only short digit groups among them can be dates
    maybe_date = ~simple | (~dotted & F.length(v).between(2, 8))
    cells = cells.withColumns({
        "w": F.when(il & ~simple, int_like_digits(v)),
        "as_date": F.when(maybe_date, v),
        "as_number": F.when(~simple, v),
    })
    cells = add_dates(cells, {"as_date": F.col("as_date")}, trimmed=True)
    cells = add_number_text(cells, {"as_number": F.col("as_number")}, dot3=dot3, trimmed=True)
    cells = cells.withColumn("number", F.coalesce(F.col("as_number"), v))
    small = simple & ~dotted & (F.length(v) <= 18)
    cells = cells.withColumns({
        # what the removal of letters does to the cell: nothing, leaves digits, leaves nothing
        "effect": F.when(~il | simple | (v == w), SAME).when(w.isNotNull(), DIGITS)
        .when(il, GONE).otherwise(SAME),
        "numeric": simple | is_number(number),
        "plain": simple | is_number(v),
        "has_digit": simple | v.rlike(r"\d"),
        "fraction": F.when(small, False).when(is_number(number), is_fraction(number)),
        "plain_fraction": F.when(small, False).when(is_number(v), is_fraction(v)),
        "at": ~simple & F.contains(v, F.lit("@")),
    })
    numeric, plain, has_digit, at = (F.col(c) for c in ("numeric", "plain", "has_digit", "at"))
    dated = F.col("as_date").isNotNull()
    left = F.when(F.col("effect") == DIGITS, w)
    per_effect = {
        "cells": F.lit(True),
        "trimmed": F.col("trimmed"),
        "nulled": F.col("nulled"),
        "int_like": il,
        "dollars": F.startswith(v, F.lit("$")),
        "values": v.isNotNull(),
        "dates": dated,
        "weak_dates": dated & v.rlike(FEW_DIGITS),
        "numbers": numeric,
        "plain": plain & ~F.startswith(v, F.lit("+")),
        "dots": numeric & F.contains(number, F.lit(".")),
        "raw_dots": dotted,
        "fractions": F.col("fraction"),
        "plain_fractions": F.col("plain_fraction"),
        "emails": at & v.rlike(K.EMAIL_PATTERN),
        "phones": has_digit & ~dotted & (F.length(v) >= 7) & v.rlike(K.PHONE_PATTERN),
        "ratios": ~simple & F.contains(v, F.lit("/")) & v.rlike(K.RATIO_PATTERN),
        "at_signs": at,
        "with_digit": has_digit,
        "names": ~has_digit & v.rlike(K.NAME_PATTERN),
        "multi_token": ~simple & v.rlike(r"\s"),
        "short": F.length(v) <= SHORT_VALUE,
        "rewritten": ~number.eqNullSafe(v),
        "lowered": at & (F.lower(v) != v),
        # the same questions for the digits that are left
        "left_dates": digits_as_date(left).isNotNull(),
        "left_weak_dates": digits_as_date(left).isNotNull() & (F.length(left) < 8),
        "left_fractions": is_fraction(left),
        "left_phones": F.length(left) >= 7,
        "left_short": F.length(left) <= SHORT_VALUE,
        "left_rewritten": left.rlike(r"^0\d"),
    }
    counts = cells.groupBy("column", "effect").agg(
        *[F.sum(F.when(test, F.col("n")).otherwise(0)).alias(name) for name, test in per_effect.items()]
    )
    return _both_branches(counts)


# how a count after the removal of letters follows for cells of which only digits are left:
# from another count, from all such cells, or not at all
_AFTER = {
    "values": "cells", "dates": "left_dates", "weak_dates": "left_weak_dates", "numbers": "cells",
    "plain": "cells", "dots": None, "raw_dots": None, "fractions": "left_fractions",
    "plain_fractions": "left_fractions", "emails": None, "phones": "left_phones", "ratios": None,
    "at_signs": None, "with_digit": "cells", "names": None, "multi_token": None,
    "short": "left_short", "rewritten": "left_rewritten", "lowered": None,
}


def _both_branches(counts: DataFrame) -> DataFrame:
    """Fold the at most three rows per column into one with both variants of each count."""
    same, digits = F.col("effect") == SAME, F.col("effect") == DIGITS
    totals = [
        F.sum(c).alias(c) for c in ("cells", "trimmed", "nulled", "int_like", "dollars")
    ]
    totals.append(F.sum(F.when(~same, F.col("cells")).otherwise(0)).alias("int_like_changed"))
    for name, after in _AFTER.items():
        stripped = F.col(after) if after else F.lit(0)
        totals.append(F.sum(name).alias(f"{name}_0"))
        totals.append(
            F.sum(F.when(same, F.col(name)).when(digits, stripped).otherwise(0)).alias(f"{name}_1")
        )
    return counts.groupBy("column").agg(*totals)


def decide(evidence: DataFrame, *, int_like: bool = True) -> DataFrame:
    """Turn counts into column roles and a target type; still one row per column."""
    applied = (
        F.lit(int_like)
        & (F.col("values_0") >= K.MIN_INT_LIKE_VALUES)
        & (F.col("int_like") >= F.col("values_0") * K.INT_LIKE_SHARE)
    )
    rows = evidence.withColumn("is_int_like", applied)
    rows = rows.withColumns({
        name[:-2]: F.when(F.col("is_int_like"), F.col(name[:-2] + "_1")).otherwise(F.col(name))
        for name in evidence.columns if name.endswith("_0")
    })
    n = F.col("values")

    def share(count: str) -> Column:
        return F.try_divide(F.col(count), n)

    enough = n >= K.MIN_VALUES
    # short digit groups such as ages are no sign of dates in a column of numbers
    evident = F.when(share("numbers") >= K.NUMERIC_SHARE, F.col("dates") - F.col("weak_dates"))
    rows = rows.withColumn("date_values", evident.otherwise(F.col("dates")))
    gate = (
        (n >= K.MIN_NAME_VALUES) & (share("at_signs") < 0.2)
        & (share("with_digit") < 0.3) & (share("names") >= 0.6)
    )
    rows = rows.withColumns({
        "is_date": enough & (F.col("date_values") == n),
        "is_date_like": (n > 0) & (share("date_values") >= K.DATE_SHARE),
        "is_email": enough & (share("emails") >= K.EMAIL_SHARE),
        "is_phone": enough & (share("phones") >= K.PHONE_SHARE),
        "is_ratio": (n > 0) & (share("ratios") >= K.RATIO_SHARE),
        "is_currency": (F.col("values_0") > 0)
        & (F.col("dollars") >= F.col("values_0") * K.CURRENCY_SHARE),
        "is_plain_number": (n > 0) & (F.col("plain") == n),
        "name_check": F.when(~F.coalesce(gate, F.lit(False)), "no")
        .when(share("multi_token") >= 0.5, "yes").otherwise("values"),
    })
    structured = ~F.col("is_plain_number") & (F.col("is_email") | F.col("is_phone") | F.col("is_ratio"))
    all_numbers = (n > 0) & (F.col("numbers") == n)
    all_dates = (n > 0) & (F.col("date_values") == n)
    whole = (
        F.when(F.col("is_plain_number"), (F.col("raw_dots") == 0) & (F.col("plain_fractions") == 0))
        .otherwise((F.col("dots") == 0) & (F.col("fractions") == 0))
    )
    number_type = F.when(whole, "bigint").otherwise("double")
    target = (
        F.when(F.col("is_date"), "timestamp_ntz")
        .when(all_numbers & ~structured, number_type)
        .when(all_dates & ~all_numbers, "timestamp_ntz")
    )
    return rows.withColumn("target", target).withColumns(_coercion_columns(n, share))


def _coercion_columns(n: Column, share) -> dict[str, Column]:
    """The type a column leans to before the rule that no value may be lost."""
    small = (
        F.when(F.col("numbers") == n, "numeric").when(F.col("date_values") == n, "datetime")
    )
    large = (
        F.when((share("numbers") >= K.NUMERIC_SHARE) & (F.col("numbers") >= F.col("date_values")), "numeric")
        .when((share("date_values") >= K.DATE_SHARE) & (F.col("date_values") > F.col("numbers")), "datetime")
    )
    leaning = F.when(n == 0, None).when(n < K.MIN_VALUES, small).otherwise(large)
    return {"leaning": leaning}


def name_value_check(values: DataFrame) -> DataFrame:
    """Tell person names from codes by their values: (column, is_person).

    Takes a long form restricted to columns that already look name-like. A column of few distinct
    short values, or with one dominant value, holds codes or categories.
    """
    freq = frequencies(values)
    short = F.length("value") <= SHORT_VALUE
    stats = freq.groupBy("column").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("kinds"),
        F.max("n").alias("most"),
        F.count_if(short).alias("short_kinds"),
        F.sum(F.when(short, F.col("n")).otherwise(0)).alias("short_n"),
    )
    codes = (F.col("short_n") / F.col("n") >= 0.5) & (F.col("short_kinds") <= 30)
    dominated = (F.col("kinds") <= 50) & (F.col("most") / F.col("n") >= 0.15)
    return stats.select("column", (~(codes | dominated)).alias("is_person"))


def person_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, is_person) for every text column.

    The first pass yields one row per column; only columns it leaves open are read again.
    """
    names = list(columns if columns is not None else text_columns(df))
    gates = decide(column_evidence(df, names), int_like=False).select("column", "name_check").collect()
    by_values = [r.column for r in gates if r.name_check == "values"]
    settled = [(r.column, r.name_check == "yes") for r in gates if r.name_check != "values"]
    out = df.sparkSession.createDataFrame(settled, "column string, is_person boolean")
    if by_values:
        out = out.unionByName(name_value_check(tidy_values(df, by_values)))
    return out


def type_evidence(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Counts for the high-level type of text columns, on the values as stored."""
    cells = melt(df, list(columns if columns is not None else text_columns(df)))
    cells = add_dates(cells, {"as_date": F.col("value")})
    number = to_loose_number(F.col("value"))
    return cells.groupBy("column").agg(
        F.count(F.lit(1)).alias("cells"),
        F.count("value").alias("non_null"),
        F.count(number).alias("numbers"),
        F.count("as_date").alias("dates"),
        F.count_if(is_fraction(F.translate(F.col("value"), ", ", "")) & number.isNotNull()).alias("fractions"),
    )


def parse_type(numbers: Column, dates: Column, non_null: Column, otherwise: Column) -> Column:
    """numeric at 90 % numbers, else datetime at 80 % dates, else the given fallback."""
    return (
        F.when(non_null == 0, otherwise)
        .when(F.try_divide(numbers, non_null) >= K.NUMERIC_SHARE, "numeric")
        .when(F.try_divide(dates, non_null) >= K.DATE_SHARE, "datetime")
        .otherwise(otherwise)
    )


def category_or_text(non_null: Column, distinct_values: Column) -> Column:
    few = (
        (distinct_values <= 50) & (non_null >= 10)
        & (distinct_values <= F.floor(non_null / 2))
    )
    return F.when((non_null > 0) & few, "categorical").otherwise("text")
