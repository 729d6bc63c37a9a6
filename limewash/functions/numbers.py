"""Numbers written as text: a clean-up ladder and one guarded parser."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limewash.functions.constants import NUMBER_PATTERN, NUMBER_WORDS
from limewash.functions.staging import Cells
from limewash.functions.text import trim

# The shapes the ladder tells apart.
SIMPLE = r"^(?:0|[1-9][0-9]*)(?:\.(?:[0-9]{1,2}|[0-9]{4,}))?$"
NO_LETTERS = r"^\P{L}+?(?i:e[+-]?0)?[fF]*$"
TYPO_TAIL = r"(?i:e[+-]?0)?[fF]*$"
US_STYLE = r"^[-+]?\d{1,3}(,\d{3})*(\.\d+)?$"
EU_STYLE = r"^[-+]?\d{1,3}(\.\d{3})*(,\d+)?$"
INNER_DASH = r"[^-+\s].*-\s*[^-\s]"
FOUR_PARTS = r"^\d+(\.\d+){3}$"
DOT_AND_THREE = r"^\d+\.\d{3}$"

_WORDS = NUMBER_WORDS
_LONGEST_WORD = max(map(len, _WORDS))


def word_number(c: Column) -> Column:
    """Digits for an exact number phrase, null for anything else."""
    literals = [F.lit(x) for pair in _WORDS.items() for x in (pair[0], str(pair[1]))]
    short = F.length(c) <= _LONGEST_WORD
    return F.when(short, F.try_element_at(F.create_map(*literals), F.upper(c)))


def word_numbers(c: Column) -> Column:
    """Replace number phrases by digits; other text is unchanged."""
    return F.coalesce(word_number(trim(c)), c)


def is_number(trimmed: Column) -> Column:
    return trimmed.rlike(NUMBER_PATTERN)


def to_number(c: Column) -> Column:
    """Parse text as DOUBLE, null if it is not a number.

    The guard keeps out what the cast alone would take (``7f``, ``5d``, ``nan``).
    """
    t = trim(c)
    return F.when(t.rlike(NUMBER_PATTERN), t.try_cast("double"))


def to_loose_number(c: Column) -> Column:
    """Parse text as DOUBLE after dropping thousands commas and inner spaces."""
    return to_number(F.translate(c, ", ", ""))


def to_whole_number(c: Column) -> Column:
    """Parse text as BIGINT; exact for digits, via DOUBLE for forms such as ``1e5``."""
    t = trim(c)
    return F.when(
        t.rlike(NUMBER_PATTERN),
        F.coalesce(t.try_cast("bigint"), t.try_cast("double").try_cast("bigint")),
    )


def is_fraction(text: Column) -> Column:
    """True when a number in text form does not fit a BIGINT without loss."""
    number = text.try_cast("double")
    whole = (number == F.rint(number)) & number.try_cast("bigint").isNotNull()
    return ~whole & (F.abs(number) != float("inf"))


def add_number_text(
    df: DataFrame, cells: Mapping[str, Column], *, dot3: bool = True, trimmed: bool = False
) -> DataFrame:
    """Add (or replace) one column per entry with the normalised numeric text of its cell.

    Text that is not a number in disguise comes back unchanged. With ``dot3`` a single dot
    before exactly three digits is read as a thousands separator.
    """
    work = Cells(df, "num", cells)

    def bare(i: int) -> Column:
        return work.get("in", i) if trimmed else trim(work.get("in", i))

    def core(i: int) -> Column:
        t = work.get("trimmed", i)
        amount = F.btrim(F.ltrim(F.regexp_replace(t, TYPO_TAIL, ""), F.lit("$")))
        return (
            F.when(t.rlike(SIMPLE), None)
            .when(F.startswith(t, F.lit("$")), F.translate(amount, "oOlI", "0011"))
            .when(t.rlike(NO_LETTERS), F.btrim(F.regexp_replace(t, TYPO_TAIL, "")))
        )

    def body(i: int) -> Column:
        s = work.get("core", i)
        blocked = (
            s.rlike(r"\p{L}") | F.contains(s, F.lit("/")) | s.rlike(INNER_DASH) | s.rlike(FOUR_PARTS)
        )
        return F.when(~blocked, s)

    def located(i: int) -> Column:
        s = work.get("body", i)
        both = F.contains(s, F.lit(",")) & F.contains(s, F.lit("."))
        return F.when(
            both,
            F.when(s.rlike(US_STYLE), F.regexp_replace(s, r"[^0-9.]", ""))
            .when(s.rlike(EU_STYLE), F.translate(F.regexp_replace(s, r"[^0-9,]", ""), ",", ".")),
        )

    def loose(i: int) -> Column:
        kept = F.regexp_replace(F.translate(work.get("body", i), ":,", ".."), r"[^0-9.]", "")
        return F.rtrim(F.regexp_replace(kept, r"\.+", "."), F.lit("."))

    def joined(i: int) -> Column:
        g = work.get("loose", i)
        many = F.instr(F.substr(g, F.instr(g, ".") + 1), ".") > 0
        thousands = many | g.rlike(DOT_AND_THREE) if dot3 else many
        return F.when(thousands, F.replace(g, F.lit("."), F.lit(""))).otherwise(g)

    def settled(i: int) -> Column:
        g = work.get("joined", i)
        lead = F.when(F.startswith(g, F.lit(".")), F.lit("0")).otherwise("")
        plain = F.concat(lead, F.regexp_replace(g, r"^0+(?=\d)", ""))
        return F.coalesce(work.get("located", i), F.when(g != "", plain))

    def final(i: int) -> Column:
        t, digits = work.get("trimmed", i), work.get("settled", i)
        sign = F.when(F.startswith(work.get("core", i), F.lit("-")), F.lit("-")).otherwise("")
        word = word_number(F.rtrim(t, F.lit("fF")))
        return (
            F.when(t.rlike(SIMPLE), t)
            .when(digits.isNotNull(), F.concat(sign, digits))
            .otherwise(F.coalesce(word, work.get("in", i)))
        )

    for name, build in (
        ("trimmed", bare), ("core", core), ("body", body), ("located", located),
        ("loose", loose), ("joined", joined), ("settled", settled),
    ):
        work.step(name, build)
    return work.finish(final)
