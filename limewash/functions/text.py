"""Cell-level text functions: pure Column -> Column, native expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from limewash.functions.constants import INT_LIKE_PATTERN, NULL_SENTINELS, WHITESPACE


_SENTINEL_STARTS = sorted({ord(x) if x else 0 for s in NULL_SENTINELS for x in (s[:1].lower(), s[:1].upper())})


def quoted(name: str) -> Column:
    """Column by literal name, also when the name holds dots, spaces or back-ticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def trim(c: Column) -> Column:
    """Strip Unicode white space at both ends; nulls stay null.

    Cells that begin and end with a printable ASCII character skip the character-set search.
    """
    first, last = F.ascii(c), F.ascii(F.right(c, F.lit(1)))
    bare = first.between(33, 126) & last.between(33, 126)
    return F.when(bare, c).otherwise(F.btrim(c, F.lit(WHITESPACE)))


def blank_to_null(trimmed: Column) -> Column:
    return F.when(trimmed != "", trimmed)


def null_if_sentinel(c: Column, trimmed: Column | None = None) -> Column:
    """Null for blank or null-like text, otherwise the cell as it is.

    Only the few first letters that null-like words have lead to the comparison of whole words.
    """
    key = trim(c) if trimmed is None else trimmed
    return F.when(~F.ascii(key).isin(*_SENTINEL_STARTS), c).when(
        ~F.lower(key).isin(*NULL_SENTINELS), c
    )


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every letter run and lower-case the rest.

    Marking each run with a separator lets the built-in ``initcap`` do the work, which
    otherwise only looks at spaces (``O'neil``).
    """
    mark = "\x01 "
    split = F.regexp_replace(c, r"(?<![\p{Lu}\p{Ll}\p{Lt}])(?=[\p{Lu}\p{Ll}\p{Lt}])", mark)
    return F.replace(F.initcap(split), F.lit(mark), F.lit(""))


def sentence_case(c: Column) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substr(c, F.lit(2))))


def is_int_like(c: Column) -> Column:
    return c.rlike(INT_LIKE_PATTERN)


def int_like_text(c: Column) -> Column:
    """``178c`` -> ``178``, ``m90`` -> ``90``, infinity or blank -> null, other text unchanged."""
    t = trim(c)
    return F.when(int_like_digits(t).isNotNull(), int_like_digits(t)).when(
        ~F.lower(t).isin("", "inf", "infinity"), c
    )


def int_like_digits(trimmed: Column) -> Column:
    """The digits of an int-like cell; null for infinity and for any other text."""
    return F.when(
        trimmed.rlike(r"^(\d+[a-zA-Z]?|[a-zA-Z]\d+)$"), F.regexp_replace(trimmed, "[a-zA-Z]", "")
    )
