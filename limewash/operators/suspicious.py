"""Text values that deserve a second look, from the value frequencies of all text columns.

Every rule yields (column, value, n) and runs for all columns at once. The rules read trimmed,
non-blank values; identifier columns are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limewash.functions import constants as K
from limewash.operators.melting import frequencies, present_values, ranked, text_columns
from limewash.session import materialise

# The lengths of short lists, and the distinct values up to which a column has rare ones.
SHOWN = 5
RARE_SHOWN = 10
RARE_KINDS = 200


def text_frequencies(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value, n) of trimmed, non-blank text."""
    return frequencies(present_values(df, list(columns if columns is not None else text_columns(df))))


def column_totals(freq: DataFrame) -> DataFrame:
    """One row of totals per column, among them the share of values with a digit."""
    digit = F.col("value").rlike(r"\d")
    return freq.groupBy("column").agg(
        F.sum("n").alias("total"),
        F.count(F.lit(1)).alias("kinds"),
        (F.sum(F.when(digit, F.col("n")).otherwise(0)) / F.sum("n")).alias("digit_share"),
    )


def id_like_columns(freq: DataFrame) -> DataFrame:
    """(column, is_id): one token of the identifier alphabet, few lengths, one length dominant."""
    value = F.col("value")
    token = value.rlike(K.ID_PATTERN) & (F.length(value) <= 64)
    lengths = freq.groupBy("column", F.length(value).alias("length")).agg(
        F.sum("n").alias("n"), F.bool_and(token).alias("tokens")
    )
    per_column = lengths.groupBy("column").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("lengths"),
        F.max("n").alias("modal"), F.bool_and("tokens").alias("tokens"),
    )
    is_id = (
        (F.col("total") >= 5) & F.col("tokens") & (F.col("lengths") <= 3)
        & (F.col("modal") / F.col("total") >= 0.85)
    )
    return per_column.select("column", is_id.alias("is_id"))


def text_consistency(freq: DataFrame) -> DataFrame:
    """(column, is_consistent): every spelling is unique once case and spaces are ignored."""
    value, n = F.col("value"), F.col("n")
    key = F.btrim(F.regexp_replace(F.lower(value), r"(?U)\s+", " "))
    spellings = freq.groupBy("column", key.alias("key")).agg(F.count(F.lit(1)).alias("spellings"))
    variants = spellings.groupBy("column").agg(F.max("spellings").alias("spellings"))
    lower = value.rlike(r"\p{Ll}") & ~value.rlike(r"[\p{Lu}\p{Lt}]")
    totals = freq.groupBy("column").agg(
        F.sum("n").alias("total"),
        F.sum(F.when(value.rlike(K.EMAIL_PATTERN), n).otherwise(0)).alias("emails"),
        F.sum(F.when(value.rlike(r"\d"), n).otherwise(0)).alias("digits"),
        F.bool_and(lower).alias("all_lower"),
    )
    digit_share = F.col("digits") / F.col("total")
    structured = F.col("is_id") | (F.col("emails") / F.col("total") >= 0.5)
    varied = (
        F.col("all_lower") | ((digit_share > 0) & (digit_share < 0.5)) | (F.col("spellings") > 1)
    )
    joined = totals.join(F.broadcast(variants), "column").join(F.broadcast(id_like_columns(freq)), "column")
    return joined.select("column", (structured | ~varied).alias("is_consistent"))


def _most_frequent(freq: DataFrame, k: int | None) -> DataFrame:
    """All rows, or the k most frequent per column."""
    top = freq if k is None else ranked(freq, k, F.desc("n"), F.asc("value"))
    return top.select("column", "value", "n")


def mojibake(freq: DataFrame, k: int | None = None) -> DataFrame:
    """Double-encoded text."""
    return _most_frequent(freq.where(F.col("value").rlike(K.MOJIBAKE_PATTERN)), k)


def hex_bytes(freq: DataFrame, k: int | None = None) -> DataFrame:
    """A leaked byte code between words."""
    return _most_frequent(freq.where(F.col("value").rlike(K.HEX_BYTE_PATTERN)), k)


def stray_digits(freq: DataFrame, k: int | None = None) -> DataFrame:
    """Digits at the edge of words, in columns where digits are unusual."""
    share = F.col("digit_share")
    unusual = column_totals(freq).where((share > 0) & (share < 0.3)).select("column")
    marked = freq.where(F.col("value").rlike(K.STRAY_DIGIT_PATTERN))
    return _most_frequent(marked.join(F.broadcast(unusual), "column", "left_semi"), k)


def _bare(value: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(value, "[^A-Za-z0-9 ]", "")))


def punctuation_variants(freq: DataFrame) -> DataFrame:
    """Spellings that equal a more frequent one but for punctuation and case."""
    keyed = freq.withColumn("key", _bare(F.col("value"))).where(F.col("key") != "")
    first = F.min(F.struct((-F.col("n")).alias("low"), F.col("value").alias("lead")))
    leads = keyed.groupBy("column", "key").agg(first.alias("first"), F.count(F.lit(1)).alias("spellings"))
    leads = leads.where(F.col("spellings") > 1).select("column", "key", F.col("first.lead").alias("lead"))
    return (
        keyed.join(leads, ["column", "key"]).where(F.col("value") != F.col("lead"))
        .select("column", "value", "n")
    )


def short_codes(freq: DataFrame) -> DataFrame:
    """Codes of two or three characters that a far more frequent longer form starts with.

    Longer forms are first reduced to the largest total per prefix, so the join is on equal keys
    and a popular prefix is one row.
    """
    keyed = freq.withColumn("key", _bare(F.col("value"))).where(F.col("key") != "")
    totals = keyed.groupBy("column", "key").agg(F.sum("n").alias("total"))
    size = F.length("key")
    prefixes = totals.select(
        "column", "total",
        F.explode(F.array(
            F.when(size > 2, F.left(F.col("key"), F.lit(2))),
            F.when(size > 3, F.left(F.col("key"), F.lit(3))),
        )).alias("key"),
    ).where(F.col("key").isNotNull())
    longest = prefixes.groupBy("column", "key").agg(F.max("total").alias("long_total"))
    weak = (
        totals.where(size.between(2, 3)).join(longest, ["column", "key"])
        .where(F.col("long_total") >= 3 * F.col("total")).select("column", "key")
    )
    return keyed.join(weak, ["column", "key"]).select("column", "value", "n")


def rare_values(freq: DataFrame, k: int | None = None, most_kinds: int = RARE_KINDS) -> DataFrame:
    """Values of at most one percent, for columns of at most ``most_kinds`` distinct values."""
    totals = column_totals(freq).where(F.col("kinds") <= most_kinds).select(
        "column", F.greatest(F.lit(1), F.floor(F.col("total") * 0.01)).alias("limit")
    )
    rare = freq.join(F.broadcast(totals), "column").where(F.col("n") <= F.col("limit"))
    return _most_frequent(rare, k)


#: Length of a rule's short list per column; the other rules have none.
SHORT = {"mojibake": SHOWN, "hex_byte": SHOWN, "stray_digits": SHOWN, "rare": RARE_SHOWN}
RULES = {
    "mojibake": mojibake,
    "hex_byte": hex_bytes,
    "stray_digits": stray_digits,
    "punctuation": punctuation_variants,
    "short_code": short_codes,
    "rare": rare_values,
}


def suspicious_values(df: DataFrame, columns: Sequence[str] | None = None, short: bool = False) -> DataFrame:
    """(column, value, n, rule): each value once, under the first rule it meets; all of them, or
    the short lists that are shown to a reader.

    Identifier columns are skipped. The frequencies are written once because every rule reads them.
    """
    return suspicious_of(materialise(text_frequencies(df, columns), "frequencies"), short)


def suspicious_of(freq: DataFrame, short: bool = False) -> DataFrame:
    """``suspicious_values`` from a stored table of ``text_frequencies``."""
    ids = id_like_columns(freq).where("is_id").select("column")
    freq = freq.join(F.broadcast(ids), "column", "left_anti")
    found = None
    for position, (rule, find) in enumerate(RULES.items()):
        found_here = find(freq, SHORT[rule]) if short and rule in SHORT else find(freq)
        part = found_here.withColumns({"position": F.lit(position), "rule": F.lit(rule)})
        found = part if found is None else found.unionByName(part)
    return found.groupBy("column", "value").agg(
        F.max("n").alias("n"), F.min_by("rule", "position").alias("rule")
    )
