"""Row and column pruning: empty rows, empty columns, exact duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limewash.functions.text import quoted, trim
from limewash.operators.melting import digests, is_text


def drop_null_rows(df: DataFrame) -> DataFrame:
    """Drop rows whose cells are all null."""
    return df.where(reduce(lambda a, b: a | b, [quoted(c).isNotNull() for c in df.columns]))


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows whose cells are all null, blank or the literal ``nan``."""
    filled = [
        ~F.lower(trim(quoted(f.name))).isin("", "nan") if is_text(f.dataType)
        else quoted(f.name).isNotNull()
        for f in df.schema
    ]
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in filled]))


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns without a name, without any value, and later columns of a repeated name."""
    positional = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    counts = positional.agg(*[F.count(c).alias(c) for c in positional.columns]).first()
    kept: dict[str, str] = {}
    for position, name in zip(positional.columns, df.columns):
        if name.strip() and counts[position]:
            kept.setdefault(name, position)
    return positional.select(*[F.col(position).alias(name) for name, position in kept.items()])


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Keep one of each set of equal rows; nulls are equal. Copies merge before the shuffle."""
    return df.dropDuplicates()


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: total rows, distinct rows and rows that repeat an earlier one. Rows are compared by
    digests of 128 bits, so that no whole row is shuffled."""
    per_row = digests(df, [], rows=True).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"))
    return per_row.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("row_count"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows"),
    )
