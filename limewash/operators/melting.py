"""Long form of a table: one (column, value) row per cell, and value frequencies over it.

Detectors run once over the long form, so the generated code and the number of jobs do not
depend on how many columns the table has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DataType,
    DateType,
    NumericType,
    StringType,
    TimestampNTZType,
    TimestampType,
)

from limewash.functions.text import blank_to_null, null_if_sentinel, quoted, trim


def is_text(kind: DataType) -> bool:
    return isinstance(kind, StringType)


def is_numeric(kind: DataType) -> bool:
    return isinstance(kind, NumericType)


def is_temporal(kind: DataType) -> bool:
    return isinstance(kind, (DateType, TimestampType, TimestampNTZType))


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_text(f.dataType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def melt(df: DataFrame, columns: Sequence[str], cast: str = "string") -> DataFrame:
    """Rows (column, value) for the given columns; nulls are kept."""
    if not columns:
        return df.sparkSession.createDataFrame([], f"column string, value {cast}")
    cells = df.select(*[quoted(c).cast(cast).alias(c) for c in columns])
    return cells.unpivot([], [quoted(c) for c in columns], "column", "value")


def tidy_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long form with trimmed, null-standardised values."""
    trimmed = melt(df, columns).withColumn("value", trim(F.col("value")))
    return trimmed.withColumn("value", null_if_sentinel(F.col("value"), F.col("value")))


def present_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long form with trimmed values, blanks and nulls removed."""
    trimmed = melt(df, columns).withColumn("value", trim(F.col("value")))
    return trimmed.where(blank_to_null(F.col("value")).isNotNull())


def frequencies(values: DataFrame) -> DataFrame:
    """(column, value, n) of a long form without nulls; combined map-side before the shuffle."""
    present = values.where(F.col("value").isNotNull())
    return present.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def value_frequencies(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """How often each non-null value of each column occurs, values as text."""
    return frequencies(melt(df, list(columns or df.columns)))


def top_values(freq: DataFrame, k: int) -> DataFrame:
    """The k most frequent values per column; ties go to the smaller value."""
    return ranked(freq, k, F.desc("n"), F.asc("value"))


def ranked(rows: DataFrame, k: int, *order: Column, by: Sequence[str] = ("column",)) -> DataFrame:
    """First k rows per group. Spark keeps k rows per group and task before it shuffles."""
    from pyspark.sql import Window

    window = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("position", F.row_number().over(window)).where(F.col("position") <= k)


def side_by_side(*rows: DataFrame) -> DataFrame:
    """One row with the columns of several one-row tables."""
    stacked = rows[0]
    for row in rows[1:]:
        stacked = stacked.unionByName(row, allowMissingColumns=True)
    return stacked.agg(*[F.first(quoted(c), ignorenulls=True).alias(c) for c in stacked.columns])


ROWS = -1
_SEED = 7


def _hashable(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType.simpleString()
    return quoted(name).cast("string") if "map<" in kind or "variant" in kind else quoted(name)


def digests(df: DataFrame, columns: Sequence[str], rows: bool = False, texts: bool = False) -> DataFrame:
    """Long form of fixed width: (id, h1, h2) for every cell that is not null, ``id`` the place of its
    column in ``columns``. Two hashes of 64 bits stand for the value, whatever its length or type.

    With ``rows``, every row adds one of its own with the id ROWS, in which nulls are equal. With
    ``texts``, ``value`` is the value of a text column.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    none = F.lit(None).cast("string")
    entries = []
    for i, name in enumerate(columns):
        c = _hashable(df, name)
        there = quoted(name).isNotNull()
        entry = [F.lit(i).alias("id"), F.when(there, F.xxhash64(c)).alias("h1"), F.xxhash64(F.lit(_SEED), c).alias("h2")]
        entries.append(F.struct(*entry, *([(quoted(name) if is_text(kinds[name]) else none).alias("value")] if texts else [])))
    if rows:
        parts = [x for name in df.columns for x in (quoted(name).isNull(), _hashable(df, name))]
        entry = [F.lit(ROWS).alias("id"), F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(_SEED), *parts).alias("h2")]
        entries.append(F.struct(*entry, *([none.alias("value")] if texts else [])))
    return df.select(F.inline(F.array(*entries))).where(F.col("h1").isNotNull())


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Number of distinct non-null values per column: (column, distinct_values).

    What is shuffled are digests of 128 bits, so neither the length of the values nor their type
    matters; different values count as one only if both hashes agree.
    """
    names = list(columns or df.columns)
    kinds = digests(df, names).groupBy("id", "h1", "h2").agg(F.lit(1).alias("one"))
    counted = kinds.groupBy("id").agg(F.count(F.lit(1)).alias("distinct_values"))
    return counted.select(F.get(F.array(*map(F.lit, names)), F.col("id")).alias("column"), "distinct_values")
