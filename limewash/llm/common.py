"""Helpers that several operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from limewash.session import materialise


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str) -> str:
    """A column name that no table of a caller has."""
    return f"__{name}_{uuid.uuid4().hex[:8]}"


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame, group: str, out: str, slices: int = 1024, chunk: int = 10_000) -> DataFrame:
    """Add ``out``: positions 0, 1, 2, ... without gaps within each value of ``group``.

    Equal rows are first counted (so a row that fills a third of the table is one row per task),
    distinct rows are dealt to ``slices`` per group by a hash of all their columns, and a slice is
    ranked on its own. Sums over the small table of slice sizes give each slice its first position.
    So no task sees a whole group, whatever its share of the rows is, and the positions depend on
    nothing but the rows. ``group`` must not be null; columns must be of types that can be grouped.
    """
    names = df.columns
    cut, hashed, n, first, off, of, at = (fresh(x) for x in ("slice", "hash", "n", "first", "off", "of", "at"))
    kinds = materialise(
        df.groupBy(*[col(c) for c in names]).agg(F.count(F.lit(1)).alias(n))
        .withColumn(hashed, F.xxhash64(*[col(c) for c in names])).withColumn(cut, F.pmod(col(hashed), F.lit(slices)).cast("int")),
        "numbered",
    )
    sizes = kinds.groupBy(col(group).alias(of), col(cut).alias(at)).agg(F.sum(n).alias(n))
    before = Window.partitionBy(of).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(of, at, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))
    earlier = Window.partitionBy(of, at).orderBy(hashed, *[col(c) for c in names]).rowsBetween(Window.unboundedPreceding, -1)
    placed = kinds.join(firsts, (col(group) == col(of)) & (col(cut) == col(at))).withColumn(
        first, col(first) + F.coalesce(F.sum(n).over(earlier), F.lit(0))
    )
    pieces = placed.withColumn(off, F.explode(F.sequence(F.lit(0).cast("long"), col(n) - 1, F.lit(chunk).cast("long"))))
    places = F.sequence(col(first) + col(off), col(first) + F.least(col(off) + chunk, col(n)) - 1)
    return pieces.select(*[col(c) for c in names], F.explode(places).alias(out))
