"""Column and data-set profiles: types, missing values, outliers, patterns, redundancy."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from limewash.functions import constants as K
from limewash.functions.dates import add_dates
from limewash.functions.numbers import is_fraction, to_loose_number
from limewash.functions.text import null_if_sentinel, quoted
from limewash.operators.correlation import PAIR_SCHEMA, redundant_pairs
from limewash.operators.detectors import category_or_text, parse_type, type_evidence
from limewash.operators.melting import (
    ROWS, digests, distinct_counts, is_numeric, is_temporal, is_text, melt, numeric_columns, text_columns,
)
from limewash.operators.quantiles import AGGREGATES_PER_JOB, SORTABLE, clean_double, exact_quantiles, grouped, in_chunks
from limewash.session import materialise

PATTERN_KINDS = 80
#: Characters of the longest text that is looked at once per value. No date is longer, and few numbers are.
SHORT = 64

PROFILE_SCHEMA = """
    ordinal int, column string, dtype string, inferred_type string,
    missing_count bigint, missing_pct double, cardinality bigint, non_null_count bigint,
    outliers_iqr struct<lower_bound: double, upper_bound: double, count_below: bigint, count_above: bigint>,
    outliers_zscore struct<z_threshold: double, count: bigint, max_abs_z: double>,
    numeric_but_categorical struct<cardinality: bigint, non_null_count: bigint, unique_ratio: double>,
    missingness_pattern struct<when_column: string, when_value: string, missing_rate_when: double,
        overall_missing_pct: double>
"""


@dataclass
class Profile:
    """A data-set profile: three small tables, none larger than the number of columns or pairs."""

    rows: int
    columns: int
    duplicate_rows: int
    column_profiles: DataFrame
    redundant_pairs: DataFrame

    def summary(self) -> DataFrame:
        return self.column_profiles.sparkSession.createDataFrame(
            [(self.rows, self.columns, self.duplicate_rows)],
            "rows bigint, columns int, duplicate_rows bigint",
        )


def cell_summary(df: DataFrame, evidence: bool = True) -> DataFrame:
    """One read and one job for all that is counted over cells: a row (id, present, distinct_values and,
    with ``evidence``, numbers, dates, fractions) per column with any value, by its place, and one
    with the id ROWS for whole rows. See ``digests``."""
    cells = digests(df, df.columns, rows=True, texts=evidence)
    if not evidence:
        kinds = cells.groupBy("id", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
        return kinds.groupBy("id").agg(F.sum("n").alias("present"), F.count(F.lit(1)).alias("distinct_values"))
    # Every value is judged once, however many cells hold it. What travels with it is short: no longer text
    # is a date, unless by its white space, and whether it is a number is told from the cell.
    value = F.col("value")
    number = to_loose_number(value)
    fraction = is_fraction(F.translate(value, ", ", "")) & number.isNotNull()
    long = F.length(value) > SHORT
    squeezed = F.regexp_replace(value, r"\s+", " ")
    cells = cells.select(
        "id", "h1", "h2", F.when(~long, value).when(long & (F.length(squeezed) <= SHORT), squeezed).alias("value"),
        F.when(long, F.when(fraction, 2).when(number.isNotNull(), 1).otherwise(0)).alias("judged"),
    )
    kinds = cells.groupBy("id", "h1", "h2", "value").agg(F.count(F.lit(1)).alias("n"), F.max("judged").alias("judged"))
    kinds = add_dates(kinds, {"as_date": value})
    judged = F.col("judged")
    signs = {
        "numbers": F.coalesce(judged >= 1, number.isNotNull()), "dates": F.col("as_date").isNotNull(),
        "fractions": F.coalesce(judged == 2, fraction),
    }
    return kinds.groupBy("id").agg(
        F.sum("n").alias("present"), F.count(F.lit(1)).alias("distinct_values"),
        *[F.sum(F.when(sign, F.col("n")).otherwise(0)).alias(name) for name, sign in signs.items()],
    )


def column_counts(df: DataFrame) -> DataFrame:
    """(ordinal, column, dtype, missing_count, missing_pct, cardinality, non_null_count), lazily."""
    spark = df.sparkSession
    names = spark.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)],
        "ordinal int, column string, dtype string",
    )
    # One job: the row of whole rows meets those of the columns over the one window of so few rows.
    counted = names.join(F.broadcast(cell_summary(df, evidence=False)), F.col("ordinal") == F.col("id"), "full")
    cells = F.coalesce(F.max(F.when(F.col("id") == ROWS, F.col("present"))).over(Window.partitionBy(F.lit(0))), F.lit(0))
    present = F.coalesce("present", F.lit(0))
    return counted.select("ordinal", "column", "dtype", cells.alias("cells"), present.alias("present"), "distinct_values").where("ordinal IS NOT NULL").select(
        "ordinal", "column", "dtype",
        (F.col("cells") - F.col("present")).alias("missing_count"),
        F.round(F.try_divide(100.0 * (F.col("cells") - F.col("present")), F.col("cells")), 2).alias("missing_pct"),
        F.coalesce("distinct_values", F.lit(0)).alias("cardinality"),
        F.col("present").alias("non_null_count"),
    )


def _present_cells(df: DataFrame) -> DataFrame:
    """(column, cells, present) from one global aggregate, a row per column."""
    names = df.columns
    counts = [F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(names)]
    row = df.agg(F.count(F.lit(1)).alias("cells"), *counts)
    entries = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("present")) for i, c in enumerate(names)
    ])
    return row.select("cells", F.inline(entries))


def infer_types(df: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """(column, inferred_type): numeric, datetime, categorical or text.

    ``kinds`` are known distinct counts (column, distinct_values), counted here if not given.
    """
    spark = df.sparkSession
    fixed = [
        (f.name, "numeric" if is_numeric(f.dataType) else "datetime")
        for f in df.schema if is_numeric(f.dataType) or is_temporal(f.dataType)
    ]
    typed = spark.createDataFrame(fixed, "column string, inferred_type string")
    open_ = [f.name for f in df.schema if f.name not in dict(fixed)]
    if not open_:
        return typed
    text = [c for c in text_columns(df)]
    other = [c for c in open_ if c not in text]
    evidence = type_evidence(df, text) if text else None
    if other:
        # booleans and nested values are never numbers or dates
        counts = melt(df, other).groupBy("column").agg(
            F.count(F.lit(1)).alias("cells"), F.count("value").alias("non_null"),
            F.lit(0).cast("bigint").alias("numbers"), F.lit(0).cast("bigint").alias("dates"),
            F.lit(0).cast("bigint").alias("fractions"),
        )
        evidence = counts if evidence is None else evidence.unionByName(counts)
    if kinds is None:
        kinds = distinct_counts(df, open_)
    judged = evidence.join(F.broadcast(kinds), "column", "left").withColumn(
        "kinds", F.coalesce("distinct_values", F.lit(0))
    )
    fallback = category_or_text(F.col("non_null"), F.col("kinds"))
    inferred = parse_type(F.col("numbers"), F.col("dates"), F.col("non_null"), fallback)
    return typed.unionByName(judged.select("column", inferred.alias("inferred_type")))


def outlier_stats(
    df: DataFrame, columns: Sequence[str] | None = None, sortable: int = SORTABLE, kinds: Mapping[str, int] | None = None,
) -> list[dict]:
    """IQR and z-score outliers of numeric columns: one dict per column with any value.

    ``kinds`` are bounds of the distinct values of each column, where they are known; columns of few
    values then give their quartiles in the same job as their moments.
    """
    names = list(columns or numeric_columns(df))
    values = df.select(*[clean_double(quoted(c)).alias(f"n{i}") for i, c in enumerate(names)])
    cells = values.columns
    known = {c: kinds.get(n) for c, n in zip(cells, names)} if kinds else dict.fromkeys(cells)
    small = [c for c in cells if known[c] is not None and known[c] <= sortable]
    quarters = {c: F.percentile(F.col(c), [0.25, 0.75]) for c in small}
    guess = {c: F.lit(None) if known[c] is not None else 2 * F.approx_count_distinct(F.col(c)) for c in cells}
    # A job holds as many values for its quartiles as quantiles allows, and as many aggregates.
    stats, quartiles = {}, {}
    for group in grouped(cells, [known[c] if c in quarters else 0 for c in cells], AGGREGATES_PER_JOB // 7):
        part = in_chunks(values, [
            x for c in group for x in (*(agg(F.col(c)) for agg in (F.count, F.avg, F.stddev_pop, F.min, F.max)), guess[c], quarters.get(c, F.lit(None)))
        ])
        for i, c in enumerate(group):
            *stats[c], estimate, quartiles[c] = part[7 * i:7 * i + 7]
            known[c] = estimate if known[c] is None else known[c]
    counts = {c: s[0] for c, s in stats.items()}
    wide = [c for c in cells if c not in quarters]
    # the estimate only decides how the exact quantiles are found
    finite = [c for c in wide if counts[c] and math.isfinite(stats[c][3]) and math.isfinite(stats[c][4])]
    quartiles |= exact_quantiles(values, wide, [0.25, 0.75], counts, known, sortable=sortable, finite=finite) if wide else {}
    filled = [c for c in cells if counts[c]]
    bounds, outside = {}, []
    for c in filled:
        q1, q3 = quartiles[c]
        iqr, (_, mean, spread, _, _) = q3 - q1, stats[c]
        low, high = (q1, q3) if iqr == 0 else (q1 - K.IQR_FACTOR * iqr, q3 + K.IQR_FACTOR * iqr)
        bounds[c] = (low, high)
        v = F.col(c)
        # Spark holds NaN above every number, so bounds and z-scores that are NaN are left out here.
        outside += [
            F.count_if(v < low) if iqr and not math.isnan(low) else F.lit(0),
            F.count_if(v > high) if iqr and not math.isnan(high) else F.lit(0),
            F.count_if(F.abs((v - mean) / spread) > K.Z_THRESHOLD) if _scalable(mean, spread) else F.lit(0),
        ]
    tallies = in_chunks(values, outside) if outside else []
    out = []
    for i, c in enumerate(filled):
        _, mean, spread, least, most = stats[c]
        below, above, far = tallies[3 * i:3 * i + 3]
        out.append({
            "column": names[cells.index(c)],
            "q1": quartiles[c][0], "q3": quartiles[c][1],
            "lower_bound": bounds[c][0], "upper_bound": bounds[c][1],
            "count_below": below, "count_above": above,
            "z_threshold": K.Z_THRESHOLD, "z_count": far,
            "max_abs_z": max(most - mean, mean - least) / spread if _scalable(mean, spread) else 0.0,
        })
    return out


def _scalable(mean: float, spread: float) -> bool:
    """Whether z-scores exist: not with a spread of zero, nor with an infinite value in the column."""
    return math.isfinite(mean) and math.isfinite(spread) and spread > 0


OUTLIER_SCHEMA = """
    column string, q1 double, q3 double, lower_bound double, upper_bound double, count_below bigint,
    count_above bigint, z_threshold double, z_count bigint, max_abs_z double
"""


def outliers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``outlier_stats`` as a table, one row per numeric column."""
    return df.sparkSession.createDataFrame(outlier_stats(df, columns), OUTLIER_SCHEMA)


def missingness_patterns(
    df: DataFrame, columns: Sequence[str] | None = None, others: Sequence[str] | None = None,
    most_kinds: int = PATTERN_KINDS,
) -> DataFrame:
    """For each column with missing values, the value of another column it goes missing with.

    Only columns of at most ``most_kinds`` distinct values are looked at, so the number of groups is bounded by
    the number of columns.
    """
    targets = list(columns or df.columns)
    if others is None:
        few = distinct_counts(df).where(F.col("distinct_values") <= most_kinds)
        others = [r["column"] for r in few.select("column").collect()]
        others = [c for c in df.columns if c in set(others)]
    if not others:
        return df.sparkSession.createDataFrame(
            [], "column string, when_column string, when_value string, missing_rate_when double, "
            "overall_missing_pct double",
        )
    flags = [quoted(c).isNull().cast("int").alias(f"m{i}") for i, c in enumerate(targets)]
    keys = [quoted(c).cast("string").alias(f"k{i}") for i, c in enumerate(others)]
    table = df.select(*flags, *keys)
    marks = [f"m{i}" for i in range(len(targets))]
    segments = table.unpivot(marks, [f"k{i}" for i in range(len(others))], "segment", "value")
    grouped = segments.groupBy("segment", "value").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(m) for m in marks]
    )
    long = grouped.select(
        "segment", "value", "n", F.posexplode(F.array(*marks)).alias("target", "missing")
    )
    # The first other column of every row yields the overall counts; a window over the few groups, so that the table is read once.
    target, first = Window.partitionBy("target"), F.col("segment") == "k0"
    long = long.withColumn("rows", F.sum(F.when(first, F.col("n"))).over(target)).withColumn("total_missing", F.sum(F.when(first, F.col("missing"))).over(target))
    long = long.withColumn("overall", 100.0 * F.col("total_missing") / F.col("rows"))
    wanted = (
        (F.col("total_missing") >= 10) & (F.col("rows") >= 20)
        & (F.round("overall", 2) >= 5.0)
    )
    ordinals = F.substr("segment", F.lit(2)).cast("int")
    own = {i: others.index(c) for i, c in enumerate(targets) if c in others}
    same = reduce(
        lambda a, b: a | b,
        [(F.col("target") == i) & (F.col("other") == j) for i, j in own.items()], F.lit(False),
    )
    rates = (
        long.where(F.col("value").isNotNull() & (F.col("n") >= 10))
        .withColumn("other", ordinals).where(~same)
        .withColumn("rate", 100.0 * F.col("missing") / F.col("n"))
        .where(F.col("rate") > 0)
    )
    found = rates.where(wanted).groupBy("target").agg(
        F.min(F.struct((-F.col("rate")).alias("low"), "other", "value")).alias("best"), F.first("overall").alias("overall")
    ).withColumn("rate", -F.col("best.low"))
    strong = (
        (F.col("rate") >= F.col("overall") * 1.2) & (F.col("rate") >= 20.0)
        & (F.col("rate") - F.col("overall") >= 15.0)
    )
    name_of = lambda names, i: F.element_at(F.array(*map(F.lit, names)), i + 1)
    return found.where(strong).select(
        name_of(targets, F.col("target")).alias("column"),
        name_of(others, F.col("best.other")).alias("when_column"),
        F.col("best.value").alias("when_value"),
        F.round("rate", 1).alias("missing_rate_when"),
        F.round("overall", 1).alias("overall_missing_pct"),
    )


def numeric_view(df: DataFrame, inferred: dict[str, str]) -> DataFrame:
    """The columns that hold numbers, as DOUBLE, including numbers kept as text."""
    picked = []
    for f in df.schema:
        if inferred.get(f.name) == "numeric":
            c = quoted(f.name)
            picked.append((to_loose_number(c) if is_text(f.dataType) else c.cast("double")).alias(f.name))
    return df.select(*picked)


def numeric_codes(counts: DataFrame, inferred: DataFrame) -> DataFrame:
    """Columns that look numeric but are so varied that they may be codes or identifiers."""
    ratio = F.col("cardinality") / F.col("non_null_count")
    return (
        counts.join(F.broadcast(inferred), "column")
        .where((F.col("inferred_type") == "numeric") & (F.col("non_null_count") >= 20))
        .where((ratio > 0.5) & (F.col("cardinality") >= 20))
        .select("column", "cardinality", "non_null_count", F.round(ratio, 3).alias("unique_ratio"))
    )


def profile_dataset(df: DataFrame, most_kinds: int = PATTERN_KINDS) -> Profile:
    """Full profile, from at most five reads of a table whose numeric columns have no more than
    ``SORTABLE`` distinct values: one for all counts and the evidence of types, one for moments and
    quartiles, one for outliers, one for missingness patterns (of columns of up to ``most_kinds``
    values) if any column has gaps, one for pairs. Every job returns at most one row per column (or
    per correlated pair)."""
    spark: SparkSession = df.sparkSession
    found = {r["id"]: r for r in cell_summary(df).collect()}
    whole = found.pop(ROWS, None)
    total = whole["present"] if whole else 0
    counts, inferred = {}, {}
    for i, f in enumerate(df.schema):
        r = found.get(i)
        present, kinds = (r["present"], r["distinct_values"]) if r else (0, 0)
        missing = total - present
        pct = _rounded(100.0 * missing / total, 2) if total else None
        counts[f.name] = {"missing_count": missing, "missing_pct": pct, "cardinality": kinds, "non_null_count": present}
        inferred[f.name] = _type_of(f.dataType, r, present, kinds)
    numbers = numeric_view(df, inferred)
    spread = {s["column"]: s for s in outlier_stats(numbers, kinds={c: counts[c]["cardinality"] for c in numbers.columns})} if numbers.columns else {}
    gappy = [c for c in df.columns if (counts[c]["missing_pct"] or 0) >= 5.0 and counts[c]["missing_count"] >= 10]
    others = [c for c in df.columns if counts[c]["cardinality"] <= most_kinds]
    patterns = {}
    if gappy and others:
        patterns = {r["column"]: r for r in missingness_patterns(df, gappy, others).collect()}
    rows = []
    for i, f in enumerate(df.schema):
        n, s, p = counts[f.name], spread.get(f.name), patterns.get(f.name)
        filled, kinds = n["non_null_count"], n["cardinality"]
        codes = (
            inferred[f.name] == "numeric" and filled >= 20 and kinds >= 20 and kinds / filled > 0.5
        )
        rows.append((
            i, f.name, f.dataType.simpleString(), inferred[f.name],
            n["missing_count"], n["missing_pct"], kinds, filled,
            s and (s["lower_bound"], s["upper_bound"], s["count_below"], s["count_above"]),
            s and (s["z_threshold"], s["z_count"], s["max_abs_z"]),
            (kinds, filled, round(kinds / filled, 3)) if codes else None,
            p and (p["when_column"], p["when_value"], p["missing_rate_when"], p["overall_missing_pct"]),
        ))
    return Profile(
        rows=total,
        columns=len(df.columns),
        duplicate_rows=total - (whole["distinct_values"] if whole else 0),
        column_profiles=spark.createDataFrame(rows, PROFILE_SCHEMA),
        redundant_pairs=materialise(redundant_pairs(df), "pairs") if len(numeric_columns(df)) > 1 else spark.createDataFrame([], PAIR_SCHEMA),
    )


def _rounded(value: float, digits: int) -> float:
    """Half up, as Spark rounds."""
    return float(Decimal(repr(value)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def _type_of(kind: DataType, evidence: Row | None, present: int, kinds: int) -> str:
    """The high-level type of a column, as ``infer_types`` has it."""
    if is_numeric(kind):
        return "numeric"
    if is_temporal(kind):
        return "datetime"
    if present and is_text(kind):
        if evidence["numbers"] / present >= K.NUMERIC_SHARE:
            return "numeric"
        if evidence["dates"] / present >= K.DATE_SHARE:
            return "datetime"
    return "categorical" if present >= 10 and kinds <= min(50, present // 2) else "text"


def schema_table(df: DataFrame) -> DataFrame:
    """(column, dtype, non_null, missing_pct) with null-like text counted as missing."""
    view = df.select(*[
        (null_if_sentinel(quoted(f.name)) if is_text(f.dataType) else quoted(f.name)).alias(f.name)
        for f in df.schema
    ])
    names = df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)],
        "ordinal int, column string, dtype string",
    )
    missing = F.col("cells") - F.col("present")
    return names.join(F.broadcast(_present_cells(view)), "column").select(
        "column", "dtype", F.col("present").alias("non_null"),
        F.round(100.0 * missing / F.col("cells"), 1).alias("missing_pct"),
    )


def cleaning_summary(
    before: DataFrame, after: DataFrame, rows_before: int, rows_after: int
) -> list[str]:
    """What cleaning did to the shape and the types, in a few words per change."""
    lines = []
    if rows_after != rows_before:
        lines.append(f"rows {rows_before} -> {rows_after}")
    if len(after.columns) != len(before.columns):
        lines.append(f"columns {len(before.columns)} -> {len(after.columns)}")
    gone = [c for c in before.columns if c not in after.columns]
    if gone:
        lines.append(f"dropped {len(gone)} empty column(s)")
    old = dict(before.dtypes)
    changed = [f"{c}: {old[c]}->{t}" for c, t in after.dtypes if c in old and old[c] != t]
    if changed:
        lines.append("types changed in " + ", ".join(changed))
    return lines
