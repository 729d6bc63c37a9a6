"""The report of a run as one nested row, and its JSON form."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limewash.operators.melting import side_by_side
from limewash.operators.profiling import Profile

ACTION_SCHEMA = "action string, column string, rows_removed bigint, safe boolean"


@dataclass
class Shape:
    rows: int
    columns: int


def profile_row(profile: Profile) -> DataFrame:
    """A profile as one row. The arrays hold one entry per column or correlated pair."""
    columns = profile.column_profiles.agg(
        F.sort_array(F.collect_list(F.struct(*profile.column_profiles.columns))).alias("column_profiles")
    )
    pairs = profile.redundant_pairs.agg(
        F.sort_array(F.collect_list(F.struct("col_a", "col_b", "correlation"))).alias("redundant_pairs")
    )
    return side_by_side(profile.summary(), columns, pairs)


def profile_json(profile: Profile) -> DataFrame:
    return profile_row(profile).select(F.to_json(F.struct("*")).alias("profile"))


def build_report(
    before: Profile,
    after: Profile | None,
    actions: list[dict],
    shape_before: Shape,
    shape_after: Shape,
    issues: DataFrame,
    quality: DataFrame,
    input_path: str | None = None,
    output_path: str | None = None,
) -> DataFrame:
    """One row: summary, both profiles, actions, issues and quality."""
    spark = issues.sparkSession
    log = spark.createDataFrame(
        [(a["action"], a.get("column"), a.get("rows_removed"), a.get("safe")) for a in actions], ACTION_SCHEMA
    ).agg(F.collect_list(F.struct("action", "column", "rows_removed", "safe")).alias("actions"))
    found = issues.agg(
        F.sort_array(F.collect_list(F.struct("ordinal", "id", "category", "severity", "title", "message", "column")))
        .alias("issues")
    )
    score = quality.select(F.struct("*").alias("quality"))
    first = profile_row(before).select(F.struct("*").alias("profile_before"))
    second = profile_row(after or before).select(F.struct("*").alias("profile_after"))
    joined = side_by_side(first, second, log, found, score)
    summary = F.struct(
        F.lit(shape_before.rows).alias("rows_before"),
        F.lit(shape_after.rows).alias("rows_after"),
        F.lit(shape_before.columns).alias("columns_before"),
        F.lit(shape_after.columns).alias("columns_after"),
        F.lit(before.duplicate_rows).alias("duplicate_rows_before"),
        F.size("actions").alias("actions_count"),
        F.size("issues").alias("issues_count"),
        F.col("quality.score").alias("quality_score"),
        F.lit(input_path).alias("input_path"),
        F.lit(output_path).alias("output_path"),
    )
    return joined.select(
        summary.alias("summary"), "profile_before", "profile_after", "actions", "issues", "quality"
    )


def write_report(report: DataFrame, path: str) -> None:
    report.write.json(path)
