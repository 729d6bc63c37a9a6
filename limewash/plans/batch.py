"""A whole run: load, clean, profile, fix, profile again, find issues, score, save, report."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from limewash.operators.actions import automatic_rules
from limewash.operators.issues import detect_issues, quality_score
from limewash.operators.profiling import Profile, profile_dataset
from limewash.plans.cleaner import Cleaner, CleanPlan
from limewash.session import materialise
from limewash.sources.delimited import export_format, load_csv, save_csv
from limewash.sources.report import Shape, build_report, write_report


@dataclass
class RunResult:
    cleaned: DataFrame
    profile_before: Profile
    profile_after: Profile
    issues: DataFrame
    quality: DataFrame
    actions: list[dict] = field(default_factory=list)
    plan: CleanPlan | None = None
    report: DataFrame | None = None

    @property
    def currency_columns(self) -> list[str]:
        return self.plan.currency_columns if self.plan else []


def run(
    spark: SparkSession,
    input_path: str,
    output_path: str,
    report_path: str | None = None,
    cleaner: Cleaner | None = None,
) -> RunResult:
    """Batch run over files; writes the cleaned table and, if asked, the report.

    The cleaned table is written once to shared storage, because profiling reads it several times.
    """
    raw, sep = load_csv(spark, input_path)
    plan = (cleaner or Cleaner()).fit(raw)
    cleaned = materialise(plan.transform(raw), "cleaned")
    before = profile_dataset(cleaned)
    fixed, actions = automatic_rules(cleaned)
    after = profile_dataset(fixed) if actions else before
    issues = detect_issues(before)
    quality = quality_score(before, issues, after)
    save_csv(export_format(fixed), output_path, sep)
    report = build_report(
        before, after, actions, Shape(before.rows, before.columns), Shape(after.rows, after.columns),
        issues, quality, input_path, output_path,
    )
    if report_path:
        write_report(report, report_path)
    return RunResult(fixed, before, after, issues, quality, actions, plan, report)


def analyse(df: DataFrame, standard_clean: bool = True, cleaner: Cleaner | None = None) -> RunResult:
    """Interactive run over a table: issues come from the cleaned table, no automatic rules."""
    plan = (cleaner or Cleaner()).fit(df) if standard_clean else None
    table = materialise(plan.transform(df), "cleaned") if plan else df
    profile = profile_dataset(table)
    issues = detect_issues(profile)
    return RunResult(table, profile, profile, issues, quality_score(profile, issues), [], plan)


def rescore(result: RunResult, table: DataFrame) -> RunResult:
    """The result after a fix: new profile and score; the list of issues is left as it was."""
    after = profile_dataset(table)
    quality = quality_score(result.profile_before, result.issues, after)
    return RunResult(
        table, result.profile_before, after, result.issues, quality, result.actions, result.plan
    )
