"""Fit a cleaning plan on a table, then apply it as one narrow chain of projections.

Fitting takes one aggregation over all text columns (plus one over the non-text columns, and one
over the few columns where person names can only be told from codes by their values). The fitted
plan holds one small decision per column; applying it costs the same whatever was found.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from limewash.functions.dates import add_dates
from limewash.functions.headers import clean_headers
from limewash.functions.numbers import add_number_text, to_number, to_whole_number
from limewash.functions.staging import sealed
from limewash.functions.text import int_like_text, null_if_sentinel, sentence_case, title_case, trim
from limewash.operators.detectors import column_evidence, decide, name_value_check
from limewash.operators.melting import is_text, tidy_values
from limewash.operators.rows import drop_null_rows

STEPS = (
    "trim_whitespace",
    "standardize_nulls",
    "normalize_column_names",
    "drop_empty_columns",
    "capitalize_person_names",
    "normalize_int_like_strings",
    "normalize_numeric_strings",
    "normalize_email_like_columns",
    "coerce_mixed_types",
    "drop_empty_rows",
    "remove_duplicates",
)


@dataclass(frozen=True)
class ColumnPlan:
    """What happens to one input column."""

    position: str
    source: str
    name: str
    kept: bool = True
    text: bool = False
    int_like: bool = False
    number_text: bool = False
    email: bool = False
    case: str | None = None
    target: str | None = None
    plain: bool = False
    currency: bool = False
    changes: dict[str, int] = field(default_factory=dict)


@dataclass
class CleanRun:
    """A cleaned table; row counts are known once an action has run on ``df``."""

    df: DataFrame
    plan: CleanPlan
    before: Observation
    filled: Observation
    after: Observation

    def row_counts(self) -> dict[str, int]:
        return {
            "rows_in": self.before.get["n"],
            "rows_filled": self.filled.get["n"],
            "rows_out": self.after.get["n"],
        }

    def steps_applied(self) -> list[str]:
        counts = self.row_counts()
        steps = set(self.plan.steps_applied)
        if counts["rows_filled"] < counts["rows_in"]:
            steps.add("drop_empty_rows")
        if counts["rows_out"] < counts["rows_filled"]:
            steps.add("remove_duplicates")
        return [step for step in STEPS if step in steps]

    def steps_table(self) -> DataFrame:
        """(position from 1, step) of every step that changed something; one row per step."""
        steps = list(enumerate(self.steps_applied(), 1))
        return self.df.sparkSession.createDataFrame(steps, "position int, step string")


@dataclass(frozen=True)
class CleanPlan:
    columns: tuple[ColumnPlan, ...]
    dot3: bool = True

    @property
    def kept(self) -> list[ColumnPlan]:
        return [c for c in self.columns if c.kept]

    @property
    def currency_columns(self) -> list[str]:
        return [c.name for c in self.kept if c.currency]

    @property
    def steps_applied(self) -> list[str]:
        """Steps that change a cell, a name or the set of columns."""
        kept = self.kept
        done = {
            "trim_whitespace": any(c.changes.get("trimmed") for c in self.columns),
            "standardize_nulls": any(c.changes.get("nulled") for c in self.columns),
            "normalize_column_names": any(c.name != c.source for c in self.columns),
            "drop_empty_columns": len(kept) < len(self.columns),
            "capitalize_person_names": any(c.case for c in kept),
            "normalize_int_like_strings": any(c.int_like and c.changes.get("int_like_changed") for c in kept),
            "normalize_numeric_strings": any(c.number_text and c.changes.get("rewritten") for c in kept),
            "normalize_email_like_columns": any(c.email and c.changes.get("lowered") for c in kept),
            "coerce_mixed_types": any(c.target for c in kept),
        }
        return [step for step in STEPS if done.get(step)]

    def decisions(self, spark: SparkSession) -> DataFrame:
        """The plan as a table, one row per input column."""
        rows = [
            (c.source, c.name, c.kept, c.int_like, c.number_text, c.email, c.case, c.target, c.currency)
            for c in self.columns
        ]
        return spark.createDataFrame(
            rows,
            "source string, name string, kept boolean, int_like boolean, number_text boolean, "
            "email boolean, letter_case string, target string, currency boolean",
        )

    def clean_cells(self, df: DataFrame) -> DataFrame:
        """All cell and column work; no shuffle, no row is dropped. Also fits a streaming table."""
        kept = self.kept
        out = df.toDF(*[c.position for c in self.columns]).select(*[c.position for c in kept])
        text = [c for c in kept if c.text]
        if text:
            out = out.withColumns({c.position: trim(F.col(c.position)) for c in text})
            out = out.withColumns(
                {c.position: null_if_sentinel(F.col(c.position), F.col(c.position)) for c in text}
            )
        shaped = {c.position: self._shaped(c) for c in text if c.case or c.int_like}
        if shaped:
            out = out.withColumns(shaped)
        numeric = [c for c in text if c.number_text or (c.target in ("bigint", "double") and not c.plain)]
        out = add_number_text(out, {c.position: F.col(c.position) for c in numeric}, dot3=self.dot3)
        dates = [c for c in text if c.target == "timestamp_ntz"]
        out = add_dates(out, {c.position: F.col(c.position) for c in dates})
        out = sealed(out, {c.position: self._final(c) for c in text})
        return out.select(*[F.col(c.position).alias(c.name) for c in kept])

    def _shaped(self, c: ColumnPlan) -> Column:
        value = F.col(c.position)
        if c.case:
            value = title_case(value) if c.case == "title" else sentence_case(value)
        return int_like_text(value) if c.int_like else value

    def _final(self, c: ColumnPlan) -> Column:
        value = F.col(c.position)
        if c.email and c.target is None:
            return F.lower(value)
        if c.target == "bigint":
            return to_whole_number(value)
        if c.target == "double":
            return to_number(value)
        return value

    def transform(self, df: DataFrame) -> DataFrame:
        """Clean cells, drop empty rows, drop exact duplicates (the only shuffle)."""
        return drop_null_rows(self.clean_cells(df)).dropDuplicates()

    def run(self, df: DataFrame) -> CleanRun:
        """Like ``transform``, counting rows on the way in the same job."""
        before, filled, after = Observation(), Observation(), Observation()
        n = F.count(F.lit(1)).alias("n")
        cells = self.clean_cells(df).observe(before, n)
        rows = drop_null_rows(cells).observe(filled, n)
        return CleanRun(rows.dropDuplicates().observe(after, n), self, before, filled, after)


@dataclass(frozen=True)
class Cleaner:
    """Options of a fit. Every stage can be switched off to run one operator alone."""

    trim_and_nulls: bool = True
    headers: bool = True
    fix_header_spelling: bool = True
    drop_empty: bool = True
    int_like: bool = True
    number_text: bool = True
    email: bool = True
    coerce: bool = True
    lossy_numbers: bool = False
    name_case: str | None = None
    dot3: bool = True

    def fit(self, df: DataFrame) -> CleanPlan:
        names = clean_headers(df.columns, self.fix_header_spelling) if self.headers else df.columns
        fields = df.schema.fields
        table = df.toDF(*[f"c{i}" for i in range(len(fields))])
        text = [f"c{i}" for i, f in enumerate(fields) if is_text(f.dataType)]
        facts = {}
        if text:
            evidence = decide(column_evidence(table, text, dot3=self.dot3), int_like=self.int_like)
            # one row per column
            facts = {r["column"]: r.asDict() for r in evidence.collect()}
        filled = self._filled_columns(table, [c for c in table.columns if c not in facts])
        person = self._person_columns(table, facts)
        columns, seen = [], set()
        for i, name in enumerate(names):
            position = f"c{i}"
            fact = facts.get(position)
            has_values = fact["values_0"] > 0 if fact else position in filled
            kept = not self.drop_empty or (bool(name.strip()) and has_values and name not in seen)
            if kept:
                seen.add(name)
            base = ColumnPlan(position, df.columns[i], name, kept, position in text)
            columns.append(self._column_plan(base, fact, position in person) if fact else base)
        return CleanPlan(tuple(columns), self.dot3)

    def _column_plan(self, base: ColumnPlan, fact: dict, person: bool) -> ColumnPlan:
        structured = fact["is_email"] or fact["is_phone"] or fact["is_ratio"]
        skip = fact["is_date_like"] or fact["is_date"] or structured or person
        target = fact["target"] if self.coerce else None
        if self.lossy_numbers and target is None and not skip and fact["leaning"] == "numeric":
            target = "double" if fact["dots"] or fact["fractions"] else "bigint"
        return replace(
            base,
            int_like=fact["is_int_like"],
            number_text=self.number_text and not skip and not fact["is_plain_number"],
            email=self.email and fact["is_email"],
            case=self.name_case if person else None,
            target=target,
            plain=fact["is_plain_number"],
            currency=fact["is_currency"],
            changes={
                k: fact[k] for k in ("trimmed", "nulled", "int_like_changed", "rewritten", "lowered")
            },
        )

    def _filled_columns(self, table: DataFrame, others: Sequence[str]) -> set[str]:
        if not others or not self.drop_empty:
            return set(others)
        counts = table.agg(*[F.count(c).alias(c) for c in others]).first()
        return {c for c in others if counts[c]}

    def _person_columns(self, table: DataFrame, facts: dict[str, dict]) -> set[str]:
        """Columns of person names; reads values again only where it can change the outcome."""
        sure = {c for c, f in facts.items() if f["name_check"] == "yes"}
        matters = {
            c: f for c, f in facts.items()
            if f["name_check"] == "values" and (self.name_case or (f["rewritten"] and not f["target"]))
        }
        if not matters:
            return sure
        values = tidy_values(table, list(matters))
        if any(f["is_int_like"] for f in matters.values()):
            stripped = [c for c, f in matters.items() if f["is_int_like"]]
            value = F.col("value")
            values = values.withColumn(
                "value", F.when(F.col("column").isin(*stripped), int_like_text(value)).otherwise(value)
            )
        return sure | {r["column"] for r in name_value_check(values).collect() if r["is_person"]}


def clean(df: DataFrame, cleaner: Cleaner | None = None) -> DataFrame:
    """Fit on a table and clean it."""
    return (cleaner or Cleaner()).fit(df).transform(df)
