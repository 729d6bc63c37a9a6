"""Approved actions, automatic rules and recommended fixes; logs are tables too."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from limewash.functions.dates import add_dates
from limewash.functions.numbers import to_loose_number
from limewash.functions.text import quoted, title_case, trim
from limewash.operators.detectors import parse_type, type_evidence
from limewash.operators.melting import is_numeric, is_temporal, is_text, text_columns, value_frequencies
from limewash.session import materialise

BROADCAST_ROWS = 50_000
SALTS = 16
LOG_SCHEMA = """
    step int, action string, column string, rows_removed bigint, filled_count bigint, value string,
    target_type string, source string, error string
"""


@dataclass(frozen=True)
class Action:
    issue_id: str
    kind: str
    column: str | None = None
    params: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Fix:
    """A recommended fix as it was approved."""

    action: str
    column: str | None = None
    params: Mapping[str, Any] = field(default_factory=dict)


def replace_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.select(*[value.alias(c) if c == name else quoted(c) for c in df.columns])


def drop_missing(df: DataFrame, column: str) -> DataFrame:
    return df.where(quoted(column).isNotNull())


def drop_column(df: DataFrame, column: str) -> DataFrame:
    return df.select(*[quoted(c) for c in df.columns if c != column])


def fill_missing(df: DataFrame, column: str, value: Any) -> DataFrame:
    kind = df.schema[column].dataType
    return replace_column(df, column, F.coalesce(quoted(column), F.lit(value).try_cast(kind)))


def cast_column(df: DataFrame, column: str, target: str) -> DataFrame:
    """Cast to numeric, datetime or (any other name) string; what does not parse becomes null."""
    kind = df.schema[column].dataType
    value = quoted(column)
    if target == "numeric":
        if is_numeric(kind):
            return df
        return replace_column(df, column, to_loose_number(value) if is_text(kind) else value.try_cast("double"))
    if target == "datetime":
        if is_temporal(kind):
            return df
        return add_dates(df, {column: value.cast("string")})
    return replace_column(df, column, value.cast("string"))


def apply_actions(df: DataFrame, actions: Iterable[Action]) -> tuple[DataFrame, DataFrame]:
    """Apply actions in order; returns the new table and a log with one row per action.

    The table is read once, whatever the number of actions: rows that an action removes stay in the
    chain with the number of that action, cells it fills are marked, and equal rows merge into one that
    carries their number. The chain runs into a stored table, from which the new table and the
    counts of the log are read. Without any action to count nothing runs.
    """
    tag = f"__{uuid.uuid4().hex[:8]}"
    gone, copies = f"{tag}_gone", f"{tag}_copies"
    out = df.withColumns({gone: F.lit(None).cast("int"), copies: F.lit(1).cast("bigint")})
    counts: dict[int, tuple[str, Column]] = {}
    notes: list[dict] = []
    for step, action in enumerate(actions):
        column = action.column or action.params.get("column")
        names = [c for c in out.columns if not c.startswith(tag)]
        out, count, more = _apply_one(out, names, step, action, column, tag)
        notes.append({"action": action.kind, "column": column, **more})
        if count:
            counts[step] = count
    names = [quoted(c) for c in out.columns if not c.startswith(tag)]
    if counts:
        out = materialise(out, "actions")
        row = out.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"n{step}") for step, (_, c) in counts.items()])
    else:
        row = df.sparkSession.range(1)
    fields = [part.split() for part in LOG_SCHEMA.replace("\n", " ").split(",")]
    entries = []
    for step, note in enumerate(notes):
        entry = {"step": F.lit(step), "source": F.lit("user_approved"), **{k: F.lit(v) for k, v in note.items()}}
        if step in counts:
            entry[counts[step][0]] = F.col(f"n{step}")
        entries.append(F.struct(*[entry.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields]))
    log = row.select(F.inline(F.array(*entries))) if entries else df.sparkSession.createDataFrame([], LOG_SCHEMA)
    return out.where(F.col(gone).isNull()).select(*names), log


# Action kinds and error codes below are fixed values.
def _apply_one(
    df: DataFrame, names: list[str], step: int, action: Action, column: str | None, tag: str
) -> tuple[DataFrame, tuple[str, Column] | None, dict]:
    """The new chain, the entry of the log to count with its addend per row, and fixed entries."""
    gone, copies, mark = F.col(f"{tag}_gone"), F.col(f"{tag}_copies"), f"{tag}_{step}"
    here = gone.isNull()
    if action.kind == "drop_duplicate_rows":
        marks = [c for c in df.columns if c.startswith(f"{tag}_") and c not in (f"{tag}_gone", f"{tag}_copies")]
        merged = df.groupBy(*[quoted(c) for c in names], gone).agg(F.sum(copies).alias(f"{tag}_copies"), *[F.sum(c).alias(c) for c in marks])
        merged = merged.withColumn(mark, F.when(here, copies - 1).otherwise(0))
        return merged.withColumn(f"{tag}_copies", F.when(here, 1).otherwise(copies).cast("bigint")), ("rows_removed", F.col(mark)), {}
    known = ("drop_rows_where_missing", "drop_column", "fillna_constant", "cast_type")
    if action.kind not in known or column is None:
        return df, None, {"error": "unsupported_action"}
    if action.kind == "fillna_constant" and action.params.get("value") is None:
        return df, None, {"error": "missing_value_param"}
    if column not in names:
        return df, None, {"error": "column_not_found"}
    missing = here & quoted(column).isNull()
    if action.kind == "drop_rows_where_missing":
        return df.withColumn(f"{tag}_gone", F.when(missing, step).otherwise(gone)), ("rows_removed", F.when(gone == step, copies)), {}
    if action.kind == "drop_column":
        return drop_column(df, column), None, {}
    if action.kind == "fillna_constant":
        value = action.params["value"]
        usable = F.lit(value).try_cast(df.schema[column].dataType).isNotNull()
        marked = df.withColumn(mark, F.when(missing & usable, copies).otherwise(0))
        return fill_missing(marked, column, value), ("filled_count", F.col(mark)), {"value": str(value)}
    target = action.params.get("target_type", "numeric")
    return cast_column(df, column, target), None, {"target_type": target}


def type_fixes(df: DataFrame, evidence: DataFrame | None = None) -> tuple[DataFrame, list[dict]]:
    """Turn text columns that hold numbers into BIGINT or DOUBLE; returns a log entry per column."""
    text = [f.name for f in df.schema if is_text(f.dataType)]
    if not text:
        return df, []
    judged = (type_evidence(df, text) if evidence is None else evidence).withColumn(
        "kind", parse_type(F.col("numbers"), F.col("dates"), F.col("non_null"), F.lit("text"))
    )
    whole = {
        r["column"]: r["fractions"] == 0
        for r in judged.where((F.col("kind") == "numeric") & (F.col("numbers") > 0)).collect()
    }
    out, log = [], []
    for f in df.schema:
        c = quoted(f.name)
        if f.name in whole:
            number = to_loose_number(c)
            c = (number.try_cast("bigint") if whole[f.name] else number).alias(f.name)
            log.append({"action": "coerce_numeric", "column": f.name, "safe": True})
        out.append(c)
    return df.select(*out), log


def automatic_rules(df: DataFrame) -> tuple[DataFrame, list[dict]]:
    """Type fixes, then exact duplicates; the log names each change. Equal rows merge in one shuffle and
    carry their number into the stored result, from which it is read."""
    fixed, log = type_fixes(df)
    copies = f"__copies_{uuid.uuid4().hex[:8]}"
    merged = materialise(fixed.groupBy(*[quoted(c) for c in fixed.columns]).agg(F.count(F.lit(1)).alias(copies)), "distinct")
    removed = merged.agg(F.coalesce(F.sum(F.col(copies) - 1), F.lit(0))).first()[0]
    if removed:
        log.append({"action": "remove_duplicates", "rows_removed": removed, "safe": True})
    return merged.drop(copies), log


def mapped(value: Column, mappings: Mapping[str, Any]) -> Column:
    """A text with whole values replaced by a dictionary."""
    if not mappings:
        return value
    texts = {str(k): None if v is None else str(v) for k, v in mappings.items()}
    lookup = F.create_map(*[F.lit(x).cast("string") for kv in texts.items() for x in kv])
    return F.when(F.map_contains_key(lookup, value), F.try_element_at(lookup, value)).otherwise(value)


def map_values(df: DataFrame, column: str, mappings: Mapping[str, Any] | DataFrame) -> DataFrame:
    """Replace whole values; a mapping to null empties the cell.

    A dictionary is a literal of the plan; of keys that are the same as text the last counts. A table
    (value, replacement) may be of any length; of rows with one value the least replacement counts.
    It is broadcast up to ``BROADCAST_ROWS`` rows; beyond that each row is joined ``SALTS`` times, so
    that a value with a large share of the data is spread over as many tasks.
    """
    value = quoted(column)
    if isinstance(mappings, Mapping):
        if not mappings:
            return df
        return replace_column(df, column, mapped(value.cast("string"), mappings))
    table = mappings.groupBy(F.col("value").cast("string").alias("__value")).agg(
        F.min(F.col("replacement").cast("string")).alias("__replacement"), F.lit(True).alias("__hit")
    ).where("__value IS NOT NULL")
    on = value.cast("string") == F.col("__value")
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        joined = df.join(F.broadcast(table), on, "left")
    else:
        table = table.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = df.withColumn("__salt", (F.monotonically_increasing_id() % SALTS).cast("int"))
        joined = salted.join(table, on & (F.col("__salt") == F.col("__part")), "left")
    new = F.when(F.col("__hit"), F.col("__replacement")).otherwise(value.cast("string"))
    return joined.select(*[new.alias(c) if c == column else quoted(c) for c in df.columns])


def safe_coerce(df: DataFrame, column: str) -> DataFrame:
    """Turn text into dates, else numbers, if not a single value would be lost."""
    if not is_text(df.schema[column].dataType):
        return df
    e = type_evidence(df, [column]).first()
    return _coerced(df, column, _lossless(e))


def _lossless(evidence: Row | None) -> str | None:
    if evidence is None or not evidence["non_null"]:
        return None
    if evidence["dates"] == evidence["non_null"]:
        return "datetime"
    return "numeric" if evidence["numbers"] == evidence["non_null"] else None


def _coerced(df: DataFrame, column: str, target: str | None) -> DataFrame:
    return cast_column(df, column, target) if target else df


def fallback_types(df: DataFrame) -> DataFrame:
    """(column, target_type): numeric, datetime or string for every column, from one pass over its values."""
    fixed = [(f.name, "numeric" if is_numeric(f.dataType) else "datetime") for f in df.schema if is_numeric(f.dataType) or is_temporal(f.dataType)]
    open_ = [f.name for f in df.schema if f.name not in dict(fixed)]
    out = df.sparkSession.createDataFrame(fixed, "column string, target_type string")
    if not open_:
        return out
    judged = type_evidence(df, open_).select("column", parse_type(F.col("numbers"), F.col("dates"), F.col("non_null"), F.lit("string")).alias("target_type"))
    return out.unionByName(judged)


def fallback_type(df: DataFrame, column: str) -> str:
    """The target type of one column; see ``fallback_types``."""
    judged = fallback_types(df.select(quoted(column))).first()
    return judged["target_type"] if judged else "string"


def apply_fix(df: DataFrame, fix: Fix) -> DataFrame:
    """Apply one recommendation; actions without effect return the table as it is."""
    return apply_fixes(df, [fix])


def replay_fixes(base: DataFrame, fixes: Mapping[str, Fix], issue_order: Iterable[str]) -> DataFrame:
    """Apply the approved fixes to the base table in issue order; undo is a replay without one."""
    return apply_fixes(base, [fixes[i] for i in issue_order if i in fixes])


def apply_fixes(df: DataFrame, fixes: Sequence[Fix]) -> DataFrame:
    """Apply recommendations in order.

    Some depend on the values at that point: text becomes a date or a number only if no value is lost,
    and a type that is not named is judged from the values. All of these are judged in one job, over how
    often each value of the columns in question occurs, with the fixes before applied to the values.
    (Only a column that was typed by one fix and made text again by a later one is looked at anew.)
    """
    evidence = _judge(df, fixes)
    out = df
    typed: set[str] = set()
    for i, fix in enumerate(fixes):
        column, params = fix.column, fix.params or {}
        if not column or column not in out.columns:
            continue
        known = evidence.get(i) if column not in typed else None
        if fix.action == "normalize_values":
            out = map_values(out, column, params.get("mappings") or {})
            out = _coerced(out, column, _lossless(known)) if known else safe_coerce(out, column)
        elif fix.action == "coerce_type":
            out = cast_column(out, column, params.get("target_type") or (known["kind"] if known else fallback_type(out, column)))
        elif fix.action == "title_case":
            out = replace_column(out, column, title_case(trim(quoted(column).cast("string"))))
        if not is_text(out.schema[column].dataType) or params.get("target_type"):
            typed.add(column)
    return out


def _judge(df: DataFrame, fixes: Sequence[Fix]) -> dict[int, Row]:
    """Evidence of types at every fix that needs it, by its place, for columns that were text all along."""
    texts = set(text_columns(df))
    probes, tables = [], []
    for i, fix in enumerate(fixes):
        needs = fix.action == "normalize_values" or (fix.action == "coerce_type" and not (fix.params or {}).get("target_type"))
        if not needs or fix.column not in texts:
            continue
        before = [f for f in fixes[: i + 1] if f.column == fix.column and f.action in ("normalize_values", "title_case")]
        joined = any(isinstance((f.params or {}).get("mappings"), DataFrame) for f in before)
        (tables if joined else probes).append((i, fix.column, before))
    if not probes and not tables:
        return {}
    freq = value_frequencies(df, sorted({c for _, c, _ in [*probes, *tables]}))
    parts = []
    if probes:
        entries = []
        for i, column, before in probes:
            value = F.col("value")
            for f in before:
                value = mapped(value, (f.params or {}).get("mappings") or {}) if f.action == "normalize_values" else title_case(trim(value))
            entries.append(F.when(F.col("column") == column, F.struct(F.lit(i).alias("fix"), value.alias("value"), F.col("n"))))
        parts.append(freq.select(F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull()))))
    for i, column, before in tables:
        own = freq.where(F.col("column") == column).select(F.lit(i).alias("fix"), "value", "n")
        for f in before:
            own = map_values(own, "value", (f.params or {}).get("mappings") or {}) if f.action == "normalize_values" else replace_column(own, "value", title_case(trim(F.col("value"))))
        parts.append(own)
    cells = parts[0]
    for part in parts[1:]:
        cells = cells.unionByName(part)
    cells = add_dates(cells.where(F.col("value").isNotNull()), {"as_date": F.col("value")})
    n = F.col("n")
    judged = cells.groupBy("fix").agg(
        F.sum(n).alias("non_null"), F.sum(F.when(to_loose_number(F.col("value")).isNotNull(), n).otherwise(0)).alias("numbers"),
        F.sum(F.when(F.col("as_date").isNotNull(), n).otherwise(0)).alias("dates"),
    )
    kind = parse_type(F.col("numbers"), F.col("dates"), F.col("non_null"), F.lit("string"))
    none = Row(fix=None, non_null=0, numbers=0, dates=0, kind="string")
    return {i: none for i, _, _ in [*probes, *tables]} | {r["fix"]: r for r in judged.withColumn("kind", kind).collect()}
