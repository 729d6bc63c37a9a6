"""A fitted plan on a stream. The cell work is a narrow projection, so it needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from limewash.operators.rows import drop_null_rows
from limewash.plans.cleaner import CleanPlan


def clean_stream(plan: CleanPlan, stream: DataFrame) -> DataFrame:
    """Clean the cells and drop empty rows of a streaming table with a plan fitted on a batch."""
    return drop_null_rows(plan.clean_cells(stream))


def clean_stream_distinct(plan: CleanPlan, stream: DataFrame, event_time: str, delay: str) -> DataFrame:
    """Also drop exact duplicates that arrive within ``delay`` of each other."""
    rows = clean_stream(plan, stream).withWatermark(event_time, delay)
    return rows.dropDuplicatesWithinWatermark(rows.columns)
