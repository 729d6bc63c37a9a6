"""Delimited text in and out: separator, width and encoding detection, repair, export."""

from __future__ import annotations

import csv
import io
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limewash.functions import constants as K
from limewash.functions.text import quoted, trim
from limewash.operators.melting import is_numeric, is_temporal
from limewash.sources.records import Batch, cell, records, together, widest


def sniff_separator(first_line: str) -> str:
    """Semicolon or comma, whichever splits the line into more fields; semicolon if neither does."""
    semicolons, commas = first_line.count(";"), first_line.count(",")
    return "," if commas and (not semicolons or commas > semicolons) else ";"


#: Lines among which a header with line breaks ends.
HEADER_LINES = 100


def detect_separator(spark: SparkSession, path: str) -> str:
    """The separator of the header; what stands in quotes, over several lines as well, does not count."""
    lines = [r["value"] for r in spark.read.text(path).head(1)]
    if lines and lines[0].count('"') % 2:
        lines = [r["value"] for r in spark.read.text(path).head(HEADER_LINES)]
    header = ""
    for line in lines:
        header += line + "\n"
        if header.count('"') % 2 == 0:
            break
    return sniff_separator(re.sub('"[^"]*"', "", header))


def header_names(line: str, sep: str) -> list[str]:
    """Names of the header record: unnamed fields numbered, repeated names suffixed."""
    names: list[str] = []
    for i, raw in enumerate(next(csv.reader(io.StringIO(line.rstrip("\r\n"), newline=""), delimiter=sep), [])):
        name = raw.strip() or f"Unnamed: {i}"
        base, n = name, 0
        while name in names:
            n += 1
            name = f"{base}.{n}"
        names.append(name)
    return names


def read_records(spark: SparkSession, path: str, sep: str | None = None, latin1: bool = True) -> DataFrame:
    """(file, fields, line, cells, rejected): every record of all files, as one parse sees it.

    ``line`` is the record as it stands in the file, ``fields`` the number of its fields and ``cells``
    their values. ``rejected`` says that it has more fields than the header in a file that is not
    parted by commas. What ``load_csv`` returns and the rejected records add up to this table.
    """
    sep = sep or detect_separator(spark, path)
    parts = []
    for batch, df in records(spark, path, sep, latin1):
        width = len(header_names(batch.header, sep))
        parts.append(df.select(
            "file", F.size("fields").alias("fields"), F.col("record").alias("line"), F.transform("fields", cell).alias("cells"),
            (F.lit(sep != ",") & (F.size("fields") > width)).alias("rejected"),
        ))
    return together(parts) if parts else spark.createDataFrame([], "file string, fields int, line string, cells array<string>, rejected boolean")


def load_csv(spark: SparkSession, path: str, sep: str | None = None, latin1: bool = True) -> tuple[DataFrame, str]:
    """All columns as text; null-like words are kept, blank cells are null.

    Records that are too short are padded. Records that are too long widen a comma file, where a
    thousands comma is then repaired; in any other file they are left out, and ``rejected_lines``
    returns them. A file that is not UTF-8 is read as Latin-1, or with ``latin1=False`` as UTF-8 with
    replacement characters; other files of the folder are not affected. Files may order their columns
    differently or lack some. The number of jobs does not depend on the width; see ``records`` for
    quotes and for records of several lines.
    """
    sep = sep or detect_separator(spark, path)
    parts = [_table(batch, df, sep) for batch, df in records(spark, path, sep, latin1)]
    return together(parts) if parts else spark.createDataFrame([], "`Unnamed: 0` string"), sep


def _table(batch: Batch, df: DataFrame, sep: str) -> DataFrame:
    names = header_names(batch.header, sep)
    if sep != ",":
        return df.where(F.size("fields") <= len(names)).select(_cells(names))
    extra = [f"Unnamed_{i}" for i in range(widest(batch, df) - len(names))]
    return repair_thousands(df.select(_cells(names + extra)), len(names))


def _cells(names: list[str]) -> list[Column]:
    return [cell(F.get("fields", F.lit(i))).alias(name) for i, name in enumerate(names)]


def rejected_lines(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """(file, fields, line) of the records that ``load_csv`` leaves out, line breaks included."""
    return read_records(spark, path, sep).where("rejected").select("file", "fields", "line")


def repair_thousands(df: DataFrame, width: int) -> DataFrame:
    """Rejoin numbers that a thousands comma split (``1,000``) in rows that really are too long.

    One pass counts, for every pair of neighbours, the long rows where it looks like a split number.
    A row is then joined at as many of its pairs as it has fields too many, the pairs that explain
    most rows first, and the rest of it moves left. Columns left empty are dropped; what no pair
    explains is kept.
    """
    names = df.columns
    if len(names) <= max(width, 1):
        return df
    fields = F.array(*[trim(quoted(c)) for c in names])
    used = F.array_max(F.transform(fields, lambda x, i: F.when(x.isNotNull() & (x != ""), i + 1).otherwise(0)))
    rows = df.withColumns({"__f": F.array(*[quoted(c) for c in names]), "__t": fields, "__n": F.greatest(used - width, F.lit(0))})
    pair = lambda i: F.get("__t", i).rlike(r"^\d{1,3}$") & F.get("__t", i + 1).rlike(r"^\d{3}$")
    places = F.filter(F.sequence(F.lit(0), F.lit(len(names) - 2)), lambda i: F.coalesce(pair(i), F.lit(False)))
    rows = rows.withColumn("__p", F.when(F.col("__n") > 0, places).otherwise(F.array().cast("array<int>")))
    left_over = F.when(F.col("__n") > F.size("__p"), F.col("__n") - F.size("__p")).otherwise(0)
    tally = (
        rows.where("__n > 0").select(F.explode(F.concat(F.array(-1 - left_over), F.col("__p"))).alias("at"))
        .groupBy("at").agg(F.count(F.lit(1)).alias("n")).collect()
    )
    kept = len(names) if any(r["at"] < -1 for r in tally) else width
    order = [r["at"] for r in sorted((r for r in tally if r["at"] >= 0), key=lambda r: (-r["n"], r["at"]))]
    if order:
        best = F.filter(F.array(*[F.lit(i) for i in order]), lambda i: F.array_contains("__p", i))
        rows = rows.withColumn("__m", F.slice(best, 1, F.col("__n")))
        joins = F.transform("__f", lambda x, i: F.struct(x.alias("x"), F.array_contains("__m", i - 1).alias("on")))
        empty = F.array().cast("array<string>")
        merged = F.aggregate(
            joins, empty,
            lambda done, s: F.when(
                s["on"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(trim(F.element_at(done, -1)), trim(s["x"]))))
            ).otherwise(F.concat(done, F.array(s["x"]))),
        )
        rows = rows.withColumn("__f", F.when(F.size("__m") > 0, merged).otherwise(F.col("__f")))
    done = rows.select(*[F.get("__f", F.lit(i)).alias(c) for i, c in enumerate(names[:kept])])
    if kept > width:  # how far the rows that stay too long reach
        filled = [F.max(F.when(F.coalesce(trim(quoted(names[i])), F.lit("")) != "", i + 1)) for i in range(width, kept)]
        kept = max([width, *[n for n in done.agg(*[c.alias(f"c{i}") for i, c in enumerate(filled)]).first() if n]])
    return done.select(*[quoted(c) for c in names[:kept]])


def export_format(df: DataFrame) -> DataFrame:
    """Dates and timestamps as ``yyyy-MM-dd`` text, blank where missing; the rest unchanged."""
    return df.select(*[
        F.coalesce(F.date_format(quoted(f.name), "yyyy-MM-dd"), F.lit("")).alias(f.name)
        if is_temporal(f.dataType) else quoted(f.name)
        for f in df.schema
    ])


def save_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """Write with a header; one file per partition, in a folder. White space around values is kept."""
    writer = df.write.option("header", True).option("sep", sep).option("escape", '"').option("emptyValue", "")
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def preview(df: DataFrame, currency: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """Rows as display text: whole dollars for currency, blanks for missing values. All rows, or
    ``rows`` of them (a screen shows ``PREVIEW_ROWS``; which ones is up to Spark)."""
    shown = []
    for f in df.schema:
        c = quoted(f.name)
        if f.name in (currency or []) and is_numeric(f.dataType):
            text = F.concat(F.lit("$"), F.format_number(c, 0))
        else:
            text = c.cast("string")
        blank = F.lower(trim(text)).isin(*K.PREVIEW_BLANKS)
        shown.append(F.when(~blank, text).otherwise("").alias(f.name))
    return (df if rows is None else df.limit(rows)).select(*shown)


