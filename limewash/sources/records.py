"""Records and fields of delimited text, also where quoted fields hold line breaks.

A quote opens a quoted field only where the field starts; two quotes in a row inside are one. What
follows the closing quote, up to the separator, belongs to the field. A record ends at a line break
outside quotes. Counting fields and reading them is the same expression, so that every record has one
width, and what is loaded and what is rejected add up to all records.

A file whose records all end with their lines is read by lines, without Python code. In any other file
each split is cut into records once, for both cases (it begins outside or inside quotes), and tells where
it ends up. The pieces are held on disk with the split they come from. Put together in the order of the splits, the
ends tell how each of them begins, and so which of its pieces hold; only a record that crosses from one split
to another is put together from its pieces.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from limewash.functions.staging import sealed
from limewash.functions.text import trim
from limewash.session import hold

#: A separator no text has, for reading whole lines.
NEVER = "\x01"


def _escaped(sep: str) -> str:
    return re.escape(sep)


def raw_fields(record: Column, sep: str) -> Column:
    """The fields of a record as they stand there, quotes included."""
    s = _escaped(sep)
    pattern = f'{s}((?:"[^"]*+")*+(?:"[^"]*+\\z|[^{s}]*+))'
    quoted = F.regexp_extract_all(F.concat(F.lit(sep), record), F.lit(pattern), F.lit(1))
    return F.when(F.contains(record, F.lit('"')), quoted).otherwise(F.split(record, s, -1))


def width_of(record: Column, sep: str) -> Column:
    """The number of fields of a record."""
    plain = F.length(record) - F.length(F.replace(record, F.lit(sep))) + 1
    return F.when(F.contains(record, F.lit('"')), F.size(raw_fields(record, sep))).otherwise(plain)


def goes_on(line: Column, sep: str) -> Column:
    """Whether a line that begins a record ends inside quotes."""
    last = F.element_at(raw_fields(line, sep), -1)
    return F.when(F.contains(line, F.lit('"')), last.rlike('^(?:"[^"]*+")*+"[^"]*+\\z')).otherwise(F.lit(False))


def cell(raw: Column) -> Column:
    """The value of a field: without its quotes, null if it is empty and has none."""
    whole = F.replace(F.substring(raw, F.lit(2), F.length(raw) - 2), F.lit('""'), F.lit('"'))
    parts = F.regexp_replace(F.replace(raw, F.lit('""'), F.lit("\x00")), '^"([^"]*+)"?', "$1")
    quoted = F.when(raw.rlike('^(?:"[^"]*+")++\\z'), whole).otherwise(F.replace(parts, F.lit("\x00"), F.lit('"')))
    return F.when(raw == "", None).when(raw.startswith('"'), quoted).otherwise(raw)


@dataclass
class Batch:
    """Files with one header and one encoding; ``broken`` if records go on behind a line break."""

    header: str
    utf8: bool
    broken: bool
    files: list[str]
    width: int  # of the widest line; 0 for broken files
    inside: dict[str, set[int]] = field(default_factory=dict)  # splits that begin inside quotes
    ends: dict[str, set[int]] = field(default_factory=dict)  # splits that end inside quotes
    cut: DataFrame | None = None  # the pieces of all broken files


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line")
    )


def _text(line: bytes, utf8: bool) -> str:
    return line.decode("utf-8", "replace") if utf8 else line.decode("latin-1")


def survey(spark: SparkSession, path: str, sep: str, latin1: bool = True) -> list[Batch]:
    """What the files under a path look like: one pass over their lines without Python code, and one
    more over files with records of several lines, which holds their pieces. One row per file comes to the driver, and for
    files of the second kind one per split, as Spark itself holds them to plan a scan."""
    lines = _lines(spark, path)
    lines = lines.withColumns({
        "at": F.struct("block", F.monotonically_increasing_id()), "valid": F.is_valid_utf8("line"),
        "width": width_of(F.col("line"), sep), "on": goes_on(F.col("line"), sep),
    })
    files = lines.groupBy("file").agg(
        F.min_by(F.col("line").cast("binary"), "at").alias("header"), F.bool_and("valid").alias("utf8"), F.bool_or("on").alias("broken"), F.max("width").alias("width")
    ).collect()
    broken = sorted(r.file for r in files if r.broken)
    splits, cut = {name: [] for name in broken}, None
    if broken:
        # Held, because another read may cut the files otherwise: by its files, and by the cores there are by then.
        lines = _lines(spark, path if len(broken) == len(files) else broken).select("file", "block", F.col("line").cast("binary").alias("line"))
        cut = hold(lines.mapInArrow(_cut(sep), CUT))
        for r in cut.where(F.col("kind") == SPLIT).collect():
            splits[r.file].append((r.block, r.outside, r.inside, r.record))
    batches: dict[tuple, Batch] = {}
    for r in sorted(files, key=lambda r: r.file):
        utf8 = r.utf8 or not latin1
        parts = sorted(splits.get(r.file, []))
        header = _text(bytes(parts[0][3] if r.broken else r.header), utf8).removeprefix("﻿")
        batch = batches.setdefault((header, utf8, r.broken), Batch(header, utf8, r.broken, [], 0, cut=cut if r.broken else None))
        batch.files.append(r.file)
        if not r.broken:
            batch.width = max(batch.width, r.width)
        now = False
        for block, outside, inside, _ in parts:
            if now:
                batch.inside.setdefault(r.file, set()).add(block)
            now = inside if now else outside
            if now:
                batch.ends.setdefault(r.file, set()).add(block)
    return list(batches.values())


_CLOSE = re.compile(rb'(?:[^"]++|"")*+"')


def ends_inside(line: bytes, inside: bool, sep: bytes) -> bool:
    """Whether a line that begins outside or inside a quoted field ends inside one."""
    at = -1 if inside else 0
    while True:
        if at >= 0:
            quote = line.find(b'"', at)
            if quote < 0:
                return False
            if quote > at and line[quote - 1 : quote] != sep:  # within a field without quotes
                at = line.find(sep, quote) + 1
                if not at:
                    return False
                continue
        close = _CLOSE.match(line, quote + 1 if at >= 0 else 0)
        if close is None:
            return True
        at = line.find(sep, close.end()) + 1
        if not at:
            return False


#: Kinds of pieces: a whole record, the beginning of one, its end, a split within one, and what a split tells of itself.
WHOLE, BEGINS, ENDS, WITHIN, SPLIT = range(5)
#: For whom a piece holds: splits that begin outside quotes, inside, or either.
OUTSIDE, INSIDE, EITHER = 0, 1, 2
CUT = "file string, block bigint, start int, kind int, record binary, outside boolean, inside boolean"
_CUT = dict(zip(("file", "block", "start", "kind", "record", "outside", "inside"), (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_(), pa.bool_())))
PIECES = "file string, block bigint, kind int, record string"
_PIECES = dict(zip(("file", "block", "kind", "record"), (pa.string(), pa.int64(), pa.int32(), pa.string())))


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=list(kinds))


class _Reading:
    """The records of a split, if it begins outside or inside quotes."""

    def __init__(self, start: int, block: int):
        self.start, self.now = start, start == INSIDE
        self.lines: list[bytes] = []
        self.kind, self.header = ENDS if self.now else WHOLE, block == 0

    def add(self, line: bytes, sep: bytes) -> tuple | None:
        """The piece that ends with the line, if one does and it is not the header of a file."""
        self.lines.append(line)
        self.now = ends_inside(line, self.now, sep) if b'"' in line else self.now
        if self.now:
            return None
        piece = None if self.header else (self.start, self.kind, b"\n".join(self.lines), None, None)
        self.lines, self.kind, self.header = [], WHOLE, False
        return piece

    def rest(self) -> tuple | None:
        return (self.start, WITHIN if self.kind == ENDS else BEGINS, b"\n".join(self.lines), None, None) if self.lines else None


def _cut(sep: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pieces of every split, for either state it may begin in, and where it ends up. Both readings
    are one from the first line on behind which neither is inside quotes. The piece of kind SPLIT
    holds the first record of a file."""
    s = sep.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, readings, head, heading = None, [], [], False
        out: list[tuple] = []

        def end() -> None:
            out.extend((*key, *piece) for piece in [r.rest() for r in readings] if piece)
            out.append((*key, EITHER, SPLIT, b"\n".join(head), readings[0].now, readings[-1].now))

        for batch in batches:
            for file, block, line in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, block) != key:
                    if key is not None:
                        end()
                    key, head, heading = (file, block), [], block == 0
                    # a file begins outside quotes
                    readings = [_Reading(OUTSIDE, block), _Reading(INSIDE, block)] if block else [_Reading(EITHER, block)]
                if heading:
                    head.append(line)
                out.extend((*key, *piece) for piece in [r.add(line, s) for r in readings] if piece)
                heading = heading and readings[0].now
                if len(readings) > 1 and not any(r.now for r in readings):
                    readings = [readings[0]]
                    readings[0].start = EITHER
            yield _batch(out, _CUT)
            out.clear()
        if key is not None:
            end()
        yield _batch(out, _CUT)

    return run


def _pieces(batch: Batch, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of the pieces of every split those that hold, as text: whole records, or else the pieces of all others."""
    files, inside, utf8 = set(batch.files), batch.inside, batch.utf8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield _batch([
                (file, block, kind, _text(record, utf8))
                for file, block, start, kind, record in zip(*(c.to_pylist() for c in part.columns))
                if (kind == WHOLE) == whole and file in files and start in (EITHER, INSIDE if block in inside.get(file, ()) else OUTSIDE)
            ], _PIECES)

    return run


def _broken(batch: Batch) -> DataFrame:
    cut = batch.cut.where(F.col("kind") != SPLIT).select("file", "block", "start", "kind", "record")
    records = cut.mapInArrow(_pieces(batch, True), PIECES).select("file", "record")
    if not batch.inside and not batch.ends:
        return records
    pieces = cut.where(F.col("kind") != WHOLE).mapInArrow(_pieces(batch, False), PIECES).withColumn("begins", (F.col("kind") == BEGINS).cast("int"))
    order = Window.partitionBy("file").orderBy("block", "begins")
    pieces = pieces.withColumn("at", F.sum("begins").over(order))
    parts = F.array_sort(F.collect_list(F.struct("block", "begins", "record")))
    crossed = pieces.groupBy("file", "at").agg(parts.alias("parts")).where("at > 0")
    return records.unionByName(crossed.select("file", F.array_join(F.col("parts.record"), "\n").alias("record")))


def _by_lines(spark: SparkSession, batch: Batch, paths: str | list[str]) -> DataFrame:
    reader = spark.read.schema("record string").option("sep", NEVER).option("quote", "").option("header", True).option("enforceSchema", True)
    reader = reader.option("encoding", "UTF-8" if batch.utf8 else "ISO-8859-1").option("maxCharsPerColumn", -1)
    return reader.csv(paths).select(F.col("_metadata.file_path").alias("file"), "record")


def records(spark: SparkSession, path: str, sep: str, latin1: bool = True) -> list[tuple[Batch, DataFrame]]:
    """For every kind of file its batch and a table (file, record, fields) without headers and blank
    records; ``fields`` are raw, see ``cell``. Line breaks within a record come out as ``\\n``."""
    batches = survey(spark, path, sep, latin1)
    found = []
    for batch in batches:
        paths = path if len(batches) == 1 else batch.files
        df = _broken(batch) if batch.broken else _by_lines(spark, batch, paths)
        found.append((batch, sealed(df.where(trim(F.col("record")) != ""), {"fields": raw_fields(F.col("record"), sep)})))
    return found


def widest(batch: Batch, df: DataFrame) -> int:
    """The number of fields of the widest record."""
    if not batch.broken:
        return batch.width
    return df.agg(F.max(F.size("fields"))).first()[0] or 0


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
