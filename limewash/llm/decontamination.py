"""Removal of documents or spans that repeat passages of a benchmark."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limewash.llm.common import col, fresh
from limewash.llm.words import ALNUM, U, owners, small_batches, windows, words_of
from limewash.session import materialise, release

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 13
#: Bytes of distinct benchmark passages and of their item ids in one broadcast index; windows take about six times as much.
BLOCK_BYTES = 16 << 20
#: What an entry takes beside its characters: a passage, an id.
ENTRY, ID = 64, 16
PIECE_WORDS = 50_000


@dataclass
class Index:
    """The distinct windows of some items: sorted hashes, and per window its text and its items."""

    lengths: list[int]
    hashes: np.ndarray
    sieve: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    group: np.ndarray
    blob: bytes
    groups: list[list[str]]


def passages(benchmark: DataFrame, item: str, text: str, window: int, piece: int, parts: int = 1) -> DataFrame:
    """Distinct (words joined by one space, window length, part, ids of the items that hold them).

    The ids of a passage that very many items repeat are dealt over ``parts`` rows by their hash. Long items are cut into pieces that overlap by a window less one word, so that every window is
    in one piece; items without words give none.
    """
    words, at, passage, length = (fresh(n) for n in ("words", "at", "passage", "length"))
    rows = benchmark.select(
        F.coalesce(col(item).cast("string"), F.lit("")).alias("id"),
        F.regexp_extract_all(F.translate(col(text), UPPER, LOW), F.lit("(" + WORD + ")")).alias(words),
    ).where(F.size(words) > 0)
    rows = rows.withColumn(at, F.explode(F.sequence(F.lit(0), F.greatest(F.size(words) - window, F.lit(0)), F.lit(piece))))
    rows = rows.select(
        "id", F.least(F.size(words), F.lit(window)).alias(length),
        F.array_join(F.slice(words, col(at) + 1, piece + window - 1), " ").alias(passage),
    )
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")
    return rows.groupBy(passage, length, part).agg(F.collect_set("id").alias("ids")).select(
        col(passage).alias("passage"), col(length).alias("length"), "part", "ids"
    )


def build_index(rows: list[tuple[str, int, list[str]]]) -> Index:
    texts = pa.array([r[0] for r in rows], pa.large_string())
    words = words_of(texts, ALNUM)
    first, parts = words.first, []
    for length in sorted({r[1] for r in rows}):
        hashed = windows(words.hashes, length)
        for i, r in enumerate(rows):
            if r[1] == length:
                at = np.arange(first[i], first[i + 1] - length + 1)
                parts.append((hashed[at], words.starts[at], words.ends[at + length - 1], np.full(len(at), i)))
    hashes, begin, end, row = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((begin, hashes))
    hashes, begin, end, row = hashes[order], begin[order], end[order], row[order]
    blob = words.data.tobytes()
    known: dict[tuple[str, ...], int] = {}
    group, keep = np.zeros(len(hashes), np.int32), np.ones(len(hashes), bool)
    bounds = np.append(np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])), len(hashes))
    for a, b in zip(bounds[:-1], bounds[1:]):
        same: dict[bytes, list[int]] = {}
        for k in range(a, b):
            same.setdefault(blob[begin[k] : end[k]], []).append(k)
        for at in same.values():
            ids = rows[row[at[0]]][2] if len(at) == 1 else {i for k in at for i in rows[row[k]][2]}
            group[at[0]] = known.setdefault(tuple(sorted(ids)), len(known))
            keep[at[1:]] = False
    hashes, begin, end, group = hashes[keep], begin[keep], end[keep], group[keep]
    sieve = np.zeros(1 << 22, bool)
    sieve[(hashes >> U(42)).astype(np.int64)] = True
    return Index(sorted({r[1] for r in rows}), hashes, sieve, begin, end, group, blob, [list(k) for k in known])


def _scan(batch: pa.RecordBatch, text: str, index: Index) -> tuple[list, list, np.ndarray]:
    """Per row: merged runs of hit words (first, last, byte start, byte end), item ids, number of words."""
    words = words_of(batch.column(batch.schema.get_field_index(text)), ALNUM)
    hits, items = [[] for _ in range(batch.num_rows)], [set() for _ in range(batch.num_rows)]
    owner = owners(words.first)
    cover = np.zeros(len(words.hashes) + 1, np.int32)
    for length in index.lengths:
        hashed = windows(words.hashes, length)
        at = np.flatnonzero(index.sieve[(hashed >> U(42)).astype(np.int64)])
        at = at[owner[at] == owner[at + length - 1]]
        lo = np.searchsorted(index.hashes, hashed[at], "left")
        hi = np.searchsorted(index.hashes, hashed[at], "right")
        for i, a, b in zip(at[hi > lo], lo[hi > lo], hi[hi > lo]):
            said = words.text(i, i + length)
            for k in range(a, b):
                if index.blob[index.begin[k] : index.end[k]] == said:
                    cover[i] += 1
                    cover[i + length] -= 1
                    items[owner[i]].add(int(index.group[k]))
    if cover.any():
        # A window never leaves its text, but two texts may both be hit up to their common border.
        hit = np.cumsum(cover[:-1]) > 0
        begin, end = hit.copy(), hit.copy()
        inner = owner[1:] == owner[:-1]
        begin[1:] &= ~(hit[:-1] & inner)
        end[:-1] &= ~(hit[1:] & inner)
        for a, b in zip(np.flatnonzero(begin), np.flatnonzero(end)):
            o = owner[a]
            base = words.first[o]
            hits[o].append((a - base, b - base, words.starts[a] - words.offsets[o], words.ends[b] - words.offsets[o]))
    return hits, [sorted({x for g in groups for x in index.groups[g]}) for groups in items], np.diff(words.first)


SPAN = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
SPAN_SQL = "array<struct<first:int,last:int,start:int,end:int>>"


def _merged(old: list, new: list) -> list:
    out: list[tuple] = []
    for s in sorted([tuple(o.values()) for o in old] + new):
        if out and s[0] <= out[-1][1] + 1:
            last = out[-1]
            out[-1] = (last[0], max(last[1], s[1]), last[2], max(last[3], s[3]))
        else:
            out.append(s)
    return out


def find_passages(
    df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, keep_text: bool = True, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """All rows of ``df`` with n_words (long), ``hits`` (runs of words that occur in a window of the
    benchmark: first and last word, first byte and the byte after the last) and ``items`` (sorted
    ids, as strings, of the items that have a window here). Columns of these names are replaced.

    A window is ``window`` words in a row of an item, or all of a shorter item. Null texts have no
    words; null item ids count as the empty id; repeated rows are judged alike; without benchmark
    rows nothing is hit.

    Distinct passages with their ids are written once and their size is taken. Up to ``block_bytes``
    of them make one index that is broadcast, and the rows are scanned in one pass without a shuffle.
    More make several indexes of that size, one pass each, with the table written between passes, so
    memory stays bounded; also where one text stands under very many ids, whose list is cut for that.
    """
    ids = benchmark.agg(F.sum(F.coalesce(F.octet_length(col(item).cast("string")), F.lit(0)) + ID)).first()[0] or 0
    found = materialise(passages(benchmark, item, item_text, window, PIECE_WORDS, max(1, math.ceil(ids / block_bytes))), "benchmark")
    entry = F.octet_length("passage") + ENTRY + F.octet_length(F.array_join("ids", "")) + ID * F.size("ids")
    size = found.agg(F.sum(entry.cast("long"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    block = F.pmod(F.xxhash64("passage", "part"), F.lit(blocks))
    names = [c for c in df.columns if c not in ("n_words", "hits", "items")]
    out, last = df.select(*[col(c) for c in names]), None
    for b in range(blocks):
        rows = [tuple(r) for r in found.where(block == b).select("passage", "length", "ids").collect()]
        index = df.sparkSession.sparkContext.broadcast(build_index(rows) if rows else None)
        out = _pass(out, names, text, index, keep_text or b < blocks - 1)
        if b < blocks - 1:
            out = materialise(out, "passages")
            if last is not None:
                release(last)
            last = out
    release(found)
    return out


def _pass(df: DataFrame, names: list[str], text: str, index, keep_text: bool) -> DataFrame:
    kept = [c for c in names if keep_text or c != text]
    schema = ", ".join(f"`{c.replace('`', '``')}` {df.schema[c].dataType.simpleString()}" for c in kept)
    schema += (", " if kept else "") + f"n_words bigint, hits {SPAN_SQL}, items array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            at = batch.schema.get_field_index
            if index.value is None:
                words = words_of(batch.column(at(text)), ALNUM)
                hits, items, n = [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)], np.diff(words.first)
            else:
                hits, items, n = _scan(batch, text, index.value)
            if at("hits") >= 0:
                hits = [_merged(o, h) for o, h in zip(batch.column(at("hits")).to_pylist(), hits)]
                items = [sorted({*o, *i}) for o, i in zip(batch.column(at("items")).to_pylist(), items)]
            spans = pa.array([[dict(zip(("first", "last", "start", "end"), map(int, s))) for s in h] for h in hits], pa.list_(SPAN))
            yield pa.RecordBatch.from_arrays(
                [batch.column(at(c)) for c in kept] + [pa.array(n, pa.int64()), spans, pa.array(items, pa.list_(pa.string()))],
                names=[*kept, "n_words", "hits", "items"],
            )

    return df.mapInArrow(run, schema)


def n_hit(hits):
    """How many words the runs cover."""
    return F.aggregate(hits, F.lit(0).cast("long"), lambda a, s: a + (s["last"] - s["first"] + 1))


def contaminated(share: int = 20):
    """Whether a document that has been searched has a hit word, and one in ``share`` words or more."""
    return (n_hit(F.col("hits")) > 0) & (share * n_hit(F.col("hits")) >= F.col("n_words"))


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", action: str = "documents", share: int = 20, **options) -> DataFrame:
    """``df`` without contaminated documents, or (``action="spans"``) with the hit spans cut out of
    every contaminated document. Same columns, same rules for nulls and repeats as ``find_passages``."""
    names = {c: f"c{i}__" for i, c in enumerate(df.columns)}
    own = names[text]
    found = find_passages(df.select(*[col(c).alias(n) for c, n in names.items()]), benchmark, own, **options)
    if action == "documents":
        return found.where(~contaminated(share)).select(*[F.col(n).alias(c) for c, n in names.items()])
    raw = F.col(own).cast("binary")
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get("hits", i - 1)["end"])
    end = lambda i: F.coalesce(F.get("hits", i)["start"], F.octet_length(raw))
    kept = F.transform(F.sequence(F.lit(0), F.size("hits")), lambda i: F.substring(raw, begin(i) + 1, end(i) - begin(i)))
    left = F.decode(F.aggregate(kept, F.lit("").cast("binary"), lambda a, x: F.concat(a, x)), "UTF-8")
    found = found.withColumn(own, F.when(contaminated(share), left).otherwise(F.col(own)))
    return found.select(*[F.col(n).alias(c) for c, n in names.items()])
