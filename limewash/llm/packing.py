"""Length buckets with the least padding, and batches of a token budget inside each bucket."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limewash.llm.common import col, fresh, numbered
from limewash.session import materialise, release

WORD = "[^ \\t\\n\\x0B\\f\\r]+"


def word_count(text: Column) -> Column:
    """Runs of characters other than white space; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def best_boundaries(lengths: Sequence[int], counts: Sequence[int], buckets: int) -> list[int]:
    """At most ``buckets`` upper bounds, the last the largest length, with the least total padding.

    ``lengths`` ascend. With bounds b1 < b2 < ... every row of a length in (b(i-1), b(i)] is padded
    to b(i). Dynamic programming over (buckets used, longest length covered); of equally good
    choices the one with shorter earlier buckets wins.
    """
    length, count = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    n = len(length)
    if not n:
        return []
    rows = np.concatenate([[0], np.cumsum(count)])
    cost = np.concatenate([[0], length * rows[1:]])  # one bucket up to each length; padded tokens in all
    choice: list[np.ndarray] = []
    for _ in range(min(buckets, n) - 1):
        best, frm = cost.copy(), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            total = cost[:j] + length[j - 1] * (rows[j] - rows[:j])
            frm[j] = int(np.argmin(total))
            best[j] = total[frm[j]]
        choice.append(frm)
        cost = best
    bounds, j = [], n
    for frm in reversed(choice):
        bounds.append(int(length[j - 1]))
        j = int(frm[j])
        if not j:
            break
    if j:
        bounds.append(int(length[j - 1]))
    return sorted(bounds)


def pack(
    df: DataFrame, key: str, tokens: Column, budget: int = 4096, buckets: int = 12, step: int = 1
) -> DataFrame:
    """Sequences of all rows of ``df``, bucketed by length and dealt into batches.

    Returns ``key``, piece (0, 1, ... of its row), start and n_tokens (the piece's tokens within the
    row), padded (the length of its bucket), batch and slot (both from 0; a batch is (padded, batch)
    and holds at most ``budget`` tokens with padding).

    A row longer than ``budget`` gives several pieces, of which only the last is shorter. A row of
    no tokens (null or empty text) gives one piece of length 0 that takes a slot of the shortest
    bucket. Null keys and repeated rows are packed like any other. No rows give no rows; other
    columns are left out. Bounds are multiples of ``step``, or ``budget``; so the histogram that
    comes to the driver has at most budget / step + 1 rows, whatever the size of the input.
    """
    n, own, piece, bound, place = fresh("n"), fresh("key"), "piece", fresh("bound"), fresh("place")
    rows = materialise(df.select(col(key).alias(own), F.coalesce(tokens, F.lit(0)).cast("long").alias(n)), "lengths")  # texts are read once
    pieces = rows.withColumn(piece, F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(col(n) / budget) - 1, F.lit(0)).cast("int"))))
    start = F.col(piece).cast("long") * budget
    pieces = pieces.select(
        own, piece, start.alias("start"), F.least(col(n) - start, F.lit(budget)).cast("int").alias("n_tokens")
    )
    rounded = F.least(F.greatest(F.ceil(F.col("n_tokens") / step), F.lit(1)) * step, F.lit(budget)).cast("int")
    histogram = sorted(tuple(r) for r in pieces.groupBy(rounded.alias("l")).count().collect())
    bounds = best_boundaries([h[0] for h in histogram], [h[1] for h in histogram], buckets)
    padded = F.lit(budget)
    for b in reversed(bounds):
        padded = F.when(rounded <= b, b).otherwise(padded)
    placed = numbered(pieces.withColumn(bound, padded.cast("int")), bound, place)
    release(rows)
    rows_per_batch = F.floor(F.lit(budget) / col(bound)).cast("long")
    return placed.select(
        col(own).alias(key), piece, "start", "n_tokens", col(bound).alias("padded"),
        F.floor(col(place) / rows_per_batch).cast("long").alias("batch"), (col(place) % rows_per_batch).cast("int").alias("slot"),
    )
