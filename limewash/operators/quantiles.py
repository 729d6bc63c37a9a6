"""Exact quantiles in bounded memory.

Small columns are ranked directly. For a large column the value at a rank is bracketed with an
approximate quantile sketch; counts below and on the bracket ends tell which side the rank is on,
and the bracket shrinks until the values left inside are few enough to sort. Every pass is one
aggregation with map-side combine, so a value that fills a third of the column is only counted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limewash.functions.text import quoted

SORTABLE = 200_000
PER_JOB = 1_000_000
SKETCHES_PER_JOB = 64
SKETCH = 10_000
AGGREGATES_PER_JOB = 400


@dataclass
class _Search:
    """The value at one zero-based rank of one column, known to lie within [low, high]."""

    column: str
    rank: int
    low: float
    high: float
    below: int = 0
    value: float | None = None
    inside: int | None = None


def in_chunks(df: DataFrame, aggregates: Sequence[Column], size: int = AGGREGATES_PER_JOB) -> list:
    """Values of many global aggregates, a bounded number of them per job."""
    values: list = []
    for start in range(0, len(aggregates), size):
        part = aggregates[start:start + size]
        values += list(df.agg(*[a.alias(f"a{i}") for i, a in enumerate(part)]).first())
    return values


def clean_double(c: Column) -> Column:
    """The column as DOUBLE with NaN as null."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    counts: dict[str, int],
    kinds: dict[str, int] | None = None,
    sortable: int = SORTABLE,
    finite: Sequence[str] = (),
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column.

    ``counts`` are the non-null counts and ``kinds``, if known, the distinct counts; the smaller of
    the two bounds the memory of ranking a column directly. Columns known to be ``finite`` are not
    searched for infinities.
    """
    weight = {c: min(counts[c], (kinds or counts)[c]) for c in columns}
    small = [c for c in columns if counts[c] and weight[c] <= sortable]
    large = [c for c in columns if weight[c] > sortable]
    out: dict[str, list[float | None]] = {c: [None] * len(probabilities) for c in columns}
    for group in grouped(small, [weight[c] for c in small]):
        row = df.agg(*[
            F.percentile(clean_double(quoted(c)), list(probabilities)).alias(f"q{i}")
            for i, c in enumerate(group)
        ]).first()
        out |= {c: row[i] for i, c in enumerate(group)}
    if large:
        ranks = {}
        for c in large:
            for p in probabilities:
                at = p * (counts[c] - 1)
                ranks[c, math.floor(at)] = ranks[c, math.ceil(at)] = None
        found = _values_at(df, list(ranks), counts, sortable, set(finite))
        for c in large:
            out[c] = [_between(found, c, p * (counts[c] - 1)) for p in probabilities]
    return out


def grouped(items: Sequence, weights: Sequence[int], most: int | None = None) -> list[list]:
    """Items in as few jobs as keep the values held at once, and the number of items, within bounds."""
    groups: list[list] = []
    held = PER_JOB
    for item, weight in zip(items, weights):
        if not groups or held + weight > PER_JOB or len(groups[-1]) == most:
            groups.append([])
            held = 0
        groups[-1].append(item)
        held += weight
    return groups


def _between(found: dict[tuple[str, int], float], column: str, at: float) -> float:
    """The weighted mean of the two values around ``at``, as Spark's ``percentile`` forms it."""
    low, high = math.floor(at), math.ceil(at)
    a, b = found[column, low], found[column, high]
    return a if low == high or a == b else (high - at) * a + (at - low) * b


def _values_at(
    df: DataFrame, ranks: list[tuple[str, int]], counts: dict[str, int], sortable: int, finite: set[str],
) -> dict[tuple[str, int], float]:
    inf = float("inf")
    names = [c for c in dict.fromkeys(c for c, _ in ranks) if c not in finite]
    tallies = in_chunks(df, [F.count_if(clean_double(quoted(c)) == v) for c in names for v in (-inf, inf)])
    ends = dict.fromkeys(finite, (0, 0)) | {c: tallies[2 * i:2 * i + 2] for i, c in enumerate(names)}
    searches = []
    for c, r in ranks:  # infinities are counted; the brackets hold finite values only
        least, most = ends[c]
        s = _Search(c, r, -inf, inf, below=least, inside=counts[c] - least - most)
        s.value = -inf if r < least else inf if r >= counts[c] - most else None
        searches.append(s)
    while open_ := [s for s in searches if s.value is None]:
        ready = [s for s in open_ if s.inside <= sortable]
        for group in grouped(ready, [s.inside for s in ready]):
            _sort_small(df, group)
        wide = [s for s in open_ if s.inside > sortable]
        for start in range(0, len(wide), SKETCHES_PER_JOB):
            _narrow(df, wide[start:start + SKETCHES_PER_JOB])
    return {(s.column, s.rank): s.value for s in searches}


def _inside(s: _Search) -> Column:
    v = clean_double(quoted(s.column))
    return F.when((v > s.low) & (v < s.high), v)


def _sort_small(df: DataFrame, searches: list[_Search]) -> None:
    """Pick ranks among the values strictly inside the bracket, whose number is known and small."""
    row = df.agg(*[
        F.element_at(F.sort_array(F.collect_list(_inside(s))), s.rank - s.below + 1).alias(f"v{i}")
        for i, s in enumerate(searches)
    ]).first()
    for i, s in enumerate(searches):
        s.value = row[i]


def _narrow(df: DataFrame, searches: list[_Search]) -> None:
    """One sketch pass for new bracket ends, one counting pass to place the rank among them."""
    slack = 2.0 / SKETCH
    # searches within the same bracket share one sketch
    shared: dict[tuple, list[_Search]] = {}
    for s in searches:
        shared.setdefault((s.column, s.low, s.high), []).append(s)
    sketches = []
    for i, group in enumerate(shared.values()):
        points = []
        for s in group:
            p = (s.rank - s.below) / s.inside
            points += [max(0.0, p - slack), min(1.0, p + slack)]
        sketches.append(F.percentile_approx(_inside(group[0]), points, SKETCH).alias(f"e{i}"))
    found = df.agg(*sketches).first()
    ends = {
        id(s): found[i][2 * j:2 * j + 2]
        for i, group in enumerate(shared.values()) for j, s in enumerate(group)
    }
    tallies = []
    for i, s in enumerate(searches):
        v, (low, high) = _inside(s), ends[id(s)]
        tallies += [
            F.count_if(v < low).alias(f"a{i}"), F.count_if(v == low).alias(f"b{i}"),
            F.count_if((v > low) & (v < high)).alias(f"c{i}"), F.count_if(v == high).alias(f"d{i}"),
        ]
    row = df.agg(*tallies).first()
    for i, s in enumerate(searches):
        low, high = ends[id(s)]
        under, on_low, within, on_high = (row[f"{x}{i}"] for x in "abcd")
        at = s.rank - s.below
        if low == high:
            within = on_high = 0
        if at < under:
            s.high, s.inside = low, under
        elif at < under + on_low:
            s.value = low
        elif at < under + on_low + within:
            s.low, s.high, s.below, s.inside = low, high, s.below + under + on_low, within
        elif at < under + on_low + within + on_high:
            s.value = high
        else:
            before = under + on_low + within + on_high
            s.low, s.below, s.inside = high, s.below + before, s.inside - before
