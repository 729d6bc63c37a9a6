"""Runs of words that repeat themselves at once, by a dictionary of basic factors.

Basic factors are all strings of 1, 2, 4, 8, ... words of a text. Each gets a name, equal ones the same:
the names of one length are made from pairs of names of half of it. Where a factor stands again within
twice its length, and from there once more as far away, its occurrences form an arithmetic progression
whose step is proposed as a period. A stretch of such starts is one proposal. It is extended to both
sides as far as words one period apart are equal, found by comparing names from the longest factor
down, and proposals of one stretch of words are united under the least period.

That finds every run of ``TIMES`` periods: for a period q and the least power of two L from q on, the
factor of length L at the first word of the run stands again q words later and not before (else q were
not the smallest period), and q <= L < 2 * q leaves room for a third one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limewash.llm.common import col, fresh
from limewash.llm.words import AS_IS, SPACED, U, kept_words, mix, owners, small_batches, words_of

TIMES = 4
LEAST = 6
#: Bytes of text that one step holds, one text at least.
STEP = 1 << 20
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Factors:
    """Names of the basic factors of several texts that stand more than once in their text; others are -1."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray):
        self.end = np.repeat(first[1:], np.diff(first))  # where the text of each word ends
        self.names: list[np.ndarray] = []
        self.n = len(hashes)
        self._name(np.arange(self.n), mix(hashes) + mix(owners(first).astype(U)))

    def _name(self, at: np.ndarray, keys: np.ndarray) -> None:
        """Name the factors at ``at`` (ascending) by their keys; ``order`` and ``name`` then list them by name and place."""
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        again = (np.append(False, same) | np.append(same, False))[: len(at)]
        name = np.cumsum(np.append(True, ~same)) - 1 if len(at) else np.zeros(0, np.int64)
        self.order, self.name = at[order][again], name[again]
        names = np.full(self.n, -1, np.int32 if self.n < 2**31 else np.int64)
        names[self.order] = self.name
        self.names.append(names)

    def double(self) -> bool:
        """Name the factors of twice the length; false if none stands twice."""
        half, last = 1 << (len(self.names) - 1), self.names[-1]
        at = np.flatnonzero(last >= 0)
        at = at[at + 2 * half <= self.end[at]]
        at = at[last[at + half] >= 0]
        self._name(at, last[at].astype(np.int64) * self.n + last[at + half])
        return len(self.order) > 0

    def progressions(self) -> tuple[np.ndarray, np.ndarray]:
        """First start and step of every stretch of starts whose factors stand again, twice, one step further each."""
        length = 1 << (len(self.names) - 1)
        step = np.zeros(self.n, np.int64)
        pair = np.flatnonzero(self.name[1:] == self.name[:-1])
        step[self.order[pair]] = self.order[pair + 1] - self.order[pair]
        at = np.flatnonzero((step > 0) & (step <= 2 * length))
        at = at[step[at + step[at]] == step[at]]
        new = np.append(True, (at[1:] != at[:-1] + 1) | (step[at][1:] != step[at][:-1])) if len(at) else np.zeros(0, bool)
        return at[new], step[at[new]]

    def reach(self, a: np.ndarray, b: np.ndarray, first: np.ndarray, forward: bool) -> np.ndarray:
        """How many words from a and b on (or before them) are equal, within their text."""
        done = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            size, names = 1 << k, self.names[k]
            # A longest common extension has at most one step of a size, but for the longest size.
            while True:
                x, y = (a + done, b + done) if forward else (a - done - size, b - done - size)
                inside = (y + size <= self.end[a]) if forward else (x >= first[a])
                same = np.zeros(len(a), bool)
                at = np.flatnonzero(inside)
                same[at] = (names[x[at]] == names[y[at]]) & (names[x[at]] >= 0)
                done[same] += size
                if k < len(self.names) - 1 or not same.any():
                    break
        return done


def runs_of(hashes: np.ndarray, first: np.ndarray, times: int = TIMES, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (among all words), length and period of every run, by start and period."""
    factors = Factors(hashes, first)
    begins = np.repeat(first[:-1], np.diff(first))
    proposed: list[tuple[np.ndarray, np.ndarray]] = []
    while len(factors.order):
        proposed.append(factors.progressions())
        if not factors.double():
            break
    none = np.zeros(0, np.int64)
    at, period = (np.concatenate([none, *[p[k] for p in proposed]]) for k in (0, 1))
    if not len(at):
        return none, none, none
    at, period = np.unique(np.stack([at, period]), axis=1)
    start = at - factors.reach(at, at + period, begins, False)
    length = at + period + factors.reach(at, at + period, begins, True) - start
    long = length >= np.maximum(least, times * period)
    start, length, period = start[long], length[long], period[long]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    # One stretch of words is one run, of its least period.
    new = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))[: len(start)]
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _find(times: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            name = whole.schema.names[-1]
            for batch in small_batches([whole], name, STEP):
                words = words_of(batch.column(batch.num_columns - 1), SPACED, AS_IS)
                start, length, period = runs_of(words.hashes, words.first, times, least)
                change = np.zeros(len(words.starts) + 1, np.int64)
                np.add.at(change, start + period, 1)
                np.add.at(change, start + length, -1)
                texts = kept_words(words, np.cumsum(change)[:-1] == 0)
                bounds = np.searchsorted(start, words.first)
                own = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
                runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - words.first[own], length, period)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns[:-1], pa.array(np.diff(words.first), pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs),
                        pa.array([t.decode("utf-8", "replace") for t in texts], pa.string()),
                    ],
                    names=[*batch.schema.names[:-1], "n_words", "runs", "collapsed"],
                )

    return run


def find_runs(df: DataFrame, text: str = "text", times: int = TIMES, least: int = LEAST) -> DataFrame:
    """The other columns of ``df``, and for each row ``n_words``, ``runs`` and ``collapsed``.

    Words are separated by white space (space and \\t to \\r). A run is a stretch of at least ``least``
    words and ``times`` of its smallest period that cannot be extended: start (from 0), length and
    period in words, by start and period. ``times`` is at least 4. ``collapsed`` has the words that no
    run covers behind its first period, with one space between. A null or empty text has no words, no
    runs and an empty ``collapsed``. Rows are independent: none is lost, repeated rows stay, an empty
    table gives none. Columns that are called like a result are replaced by it.

    Each text is searched within one task; memory grows with its words times the logarithm of its
    longest repeated stretch. Equality of words is equality of 64-bit hashes, that of longer strings exact.
    """
    if times < 4:
        raise ValueError("runs of fewer than four periods are not found by this method")
    others = [f for f in df.schema.fields if f.name not in (text, "n_words", "runs", "collapsed")]
    body = fresh("text")
    schema = ", ".join([*["`" + f.name.replace("`", "``") + "` " + f.dataType.simpleString() for f in others], "n_words bigint", f"runs {RUNS}", "collapsed string"])
    return df.select(*[col(f.name) for f in others], F.coalesce(col(text), F.lit("")).alias(body)).mapInArrow(_find(times, least), schema)


def densest(runs: Column) -> Column:
    """The run of the greatest length per period, in whole numbers; of equal ones the first. Null if there is none."""
    better = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(better(best, r), r).otherwise(best))
