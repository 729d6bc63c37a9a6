"""Correlations of all pairs of numeric columns, from blocked matrices of moments.

Each task turns its rows into matrices, a few thousand rows at a time: for every pair of columns the
number of rows that have both, their means, squared deviations and products of deviations over
these rows. Matrices are merged by the rule for two samples, which does not lose digits as sums of
squares do. Rows of the matrices are dealt out by column, merged as they arrive, and only pairs whose
correlation is high enough leave. One job serves all pairs of two blocks of columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limewash.functions import constants as K
from limewash.functions.text import quoted
from limewash.operators.melting import numeric_columns
from limewash.operators.quantiles import clean_double

PAIR_SCHEMA = "col_a string, col_b string, correlation double"
#: Columns of one block; a task holds the matrices of two blocks.
BLOCK = 256
#: Rows that one matrix product takes.
ROWS = 4096
#: Rows that tell a value near the others.
NEAR = 128
_MATRICES = ("n", "mean_a", "mean_b", "square_a", "square_b", "product")
#: Variance that is nothing but rounding, as a share of the squares it is left from.
NOTHING = 1e-12


def _sample(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The six matrices of a batch; NaN stands for a missing value."""
    with np.errstate(all="ignore"):
        mid_a, mid_b = _middle(a), _middle(b)
        has_a, has_b = ~np.isnan(a), ~np.isnan(b)
        far = np.isinf(a).T.astype(float) @ has_b + has_a.T.astype(float) @ np.isinf(b) > 0
        x = np.where(has_a & np.isfinite(a), a - mid_a, 0.0)
        y = np.where(has_b & np.isfinite(b), b - mid_b, 0.0)
        p, q = has_a.astype(float), has_b.astype(float)
        n, sum_a, sum_b = p.T @ q, x.T @ q, p.T @ y
        square_a, square_b = (x * x).T @ q, p.T @ (y * y)
        least = np.maximum(n, 1.0)
        out = np.stack([
            n, sum_a / least + mid_a[:, None], sum_b / least + mid_b[None, :],
            _left(square_a, sum_a, least), _left(square_b, sum_b, least), x.T @ y - sum_a * sum_b / least,
        ])
        out[1:, far] = np.nan  # infinite values have no correlation
    return out


def _middle(values: np.ndarray) -> np.ndarray:
    """A finite value amid those of each column, so that deviations from it are small; any such value
    gives the same moments, so a part of the rows tells it, unless it holds none of a column."""
    part = values[:: len(values) // NEAR + 1]
    if not np.isfinite(part).any(axis=0).all():
        part = values
    finite = np.where(np.isfinite(part), part, np.nan)
    known = ~np.isnan(finite).all(axis=0)
    out = np.zeros(values.shape[1])
    if known.any():
        out[known] = np.nanmedian(finite[:, known], axis=0)
    return out


def _left(square: np.ndarray, total: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Squared deviations from the mean; exactly none where only rounding is left."""
    left = square - total * total / n
    return np.where(left <= NOTHING * square, 0.0, left)


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The matrices of two samples together."""
    with np.errstate(all="ignore"):
        n = a[0] + b[0]
        share = np.where(n > 0, b[0] / np.maximum(n, 1.0), 0.0)
        weight = a[0] * share
        step_a, step_b = (np.where(weight > 0, b[k] - a[k], 0.0) for k in (1, 2))
        none = a[0] == 0
        return np.stack([
            n, np.where(none, b[1], a[1] + step_a * share), np.where(none, b[2], a[2] + step_b * share),
            a[3] + b[3] + step_a * step_a * weight, a[4] + b[4] + step_b * step_b * weight, a[5] + b[5] + step_a * step_b * weight,
        ])


def _moments(left: int):
    """Of the first ``left`` columns with the others: one row of each matrix for every column of the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            table = np.stack([np.asarray(c.fill_null(float("nan")), np.float64) for c in batch.columns], axis=1)
            for at in range(0, len(table), ROWS):
                part = table[at : at + ROWS]
                sample = _sample(part[:, :left], part[:, left:])
                total = sample if total is None else _merged(total, sample)
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(left), pa.int32()), *(pa.array(list(m), pa.list_(pa.float64())) for m in total)], names=["a", *_MATRICES]
            )

    return run


def _correlated(least: float, first_a: int, first_b: int):
    """Pairs (a, b, correlation) from rows of matrices in the order of a."""

    def pairs(a: int, total: np.ndarray) -> list[tuple[int, int, float]]:
        with np.errstate(all="ignore"):
            spread = np.sqrt(total[3] / total[0]) * np.sqrt(total[4] / total[0])
            value = total[5] / total[0] / spread
        fit = (spread > 0) & (np.abs(value) >= least) & (first_b + np.arange(len(value)) > first_a + a)
        return [(first_a + a, first_b + int(b), round(float(value[b]), 4)) for b in np.flatnonzero(fit)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, out = None, None, []
        for batch in batches:
            for i in range(batch.num_rows):
                a = batch.column(0)[i].as_py()
                row = np.stack([np.asarray(batch.column(k)[i].values) for k in range(1, 7)])
                if a != now:
                    out += pairs(now, total) if now is not None else []
                    now, total = a, row
                else:
                    total = _merged(total, row)
        out += pairs(now, total) if now is not None else []
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.float64()))], names=["a", "b", "correlation"])

    return run


def redundant_pairs(df: DataFrame, columns: Sequence[str] | None = None, min_correlation: float = K.MIN_CORRELATION, block: int = BLOCK) -> DataFrame:
    """(col_a, col_b, correlation) of numeric columns whose correlation is close to 1 or -1, over the
    rows that have both; lazily. Columns without spread, or with infinite values, have none.

    Each pair of blocks of ``block`` columns is one read of these columns; a table of fewer columns is read once.
    """
    names = list(columns or numeric_columns(df))
    blocks = [range(i, min(i + block, len(names))) for i in range(0, len(names), block)]
    found = None
    for a, b in combinations_with_replacement(blocks, 2):
        values = df.select(*[clean_double(quoted(names[i])).alias(f"{side}{i}") for side, part in (("a", a), ("b", b)) for i in part])
        rows = values.mapInArrow(_moments(len(a)), "a int, " + ", ".join(f"{m} array<double>" for m in _MATRICES))
        pairs = rows.repartition("a").sortWithinPartitions("a").mapInArrow(_correlated(min_correlation, a[0], b[0]), "a int, b int, correlation double")
        found = pairs if found is None else found.unionByName(pairs)
    if found is None:
        return df.sparkSession.createDataFrame([], PAIR_SCHEMA)
    name = F.array(*map(F.lit, names))
    return found.select(F.get(name, F.col("a")).alias("col_a"), F.get(name, F.col("b")).alias("col_b"), "correlation")
