"""Exact search for the highest inner products, by histograms of all scores."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limewash.llm.common import col
from limewash.session import materialise, release, scratch_path

BINS = 1024
#: Queries that one broadcast holds.
BLOCK = 1024
#: Candidates scored at once.
CHUNK = 1024
#: A bin is refined until it holds at most this many scores more than are wanted, or one value.
SLACK = 16
#: Vectors whose components add up to more are scored in whole numbers: two others give less than 2 ** 53.
PLAIN = float(2**26)
LONG = 2**63 - 1
FOUND = "query_id bigint, vec_id bigint, score bigint"


def quantised(vectors: Column, scale: int) -> Column:
    """floor(scale * x) of every component as long; null for a vector that is null or holds a null
    or a number that is not finite."""
    usable = F.forall(vectors, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.when(usable, F.transform(vectors, lambda x: F.floor(x.cast("double") * scale)))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _scores(batches: Iterator[pa.RecordBatch], ids: np.ndarray, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate ids and the scores of all queries (rows) with them; no score with the same id.

    Products of integers are exact in doubles up to 2 ** 53, so vectors whose components add up to
    more than PLAIN are left to ``_exactly``.
    """
    for batch in batches:
        for a in range(0, batch.num_rows, CHUNK):
            part = batch.slice(a, CHUNK)
            own = np.asarray(part.column(0))
            score = queries @ _matrix(part.column(1)).T
            score[ids[:, None] == own[None, :]] = -np.inf
            yield own, score


def _histograms(block, k: int):
    """(query, bin, n) of a task's scores, from the highest bin down until k scores are counted.

    The kth score of all is not below the kth of the task, so bins further down are not needed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, low, width = block.value
        counts = np.zeros((len(ids), BINS), np.int64)
        base = np.arange(len(ids))[:, None] * BINS
        for _, score in _scores(batches, ids, queries):
            place = np.floor((score - low[:, None]) / width[:, None])
            inside = place >= 0
            place = np.minimum(place, BINS - 1)
            counts += np.bincount((base + np.where(inside, place, 0))[inside].astype(np.int64), minlength=counts.size).reshape(counts.shape)
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        q, b = np.nonzero((counts > 0) & (above < k))
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(counts[q, b])], names=["q", "bin", "n"])

    return run


def _above(block, k: int):
    """(query, vec_id, score) of a task's scores that reach the query's bound: its k best of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, low, _ = block.value
        held = [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        for own, score in _scores(batches, ids, queries):
            q, c = np.nonzero((score >= low[:, None]) & np.isfinite(score))
            held = [np.concatenate(x) for x in zip(held, (q, own[c], score[q, c]))]
            order = np.lexsort((held[1], -held[2], held[0]))
            held = [h[order] for h in held]
            first = np.searchsorted(held[0], held[0])
            keep = np.arange(len(order)) - first < k
            held = [h[keep] for h in held]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[held[0]], pa.int64()), pa.array(held[1], pa.int64()), pa.array(held[2].astype(np.int64))], names=["query_id", "vec_id", "score"]
        )

    return run


def _exactly(block, k: int):
    """(query, vec_id, score) of a task's k best candidates per query, in whole numbers of any size; a score
    beyond a long counts as the nearest long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = block.value
        held: list[list[tuple[int, int]]] = [[] for _ in ids]
        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for q, vector in enumerate(queries):
                held[q] += [(-max(-LONG, min(LONG, sum(x * y for x, y in zip(vector, v)))), i) for i, v in rows if i != ids[q]]
                held[q] = heapq.nsmallest(k, held[q])
        found = [(ids[q], i, -s) for q, best in enumerate(held) for s, i in best]
        yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], pa.int64()) for j in range(3)], names=["query_id", "vec_id", "score"])

    return run


def top_k(df: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for every row that ``is_query`` names, the k rows of
    another id with the highest inner product of quantised vectors; equal scores by the smaller id.

    Keys are integers. Vectors that are null or hold a null or a number that is not finite, and rows of
    a null id, take no part, neither do candidates of another length than the query. Rows that repeat an
    id and a vector count once. With fewer than k candidates all are returned; without queries no rows.
    Scores beyond a long count as the largest or smallest long.

    Queries go in blocks of ``block`` rows, each broadcast (a fixed size) and scored against all rows.
    A pass counts scores per bin; the counts of all tasks tell the bin of the kth highest score,
    which the next pass divides again, until it is one value or holds few scores. The last pass
    keeps what reaches it; a task passes on its k best, so ties of any number stay small. The rows of a
    block are written and its broadcasts removed before the next one begins.

    Vectors of components so large that doubles would round their products are scored in whole numbers,
    as queries and as candidates; there each task keeps its k best of all.
    """
    spark = df.sparkSession
    rows = df.where(col(key).isNotNull()).select(col(key).cast("long").alias("id"), quantised(col(vector), scale).alias("v"), is_query.alias("asks"))
    reach = F.aggregate("v", F.lit(0.0), lambda n, x: n + F.abs(x.cast("double")))
    rows = materialise(rows.where("v IS NOT NULL").distinct().withColumns({"dim": F.size("v"), "large": reach > PLAIN}), "vectors")
    path = scratch_path(spark, "best")
    spark.createDataFrame([], FOUND).write.parquet(path)
    top = F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))
    sizes = rows.groupBy("dim", "large").agg(top.alias("top"), F.count_if("asks").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    plain_top = {r.dim: float(r.top or 0) for r in sizes if not r.large}
    with_large = {r.dim for r in sizes if r.large}
    for r in sizes:
        blocks = -(-r.n // block)
        own = rows.where((F.col("dim") == r.dim) & (F.col("large") == r.large) & F.col("asks"))
        every = rows.where(F.col("dim") == r.dim)
        for b in range(blocks):
            asks = own.where(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == b).select("id", "v").collect()
            if not asks:
                continue
            if not r.large:
                _block(every.where("NOT large").select("id", "v"), asks, r.dim, plain_top[r.dim], k, path)
            if r.large or r.dim in with_large:
                sent = spark.sparkContext.broadcast(([a.id for a in asks], [a.v for a in asks]))
                some = every if r.large else every.where("large")
                _keep(some.select("id", "v").mapInArrow(_exactly(sent, k), "query_id bigint, vec_id bigint, score bigint"), k, path)
                sent.destroy()
    release(rows)
    return _ranked(spark.read.schema(FOUND).parquet(path), k).select("query_id", "rank", "vec_id", "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _keep(found: DataFrame, k: int, path: str) -> None:
    _ranked(found, k).drop("rank").write.mode("append").parquet(path)


def _block(every: DataFrame, asks: list, dim: int, top: float, k: int, path: str) -> None:
    context = every.sparkSession.sparkContext
    ids = np.array([a[0] for a in asks], np.int64)
    queries = np.array([a[1] for a in asks], np.float64).reshape(len(asks), dim)
    reach = np.abs(queries).sum(axis=1) * top
    low, width = -reach, np.maximum(1.0, np.ceil((2 * reach + 1) / BINS))
    open_ = np.ones(len(ids), bool)
    bound = low.copy()
    while open_.any():
        at = np.flatnonzero(open_)
        sent = context.broadcast((ids[at], queries[at], low[at], width[at]))
        counted = every.mapInArrow(_histograms(sent, k), "q int, bin int, n bigint").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        above = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin"))) - F.col("n")
        # One row per query: the bin where the count from above reaches k, or else its lowest bin.
        hit = counted.withColumn("above", above).where(F.col("above") < k).groupBy("q").agg(
            F.min(F.struct("bin", "n", "above")).alias("b")
        ).select("q", "b.*").collect()
        seen = np.zeros(len(at), bool)
        for q, b, n, over in hit:
            i = at[q]
            seen[q] = True
            bound[i] = low[i] + b * width[i]
            open_[i] = width[i] > 1 and over + n > k + SLACK
            low[i], width[i] = bound[i], max(1.0, np.ceil(width[i] / BINS))
        open_[at[~seen]] = False
        sent.destroy()
    sent = context.broadcast((ids, queries, bound, width))
    _keep(every.mapInArrow(_above(sent, k), "query_id bigint, vec_id bigint, score bigint"), k, path)
    sent.destroy()
