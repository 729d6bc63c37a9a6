"""Hard negatives by inner product, with bounds along a spanning tree of the anchors.

The anchors of a block are joined by a least spanning tree over the distances of their vectors. For
an anchor c with the parent p and a candidate x, the score of c is that of p, more or less
|c - p| * |x|. A task walks the tree from its root, where every score is computed. Further down a
candidate carries an interval, and only those whose interval meets a window of the anchor that still
wants rows are scored again, which makes their interval one point.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limewash.llm.common import col
from limewash.llm.topk import quantised
from limewash.session import materialise, release, scratch_path

#: Anchors that one broadcast holds.
BLOCK = 1024
#: Candidates that one walk through the tree takes.
CHUNK = 2048
#: Vectors whose components add up to more are scored in whole numbers of any size, others in doubles.
PLAIN = float(2**26)
LONG = 2**63 - 1
#: Share of a bound that covers the rounding of doubles.
ROUNDING = 1e-9


@dataclass
class Need:
    """Rows wanted for an anchor: the ``k`` best scores from ``low`` to ``high``."""

    low: float
    high: float
    k: int
    positive_id: int = 0
    positive_score: int = 0
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """Keep the best; once there are k, lower scores are not asked for any more."""
        fit = np.flatnonzero((scores >= self.low) & (scores <= self.high))
        if not len(fit):
            return
        ids, scores = np.append(self.ids, ids[fit]), np.append(self.scores, scores[fit])
        best = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[best], scores[best]
        if len(best) == self.k:
            self.low = max(self.low, int(self.scores[-1]))


@dataclass
class Tree:
    """Anchors of a block so that each comes after its parent; ``edge`` is the distance between them."""

    ids: np.ndarray
    labels: list
    vectors: np.ndarray  # whole numbers
    parent: np.ndarray
    edge: np.ndarray


def spanning_tree(ids: list, labels: list, vectors: np.ndarray) -> Tree:
    """The least spanning tree, grown from the first anchor by the nearest one outside."""
    points = vectors.astype(np.float64)
    n = len(points)
    square = (points**2).sum(axis=1)
    order, parent = [0], np.zeros(n, np.int64)
    near = square + square[0] - 2 * (points @ points[0])
    outside = np.ones(n, bool)
    outside[0] = False
    for _ in range(n - 1):
        at = int(np.argmin(np.where(outside, near, np.inf)))
        order.append(at)
        outside[at] = False
        far = square + square[at] - 2 * (points @ points[at])
        closer = outside & (far < near)
        near[closer], parent[closer] = far[closer], at
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    ordered = points[order]
    above = place[parent[order]]
    edge = np.sqrt(((ordered - ordered[above]) ** 2).sum(axis=1))
    return Tree(np.array(ids, np.int64)[order], [labels[i] for i in order], vectors[order], above, edge)


def _exact(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Inner products in numbers of any size; one beyond a long counts as the nearest long."""
    q = [int(x) for x in anchor]
    return np.array([max(-LONG, min(LONG, sum(x * y for x, y in zip(map(int, r), q)))) for r in rows], np.int64)


def _walk(tree: Tree, needs: list[list[Need]], same_label: bool, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
    """Offer a chunk of candidates to all needs of all anchors."""
    points = rows.astype(np.float64)
    reach = np.abs(points).sum(axis=1)
    length = np.sqrt((points**2).sum(axis=1))
    plain = reach <= PLAIN
    low, high = np.empty((len(tree.ids), len(ids))), np.empty((len(tree.ids), len(ids)))
    for a, anchor in enumerate(tree.vectors):
        wanted = (labels == tree.labels[a]) & (ids != tree.ids[a]) if same_label else labels != tree.labels[a]
        if a:
            spread = tree.edge[a] * length
            above = tree.parent[a]
            spread = spread + ROUNDING * (spread + np.maximum(np.abs(low[above]), np.abs(high[above])) + 1)
            low[a], high[a] = low[above] - spread, high[above] + spread
            meets = np.zeros(len(ids), bool)
            for need in needs[a]:
                least, most = float(need.low), float(need.high)
                slack = ROUNDING * (1 + min(abs(least), LONG)), ROUNDING * (1 + min(abs(most), LONG))
                meets |= (high[a] >= least - slack[0]) & (low[a] <= most + slack[1])
            at = np.flatnonzero(wanted & meets)
        else:
            at = np.arange(len(ids))
        if not len(at):
            continue
        q = anchor.astype(np.float64)
        if np.abs(q).sum() <= PLAIN and plain[at].all():
            score = np.rint(points[at] @ q).astype(np.int64)
        else:
            score = _exact(rows[at], anchor)
        low[a, at] = high[a, at] = score
        fit = wanted[at]
        for need in needs[a]:
            need.offer(ids[at][fit], score[fit])


def _mine(block, same_label: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(anchor, need, anchor_id, positive_id, vec_id, positive_score, score): a task's best rows for each need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, needs = block.value
        needs = [[Need(w.low, w.high, w.k, w.positive_id, w.positive_score) for w in own] for own in needs]
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK):
                part = batch.slice(i, CHUNK)
                rows = np.asarray(part.column(2).flatten(), np.int64).reshape(part.num_rows, tree.vectors.shape[1])
                _walk(tree, needs, same_label, np.asarray(part.column(0)), np.asarray(part.column(1)), rows)
        found = [(a, w, tree.ids[a], need, i) for a, own in enumerate(needs) for w, need in enumerate(own) for i in range(len(need.ids))]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int64()),
                pa.array([f[3].positive_id for f in found], pa.int64()), pa.array([f[3].ids[f[4]] for f in found], pa.int64()),
                pa.array([f[3].positive_score for f in found], pa.int64()), pa.array([f[3].scores[f[4]] for f in found], pa.int64()),
            ],
            names=["anchor", "need", "anchor_id", "positive_id", "vec_id", "positive_score", "score"],
        )

    return run


MINED = "anchor int, need int, anchor_id bigint, positive_id bigint, vec_id bigint, positive_score bigint, score bigint"


def _best(every: DataFrame, tree: Tree, needs: list[list[Need]], same_label: bool, k: int, use: Callable[[DataFrame], object]) -> object:
    """What ``use`` makes of the k best rows of each need, with their ``rank``; the broadcast is gone afterwards."""
    sent = every.sparkSession.sparkContext.broadcast((tree, needs))
    order = Window.partitionBy("anchor", "need").orderBy(F.desc("score"), "vec_id")
    found = every.mapInArrow(_mine(sent, same_label), MINED).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = use(found)
    sent.destroy()
    return out


def hard_negatives(
    df: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, percent: tuple[int, int] = (30, 90),
    key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256, block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score.

    For every row that ``is_anchor`` names, its ``positives`` best other rows of the same label, and
    for each of them the ``negatives`` best rows of another label whose score lies between the two
    percentages of the positive's. A score is the inner product of ``floor(scale * x)``; equal scores
    go by the smaller id. With fewer rows all are returned; a positive without negatives has no row.

    Keys are integers, labels numbers. Rows with a null key, label or vector, or a component that is
    null or not finite, take no part; neither do rows of another length than the anchor. Rows that
    repeat id, label and vector count once; different rows of one id are different candidates, but
    never positives of each other. Scores beyond a long count as the largest or smallest long.

    Anchors go in blocks of ``block`` rows, each broadcast (a fixed size) with its tree, and each task
    passes on the best rows of each need, at most ``positives * negatives`` an anchor. The rows of a
    block are written before the next one begins. An empty table, or one without anchors, gives no rows.
    """
    spark = df.sparkSession
    rows = df.select(
        col(key).cast("long").alias("id"), col(label).cast("double").alias("label"), quantised(col(vector), scale).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks")
    )
    rows = materialise(rows.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").distinct().withColumn("dim", F.size("v")), "labelled")
    path = scratch_path(spark, "negatives")
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    spark.createDataFrame([], schema).write.parquet(path)
    low, high = percent
    for dim, n in rows.groupBy("dim").agg(F.count_if("asks").alias("n")).where("n > 0").collect():
        every = rows.where(F.col("dim") == dim).select("id", "label", "v")
        blocks = -(-n // block)
        for b in range(blocks):
            asks = rows.where((F.col("dim") == dim) & F.col("asks") & (F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == b)).select("id", "label", "v").collect()
            if not asks:
                continue
            tree = spanning_tree([a.id for a in asks], [a.label for a in asks], np.array([a.v for a in asks], np.int64).reshape(len(asks), dim))
            near = _best(every, tree, [[Need(-np.inf, np.inf, positives)] for _ in asks], True, positives, DataFrame.collect)
            needs: list[list[Need]] = [[] for _ in asks]
            for r in sorted(near, key=lambda r: (r.anchor, r.rank)):
                least, most = -(-low * r.score // 100), high * r.score // 100
                if least <= most:
                    needs[r.anchor].append(Need(least, most, negatives, r.vec_id, r.score))

            def write(found: DataFrame) -> None:
                found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)

            if any(needs):
                _best(every, tree, needs, False, negatives, write)
    release(rows)
    return spark.read.schema(schema).parquet(path)
