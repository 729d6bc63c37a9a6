"""Weighted rendezvous hashing of stable record keys over shards."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limewash.llm.common import col, fresh, numbered


def _draw(key: Column, shard: int) -> Column:
    """A uniform number in (0, 1) from key and shard: 53 bits of their hash."""
    return (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def best_shard(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard of the smallest draw of an exponential variable with the shard's weight as rate.

    A shard wins with a probability in proportion to its weight. Every shard draws on its own, so a
    new shard or a larger weight only takes keys for itself, and the keys of a removed shard are
    the only ones that move.
    """
    draws = [
        F.struct((-F.log(_draw(key, s)) / F.lit(float(w))).alias("draw"), F.lit(int(s)).alias("shard"))
        for s, w in weights.items()
    ]
    return F.array_min(F.array(*draws))


def shard(
    df: DataFrame,
    key: str,
    weights: Mapping[int, float] | int,
    grown: Mapping[int, float] | None = None,
    shard_col: str = "shard",
    slot_col: str | None = "slot",
    grown_col: str = "grown_shard",
) -> DataFrame:
    """Give every row a shard by its key, and a slot in the shard (0, 1, 2, ... without gaps).

    ``weights`` maps shards to positive weights; a number n stands for shards 0 to n - 1 of one
    weight. ``grown`` are shards that may be added later: ``grown_col`` tells where the row would
    go then (left out without ``grown``).

    Only the key decides: equal keys share a shard, and so do all null keys. Repeated rows are kept
    and get slots of their own (equal rows are counted, so columns must be of types that can be
    grouped). No rows give no rows. New columns replace columns of their names.
    """
    if isinstance(weights, int):
        weights = {s: 1.0 for s in range(weights)}
    if not weights or any(not w > 0 for w in [*weights.values(), *(grown or {}).values()]):
        raise ValueError("shards need positive weights")
    new = [shard_col] + ([slot_col] if slot_col else []) + ([grown_col] if grown else [])
    df = df.drop(*[c for c in df.columns if c in new and c != key])
    now, later = fresh("now"), fresh("later")
    out = df.withColumn(now, best_shard(col(key), weights))
    if grown:
        out = out.withColumn(later, best_shard(col(key), grown))
        out = out.withColumn(grown_col, F.array_min(F.array(col(now), col(later)))["shard"])
    out = out.withColumn(shard_col, col(now)["shard"]).drop(now, later)
    return numbered(out, shard_col, slot_col) if slot_col else out


def write_shards(sharded: DataFrame, path: str, shard_col: str = "shard", slot_col: str = "slot", rows_per_file: int = 1_000_000) -> None:
    """Write one folder per shard, in files of at most ``rows_per_file`` rows in slot order."""
    piece = fresh("piece")
    (
        sharded.withColumn(piece, F.floor(col(slot_col) / rows_per_file))
        .repartition(col(shard_col), col(piece))
        .drop(piece)
        .sortWithinPartitions(shard_col, slot_col)
        .write.option("maxRecordsPerFile", rows_per_file)
        .partitionBy(shard_col)
        .parquet(path)
    )
