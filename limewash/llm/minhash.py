"""Near-duplicate documents by b-bit MinHash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limewash.llm.common import col, fresh
from limewash.llm.components import components
from limewash.llm.words import SPACED, U, mix, small_batches, windows, words_of
from limewash.session import materialise, release

SHINGLE = 5
BANDS, ROWS, BITS = 32, 4, 2
HASHES = BANDS * ROWS
#: Pairs whose estimate is lower are not compared in full. At a similarity of 0.75 the estimate of
#: 128 codes of two bits has a standard deviation of 0.046, so this is more than five of them away.
CUT = 0.5
#: Members of a band's bucket that meet in one task.
ROOM = 4096
#: Documents compared with one centre by one task.
SPAN = 256
#: Shingles that a block of documents holds in memory.
BLOCK_SHINGLES = 2_000_000
#: Documents of a cluster that one task compares with a block.
SLICE = 512

_random = np.random.default_rng(20240607)
_XOR = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64) * U(2) + _random.integers(0, 2, HASHES, dtype=np.uint64)
_MUL = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64) * U(2) + U(1)
_EVEN = U(0x5555555555555555)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and where each begins."""
    words = words_of(texts, SPACED)
    grams = windows(words.hashes, size)
    out, at = [], [0]
    for a, b in zip(words.first[:-1], words.first[1:]):
        n = b - a
        own = np.unique(grams[a : b - size + 1]) if n >= size else windows(words.hashes[a:b], int(n)) if n else grams[:0]
        out.append(own)
        at.append(at[-1] + len(own))
    return np.concatenate(out) if out else np.zeros(0, U), np.asarray(at)


def signatures(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sets that are not empty: fingerprints (n x 2), band keys (n x BANDS) and packed codes
    (n x 4 words: BITS low bits of each minimum)."""
    starts = at[:-1]
    minima = np.empty((len(starts), HASHES), U)
    for k in range(HASHES):
        minima[:, k] = np.minimum.reduceat((hashes ^ _XOR[k]) * _MUL[k], starts)
    prints = np.stack([np.add.reduceat(mix(hashes), starts), np.bitwise_xor.reduceat(mix(hashes ^ _XOR[0]), starts)], 1)
    keys = np.empty((len(starts), BANDS), U)
    for b in range(BANDS):
        key = np.full(len(starts), U(b + 1))
        for r in range(ROWS):
            key = mix(key ^ minima[:, b * ROWS + r])
        keys[:, b] = key
    codes = (mix(minima.ravel()) & U(3)).reshape(len(starts), HASHES // 32, 32)
    packed = (codes << (U(2) * np.arange(32, dtype=U))).sum(axis=2, dtype=U)
    return prints, keys, packed


def similarity(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity estimates of packed codes: the share of equal codes, less what chance makes equal."""
    differ = x ^ y
    unequal = np.bitwise_count((differ | (differ >> U(1))) & _EVEN).sum(axis=-1, dtype=np.int64)
    chance = 1 / (1 << BITS)
    return ((1 - unequal / HASHES) - chance) / (1 - chance)


def sketch(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, n_shingles, print1, print2, bands, codes) of every row; nulls for a row without words."""
    schema = "id bigint, n_shingles bigint, print1 bigint, print2 bigint, bands array<bigint>, codes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            hashes, at = shingle_sets(batch.column(1))
            n = np.diff(at)
            full = np.flatnonzero(n)
            none = n == 0
            if len(full):
                prints, keys, packed = signatures(hashes, np.append(at[:-1][full], at[-1]))
            else:
                prints, keys, packed = np.zeros((0, 2), U), np.zeros((0, BANDS), U), np.zeros((0, 4), U)
            row = np.full(len(n), 0)
            row[full] = np.arange(len(full))

            def spread(values):
                return pa.array(values.view(np.int64)[row] if len(full) else np.zeros(len(n), np.int64), pa.int64(), mask=none)

            bands = pa.array([None if none[i] else keys[row[i]].view(np.int64) for i in range(len(n))], pa.list_(pa.int64()))
            codes = pa.array([None if none[i] else packed[row[i]].tobytes() for i in range(len(n))], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), spread(prints[:, 0].copy()), spread(prints[:, 1].copy()), bands, codes],
                names=["id", "n_shingles", "print1", "print2", "bands", "codes"],
            )

    return df.select(col(key).cast("long").alias("id"), col(text).alias("text")).mapInArrow(run, schema)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each value of the first ``keys`` columns, which come one after the other."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is not None and last != tuple(c[0] for c in columns)
        cuts = [0, *np.flatnonzero(change), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if change[a] and held:
                yield pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def _codes(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), U).reshape(-1, HASHES // 32)


def _pairs(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (zip(*parts) if parts else ((), ())))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"])


def _stars(cut: float):
    """Within each (bucket, part): likely similar members b of a centre a, which is the bucket's least
    member or the member nearest to the majority of the part's bits. ``parts`` is the power of two
    that deals all partners the bucket may hold for its centre in some ``SPAN`` each."""

    def centred(found: list[tuple[int, np.ndarray, int]]) -> pa.RecordBatch:
        n = [len(f[1]) for f in found]
        others = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        centres, parts = (np.repeat(np.array([f[k] for f in found], np.int64), n) for k in (0, 2))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (centres, others, parts)], names=["a", "b", "parts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list = []
        for group in _runs(batches, 2):
            ids, codes = np.asarray(group.column("id")), _codes(group.column("codes"))
            hub, hub_codes = group.column("hub")[0].as_py(), _codes(group.column("hub_codes")[:1])
            bits = np.unpackbits(codes.view(np.uint8), axis=1)
            major = np.packbits(bits.sum(axis=0) * 2 > len(ids)).view(U)
            near = int(np.argmin(np.bitwise_count(codes ^ major).sum(axis=1)))
            for centre, own, reach in ((hub, hub_codes, group.column("n")[0].as_py()), (int(ids[near]), codes[near : near + 1], len(ids))):
                alike = (similarity(codes, own) >= cut) & (ids != centre)
                found.append((centre, ids[alike], 1 << max(0, -(-reach // SPAN) - 1).bit_length()))
            if len(found) > 1000:
                yield centred(found)
                found = []
        yield centred(found)

    return run


def _ties(cut: float):
    """Within each (bucket, block, part): pairs of likely similar members of different components, one
    of them of the block of outsiders (kind 0) and one of the part (kind 1), such that every member
    that has such a partner is in one, and that they connect whatever components all such pairs connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, 3):
            ids, codes, comps = np.asarray(group.column("id")), _codes(group.column("codes")), np.asarray(group.column("component"))
            sides = [np.flatnonzero(np.asarray(group.column("kind")) == kind) for kind in (0, 1)]
            _, comp = np.unique(comps, return_inverse=True)
            label = np.arange(comp.max() + 1)
            found: list[tuple[int, int]] = []
            for own, others in (sides, sides[::-1]):
                for x in range(0, len(own), 256):
                    at = own[x : x + 256]
                    alike = similarity(codes[at][:, None, :], codes[others][None, :, :]) >= cut
                    alike &= comp[at][:, None] != comp[others][None, :]
                    for k in np.flatnonzero(alike.any(axis=1)):
                        partners = others[alike[k]]
                        labels, first = np.unique(label[comp[partners]], return_index=True)
                        mine = label[comp[at[k]]]
                        new = labels != mine
                        found += [(ids[at[k]], ids[p]) for p in (partners[first[new]] if new.any() else partners[:1])]
                        label[np.isin(label, labels)] = mine
            yield _pairs([(np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64))])

    return run


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted sets have in common."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    if not len(small):
        return 0
    place = np.searchsorted(large, small)
    return int((large[np.minimum(place, len(large) - 1)] == small).sum())


def _linked(x: np.ndarray, y: np.ndarray, least: int) -> bool:
    both = _shared(x, y)
    return both > 0 and 100 * both >= least * (len(x) + len(y) - both)


def _meet(cut: float, least: int):
    """Within each (cluster, block): links between the block's documents (kind 0, which come first)
    and all documents of the cluster (kind 1), as many as join components that are still apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, []
        joined: dict[int, int] = {}

        def find(c: int) -> int:
            while joined.get(c, c) != c:
                joined[c] = c = joined.get(joined[c], joined[c])
            return c

        for batch in small_batches(batches, "text"):
            cluster, part, kind, ids, comps, codes = (batch.column(k) for k in range(6))
            hashes, at = shingle_sets(batch.column(6))
            codes, ids, comps = _codes(codes), np.asarray(ids), np.asarray(comps)
            keys = list(zip(cluster.to_pylist(), part.to_pylist()))
            kinds = np.asarray(kind)
            cuts = [0, *[k for k in range(1, len(keys)) if keys[k] != keys[k - 1]], len(keys)]
            found: list[tuple[int, int]] = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if keys[a] != now:
                    now, block, joined = keys[a], [], {}
                for k in range(a, b):
                    if kinds[k] == 0:
                        block.append((int(ids[k]), int(comps[k]), codes[k], hashes[at[k] : at[k + 1]].copy()))
                others = np.arange(a, b)[kinds[a:b] == 1]
                for x in range(0, len(block), 256):
                    some = block[x : x + 256]
                    alike = similarity(np.stack([s[2] for s in some])[:, None, :], codes[others][None, :, :])
                    i, j = np.nonzero((alike >= cut) & (np.array([s[1] for s in some])[:, None] != comps[others][None, :]))
                    for k in np.argsort(-alike[i, j], kind="stable"):
                        own, other = some[i[k]], others[j[k]]
                        p, q = find(own[1]), find(int(comps[other]))
                        if p != q and _linked(own[3], hashes[at[other] : at[other + 1]], least):
                            joined[max(p, q)] = min(p, q)
                            found.append((own[0], int(ids[other])))
            yield _pairs([(np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64))])

    return run


def _verify(least: int):
    """Exact check of (centre, part, kind, id, text): kind 0 is the centre, then those to compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []
        for batch in small_batches(batches, "text"):
            hashes, at = shingle_sets(batch.column(4))
            found: list[tuple[int, int]] = []
            for k, (a, part, kind, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
                mine = hashes[at[k] : at[k + 1]]
                if now != (a, part):
                    now, own = (a, part), []
                if kind == 0:
                    own.append(mine.copy())
                    continue
                if any(_linked(mine, other, least) for other in own):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """The pairs whose full shingle sets are similar enough. A centre ``a`` is sent once for each of
    its ``parts`` (a power of two) that holds partners; no task sees all partners of a centre."""
    # Parts of different powers of two keep apart: those of 2 ** k have the numbers from 2 ** k on.
    parted = pairs.select("a", "b", (F.col("parts") + F.pmod(F.xxhash64("b"), "parts")).alias("part"))
    # Both uses of the texts share one join.
    wanted = parted.select("a", "part", F.lit(1).alias("kind"), F.col("b").alias("who")).unionByName(
        parted.select("a", "part", F.lit(0).alias("kind"), F.col("a").alias("who")).distinct()
    )
    rows = wanted.join(texts, F.col("who") == F.col("id")).select("a", "part", "kind", "who", "text")
    return rows.repartition("a", "part").sortWithinPartitions("a", "part", "kind").mapInArrow(_verify(least), "a bigint, b bigint")


def _across(near: DataFrame, first: DataFrame, sets: DataFrame, texts: DataFrame, cut: float, least: int) -> DataFrame:
    """Links between components. Clusters are components that ``near`` ties together. All documents
    of a cluster that have a likely partner in another component are read next to a block of those
    outside its largest component; a block's sets hold some ``BLOCK_SHINGLES``, and a large cluster
    passes it in slices of some ``SLICE`` documents, each in a task of its own."""
    ids = near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))).distinct()
    ids = ids.join(first.withColumnRenamed("node", "m"), F.col("id") == F.col("m"), "left").select("id", F.coalesce("component", "id").alias("component"))
    ids = materialise(ids, "members")
    clusters = components(near.unionByName(ids.select(F.col("id").alias("a"), F.col("component").alias("b"))))
    clusters = clusters.select(F.col("node").alias("c"), F.col("component").alias("cluster"))
    sizes = sets.select(F.col("id").alias("s"), "n_shingles", F.col("s.codes").alias("codes"))
    ids = materialise(
        ids.join(clusters, F.col("id") == F.col("c")).join(sizes, F.col("id") == F.col("s")).select("cluster", "id", "component", "codes", "n_shingles"), "members"
    )
    main = ids.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("cluster").alias("k")).agg(F.max_by("component", "n").alias("main"))
    outside = ids.join(main, F.col("cluster") == F.col("k")).where("component <> main")
    blocks = outside.groupBy(F.col("cluster").alias("o")).agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    slices = ids.groupBy(F.col("cluster").alias("l")).agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))
    cuts = blocks.join(slices, F.col("o") == F.col("l")).select("o", "blocks", "slices")
    named = ["cluster", "block", "kind", "id", "component", "codes"]
    block, slice_ = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("slices")).cast("int")
    own = outside.join(cuts, F.col("cluster") == F.col("o")).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    own = own.withColumns({"block": block * F.col("slices") + F.col("at"), "kind": F.lit(0)})
    every = ids.join(cuts, F.col("cluster") == F.col("o")).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    every = every.withColumns({"block": F.col("at") * F.col("slices") + slice_, "kind": F.lit(1)})
    wanted = own.select(*named).unionByName(every.select(*named))
    rows = wanted.join(texts.withColumnRenamed("id", "t"), F.col("id") == F.col("t")).select(*named, "text")
    return (
        rows.repartition("cluster", "block").sortWithinPartitions("cluster", "block", "kind").mapInArrow(_meet(cut, least), "a bigint, b bigint")
    )


def _meetings(named: DataFrame) -> DataFrame:
    """Of ``named`` (bucket, part, id, codes, n, component): the rows (bucket, block, part, kind, ...) of
    all buckets with several components. Members outside the component that has most members come in
    blocks of some ``ROOM`` (kind 0) to every part, and every member (kind 1) to every such block, so
    one stray member of a bucket adds no more rows than the bucket has members."""
    counts = materialise(named.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("held")), "mixed")
    mixed = counts.groupBy(F.col("bucket").alias("k")).agg(
        F.max_by("component", F.struct("held", "component")).alias("main"), (F.sum("held") - F.max("held")).alias("outsiders")
    )
    mixed = mixed.where("outsiders > 0").withColumn("blocks", F.ceil(F.col("outsiders") / ROOM).cast("int"))
    rows = named.join(mixed, F.col("bucket") == F.col("k"))
    parts = F.ceil(F.col("n") / ROOM).cast("int")
    outside = rows.where("component <> main").withColumn("block", F.pmod(F.xxhash64("id", F.lit(2)), "blocks").cast("int"))
    outside = outside.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("kind", F.lit(0))
    inside = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("kind", F.lit(1))
    met = ["bucket", "block", "part", "kind", "id", "codes", "component"]
    return outside.select(*met).unionByName(inside.select(*met))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 75, cut: float = CUT) -> DataFrame:
    """Per row of ``df``: ``key``, n_shingles, component_id (the least key that can be reached over
    links, the row's own included) and kept (whether that is the row's own key).

    A link joins two documents whose sets of distinct word 5-shingles have a Jaccard similarity of
    at least ``least`` percent; every link is confirmed on the full sets. Fewer than five words are
    one shingle; a document without words (null, empty, white space) has an empty set and no link.
    Rows of a null key are linked with nothing and kept. Repeated rows share a component; rows of one
    key and different texts count as one document that has the links of each. No rows give no rows.

    Equal sets are one candidate. Candidates are those that share one of 32 bands of 4 minima and
    whose packed 2-bit codes give a corrected estimate of at least ``cut``. At a similarity of 0.75 a
    pair shares no band with probability 5e-6. Large buckets are searched in two rounds: first every
    member is compared with its bucket's least member and with the one nearest to the majority; then
    documents outside the main component of such a cluster are read, block by block, next to all of
    it, and only those still apart are compared. So a group of alike documents never gives all its
    pairs as rows. In the first round the partners of a centre are dealt over tasks, and of a bucket
    whose members belong to several components only those outside its main one meet all others.
    """
    sketched = materialise(sketch(df, key, text), "sketches")
    full = sketched.where("n_shingles > 0 AND id IS NOT NULL")
    sets = materialise(
        full.groupBy("print1", "print2", "n_shingles").agg(F.min_by(F.struct("bands", "codes"), "id").alias("s"), F.min("id").alias("id")),
        "sets",
    )
    rows = sets.select("id", F.explode("s.bands").alias("bucket"), F.col("s.codes").alias("codes"))
    buckets = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("hub")).where("n > 1")
    shared = materialise(
        rows.join(buckets.withColumnRenamed("bucket", "k"), F.col("bucket") == F.col("k")).select(
            "bucket", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / ROOM)).cast("int").alias("part"), "id", "codes", "hub", "n",
        ),
        "buckets",
    )
    hubs = shared.where("id = hub").groupBy(F.col("bucket").alias("k")).agg(F.first("codes").alias("hub_codes"))
    members = shared.join(hubs, F.col("bucket") == F.col("k"))
    stars = (
        members.select("bucket", "part", "id", "codes", "hub", "hub_codes", "n")
        .repartition("bucket", "part").sortWithinPartitions("bucket", "part")
        .mapInArrow(_stars(cut), "a bigint, b bigint, parts bigint")
    )
    stars = stars.groupBy("a", "b").agg(F.max("parts").alias("parts"))
    tested = materialise(stars, "pairs")
    candidates = shared.select("id").distinct().withColumnRenamed("id", "c")
    texts = df.select(col(key).cast("long").alias("id"), col(text).alias("text")).join(candidates, F.col("id") == F.col("c"), "left_semi")
    texts = materialise(texts, "texts")
    links = materialise(_confirmed(tested, texts, least), "confirmed")
    first = materialise(components(links), "components")
    named = shared.join(first.withColumnRenamed("node", "m"), F.col("id") == F.col("m"), "left").withColumn(
        "component", F.coalesce("component", "id")
    )
    meetings = _meetings(named).repartition("bucket", "block", "part").sortWithinPartitions("bucket", "block", "part")
    near = materialise(meetings.mapInArrow(_ties(cut), "a bigint, b bigint").distinct(), "near")
    more = materialise(_across(near, first, sets, texts, cut, least), "confirmed")
    reps = full.select("id", "n_shingles", "print1", "print2").join(
        sets.select("print1", "print2", "n_shingles", F.col("id").alias("rep")), ["print1", "print2", "n_shingles"]
    ).select("id", "n_shingles", "rep")
    several = reps.groupBy(F.col("id").alias("i")).agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi")
    tied = reps.join(several, F.col("id") == F.col("i")).select(F.col("rep").alias("a"), F.col("lo").alias("b"))
    final = components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more).unionByName(tied))
    found = reps.join(final, F.col("rep") == F.col("node"), "left").select("id", "n_shingles", F.coalesce("component", "rep").alias("component"))
    alone = sketched.where("n_shingles = 0 OR id IS NULL").select("id", "n_shingles", F.col("id").alias("component"))
    out = found.unionByName(alone)
    return out.select(
        F.col("id").alias(key), "n_shingles", F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``df`` with one document of each component: the one of the least key, and of rows that repeat
    that key the one of the least text. Rows of a null key all stay. Same columns."""
    own, n = fresh("kept"), fresh("rows")
    judged = near_duplicates(df, key, text, **options).where(F.col("kept") & col(key).isNotNull())
    kept = judged.groupBy(col(key).alias(own)).agg(F.count(F.lit(1)).alias(n))
    names = [col(c) for c in df.columns]
    rows = df.join(kept, col(key) == F.col(own))
    once = rows.where(F.col(n) == 1).select(*names)
    least = rows.where(F.col(n) > 1).groupBy(own).agg(F.min(F.struct(F.coalesce(col(text), F.lit("")), F.struct(*names))).alias("r"))
    return once.unionByName(least.select(*[F.col("r").getField("col2").getField(c).alias(c) for c in df.columns])).unionByName(
        df.where(col(key).isNull())
    )
