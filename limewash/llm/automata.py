"""Removal of word sequences that stand in an earlier document, by suffix automata.

A window of ``LENGTH`` words goes if it also starts in a document of a smaller key. The documents are
their own reference, which grows with them, so it is cut into shards whose windows can only match one
another, and each shard's automaton is built where the shard is dealt to:

1. Every window picks its anchor, the leftmost of its least GRAM-word strings; equal windows pick
   equal anchors. Windows of one anchor in a row are a unit. Units meet by their anchor: a shard is
   what shares one. A unit that equals one of an earlier document is a repeat; the earliest documents
   of each different unit stay as the reference.
2. Their words go through the shard's automaton in the order of the documents: a unit is streamed
   through the automaton of all smaller documents first, and the matching statistics (the longest
   suffix at each word that stands in the reference) tell which windows are repeats. Then its words
   are added.
3. The repeats go back to the documents, which drop the words covered.

Anchors that very many documents share are told from a sample of the documents. Their windows meet
one by one, and the windows that very many documents share do not travel: the least document that
has them, found by an aggregation, is broadcast. The sample steers only the way a window goes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limewash.llm.common import col, fresh
from limewash.llm.words import AS_IS, SPACED, U, Words, kept_words, mix, owners, small_batches, windows, words_of
from limewash.session import materialise, release

LENGTH = 13
GRAM = 6
#: Grams of a window; a power of two.
SPAN = LENGTH - GRAM + 1
#: One of so many documents is looked at to find hot anchors and windows.
SAMPLE = 32
#: Documents of the sample that make an anchor or a window hot, and how many hot ones are broadcast at most.
HOT, HOTTEST = 32, 20_000
#: Units that one automaton holds; the windows of a larger shard meet by their hash.
ROOM = 10_000
#: Rows of one anchor that are compared at once.
HELD = 500_000
#: Bytes of text that one step of a scan holds, one text at least.
STEP = 1 << 19
_A, _B, _C = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)


class Automaton:
    """Suffix automaton of word sequences that are added one after the other."""

    def __init__(self) -> None:
        self.steps: list[dict] = [{}]
        self.link = [-1]
        self.size = [0]

    def _state(self, steps: dict, link: int, size: int) -> int:
        self.steps.append(steps)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def _split(self, p: int, word) -> int:
        """The state of what p reads with ``word``: its own, cut out of a longer one where needed."""
        q = self.steps[p][word]
        if self.size[q] == self.size[p] + 1:
            return q
        clone = self._state(dict(self.steps[q]), self.link[q], self.size[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.steps[p].get(word) == q:
            self.steps[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list) -> None:
        at = 0
        for word in words:
            if word in self.steps[at]:
                at = self._split(at, word)
                continue
            new, p = self._state({}, 0, self.size[at] + 1), at
            while p >= 0 and word not in self.steps[p]:
                self.steps[p][word] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, word)
            at = new

    def statistics(self, words: list) -> list[int]:
        """For each word the length of the longest string that ends there and stands in what was added."""
        at = length = 0
        out = []
        for word in words:
            while at and word not in self.steps[at]:
                at = self.link[at]
                length = self.size[at]
            if word in self.steps[at]:
                at = self.steps[at][word]
                length += 1
            out.append(length)
        return out


@dataclass
class Units:
    """Windows of several texts, those of one anchor in a row together."""

    words: Words
    owner: np.ndarray
    begin: np.ndarray  # start of the first window
    last: np.ndarray  # start of the last window
    anchor: np.ndarray
    context: np.ndarray  # hash of all words and of the place of the anchor
    whole: np.ndarray  # hash of the window at each word
    hot: np.ndarray  # starts of windows that are broadcast, and for each
    least: np.ndarray  # the least document that has it

    def key(self) -> np.ndarray:
        return mix(self.anchor + mix(self.context))


def _place(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are in the sorted table, and where."""
    at = np.searchsorted(table, values)
    found = at < len(table)
    found[found] = table[at[found]] == values[found]
    return found, at


def units_of(texts: pa.Array, anchors: np.ndarray, hot: np.ndarray, least: np.ndarray) -> Units:
    """``anchors`` and ``hot`` are sorted hashes of hot anchors and hot windows, ``least`` goes with the latter."""
    words = words_of(texts, SPACED, AS_IS)
    none = np.zeros(0, np.int64)
    if len(words.hashes) < LENGTH:
        return Units(words, none, none, none, np.zeros(0, U), np.zeros(0, U), np.zeros(0, U), none, none)
    grams, whole = windows(words.hashes, GRAM), windows(words.hashes, LENGTH)
    own = owners(words.first)
    start = np.flatnonzero(np.arange(len(whole)) + LENGTH <= words.first[1:][own[: len(whole)]])
    best, n = np.arange(len(grams)), 1
    while n < SPAN:  # the leftmost least gram of each window
        x, y = best[:-n], best[n:]
        best = np.where(grams[x] <= grams[y], x, y)
        n *= 2
    place = best[start]
    cut = np.flatnonzero(np.append(True, place[1:] != place[:-1]))[: len(start)]
    begin, last, place = start[cut], start[np.append(cut[1:], len(start))[: len(cut)] - 1], place[cut]
    anchor = grams[place]
    context = mix(whole[begin] * _A + whole[last] * _B + (place - begin).astype(U) * _C + (last - begin).astype(U))
    alone, _ = _place(anchors, anchor)
    if alone.any():
        size = (last - begin + 1)[alone]
        single = np.repeat(begin[alone] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        known, at = _place(hot, whole[single])
        shared, least = single[known], least[at[known]]
        single = single[~known]
        begin, last = np.append(begin[~alone], single), np.append(last[~alone], single)
        anchor, context = np.append(anchor[~alone], whole[single]), np.append(context[~alone], whole[single])
    else:
        shared, least = none, none
    return Units(words, own[begin], begin, last, anchor, context, whole, shared, least)


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64), pa.int64())


def _ids(batch: pa.RecordBatch, n: int, rows: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.asarray(batch.column(k))[rows]) for k in range(n)]


@dataclass
class Plan:
    """What all scans of the documents share. The first ``ids`` columns say which document a row is:
    the key, and a hash of the text where a key has several rows. The last one is the text."""

    ids: list[str]
    anchors: np.ndarray
    hot: np.ndarray
    least: np.ndarray

    def units(self, batch: pa.RecordBatch, column: int) -> Units:
        return units_of(batch.column(column), self.anchors, self.hot, self.least)


def _scan(shared, take: Callable[[Plan, Units, pa.RecordBatch], pa.RecordBatch]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for whole in batches:
            at = whole.schema.get_field_index("text")
            for batch in small_batches([whole], "text", STEP):
                yield take(plan, plan.units(batch, at), batch)

    return run


def _anchors_seen(plan: Plan, units: Units, batch: pa.RecordBatch) -> pa.RecordBatch:
    """Each anchor once for each text."""
    pair = np.unique(np.stack([units.owner.astype(U), units.anchor]), axis=1) if len(units.owner) else np.zeros((2, 0), U)
    return pa.RecordBatch.from_arrays([_longs(pair[1])], names=["h"])


def _windows_seen(plan: Plan, units: Units, batch: pa.RecordBatch) -> pa.RecordBatch:
    """Windows of hot anchors, each once for each text."""
    at = np.flatnonzero(units.anchor == units.context)
    pair = np.unique(np.stack([units.owner[at].astype(U), units.anchor[at]]), axis=1) if len(at) else np.zeros((2, 0), U)
    return pa.RecordBatch.from_arrays([_longs(pair[1])], names=["h"])


def _hot_owners(plan: Plan, units: Units, batch: pa.RecordBatch) -> pa.RecordBatch:
    """Hot windows and the least document of the batch that has each."""
    doc = np.asarray(batch.column(0))[np.searchsorted(units.words.first, units.hot, "right") - 1]
    h = units.whole[units.hot]
    order = np.lexsort((doc, h))
    new = np.append(True, h[order][1:] != h[order][:-1])[: len(h)]
    return pa.RecordBatch.from_arrays([_longs(h[order][new]), pa.array(doc[order][new], pa.int64())], names=["h", "doc"])


def _sent(plan: Plan, units: Units, batch: pa.RecordBatch) -> pa.RecordBatch:
    """(anchor, context, document) of the units, each once for each text."""
    _, at = np.unique(mix(units.key() + units.owner.astype(U)), return_index=True)
    return pa.RecordBatch.from_arrays(
        [_longs(units.anchor[at]), _longs(units.context[at]), *_ids(batch, len(plan.ids), units.owner[at])], names=["anchor", "context", *plan.ids]
    )


#: Marks: of a repeated unit all windows go (first is null), of a wanted one the words are asked for.
REPEATED, WANTED = 0, 1


def _compare(ids: list[str]):
    """From units in the order of (anchor, context, document): REPEATED for those of a later document,
    WANTED for those of the least document of each context where an anchor has several."""

    def marks(rows: list[np.ndarray], all_wanted: bool) -> pa.RecordBatch:
        anchor, context, doc = rows[:3]
        new_anchor = np.append(True, anchor[1:] != anchor[:-1])
        new = new_anchor | np.append(True, context[1:] != context[:-1])
        first = np.flatnonzero(new)
        least = doc[first][np.cumsum(new) - 1]
        of = np.cumsum(new_anchor) - 1
        cuts = np.flatnonzero(new_anchor)
        low, high = np.minimum.reduceat(least, cuts), np.maximum.reduceat(least, cuts)
        again = ~new
        for r in rows[2:]:
            again[1:] &= r[1:] == r[:-1]
        repeated = np.flatnonzero((doc > least) & ~again)
        wanted = np.flatnonzero((doc == least) & ~again & ((low < high)[of] | all_wanted))
        at = np.append(repeated, wanted)
        key = mix(anchor.view(U)[at] + mix(context.view(U)[at]))
        kind = np.repeat(np.array([REPEATED, WANTED], np.int32), [len(repeated), len(wanted)])
        return pa.RecordBatch.from_arrays([*(pa.array(r[at]) for r in rows[2:]), _longs(key), pa.array(kind)], names=[*ids, "key", "kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        cut_before = False  # some rows of the held anchor are done
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.asarray(c) for c in batch.columns]
            if held is not None:
                rows = [np.append(h, r) for h, r in zip(held, rows)]
            done = int(np.searchsorted(rows[0], rows[0][-1]))  # signed, as Spark sorts
            if done:
                yield marks([r[:done] for r in rows], cut_before)
                cut_before = False
            held = [r[done:] for r in rows]
            if len(held[0]) > HELD:
                # The rest of the anchor needs the first row of its last context only.
                yield marks(held, True)
                at = int(np.flatnonzero(held[1] == held[1][-1])[0])
                held, cut_before = [r[at : at + 1] for r in held], True
        if held is not None and len(held[0]):
            yield marks(held, cut_before)

    return run


def _found(units: Units, rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in ``keys``, unit) of the units of row ``rows[i]`` with the key ``keys[i]``."""
    have = mix(units.key() + units.owner.astype(U))
    order = np.argsort(have, kind="stable")
    want = mix(keys.view(U) + rows.astype(U))
    a, b = (np.searchsorted(have[order], want, side) for side in ("left", "right"))
    pair = np.repeat(np.arange(len(want)), b - a)
    within = np.arange(len(pair)) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
    return pair, order[a[pair] + within]


def _contexts(plan: Plan, units: Units, batch: pa.RecordBatch) -> pa.RecordBatch:
    """(anchor, document, key, words) of the units that are asked for."""
    n = len(plan.ids)
    asked = batch.column(n + 1)
    row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(asked.offsets)))
    keys = np.asarray(asked.flatten())
    pair, unit = _found(units, row, keys)
    pair, at = np.unique(pair, return_index=True)  # one of equal units of a text is enough
    unit = unit[at]
    size = units.last[unit] - units.begin[unit] + LENGTH
    end = np.cumsum(size)
    word = np.repeat(units.begin[unit] - (end - size), size) + np.arange(int(size.sum()))
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, end), pa.int32()), _longs(units.words.hashes[word]))
    return pa.RecordBatch.from_arrays(
        [_longs(units.anchor[unit]), *_ids(batch, n, row[pair]), pa.array(keys[pair], pa.int64()), lists], names=["anchor", *plan.ids, "key", "words"]
    )


def _match(ids: list[str]):
    """From (anchor, document, key, words) by anchor and document: (document, key, first, last, h), windows
    of a unit that stand in a smaller document. Of a shard beyond ROOM all windows, with their hash."""
    n = len(ids)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * (n + 4)
        kinds = [pa.int64()] * (n + 1) + [pa.int32()] * 2 + [pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*ids, "key", "first", "last", "h"])

    def matched(shard: list[tuple]) -> Iterator[tuple]:
        automaton, a = Automaton(), 0
        while a < len(shard):
            b = a
            while b < len(shard) and shard[b][0] == shard[a][0]:
                b += 1
            for unit in shard[a:b] if a else ():
                first = None
                for i, length in enumerate([*automaton.statistics(unit[-1])[LENGTH - 1 :], 0]):
                    if length >= LENGTH and first is None:
                        first = i
                    elif length < LENGTH and first is not None:
                        yield (*unit[:-1], first, i - 1, None)
                        first = None
            if b < len(shard):
                for unit in shard[a:b]:
                    automaton.add(unit[-1])
            a = b

    def hashed(shard: list[tuple]) -> Iterator[tuple]:
        for unit in shard:
            for i, h in enumerate(windows(np.array(unit[-1], np.int64).view(U), LENGTH).view(np.int64).tolist()):
                yield (*unit[:-1], i, i, h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard, large, out = None, [], False, []
        for batch in batches:
            anchors = batch.column(0).to_pylist()
            units = list(zip(*(batch.column(k).to_pylist() for k in range(1, n + 3))))
            for anchor, unit in zip(anchors, units):
                if anchor != now:
                    out += hashed(shard) if large else matched(shard)
                    now, shard, large = anchor, [], False
                shard.append(unit)
                if len(shard) > ROOM:
                    out += hashed(shard)
                    shard, large = [], True
                if len(out) > ROOM:
                    yield rows(out)
                    out = []
        out += hashed(shard) if large else matched(shard)
        yield rows(out)

    return run


def _drop(plan: Plan, units: Units, batch: pa.RecordBatch) -> pa.RecordBatch:
    """The columns behind the text, and n_words, the removed stretches and the words that are left."""
    n, words = len(plan.ids), units.words
    marks = batch.column(n + 1)
    row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(marks.offsets)))
    key, first, last = (np.asarray(marks.flatten().field(k).fill_null(-1)) for k in range(3))
    pair, unit = _found(units, row, key)
    whole = first[pair] < 0
    begin = units.begin[unit] + np.where(whole, 0, first[pair])
    end = np.where(whole, units.last[unit], units.begin[unit] + last[pair]) + LENGTH
    doc = np.asarray(batch.column(0))
    shared = units.hot[units.least < doc[np.searchsorted(words.first, units.hot, "right") - 1]]
    change = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(change, np.append(begin, shared), 1)
    np.add.at(change, np.append(end, shared + LENGTH), -1)
    gone = np.cumsum(change)[:-1] > 0
    rise = gone & np.append(True, ~gone[:-1])[: len(gone)]
    fall = gone & np.append(~gone[1:], True)[: len(gone)]
    inner = words.first[1:-1][(words.first[1:-1] > 0) & (words.first[1:-1] < len(gone))]
    rise[inner] = gone[inner]
    fall[inner - 1] = gone[inner - 1]
    a, b = np.flatnonzero(rise), np.flatnonzero(fall)
    bounds = np.searchsorted(a, words.first)
    own = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
    spans = pa.StructArray.from_arrays([pa.array(a - words.first[own], pa.int64()), pa.array(b - a + 1, pa.int64())], ["start", "length"])
    return pa.RecordBatch.from_arrays(
        [
            *batch.columns[n + 2 :], pa.array(np.diff(words.first), pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), spans),
            pa.array([t.decode("utf-8", "replace") for t in kept_words(words, ~gone)], pa.string()),
        ],
        names=[*batch.schema.names[n + 2 :], "n_words", "removed", "kept"],
    )


def _hottest(counted: DataFrame, hot: int, hottest: int) -> np.ndarray:
    rows = counted.groupBy("h").count().where(F.col("count") >= hot).orderBy(F.desc("count"), "h").limit(hottest).collect()
    return np.sort(np.array([r.h for r in rows], np.int64).view(U))


def repeated_windows(df: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, hot: int = HOT, hottest: int = HOTTEST) -> DataFrame:
    """The other columns of ``df``, and for each row ``n_words``, ``removed`` (start and length of the
    word sequences that go) and ``kept`` (the words left, with one space between).

    Words are separated by white space (space and \\t to \\r) and unchanged. A word goes if a window of
    LENGTH words that covers it also starts in a document of a smaller key; what is removed elsewhere
    does not matter. Keys are integers; a null key comes before all others. Rows of one key do not
    remove anything from each other; repeated rows stay, each judged alike. A null or empty text has no
    words, one of fewer than LENGTH loses none. An empty table gives no rows. Columns that are called
    like a result are replaced by it.

    Equal words and windows are those of equal 64-bit hashes; within a shard the automaton compares word
    by word. What is broadcast is bounded: ``hottest`` anchors, and SPAN times as many windows (16 bytes each).
    """
    spark = df.sparkSession
    others = [f for f in df.schema.fields if f.name not in (text, "n_words", "removed", "kept")]
    inner = {f.name: fresh(f"c{i}") for i, f in enumerate(others)}
    doc = F.coalesce(col(key).cast("long"), F.lit(-(2**63)))
    several = df.groupBy(doc.alias("doc")).count().where("count > 1").limit(1).count() > 0
    ids = ["doc", "twin"] if several else ["doc"]
    own = [doc.alias("doc"), *([F.xxhash64(col(text)).alias("twin")] if several else [])]
    body = F.coalesce(col(text), F.lit("")).alias("text")
    rows = df.select(*own, body)
    named = ", ".join(f"{i} bigint" for i in ids)

    context = spark.sparkContext
    none = np.zeros(0, U)

    def shared(anchors: np.ndarray, windows_: np.ndarray, least: np.ndarray):
        return context.broadcast(Plan(ids, anchors, windows_, least))

    part = rows.where(F.pmod(F.xxhash64("doc"), F.lit(sample)) == 0)
    sent = shared(none, none, np.zeros(0, np.int64))
    anchors = _hottest(part.mapInArrow(_scan(sent, _anchors_seen), "h bigint"), hot, hottest)
    sent.destroy()
    common, least = none, np.zeros(0, np.int64)
    if len(anchors):
        sent = shared(anchors, none, least)
        common = _hottest(part.mapInArrow(_scan(sent, _windows_seen), "h bigint"), hot, hottest * SPAN)
        sent.destroy()
    if len(common):
        sent = shared(anchors, common, np.zeros(len(common), np.int64))
        first = dict(rows.mapInArrow(_scan(sent, _hot_owners), "h bigint, doc bigint").groupBy("h").agg(F.min("doc")).collect())
        least = np.array([first[h] for h in common.view(np.int64).tolist()], np.int64)
        sent.destroy()
    plan = shared(anchors, common, least)

    units = rows.mapInArrow(_scan(plan, _sent), f"anchor bigint, context bigint, {named}")
    marks = materialise(
        units.repartition("anchor").sortWithinPartitions("anchor", "context", *ids).mapInArrow(_compare(ids), f"{named}, key bigint, kind int"), "marks"
    )
    asked = marks.where(F.col("kind") == WANTED).groupBy(*ids).agg(F.collect_list("key").alias("keys"))
    contexts = rows.join(asked, ids).select(*ids, "text", "keys").mapInArrow(_scan(plan, _contexts), f"anchor bigint, {named}, key bigint, words array<bigint>")
    found = materialise(
        contexts.repartition("anchor").sortWithinPartitions("anchor", *ids).mapInArrow(_match(ids), f"{named}, key bigint, first int, last int, h bigint"), "matches"
    )
    large = found.where("h IS NOT NULL")
    smallest = large.groupBy("h").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("h", "least")
    late = large.join(smallest, "h").where("doc > least")
    columns = [*ids, "key", "first", "last"]
    repeats = marks.where(F.col("kind") == REPEATED).select(*ids, "key", *(F.lit(None).cast("int").alias(c) for c in ("first", "last")))
    repeats = repeats.unionByName(found.where("h IS NULL").select(columns)).unionByName(late.select(columns))
    repeats = materialise(repeats.groupBy(*ids).agg(F.collect_list(F.struct("key", "first", "last")).alias("marks")), "repeats")
    release(marks, found)
    empty = F.array().cast("array<struct<key:bigint,first:int,last:int>>")
    full = df.select(*own, body, *[col(f.name).alias(inner[f.name]) for f in others]).join(repeats, ids, "left")
    full = full.select(*ids, "text", F.coalesce("marks", empty).alias("marks"), *inner.values())
    schema = ", ".join([*(f"{inner[f.name]} {f.dataType.simpleString()}" for f in others), "n_words bigint", "removed array<struct<start:bigint,length:bigint>>", "kept string"])
    out = full.mapInArrow(_scan(plan, _drop), schema)
    return out.withColumnsRenamed({v: k for k, v in inner.items()})


def n_removed(removed: Column) -> Column:
    """How many words the removed stretches hold."""
    return F.aggregate(removed, F.lit(0).cast("long"), lambda n, s: n + s["length"])
