"""Removal of passages that repeat earlier text, by longest previous factors.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier, that is if the
longest previous factor of one of the strings' starts is ``LENGTH`` or more. Suffixes cannot be
sorted in one place, so they are first dealt to groups such that equal strings always meet:

1. Every string picks its anchor, the leftmost of its 32-grams with the least hash; equal strings
   pick the same one. Starts with one anchor form a run, some 35 bytes apart from the next. Runs
   meet by the hash of their anchor. Those whose whole context is equal to an earlier one's repeat
   it with every start; those alone with their anchor repeat nothing.
2. Where contexts of one anchor differ, their bytes are fetched. All starts are put in suffix order,
   and the previous and next smaller positions among neighbours that share ``LENGTH`` bytes tell
   which starts have an earlier match.
3. The marks go back to the documents, which drop the bytes covered.

What very many documents share is told from a sample of the documents: runs, and starts of runs whose
anchor stands in very many different contexts. These do not travel: the least document that has
each is found by an aggregation and broadcast (a bounded number of hashes). The sample steers
only the way a run goes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limewash.llm.common import col, fresh
from limewash.llm.words import U, mix, small_batches, text_bytes
from limewash.session import materialise, release

LENGTH = 100
GRAM = 32
SPAN = LENGTH - GRAM + 1
#: Contexts of one anchor that are sorted together; the starts of a larger group meet by their hash.
ROOM = 20_000
#: Starts that one sort holds (unless one group has more).
AT_ONCE = 200_000
#: Bytes of text that one step of a scan holds.
STEP = 1 << 19
#: One of so many documents is looked at to find what very many share.
SAMPLE = 32
#: Documents of the sample that make an anchor, a run or a start hot, and how many hot ones are broadcast at most.
HOT, HOTTEST = 32, 100_000
#: Rows of one anchor that are compared at once.
HELD = 500_000

_random = np.random.default_rng(715517)
_BYTE = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_JOIN = _random.integers(0, 1 << 63, 8, dtype=np.uint64) * U(2) + U(1)
_BITS = 20
_PLACE = U((1 << _BITS) - 1)


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of every GRAM bytes in a row."""
    h, n = _BYTE[data], 1
    while n < GRAM:
        h = h[:-n] * _JOIN[n.bit_length()] + h[n:]
        n *= 2
    return mix(h)


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """The least of every n values in a row."""
    done = 1
    while done * 2 <= n:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (n - done)], values[n - done :]) if done < n else values


def _picks(grams: np.ndarray, base: int) -> np.ndarray:
    """For every start the place of its anchor; ``base`` is added to the places."""
    keys = (grams & ~_PLACE) | np.arange(len(grams), dtype=U)
    return (_least(keys, SPAN) & _PLACE).astype(np.int64) + base


@dataclass
class Runs:
    """Runs of starts with one anchor, of several texts; places are in ``data``."""

    data: np.ndarray
    offsets: np.ndarray
    owner: np.ndarray
    begin: np.ndarray  # first start
    end: np.ndarray  # last start
    anchor: np.ndarray  # hash of the anchor
    context: np.ndarray  # hash of all bytes of the run and of the place of its anchor
    grams: np.ndarray  # hash of the gram at every byte

    def key(self) -> np.ndarray:
        return mix(self.anchor + mix(self.context))


def _no_runs(data: np.ndarray, offsets: np.ndarray) -> Runs:
    none = np.zeros(0, np.int64)
    return Runs(data, offsets, none, none, none, np.zeros(0, U), np.zeros(0, U), np.zeros(0, U))


def runs_of(texts: pa.Array) -> Runs:
    data, offsets = text_bytes(texts)
    places, hashes = [], []
    step = (1 << _BITS) - 2 * LENGTH
    for a in range(0, max(0, len(data) - LENGTH + 1), step):
        grams = _grams(data[a : a + step + LENGTH - 1])
        places.append(_picks(grams, a))
        hashes.append(grams[:step])
        tail = grams[step:]
    if not places:
        return _no_runs(data, offsets)
    place, grams = np.concatenate(places), np.concatenate([*hashes, tail])
    change = np.zeros(len(data) + 1, np.int32)
    np.add.at(change, np.maximum(offsets[:-1], offsets[1:] - LENGTH + 1), 1)
    np.add.at(change, offsets[1:], -1)
    start = np.flatnonzero(np.cumsum(change)[: len(place)] == 0)
    if not len(start):
        return _no_runs(data, offsets)
    place = place[start]
    cut = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    begin, end, place = start[cut], start[np.append(cut[1:], len(start)) - 1], place[cut]
    owner = np.searchsorted(offsets, begin, "right") - 1
    last = end + LENGTH - GRAM
    context = mix((place - begin).astype(U) * _JOIN[7] + (end - begin).astype(U))
    for k in range(-(-(LENGTH + SPAN) // GRAM)):
        context = mix(context * _JOIN[6] ^ grams[np.minimum(begin + GRAM * k, last)])
    return Runs(data, offsets, owner, begin, end, grams[place], context, grams)


def _string_hashes(grams: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the LENGTH bytes at every start, from the 64-bit hashes of their grams."""
    h1, h2 = np.full(len(start), U(1)), np.full(len(start), U(2))
    for k in (0, GRAM, 2 * GRAM, LENGTH - GRAM):
        h1, h2 = mix(h1 * _JOIN[6] ^ grams[start + k]), mix(h2 * _JOIN[5] + grams[start + k])
    return h1, h2


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64), pa.int64())


def _place(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are in the sorted table, and where."""
    at = np.searchsorted(table, values)
    found = at < len(table)
    found[found] = table[at[found]] == values[found]
    return found, at


@dataclass
class Plan:
    """What all scans share. The first ``ids`` columns say which document a row is: the key, and a hash
    of the text where a key has several rows."""

    ids: list[str]
    anchors: np.ndarray  # sorted hashes of hot anchors
    hot: np.ndarray  # sorted keys of hot runs and starts
    least: np.ndarray  # for each the ids of the least document that has it; no rows as long as it is unknown


def _later(least: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Whether own ids come after the least ones."""
    out = own[:, -1] > least[:, -1]
    for k in range(own.shape[1] - 2, -1, -1):
        out = (own[:, k] > least[:, k]) | ((own[:, k] == least[:, k]) & out)
    return out


class Units:
    """What of several texts is compared: runs, and the single starts of runs with hot anchors.

    ``hot`` marks units that are broadcast. As soon as their least documents are known, ``repeated`` marks
    those of later documents, and only the least document's run stands for the others.
    """

    def __init__(self, plan: Plan, batch: pa.RecordBatch, text: int):
        runs = runs_of(batch.column(text))
        self.data, self.offsets = runs.data, runs.offsets
        rows = np.stack([np.asarray(batch.column(k)) for k in range(len(plan.ids))], axis=1) if batch.num_rows else np.zeros((0, len(plan.ids)), np.int64)
        settled = len(plan.least) > 0
        key = runs.key()
        known, at = _place(plan.hot, key)
        later = np.zeros(len(key), bool)
        if settled:
            later[known] = _later(plan.least[at[known]], rows[runs.owner[known]])
        alone = _place(plan.anchors, runs.anchor)[0] & ~later
        whole = ~alone if settled else ~alone | known
        size = (runs.end - runs.begin + 1)[alone]
        start = np.repeat(runs.begin[alone] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        own = np.repeat(runs.owner[alone], size)
        h1, h2 = _string_hashes(runs.grams, start)
        single = mix(h1 + mix(h2))
        shared, spot = _place(plan.hot, single)
        after = np.zeros(len(single), bool)
        if settled:
            after[shared] = _later(plan.least[spot[shared]], rows[own[shared]])
        self.owner = np.append(runs.owner[whole], own)
        self.begin, self.end = np.append(runs.begin[whole], start), np.append(runs.end[whole], start)
        self.anchor, self.context = np.append(runs.anchor[whole], h1), np.append(runs.context[whole], h2)
        self.key = np.append(key[whole], single)
        self.hot = np.append(known[whole], shared)
        self.repeated = np.append(later[whole], after)
        self.single = np.append(np.zeros(int(whole.sum()), bool), np.ones(len(start), bool))
        # Units that are equal within one text: all but the first repeat it.
        same = mix(self.key + mix(self.owner.astype(U)))
        order = np.lexsort((self.begin, same))
        new = np.append(True, same[order][1:] != same[order][:-1])[: len(order)]
        self.copy = np.zeros(len(order), bool)
        self.copy[order] = ~new
        self.same = same


def _ids(plan: Plan, batch: pa.RecordBatch, rows: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.asarray(batch.column(k))[rows], pa.int64()) for k in range(len(plan.ids))]


def _scan(shared, take: Callable[[Plan, Units, pa.RecordBatch], pa.RecordBatch]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for whole in batches:
            at = whole.schema.get_field_index("text")
            for batch in small_batches([whole], "text", STEP):
                yield take(plan, Units(plan, batch, at), batch)

    return run


def _seen(values: np.ndarray, units: Units, at: np.ndarray) -> pa.RecordBatch:
    """Each value once for each text."""
    pair = np.unique(np.stack([units.owner[at].astype(U), values[at]]), axis=1) if len(at) else np.zeros((2, 0), U)
    return pa.RecordBatch.from_arrays([_longs(pair[1])], names=["h"])


def _runs_seen(plan: Plan, units: Units, batch: pa.RecordBatch) -> pa.RecordBatch:
    return _seen(units.key, units, np.arange(len(units.key)))


def _anchors_seen(plan: Plan, units: Units, batch: pa.RecordBatch) -> pa.RecordBatch:
    """Anchors of runs that are not hot themselves."""
    return _seen(units.anchor, units, np.flatnonzero(~units.hot))


def _starts_seen(plan: Plan, units: Units, batch: pa.RecordBatch) -> pa.RecordBatch:
    return _seen(units.key, units, np.flatnonzero(units.single))


def _hot_owners(plan: Plan, units: Units, batch: pa.RecordBatch) -> pa.RecordBatch:
    """Hot units and the documents that have them."""
    at = np.flatnonzero(units.hot & ~units.copy)
    return pa.RecordBatch.from_arrays([_longs(units.key[at]), *_ids(plan, batch, units.owner[at])], names=["h", *plan.ids])


def _sent(plan: Plan, units: Units, batch: pa.RecordBatch) -> pa.RecordBatch:
    """(anchor, context, document) of the units that are to be compared, each once for each text."""
    at = np.flatnonzero(~units.copy & ~units.repeated & ~(units.single & units.hot))
    return pa.RecordBatch.from_arrays([_longs(units.anchor[at]), _longs(units.context[at]), *_ids(plan, batch, units.owner[at])], names=["anchor", "context", *plan.ids])


#: Marks: all starts of a repeated unit go, of a wanted one the bytes are asked for.
REPEATED, WANTED = 0, 1


def _compare(ids: list[str]):
    """From units in the order of (anchor, context, document): REPEATED for those that are not the first of
    their context, WANTED for the first of each context where an anchor has several."""

    def marks(rows: list[np.ndarray], all_wanted: bool) -> pa.RecordBatch:
        anchor, context = rows[:2]
        new_anchor = np.append(True, anchor[1:] != anchor[:-1])
        new = new_anchor | np.append(True, context[1:] != context[:-1])
        of = np.cumsum(new_anchor) - 1
        several = np.bincount(of, new) > 1
        # Rows that repeat a document are that document.
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        own = np.ones(len(new), bool)
        for r in rows[2:]:
            own &= r == r[first]
        repeated, wanted = np.flatnonzero(~own), np.flatnonzero(new & (several[of] | all_wanted))
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
            done = int(np.searchsorted(rows[0], rows[0][-1]))
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
    """Pairs (place in ``keys``, unit): the first unit of row ``rows[i]`` with the key ``keys[i]``."""
    first = np.flatnonzero(~units.copy)
    order = first[np.argsort(units.same[first])]
    found, at = _place(units.same[order], mix(keys.view(U) + mix(rows.astype(U))))
    pair = np.flatnonzero(found)
    return pair, order[at[pair]]


def _contexts(plan: Plan, units: Units, batch: pa.RecordBatch) -> pa.RecordBatch:
    """(anchor, document, start, bytes) of the units that are asked for."""
    n = len(plan.ids)
    asked = batch.column(n + 1)
    row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(asked.offsets)))
    pair, unit = _found(units, row, np.asarray(asked.flatten()))
    pair, at = np.unique(pair, return_index=True)
    unit = unit[at]
    body = units.data.tobytes()
    texts = [body[a : b + LENGTH] for a, b in zip(units.begin[unit], units.end[unit])]
    twin = np.asarray(batch.column(1)) if n > 1 else np.zeros(batch.num_rows, np.int64)
    return pa.RecordBatch.from_arrays(
        [
            _longs(units.anchor[unit]), pa.array(np.asarray(batch.column(0))[row[pair]], pa.int64()), pa.array(twin[row[pair]], pa.int64()),
            pa.array(units.begin[unit] - units.offsets[row[pair]], pa.int64()), pa.array(texts, pa.binary()),
        ],
        names=["anchor", "doc", "twin", "start", "bytes"],
    )


def earlier_matches(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which of the starts (ascending) have a longest previous factor of LENGTH bytes or more.

    The starts are put in the order of their suffixes, as far as LENGTH bytes. Where neighbours share
    all of these, an earlier match is the previous or the next smaller position of that stretch.
    """
    strings = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[starts]
    keys = np.ascontiguousarray(strings).view(f"S{LENGTH}").ravel()
    order = np.argsort(keys)
    ranked = keys[order]
    stretch = np.cumsum(np.append(False, ranked[1:] != ranked[:-1]))
    # Smaller positions before and after within a stretch: running minima, later stretches lower.
    n = len(starts)
    before = np.minimum.accumulate(order - stretch * n) + stretch * n
    after = np.minimum.accumulate((order + stretch * n)[::-1])[::-1] - stretch * n
    out = np.zeros(n, bool)
    out[order] = (before < order) | (after < order)
    return out


def _factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From contexts in the order of (anchor, doc, twin, start): stretches of starts with an earlier
    match. Of an anchor with more than ROOM contexts all starts leave with a hash of their bytes."""

    def rows(doc, twin, first, last, h1=None, h2=None):
        hashes = [pa.nulls(len(doc), pa.int64())] * 2 if h1 is None else [_longs(h1), _longs(h2)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, twin, first, last)] + hashes, names=["doc", "twin", "first", "last", "h1", "h2"])

    def places(held):
        doc, twin, start = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3))
        texts = [t for h in held for t in h[4]]
        sizes = np.array([len(t) for t in texts])
        data = np.frombuffer(b"".join(texts), np.uint8)
        base, n = np.cumsum(sizes) - sizes, sizes - LENGTH + 1
        of = np.repeat(np.arange(len(texts)), n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return doc, twin, start[of] + within, of, data, base[of] + within

    def found(held):
        doc, twin, start, of, data, place = places(held)
        hit = np.flatnonzero(earlier_matches(data, place))
        if not len(hit):
            return rows(*[np.zeros(0, np.int64)] * 4)
        cut = np.append(True, (of[hit][1:] != of[hit][:-1]) | (hit[1:] != hit[:-1] + 1))
        a, b = hit[cut], hit[np.append(np.flatnonzero(cut)[1:], len(hit)) - 1]
        return rows(doc[of[a]], twin[of[a]], start[a], start[b])

    def hashed(held):
        doc, twin, start, of, data, place = places(held)
        h1, h2 = _string_hashes(_grams(data), place)
        return rows(doc[of], twin[of], start, start, h1, h2)

    def pieces() -> Iterator[tuple]:
        for batch in batches:
            if batch.num_rows:
                part = [np.asarray(batch.column(k)) for k in range(4)]
                cuts = [0, *(np.flatnonzero(part[0][1:] != part[0][:-1]) + 1), batch.num_rows]
                texts = batch.column(4).to_pylist()
                for a, b in zip(cuts[:-1], cuts[1:]):
                    yield part[0][a], part[1][a:b], part[2][a:b], part[3][a:b], texts[a:b]

    full: list = []  # groups that are complete, then the parts of the one that is not
    group: list = []
    now, hot, size = None, False, 0
    for piece in pieces():
        if piece[0] != now:
            full, group, now, hot = full + group, [], piece[0], False
            if size >= AT_ONCE:
                yield found(full)
                full, size = [], 0
        if not hot and sum(len(p[4]) for p in group) + len(piece[4]) > ROOM:
            size -= sum(len(t) - LENGTH + 1 for p in group for t in p[4])
            if group:
                yield hashed(group)
            group, hot = [], True
        if hot:
            yield hashed([piece])
        else:
            group.append(piece)
            size += sum(len(t) - LENGTH + 1 for t in piece[4])
    if full or group:
        yield found(full + group)


def _drop(decoded: bool) -> Callable[[Plan, Units, pa.RecordBatch], pa.RecordBatch]:
    """The columns behind the marks, and n_bytes, n_removed, n_spans and what is kept: as bytes, or as text
    in which a character that loses one of its bytes goes whole."""

    def take(plan: Plan, units: Units, batch: pa.RecordBatch) -> pa.RecordBatch:
        n, rows = len(plan.ids), np.arange(batch.num_rows)
        keys, spans, offsets = batch.column(n + 1), batch.column(n + 2), units.offsets
        row = np.repeat(rows, np.diff(np.asarray(keys.offsets)))
        _, unit = _found(units, row, np.asarray(keys.flatten()))
        unit = np.concatenate([unit, np.flatnonzero(units.repeated | units.copy)])
        own = np.repeat(rows, np.diff(np.asarray(spans.offsets)))
        parts = spans.flatten()
        change = np.zeros(len(units.data) + 1, np.int64)
        np.add.at(change, np.append(units.begin[unit], np.asarray(parts.field(0)) + offsets[own]), 1)
        np.add.at(change, np.append(units.end[unit], np.asarray(parts.field(1)) + offsets[own]) + LENGTH, -1)
        gone = np.cumsum(change)[:-1] > 0
        rise = gone.copy()
        rise[1:] &= ~gone[:-1]
        inner = offsets[(offsets > 0) & (offsets < len(gone))]
        rise[inner] = gone[inner]
        total, rises = (np.append(0, np.cumsum(x)) for x in (gone, rise))
        a, b = offsets[:-1], offsets[1:]
        kept = [units.data[i:j].tobytes() if total[i] == total[j] else units.data[i:j][~gone[i:j]].tobytes() for i, j in zip(a, b)]
        out = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if decoded else pa.array(kept, pa.binary())
        return pa.RecordBatch.from_arrays(
            [*batch.columns[n + 3 :], pa.array(b - a, pa.int64()), pa.array(total[b] - total[a], pa.int64()), pa.array(rises[b] - rises[a], pa.int64()), out],
            names=[*batch.schema.names[n + 3 :], "n_bytes", "n_removed", "n_spans", "kept"],
        )

    return take


def _hottest(counted: DataFrame, hot: int, hottest: int) -> np.ndarray:
    rows = counted.groupBy("h").count().where(F.col("count") >= hot).orderBy(F.desc("count"), "h").limit(hottest).collect()
    return np.sort(np.array([r.h for r in rows], np.int64).view(U))


def _plan(rows: DataFrame, ids: list[str], sample: int, hot: int, hottest: int) -> Plan:
    """Hot runs, hot anchors of other runs, hot starts of these, and the least document of each."""
    context = rows.sparkSession.sparkContext
    none = np.zeros(0, U)
    plan = Plan(ids, none, none, np.zeros((0, len(ids)), np.int64))

    def over(df: DataFrame, take, schema: str, use):
        sent = context.broadcast(plan)
        out = use(df.mapInArrow(_scan(sent, take), schema))
        sent.destroy()
        return out

    part = rows.where(F.pmod(F.xxhash64("doc"), F.lit(sample)) == 0)
    plan.hot = over(part, _runs_seen, "h bigint", lambda df: _hottest(df, hot, hottest))
    plan.anchors = over(part, _anchors_seen, "h bigint", lambda df: _hottest(df, hot, hottest // 5))
    if len(plan.anchors):
        plan.hot = np.union1d(plan.hot, over(part, _starts_seen, "h bigint", lambda df: _hottest(df, hot, hottest)))
    if len(plan.hot):
        named = ", ".join(f"{i} bigint" for i in ids)
        least = lambda df: {r.h: r.least for r in df.groupBy("h").agg(F.min(F.struct(*ids)).alias("least")).collect()}
        first = over(rows, _hot_owners, f"h bigint, {named}", least)
        plan.least = np.array([first[h] for h in plan.hot.view(np.int64).tolist()], np.int64).reshape(len(plan.hot), len(ids))
    return plan


def repeated_passages(
    df: DataFrame, key: str = "doc_id", text: str = "text", decoded: bool = False, sample: int = SAMPLE, hot: int = HOT, hottest: int = HOTTEST
) -> DataFrame:
    """The other columns of ``df``, and for each row ``n_bytes``, ``n_removed``, ``n_spans`` (stretches
    removed) and ``kept``: the bytes that no string of LENGTH bytes covers which also starts earlier.

    Texts count as UTF-8 bytes, a null as none. Earlier is: a smaller key, or an earlier start in the
    same text. A null key comes before all others; keys are integers. Rows that repeat key and text are
    one document, judged once, and all of them stay; of different texts with one key (or none) the one
    of the smaller hash comes first. With ``decoded``, ``kept`` is text, without characters that lost a
    byte. An empty table gives no rows. Columns that are called like a result are replaced by it.

    Equal contexts, and equal strings of hot starts or of anchors beyond ROOM contexts, are those of
    equal hashes, built from 64-bit hashes of their 32-grams.
    """
    others = [f for f in df.schema.fields if f.name not in (text, "n_bytes", "n_removed", "n_spans", "kept")]
    spark = df.sparkSession
    inner = {f.name: fresh(f"c{i}") for i, f in enumerate(others)}
    doc = F.coalesce(col(key).cast("long"), F.lit(-(2**63)))
    several = df.groupBy(doc.alias("doc")).count().where("count > 1").limit(1).count() > 0
    ids = ["doc", "twin"] if several else ["doc"]
    own = [doc.alias("doc"), *([F.xxhash64(col(text)).alias("twin")] if several else [])]
    body = F.coalesce(col(text), F.lit("")).alias("text")
    rows = df.select(*own, body)
    named = ", ".join(f"{i} bigint" for i in ids)
    plan = spark.sparkContext.broadcast(_plan(rows, ids, sample, hot, hottest))

    units = rows.mapInArrow(_scan(plan, _sent), f"anchor bigint, context bigint, {named}")
    marks = materialise(units.repartition("anchor").sortWithinPartitions("anchor", "context", *ids).mapInArrow(_compare(ids), f"{named}, key bigint, kind int"), "marks")
    asked = marks.where(F.col("kind") == WANTED).groupBy(*ids).agg(F.collect_list("key").alias("keys"))
    texts = rows.dropDuplicates(ids) if several else rows
    contexts = texts.join(asked, ids).select(*ids, "text", "keys").mapInArrow(_scan(plan, _contexts), "anchor bigint, doc bigint, twin bigint, start bigint, bytes binary")
    factors = materialise(
        contexts.repartition("anchor").sortWithinPartitions("anchor", "doc", "twin", "start")
        .mapInArrow(_factors, "doc bigint, twin bigint, first bigint, last bigint, h1 bigint, h2 bigint"),
        "factors",
    )
    many = factors.where("h1 IS NOT NULL").withColumn("at", F.struct("doc", "twin", "first"))
    least = many.groupBy(F.col("h1").alias("x1"), F.col("h2").alias("x2")).agg(F.min("at").alias("least"), F.max("at").alias("most")).where("least < most")
    later = many.join(least, (F.col("h1") == F.col("x1")) & (F.col("h2") == F.col("x2"))).where("at > least")
    columns = [*ids, F.lit(None).cast("bigint").alias("key"), F.struct("first", "last").alias("span")]
    none = F.lit(None).cast("struct<first:bigint,last:bigint>").alias("span")
    found = marks.where(F.col("kind") == REPEATED).select(*ids, "key", none)
    found = found.unionByName(factors.where("h1 IS NULL").select(*columns)).unionByName(later.select(*columns))
    found = materialise(found.groupBy(*ids).agg(F.collect_list("key").alias("keys"), F.collect_list("span").alias("spans")), "repeats")
    release(marks, factors)
    full = df.select(*own, body, *[col(f.name).alias(inner[f.name]) for f in others]).join(found, ids, "left")
    no_keys, no_spans = F.array().cast("array<bigint>"), F.array().cast("array<struct<first:bigint,last:bigint>>")
    full = full.select(*ids, "text", F.coalesce("keys", no_keys).alias("keys"), F.coalesce("spans", no_spans).alias("spans"), *inner.values())
    kept = "string" if decoded else "binary"
    schema = ", ".join([*(f"{inner[f.name]} {f.dataType.simpleString()}" for f in others), "n_bytes bigint", "n_removed bigint", "n_spans bigint", f"kept {kept}"])
    out = full.mapInArrow(_scan(plan, _drop(decoded)), schema)
    return out.withColumnsRenamed({v: k for k, v in inner.items()})


def drop_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with repeated passages removed from its texts; a character that loses one of its bytes
    goes whole. Rows, other columns and null texts stay; a text that repeats in full becomes empty."""
    names = {c: fresh(f"d{i}") for i, c in enumerate(df.columns)}
    missing = fresh("missing")
    inner = df.select(*[col(c).alias(n) for c, n in names.items()]).withColumn(missing, col(names[text]).isNull())
    out = repeated_passages(inner, names[key], names[text], decoded=True)
    return out.select(*[(F.when(~col(missing), F.col("kept")) if c == text else col(n)).alias(c) for c, n in names.items()])
