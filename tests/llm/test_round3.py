"""Periodic runs, hard negatives and repeated windows: brute force, nulls, empty and long texts, ties, repeated
rows, empty tables, clashing columns, and the registered queries over the smallest tables."""

import hashlib
import random
from fractions import Fraction

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from limewash.llm import automata, negatives, periods

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def run(spark, name):
    return entry.queries()[name](spark, SF).collect()


# periodic runs


def repetitive(rng):
    words = []
    for _ in range(rng.randrange(8)):
        unit = [rng.choice("abc") for _ in range(rng.randrange(1, 9))]
        words += (unit * rng.randrange(1, 9))[: rng.randrange(1, 60)]
        words += [rng.choice("abAB") for _ in range(rng.randrange(9))]
    return words


def test_runs_of_many_texts():
    rng = random.Random(7)
    for _ in range(300):
        texts = [repetitive(rng) for _ in range(rng.randrange(1, 5))]
        first = np.cumsum([0, *map(len, texts)])
        found = periods.runs_of(np.array([ord(w) for t in texts for w in t], np.uint64), first)
        own = np.searchsorted(first, found[0], "right") - 1
        got = [[(int(s - first[i]), int(n), int(q)) for s, n, q, o in zip(*found, own) if o == i] for i in range(len(texts))]
        assert got == [brute.runs(t) for t in texts]


def test_runs_and_collapsed_texts(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([" ", "\t \n"]).join(repetitive(rng)), "x") for i in range(80)]
    rows += [(200, None, None), (201, "", "y"), (202, " \n ", "y"), (None, "a " * 9, None), (203, "ö é " * 5, "z"), (203, "ö é " * 5, "z"), (204, "x " * 30_000, "long")]
    out = periods.find_runs(spark.createDataFrame(rows, "id long, text string, runs string"))
    assert out.columns == ["id", "n_words", "runs", "collapsed"]
    got = sorted(((r.id is not None, r.id or 0), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect())
    want = []
    for i, text, _ in rows:
        words = brute.spaced(text)
        found = [(0, 30_000, 1)] if i == 204 else brute.runs(words)
        want.append(((i is not None, i or 0), len(words), found, brute.collapsed(words, found)))
    assert got == sorted(want)
    assert periods.find_runs(spark.createDataFrame([], "id long, text string")).count() == 0
    with pytest.raises(ValueError):
        periods.find_runs(spark.createDataFrame(rows[:1], "id long, text string, runs string"), times=3)


def test_op11(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = run(spark, "op11_periodic_runs")
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        words = brute.rewritten(r.doc_id, brute.spaced(texts[r.doc_id]))
        found = brute.runs(words)
        best = max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2])) if found else (None,) * 3
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in found)) and r.collapsed_sha256 == sha(brute.collapsed(words, found))


# hard negatives


def mined(spark, rows, is_anchor, **options):
    schema = options.pop("schema", "vec_id long, embedding array<double>, label int")
    out = negatives.hard_negatives(spark.createDataFrame(rows, schema), is_anchor, **options)
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in out.collect())


def wanted(rows, is_anchor, **options):
    usable = [(i, l, tuple(int(np.floor(256 * x)) for x in v)) for i, v, l in rows if None not in (i, v, l) and None not in v and all(np.isfinite(v))]
    return brute.hard_negatives(usable, is_anchor, **options)


@pytest.mark.parametrize("block", [1024, 7])
def test_hard_negatives(spark, block):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 6))
    rows = []
    for i in range(600):
        label = int(rng.integers(4))
        v = centres[label] * rng.choice([0, 1]) + rng.normal(size=6) * rng.choice([0.1, 1.0])
        rows.append((i, [float(x) for x in np.round(v, 1)], label))
    rows += [(700 + i, [0.5, 0.5, 0.0, 0.0, 0.0, 0.0], i % 2) for i in range(40)] + rows[10:40]
    rows += [(800, None, 1), (801, [1.0] * 5 + [None], 1), (802, [1.0] * 5 + [float("nan")], 1), (803, [1.0] * 5 + [float("inf")], 2), (None, [1.0] * 6, 1), (804, [1.0] * 6, None)]
    rows += [(810, [1.0, 2.0], 1), (811, [1.0, 2.0], 1), (820, [1.0, 1.0], 2), (830, [], 1), (20, [0.1] * 6, 3)]
    want = wanted([r for r in rows if r[0] != 20], lambda i: i % 10 == 0)
    got = mined(spark, rows, F.col("vec_id") % 10 == 0, block=block)
    # An id with two vectors is an anchor twice, so it is left out of this comparison; it stays a candidate.
    rows_20 = wanted(rows, lambda i: i % 10 == 0 and i != 20)
    assert [r for r in got if r[0] != 20] == rows_20 and len(want) > 500


def test_hard_negatives_of_large_components(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4) * (1e9 if i % 3 == 0 else 1)], i % 2) for i in range(120)]
    rows.append((500, [float(2**44)] * 4, 0))
    want = [r for r in wanted(rows, lambda i: i % 10 == 0 and i != 500)]
    got = mined(spark, rows, F.col("vec_id") % 10 == 0)
    limit = 2**63 - 1
    assert [r for r in got if r[0] != 500 and max(map(abs, r[4:])) < limit] == [r for r in want if max(map(abs, r[4:])) < limit]
    assert any(abs(r[4]) > 2**53 for r in got)


def test_hard_negatives_of_nothing(spark):
    assert mined(spark, [], F.lit(True)) == []
    assert mined(spark, [(1, [1.0], 1)], F.lit(True)) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 1), (3, [0.5], 2)], F.lit(False)) == []
    rows = [(1, [1.0], 1, 5, "a"), (2, [1.0], 1, 5, "a"), (3, [0.5], 2, 6, "b")]
    schema = "vec_id long, embedding array<float>, label int, rank int, anchor_id string"
    assert mined(spark, rows, F.col("vec_id") == 1, schema=schema) == [(1, 2, 1, 3, 65536, 32768)]


# repeated windows


def windows(rng, n, kinds=5):
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]


def texts_that_repeat(rng):
    passages = [windows(rng, rng.randrange(8, 50), 400) for _ in range(6)]
    rows = []
    for i in range(150):
        parts = [windows(rng, rng.randrange(20), rng.choice([2, 400])) for _ in range(3)]
        words = [w for p in parts for w in [*p, *(rng.choice(passages) if rng.random() < 0.6 else [])]]
        rows.append((i % 140 if i < 145 else None, rng.choice([" ", "\n\t"]).join(words), "x"))
    line = windows(rng, 20, 400)
    rows += [(1000 + i, " ".join([*windows(rng, 6, 400), *line, *windows(rng, 6, 400)]), "hot") for i in range(100)]
    rows += rows[3:9] + [(2000, None, None), (2001, "", ""), (2002, "a b c", "")] + [(3000 + i, "a " * (12 + i), "") for i in range(4)]
    return rows


@pytest.mark.parametrize("options", [{}, {"sample": 1, "hot": 3}, {"sample": 1, "hot": 3, "hottest": 4}])
def test_repeated_windows(spark, options):
    rows = texts_that_repeat(random.Random(11))
    out = automata.repeated_windows(spark.createDataFrame(rows, "doc_id long, text string, removed string"), **options)
    assert out.columns == ["doc_id", "n_words", "removed", "kept"]
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, sum(s.length for s in r.removed), r.kept) for r in out.collect())
    assert got == sorted((i is not None, i or 0, n, gone, kept) for i, n, gone, kept in brute.repeated_windows([r[:2] for r in rows]))


def test_repeated_windows_of_nothing(spark):
    assert automata.repeated_windows(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def shards(rng):
    """Rows (anchor, doc, key, words) in the order of their shards."""
    rows = []
    for anchor in range(6):
        for _ in range(rng.randrange(1, 30)):
            rows.append((anchor, rng.randrange(10), len(rows), [rng.randrange(2) for _ in range(rng.randrange(13, 21))]))
    return sorted(rows, key=lambda r: r[:2])


@pytest.mark.parametrize("room", [10_000, 7])
def test_matching_statistics(room, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(automata, "ROOM", room)
    rows = shards(random.Random(2))
    batches = [
        pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + 9]], pa.int64() if k < 3 else pa.list_(pa.int64())) for k in range(4)], names=["anchor", "doc", "key", "words"])
        for i in range(0, len(rows), 9)
    ]
    out = [tuple(r.values()) for b in automata._match(["doc"])(iter(batches)) for r in b.to_pylist()]
    words = {r[2]: r for r in rows}
    got = {(key, i) for doc, key, a, b, h in out if h is None for i in range(a, b + 1)}
    hashed = [(words[key][0], h, doc, key, a) for doc, key, a, b, h in out if h is not None]
    for anchor, h, doc, key, i in hashed:
        if any(o[:2] == (anchor, h) and o[2] < doc for o in hashed):
            got.add((key, i))
    want = set()
    for anchor, doc, key, w in rows:
        smaller = {tuple(x[i : i + 13]) for a, d, _, x in rows if a == anchor and d < doc for i in range(len(x) - 12)}
        want |= {(key, i) for i in range(len(w) - 12) if tuple(w[i : i + 13]) in smaller}
    assert got == want and bool(hashed) == (room == 7)


def test_units_compared_in_parts(monkeypatch):
    import pyarrow as pa

    rng = random.Random(6)
    rows = sorted((rng.choice([-3, 5, 9]), rng.randrange(12), rng.randrange(8)) for _ in range(400))
    batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + 11]], pa.int64()) for k in range(3)], names=["anchor", "context", "doc"]) for i in range(0, 400, 11)]
    results = []
    for held in (automata.HELD, 20):
        monkeypatch.setattr(automata, "HELD", held)
        out = [tuple(r.values()) for b in automata._compare(["doc"])(iter(batches)) for r in b.to_pylist()]
        results.append(({r for r in out if r[2] == automata.REPEATED}, {r for r in out if r[2] == automata.WANTED}))
    assert results[0][0] == results[1][0] and results[0][1] <= results[1][1] and results[0][0]


def test_automaton_reads_what_was_added():
    rng = random.Random(1)
    for _ in range(60):
        added = [[rng.randrange(3) for _ in range(rng.randrange(12))] for _ in range(rng.randrange(1, 6))]
        automaton = automata.Automaton()
        for words in added:
            automaton.add(words)
        inside = {tuple(w[i:j]) for w in added for i in range(len(w)) for j in range(i + 1, len(w) + 1)} | {()}
        read = [rng.randrange(4) for _ in range(40)]
        want = [max(n for n in range(k + 2) if tuple(read[k + 1 - n : k + 1]) in inside) for k in range(40)]
        assert automaton.statistics(read) == want


def test_op13(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {i: (n, gone, sha(kept)) for i, n, gone, kept in brute.repeated_windows(rows)}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in run(spark, "op13_substring_dedup")} == want


# top-k search of large components


def test_top_k_beyond_doubles(spark):
    from limewash.llm import topk

    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=4) * (1e9 if i % 3 == 0 else 1)]) for i in range(90)] + [(200, [1e9] * 4), (201, [1e9] * 4), (202, [2.0**60] * 4)]
    whole = [(i, [min(2**63 - 1, int(np.floor(256 * x))) for x in v]) for i, v in rows]
    clip = lambda x: max(1 - 2**63, min(2**63 - 1, x))
    want = []
    for i, v in whole:
        if i % 10 == 0:
            best = sorted((-clip(sum(a * b for a, b in zip(v, w))), j) for j, w in whole if j != i)[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    out = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, block=4)
    assert sorted(map(tuple, out.collect())) == sorted(want) and any(abs(w[3]) > 2**53 for w in want)


# pages as browsers read them


@pytest.mark.parametrize("piece, text", [
    ("<p><a title=it's href=x>link</a> of it.<p>Don't lose this, please.", "link of it. Don't lose this, please."),
    ("<!--><p>After an empty comment.<!-- not this --><!---><p>And another.<!-- nor this --!><p>End.", "After an empty comment. And another. End."),
    ("<p title='a hidden gem'>A gem, found.<p title='style: display:none;'>Shown, after all.", "A gem, found. Shown, after all."),
    ("<p hidden>No.<p style='color:red; display: none'>No.<p aria-hidden=true>No.<p class=x data-a=\">\" >Yes, indeed.", "Yes, indeed."),
    ("<p title=\"a > b\">Greater, or not.<p data-hidden=1 alt=hidden>Not hidden, this.", "Greater, or not. Not hidden, this."),
])
def test_attributes_and_comments(piece, text):
    from limewash.llm import extraction

    lead = "A paragraph, with words enough; it goes on, and on, to its end."
    assert extraction.main_text(f"<body><article><p>{lead}</p>{piece}</article></body>") == f"{lead} {text}"
