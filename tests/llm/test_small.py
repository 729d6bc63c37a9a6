"""Operators on small tables: brute force, nulls, empty texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import brute
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from limewash.llm import chat, decontamination, extraction, minhash, packing, sharding, suffixes, topk, toxicity, url_filter
from limewash.llm.components import components


@pytest.fixture
def docs(spark):
    def build(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema)

    return build


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


# sharding


def test_shards(docs):
    rows = [(i, f"t{i}") for i in range(400)] + [(5, "t5")] * 30 + [(None, None), (None, "x")]
    weights = {0: 1.0, 1: 3.0, 2: 0.5}
    out = sharding.shard(docs(rows), "doc_id", weights, grown={3: 2.0}).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out) == sorted((a is None, a or 0, b or "") for a, b in rows)
    for r in out:
        if r.doc_id is not None:
            assert r.shard == brute.shard(r.doc_id, weights)
            assert r.grown_shard == brute.shard(r.doc_id, weights | {3: 2.0})
        assert r.grown_shard in (r.shard, 3)
    for s in weights:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert len({r.shard for r in out if r.doc_id is None}) == 1


def test_shards_of_nothing_and_of_clashing_columns(docs):
    assert sharding.shard(docs([]), "doc_id", 4).count() == 0
    out = sharding.shard(docs([(1, 7, 8), (2, 7, 8)], "doc_id long, shard long, slot long"), "doc_id", 4)
    assert sorted(out.columns) == ["doc_id", "shard", "slot"] and out.count() == 2
    with pytest.raises(ValueError):
        sharding.shard(docs([]), "doc_id", {0: 0.0})


def test_shard_files_hold_their_shards(docs, tmp_path, spark):
    out = sharding.shard(docs([(i, "x" * i) for i in range(50)]), "doc_id", 3)
    sharding.write_shards(out, str(tmp_path / "shards"), rows_per_file=7)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((r.doc_id, r.shard) for r in back.collect()) == sorted((r.doc_id, r.shard) for r in out.collect())


# decontamination

ITEM = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
DOCS = [
    (1, "before " + ITEM.upper() + " after"), (2, None), (3, ""), (4, " ".join(["pad"] * 400) + " " + ITEM), (5, ITEM.replace(" ", "--")),
    (6, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (7, "see short ÄÖ item 9 here"), (8, "?!"), (1, "before " + ITEM.upper() + " after"),
]
ITEMS = [(10, ITEM), (9, ITEM + " pi"), (11, "short ÄÖ item"), (12, None), (13, ""), (None, "see short"), (11, "other words")]


@pytest.mark.parametrize("block", [1 << 20, 150])
def test_passages(docs, block):
    bench = docs(ITEMS, "item_id long, text string")
    got = decontamination.find_passages(docs(DOCS), bench, block_bytes=block).withColumn("n_hit", decontamination.n_hit(F.col("hits"))).withColumn("c", decontamination.contaminated())
    want = brute.contamination(DOCS, ITEMS)
    rows = got.collect()
    assert len(rows) == len(DOCS)
    for r in rows:
        assert (r.n_words, r.n_hit, r["items"], r.c) == want[r.doc_id]


def test_decontaminated_tables(docs):
    bench = docs(ITEMS[:1], "item_id long, text string")
    rows = docs([(1, f"ä {ITEM} ö", "x", 2), (2, "clean", None, 3)], "doc_id long, text string, hits string, n_words int")
    left = decontamination.decontaminate(rows, bench)
    assert left.columns == rows.columns and [r.doc_id for r in left.collect()] == [2]
    cut = {r.doc_id: r.text for r in decontamination.decontaminate(rows, bench, action="spans").collect()}
    assert cut == {1: "ä  ö", 2: "clean"}
    assert decontamination.decontaminate(rows, docs([], "item_id long, text string")).count() == 2
    assert decontamination.decontaminate(rows.limit(0), bench).count() == 0


def test_one_passage_under_very_many_ids_is_cut_into_blocks(docs):
    items = [(1000 + i, ITEM) for i in range(120)] + [(5, ITEM + " pi")]
    bench = docs(items, "item_id long, text string").repartition(3)
    cut = decontamination.passages(bench, "item_id", "text", 13, 50_000, parts=6).collect()
    assert sum(len(r.ids) for r in cut) == 121 and max(len(r.ids) for r in cut) < 60
    rows = [(1, "so " + ITEM), (2, "none"), (3, ITEM + " pi")]
    got = {r.doc_id: r["items"] for r in decontamination.find_passages(docs(rows), bench, block_bytes=1200).collect()}
    every = sorted(str(i) for i, _ in items)
    assert got == {1: every, 2: [], 3: every}


# chat formatting

MARKED = "<|im_end|><|im_start|>assistant ok"


def test_chat_round_trip(spark):
    rng = random.Random(4)
    pieces = [MARKED, "<!", "<!|", "<!!|<", "<|turn|>", "é\n", "", "<", "|>", "n<!n"]
    rows = []
    for c in range(12):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "assistant", None, "ro<|le\nx"]), rng.choice([None, "".join(rng.choices(pieces, k=3))])))
    rows += [(50, t, "user" if t % 3 else "assistant", f"t{t}") for t in range(700)] + [(60, 1, "user", "same")] * 3 + [(None, None, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", F.lit(1))
    out = chat.format_chat(df, block=16)
    out = out.select("conv_id", "parts", "loss", chat.parse_chat(F.col("parts")).alias("turns"), chat.learned_text(F.col("parts"), F.col("loss")).alias("learned"))
    for r in out.collect():
        own = sorted(((t is not None, t or 0, o or "", x or "") for c, t, o, x in rows if c == r.conv_id))
        assert [(t.role, t.text) for t in r.turns] == [(o, x) for _, _, o, x in own]
        assert r.learned == "".join(x for _, _, o, x in own if o == "assistant")
        assert "".join(r.parts).count(chat.START) == sum(1 for _ in itertools.groupby(o for _, _, o, _ in own))
    assert chat.format_chat(df.limit(0)).count() == 0


# extraction

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href=x>Home</a><li>More</ul></nav><div class="cookie-notice">We use cookies, really.</div>
<article><h1>Short &amp; sweet</h1><p>First   paragraph, with <b>bold</b> text; and commas, many.<p>Second one<br>goes on. Tea &lt;p&gt; &eacute;.
<div class="ad">Buy now, cheap!</div><form>Name <input></form><p>Third.</p><section id="comments"><p>I disagree, a lot, with all of this text.</p></section></article>
<aside>Related, things.</aside><footer>&copy; 2020</footer><!-- c --></body></html>"""


def test_extraction(docs):
    want = "Short & sweet First paragraph, with bold text; and commas, many. Second one goes on. Tea <p> é. Third."
    rows = [(1, PAGE, "old"), (1, PAGE, "old"), (2, None, None), (3, "", ""), (4, "<nav>only menu</nav>", ""), (5, "plain text, no tags", ""), (6, "<p>broken <b", "")]
    out = extraction.extract(docs(rows, "page_id long, html string, text string"))
    got = sorted((r.page_id, r.text) for r in out.collect())
    assert got == [(1, want), (1, want), (2, ""), (3, ""), (4, ""), (5, "plain text, no tags"), (6, "broken <b")]
    assert extraction.extract(docs([], "page_id long, html string")).count() == 0


def test_long_and_deep_pages():
    page = "<article>" + "<div>" * 3000 + "deep, text. " * 20 + "</div>" * 3000 + "<p>end, of it.</article>"
    assert extraction.main_text(page).endswith("end, of it.")
    assert extraction.main_text("<" * 2000 + "x") == "<" * 2000 + "x"


def test_content_beside_the_largest_part_is_kept():
    long = "A paragraph, with words enough; it goes on, and on, to its end. "
    a, b = "".join(f"<p>{i} {long * 3}</p>" for i in range(4)), f"<p>fifth {long * 3}</p>"
    want = " ".join([*(f"{i} {long * 3}".strip() for i in range(4)), f"fifth {long * 3}".strip()])
    for page in (
        f"<body><div class=a>{a}</div><div class=b>{b}</div></body>", f"<body><article>{a}</article><div class=part>{b}</div></body>",
        f"<body><div><div class=x><div class=y>{a}</div></div><section>{b}</section></div><p>short</p></body>",
        f"<body><nav>Menu</nav><main><div class=a>{a}</div><div class=b>{b}</div></main><footer>Foot, note.</footer></body>",
    ):
        assert extraction.main_text(page) == want
    assert extraction.main_text(f"<body><div>Home</div><article>{a}<h2>End</h2><p>Yes.</p></article></body>").endswith("End Yes.")


LONG = "A paragraph, with words enough; it goes on, and on, to its end. And a second sentence, no less."
#: Pages without a single name or element that tells the article, and their texts.
NAMELESS = [
    (f"<body><div><a href=x>Home</a> <a href=y>About</a></div><div><p>{LONG}</p><p>{LONG}</p></div><div>Copyright, all rights reserved</div></body>", f"{LONG} {LONG}"),
    (f"<body><div><a href=x>Home</a></div><div><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div>Foot</div></body>", f"{LONG} Short. {LONG}"),
    (f"<body><div>Menu</div><h1>Title</h1><div><p>{LONG}</p><p>{LONG}</p></div><div>Foot</div></body>", f"Title {LONG} {LONG}"),
    (f"<body><div>Menu</div><div><p>{LONG}</p></div><div>aside</div><div><p>{LONG}</p></div><div>Foot</div></body>", f"{LONG} aside {LONG}"),
    (f"<body><div>Menu</div><div><p>{LONG}</p></div><div>Foot</div></body>", LONG),
    (f"<div><div><b>One</b></div><div><i>Two</i></div></div><div><div><p>{LONG}</p><ul><li>a<li>b</ul><p>{LONG}</p></div></div>", f"{LONG} a b {LONG}"),
]


@pytest.mark.parametrize("page, text", NAMELESS)
def test_path_ratios_find_an_article_that_nothing_names(page, text):
    assert extraction.main_text(page) == text


def test_constant_ratios_find_nothing(monkeypatch):
    monkeypatch.setattr(extraction, "ratios", lambda blocks: np.ones(len(blocks)))
    monkeypatch.setattr(extraction, "path_ratios", lambda blocks: (np.ones(len(blocks)), np.ones(len(blocks))))
    assert all(extraction.main_text(page) != text for page, text in NAMELESS)


def test_scores_and_threshold_by_brute_force():
    rng = random.Random(41)
    for _ in range(200):
        tags = ["div", "p", "section", "article", "nav", "ul", "h2"]
        page = "".join(f"<{(t := rng.choice(tags))}>{prose(rng, rng.randrange(1, 30))}{'.,'[: rng.randrange(3)]}{rng.choice(['', f'</{t}>'])}" for _ in range(rng.randrange(1, 15)))
        blocks = extraction.blocks_of(page)
        own = []
        for b in blocks:
            same = [c.text for c in blocks if c.path == b.path]
            own.append((0.0, 0.0) if b.apart else (sum(map(len, same)) / len(same), sum(ch in ".,;:!?" for t in same for ch in t) / len(same)))
        near = lambda k, j: own[k][j] if 0 <= k < len(own) else 0.0
        smooth = [[near(k - 1, j) / 4 + near(k, j) / 2 + near(k + 1, j) / 4 for j in (0, 1)] for k in range(len(own))]
        score = [0.0 if b.apart else x * (1 + y) for b, (x, y) in zip(blocks, smooth)]
        assert np.allclose(extraction.ratios(blocks), score, rtol=1e-12)
        mean = sum(score) / len(score)
        least = min((sum((x - mean) ** 2 for x in score) / len(score)) ** 0.5, max(score))
        assert [s >= least - 1e-9 and s > 0 for s in score] == [bool(a >= least - 1e-9 and a > 0) for a in extraction.ratios(blocks)]
        content, chosen = extraction.content_of(blocks)
        for k in range(len(blocks)):
            fused = own[k][0] * (1 + own[k][1])
            if min(abs(fused - least), abs(score[k] - least)) > 1e-6:
                assert chosen[k] == (fused > least)
                if any(content & chosen):
                    assert content[k] == (score[k] > least and fused > least)


@pytest.mark.parametrize("opened", [
    '<body class="no-sidebar"><article>', '<body class="single has-sidebar"><div>', '<body><div class="post-content with-sidebar">', '<body><article class="has-comments post">',
    '<body class="search"><main id="search">', '<body><div class="widget">', '<body><main><h1>Site</h1><div class="widget"><div class="alert">',
])
def test_names_do_not_set_an_article_apart(opened):
    text = "A paragraph, with words enough; it goes on, and on, to its end."
    body = f'<h2 id="related-work">Related work</h2><p>{text}</p><p>{text}</p><div class="ad">Buy, now.</div><span class="share-buttons">Share</span><p>{text}</p>'
    assert extraction.main_text(opened + body).endswith(" ".join(["Related work", *[text] * 3]))


def test_names_set_apart_what_is_no_article():
    page = '<body><div class="ad">An advertisement that is longer, much longer, than the article.</div><article><h1>Hm</h1><p>Hm.</article>'
    page += "".join(f'<div class="{c}">Not this, please.</div>' for c in ("site-footer", "main-nav", "cookie-notice", "x comments-area", "sidebar_left", "ad-slot-2"))
    assert extraction.main_text(page) == "Hm Hm."


# url filters

RULES = [url_filter.Rule("allow", "org", "/"), url_filter.Rule("block", "bad.org", "/x"), url_filter.Rule("block", "evil.com", "/")]


def test_url_parts_and_rules(docs):
    rows = [
        (1, "http://A.Org/x?y"), (2, "https://sub.bad.org/xy#z"), (3, "//nohost"), (4, None), (5, "http://norg/"), (6, "http://bad.org"), (7, "a://b://c/d"), (8, "http://É.ORG/É"),
    ]
    out = url_filter.judge_urls(docs(rows, "page_id long, url string").withColumns({"html": F.lit(None).cast("string"), "trust": F.lit("old")}), RULES)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert got == {
        1: ("a.org", "/x", "org/", "allow"), 2: ("sub.bad.org", "/xy", "bad.org/x", "block"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"),
        5: ("norg", "/", None, "allow"), 6: ("bad.org", "", None, "allow"), 7: ("b:", "//c/d", None, "allow"), 8: ("É.org", "/É", "org/", "allow"),
    }
    assert url_filter.judge_urls(docs([], "page_id long, url string, html string"), RULES).count() == 0


def test_trust_and_distrust_spread(docs):
    link = lambda *hosts: "".join(f'<a class="l" href="http://{h}/p">x</a>' for h in hosts)
    rows = [
        (1, "http://good.org/", link("friend.net", "good.org", "evil.com")), (2, "http://friend.net/", link("pal.net")), (3, "http://pal.net/", None),
        (4, "http://linker.net/", link("evil.com", "evil.com")), (5, "http://evil.com/", link("pal.net")), (6, "http://second.net/", link("linker.net", "LINKER.net")), (7, "http://lone.net/", ""),
    ]
    out = url_filter.judge_urls(docs(rows, "page_id long, url string, html string"), RULES, rounds=6)
    got = {r.page_id: r for r in out.collect()}
    assert [got[i].verdict for i in range(1, 8)] == ["allow", "allow", "allow", "block", "block", "block", "allow"]
    edges = {("good.org", "friend.net"): 1, ("good.org", "evil.com"): 1, ("friend.net", "pal.net"): 1, ("linker.net", "evil.com"): 2, ("evil.com", "pal.net"): 1, ("second.net", "linker.net"): 2}
    for name, links, seed in (("trust", edges, "good.org"), ("distrust", {(b, a): w for (a, b), w in edges.items()}, "evil.com")):
        hosts = sorted({h for e in links for h in e} | {"lone.net"})
        at = {h: i for i, h in enumerate(hosts)}
        move, start = np.zeros((len(hosts), len(hosts))), np.zeros(len(hosts))
        for (a, b), w in links.items():
            move[at[b], at[a]] = w
        move /= np.maximum(move.sum(axis=0), 1)
        start[at[seed]] = 1.0
        rank = start
        for _ in range(6):
            rank = 0.15 * start + 0.85 * move @ rank
            rank = rank + (1 - rank.sum()) * start  # what dead ends lose
        mine = {r.host: r[name] for r in got.values()}
        assert all(abs(mine[h] - rank[at[h]]) < 1e-9 for h in hosts)


def test_heavy_hosts_are_dealt_and_rank_alike(docs, monkeypatch):
    rng = random.Random(17)
    link = lambda h: f'<a href="http://{h}/">x</a>'
    rows = [(i, f"http://h{i}.net/", link("hub.net") + link(f"h{rng.randrange(60)}.net") + link(rng.choice(["evil.com", "good.org"]))) for i in range(60)]
    rows += [(100 + i, f"http://hub.net/{i}", "".join(link(f"h{k}.net") for k in range(i, 60, 40))) for i in range(40)] + [(300 + i, None, None) for i in range(40)]
    rows += [(400, "http://good.org/", None), (401, "http://evil.com/", None)]
    pages = docs(rows, "page_id long, url string, html string").withColumn("tags", F.create_map(F.lit("a"), F.lit(1)))
    one = {r.page_id: (r.host, r.verdict, r.trust, r.distrust) for r in url_filter.judge_urls(pages, RULES, rounds=5).collect()}
    monkeypatch.setattr(url_filter, "PARTS", 1)
    plain = {r.page_id: (r.host, r.verdict, r.trust, r.distrust) for r in url_filter.judge_urls(pages, RULES, rounds=5).collect()}
    assert one.keys() == plain.keys() == {r[0] for r in rows}
    for i, (host, verdict, trust, distrust) in plain.items():
        assert one[i][:2] == (host, verdict) and one[i][2:] == pytest.approx((trust, distrust), abs=1e-12)
    monkeypatch.setattr(url_filter, "PARTS", 20)
    counts = docs([("hub", 50), ("rest", 4), (None, 46)], "host string, n long")
    copies = counts.select("host", url_filter.copies_of(counts, "n").alias("copies"))
    assert {r.host: r.copies for r in copies.collect()} == {"hub": 10, "rest": 1, None: 10}
    dealt = url_filter.dealt(docs([(i, "hub") for i in range(200)], "id long, host string"), "host", copies, F.xxhash64("id"))
    assert {r.part__ for r in dealt.collect()} == set(range(10))


def test_ranks_settle_over_long_chains(docs):
    n = 14
    links = {(f"h{i}.net", f"h{i + 1}.net"): 1 for i in range(n - 1)} | {(f"h{n - 1}.net", "evil.com"): 1, ("good.org", "far.net"): 1, ("far.net", "h9.net"): 1, ("h5.net", "h2.net"): 1}
    rows = [(i, f"http://{a}/", f'<a href="http://{b}/">x</a>') for i, (a, b) in enumerate(links)] + [(100, "http://evil.com/", None)]
    got = {r.host: r for r in url_filter.judge_urls(docs(rows, "page_id long, url string, html string"), RULES, damping=0.5).collect()}
    hosts = sorted({h for e in links for h in e})
    at = {h: i for i, h in enumerate(hosts)}
    for name, seed, turn in (("trust", "good.org", False), ("distrust", "evil.com", True)):
        move, start = np.zeros((len(hosts), len(hosts))), np.zeros(len(hosts))
        for a, b in links:
            move[(at[a], at[b]) if turn else (at[b], at[a])] = 1.0
        start[at[seed]] = 1.0
        move[:, move.sum(axis=0) == 0] = start[:, None]  # dead ends go back to the seed
        move /= move.sum(axis=0)
        rank = np.linalg.solve(np.eye(len(hosts)) - 0.5 * move, 0.5 * start)
        assert all(abs(got[h][name] - rank[at[h]]) < 1e-8 for h in hosts)
    assert got["h0.net"].distrust > 0 and got["h0.net"].verdict == got["h1.net"].verdict == "block"


# top-k


@pytest.mark.parametrize("block", [1024, 2])
def test_top_k(docs, block):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(60)] + [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (None, rows[3][1]), (5, rows[5][1]), (404, [1.0, 2.0]), (450, [])]
    out = topk.top_k(docs(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, block=block).collect()
    usable = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q, a in usable.items():
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable.items() if i != q and len(a) == len(b))
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:5])]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out) == sorted(want)


def test_top_k_of_few(docs):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(docs([], schema), F.lit(True)).count() == 0
    out = topk.top_k(docs([(0, [1.0]), (1, [0.5]), (2, [-1.0])], schema), F.col("vec_id") == 0).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in out) == [(1, 1, 256 * 128), (2, 2, -(256**2))]


# near-duplicates


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_duplicates(docs, monkeypatch):
    rng = random.Random(12)
    base = [prose(rng, n) for n in (5, 30, 120, 120)]
    rows = [(None, base[0]), (900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "One  TWO"), (905, "x"), (906, prose(rng, 4000))]
    for i in range(60):  # a star: alike to the middle, less so to each other
        rows.append((i + 100, edited(rng, base[2], rng.randrange(0, 5))))
    for i in range(40):
        rows.append((i + 300, edited(rng, base[i % 4], rng.randrange(0, 3))))
    rows += [(500, base[3])] * 3 + [(501, rows[20][1])]
    monkeypatch.setattr(minhash, "ROOM", 16)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(minhash, "SLICE", 7)
    monkeypatch.setattr(minhash, "SPAN", 4)
    out = minhash.near_duplicates(docs(rows).withColumn("component_id", F.lit("x"))).collect()
    want = brute.near_duplicates([r for r in rows if r[0] is not None])
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], r.doc_id == want[r.doc_id][1])
    left = minhash.drop_near_duplicates(docs(rows)).collect()
    assert sorted(r.doc_id for r in left if r.doc_id is not None) == sorted({c for _, c in want.values()}) and sum(r.doc_id is None for r in left) == 1


def test_near_duplicates_of_nothing(docs):
    assert minhash.near_duplicates(docs([])).count() == 0
    out = minhash.near_duplicates(docs([(1, "a b c d e f"), (2, None)])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == [(1, 2, 1), (2, 0, 2)]


def test_ties_connect_what_all_pairs_connect():
    codes = np.random.default_rng(3).integers(0, 1 << 63, (6, 4), dtype=np.uint64)
    codes[1] = codes[0]
    codes[3] = codes[2]
    codes[5] = codes[0]
    ids, comps = [1, 2, 3, 4, *range(6)], [0, 1, 2, 3, 4, 0]
    batch = pa.RecordBatch.from_pydict({
        "bucket": [1] * 10, "block": [0] * 10, "part": [0] * 10, "kind": [0] * 4 + [1] * 6,
        "id": ids, "codes": [codes[i].tobytes() for i in ids], "component": [comps[i] for i in ids],
    })
    pairs = {(a, b) for out in minhash._ties(0.5)(iter([batch])) for a, b in zip(out[0].to_pylist(), out[1].to_pylist())}
    assert {p for pair in pairs for p in pair} == {0, 1, 2, 3, 5} and all(codes[a].tobytes() == codes[b].tobytes() for a, b in pairs)


def test_one_stray_member_does_not_send_a_bucket_to_itself(docs, monkeypatch):
    monkeypatch.setattr(minhash, "ROOM", 16)
    rows = [(7, i % 63, i, 1000, 5) for i in range(999)] + [(7, 3, 999, 1000, 999)] + [(8, 0, i, 10, 5) for i in range(10)]
    named = docs(rows, "bucket long, part int, id long, n long, component long").withColumn("codes", F.lit(b"x"))
    sent = minhash._meetings(named).collect()
    assert {r.bucket for r in sent} == {7}
    assert sorted(r.id for r in sent if r.kind == 1) == list(range(1000))
    assert sorted((r.id, r.part) for r in sent if r.kind == 0) == [(999, p) for p in range(63)]


def test_template_with_strays(docs, monkeypatch):
    rng = random.Random(31)
    base = prose(rng, 150)
    rows = [(i, edited(rng, base, rng.randrange(0, 3))) for i in range(150)] + [(i, edited(rng, base, k)) for i, k in ((200, 6), (201, 9), (202, 14), (203, 60))]
    for name in ("ROOM", "SPAN"):
        monkeypatch.setattr(minhash, name, 16)
    want = brute.near_duplicates(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(rows)).collect()} == want
    assert len({c for _, c in want.values()}) > 1


def test_similarity_estimates_are_near():
    rng = random.Random(5)
    a = prose(rng, 800, 10**6)
    for edits in (10, 40, 100):
        b = edited(rng, a, edits)
        hashes, at = minhash.shingle_sets(pa.array([a, b]))
        codes = minhash.signatures(hashes, at)[2]
        x, y = set(hashes[: at[1]]), set(hashes[at[1] :])
        assert abs(minhash.similarity(codes[0], codes[1]) - len(x & y) / len(x | y)) < 0.2


def test_components(docs):
    links = docs([(1, 2), (3, 2), (5, 9), (9, 7), (4, 4)] + [(20 + i, 21 + i) for i in range(30)] + [(100, i) for i in range(101, 140)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 9: 5, 7: 5} | {20 + i: 20 for i in range(31)} | {100 + i: 100 for i in range(40)}
    assert components(links.limit(0)).count() == 0


# packing


def test_boundaries_have_the_least_padding():
    rng = random.Random(8)
    for _ in range(40):
        lengths = sorted(rng.sample(range(1, 60), rng.randrange(1, 9)))
        counts = [rng.randrange(1, 30) for _ in lengths]
        for k in (1, 2, 3, 12):
            bounds = packing.best_boundaries(lengths, counts, k)
            assert len(bounds) <= k and bounds[-1] == lengths[-1]
            every = [c + (lengths[-1],) for n in range(min(k, len(lengths))) for c in itertools.combinations(lengths[:-1], n)]
            assert brute.padding(lengths, counts, bounds) == min(brute.padding(lengths, counts, b) for b in every)
    assert packing.best_boundaries([], [], 3) == []


def test_packing(docs):
    rng = random.Random(2)
    rows = [(i, " ".join("x" * rng.randrange(1, 4) for _ in range(rng.choice([0, 1, 7, 30, 64, 65, 200])))) for i in range(300)] + [(7, "a b")] * 50 + [(None, None), (8, "")]
    df = docs(rows).withColumnRenamed("doc_id", "batch")
    out = packing.pack(df, "batch", packing.word_count(F.col("text")), budget=64, buckets=4, step=4).toPandas()
    out.columns = ["doc_id", "piece", "start", "n_tokens", "padded", "batch", "slot"]
    assert out.n_tokens.sum() == sum(len((t or "").split()) for _, t in rows)
    assert len(out) == sum(max(1, -(-len((t or "").split()) // 64)) for _, t in rows)
    assert (out.n_tokens <= out.padded).all() and out.padded.nunique() <= 4
    for (padded, _), g in out.groupby(["padded", "batch"]):
        assert len(g) * padded <= 64 and sorted(g.slot) == list(range(len(g)))
    for padded, g in out.groupby("padded"):
        sizes = g.groupby("batch").size()
        assert sorted(sizes.index) == list(range(len(sizes))) and (sizes.iloc[:-1] == 64 // padded).all()
    assert packing.pack(docs([]), "doc_id", F.lit(1)).count() == 0


def test_packing_pads_no_more_than_it_must(docs):
    out = packing.pack(docs([(i, "x " * (5 if i % 2 else 9)) for i in range(6)]), "doc_id", packing.word_count(F.col("text")), buckets=2)
    assert all(r.padded == r.n_tokens for r in out.collect())


# toxicity

BAD = ["grobian", "lumpazi", "schuftig"]


def toxic_table(rng, n):
    rows = []
    for i in range(n):
        words = prose(rng, rng.randrange(20, 60)).split()
        if i % 3 == 0:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) if rng.random() < 0.7 else "vilex" + prose(rng, 1, 10**5))
        rows.append((i, ". ".join([" ".join(words[:10]), " ".join(words[10:])]), int(i % 3 == 0)))
    return rows


def test_toxic_documents_and_spans(docs):
    rows = toxic_table(random.Random(6), 600)
    table = docs([(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (1002, "É Grobian " + "w1 " * 3000), (None, "grobian")])
    labels = docs([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (5000, 1)], "doc_id long, toxic int")
    model = toxicity.train(table, labels)
    out = toxicity.tag(table.withColumn("score", F.lit("old")), model).collect()
    got = {r.doc_id: r for r in out}
    held = [(y, got[i].score >= 0.3) for i, _, y in rows if brute.is_held_out(i)]
    assert sum(y == p for y, p in held) >= 0.97 * len(held)
    assert got[1000].score == got[1001].score < 0.3 and got[1000].toxic_spans == []
    assert [("É Grobian "[s.start : s.end]) for s in got[1002].toxic_spans] == ["Grobian"] and got[1002].score >= 0.3 and got[None].score >= 0.3
    flags = {r.doc_id: r.h for r in table.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()}
    assert all(h == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, h in flags.items())
    left = {r.doc_id for r in toxicity.drop_toxic(table, model).collect()}
    assert left == {i for i, r in got.items() if r.score < 0.3}


def test_labels_that_teach_nothing(docs):
    table = docs([(1, "a b"), (3, None)])
    none = docs([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.tag(table, toxicity.train(table, none)).collect()} == {0.5}
    assert {r.score for r in toxicity.tag(table, toxicity.train(table, docs([(1, 0)], "doc_id long, toxic int"))).collect()} == {0.0}
    assert toxicity.tag(table.limit(0), toxicity.train(table.limit(0), none)).count() == 0


def test_marginals_are_those_of_all_tag_sequences():
    rng = np.random.default_rng(1)
    model = toxicity.Model(rng.normal(size=1 << toxicity.BITS), rng.normal(size=(2, 2)), 0.7, np.zeros(3))
    feature = rng.integers(0, 1 << toxicity.BITS, (9, 5)).astype(np.int32)
    chain, place = np.array([0] * 5 + [1] * 4), np.array([*range(5), *range(4)])
    emit = model.weights[feature].sum(axis=1)
    want = []
    for c in (0, 1):
        e = emit[chain == c]
        total, each = 0.0, np.zeros(len(e))
        for tags in itertools.product((0, 1), repeat=len(e)):
            w = np.exp(sum(x for x, t in zip(e, tags) if t) + model.first * tags[0] + sum(model.moves[a, b] for a, b in itertools.pairwise(tags)))
            total += w
            each += w * np.array(tags)
        want += list(each / total)
    assert np.allclose(model.marginals(feature, chain, place), want)


@pytest.mark.parametrize("n", [60, 240, 2000])
def test_toxic_words_are_learnt_at_any_size(n):
    rng = random.Random(n)
    rows = []
    for i in range(n):
        words = prose(rng, rng.randrange(20, 60)).split()
        if i % 8 == 0:
            for word in BAD:
                words.insert(rng.randrange(len(words)), word)
        rows.append((" ".join(words), int(i % 8 == 0)))
    texts, labels = zip(*rows)
    words = toxicity.words_of(pa.array(texts, pa.large_string()), toxicity.ALNUM)
    tags = toxicity.token_tags(toxicity.features(words), words, np.array(labels))
    tagged = [words.text(k, k + 1).decode() for k in np.flatnonzero(tags)]
    assert set(BAD) <= set(tagged) and sum(w not in BAD for w in tagged) <= 0.1 * len(tagged)


def test_copied_texts_are_sampled_once(docs):
    rows = [(i, t, y) for i, t, y in toxic_table(random.Random(7), 150)]
    copies = [(1000 + i, "same bad text, copied", 1) for i in range(900)]
    table = docs([(i, t) for i, t, _ in rows + copies])
    model = toxicity.train(table, docs([(i, y) for i, _, y in rows + copies], "doc_id long, toxic int"), sample=80)
    got = {r.doc_id: r.score for r in toxicity.tag(table.where("doc_id < 1000"), model).collect()}
    assert sum((got[i] >= 0.3) == y for i, _, y in rows) >= 0.95 * len(rows)


# suffixes


def repeated_rows():
    rng = random.Random(3)
    shared = [prose(rng, n, 10**5) for n in (25, 60, 300)]
    rows = [(None, shared[1] + " end"), (50, None), (51, ""), (52, "a" * 350), (53, "ab" * 99), (54, "x" * 99), (55, "é" * 80)]
    for i in range(40):
        parts = [prose(rng, rng.randrange(0, 60), 10**5), rng.choice(shared), prose(rng, 20, 10**5), rng.choice([*shared, ""])]
        rows.append((i, " ".join(parts)))
    rows += [(60, shared[2])] * 3 + [(61, shared[2]), (62, shared[2][:150]), (63, "y" + "a" * 120)]
    return rows


@pytest.mark.parametrize("room", [20_000, 3])
def test_repeats(docs, monkeypatch, room):
    rows = repeated_rows()
    monkeypatch.setattr(suffixes, "ROOM", room)
    monkeypatch.setattr(suffixes, "AT_ONCE", 1000)
    df = docs(rows)
    want = brute.repeats(list(dict.fromkeys(rows)))
    for options in ({}, {"sample": 1, "hot": 3}, {"sample": 1, "hot": 3, "hottest": 10}):
        got = suffixes.repeated_passages(df, **options).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) == want[r.doc_id], (r.doc_id, options)


def test_texts_without_repeats(docs):
    rows = repeated_rows()
    df = docs([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string")
    out = suffixes.drop_repeats(df)
    assert out.columns == df.columns and out.count() == len(rows)
    left = {r.doc_id: r.text for r in out.collect()}
    assert left[50] is None and left[61] == "" and left[54] == "x" * 99 and left[55] == "é"
    assert suffixes.drop_repeats(df.limit(0)).count() == 0


def test_two_texts_of_one_key(docs):
    text = prose(random.Random(1), 80, 10**5)
    out = suffixes.drop_repeats(docs([(1, text), (1, "z" + text), (2, "short")])).collect()
    assert sorted(len(r.text) for r in out)[:2] in ([1, 5], [0, 5]) and len(out) == 3


def test_earlier_matches_are_longest_previous_factors():
    rng = random.Random(2)
    data = np.frombuffer(("ab" * 150 + "".join(rng.choices("ab", k=400)) + "ab" * 100).encode(), np.uint8)
    starts = np.arange(len(data) - 99)
    body = data.tobytes()
    want = [body.find(body[s : s + 100], 0, s + 99) >= 0 for s in starts]
    assert suffixes.earlier_matches(data, starts).tolist() == want
