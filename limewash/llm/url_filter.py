"""Verdicts on urls: fixed rules first, then trust and distrust that spread over the links of hosts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limewash.llm.common import col, fresh
from limewash.session import materialise, release

UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ranks are settled once a round changes them by no more than this in all, and each by no more than
#: this share of itself; ranks under LEAST, at the end of doubles, may change.
TOLERANCE, RELATIVE, LEAST = 1e-9, 1e-6, 1e-300
LOOK = 4
#: A host with more than one in PARTS of all rows is dealt over several tasks; fewer than PARTS hosts are so heavy.
PARTS = 1000
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*((?:https?:)?//[^\s"'>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rest_of(url: Column) -> Column:
    """What follows the first ``://``; empty without one, or without a url."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(rest_of(url), "^[^/?#]*", 0), UPPER, LOW)


def path_of(url: Column) -> Column:
    return F.regexp_extract(rest_of(url), "^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule whose host is the url's or a parent of it, and whose path begins the url's."""
    found = F.lit(None)
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def copies_of(counts: DataFrame, n: str) -> Column:
    """Over how many tasks the rows of a host go, from the ``n`` rows of each host in ``counts``."""
    total = counts.agg(F.sum(n)).first()[0] or 1
    return F.greatest(F.ceil(F.col(n) * PARTS / F.lit(total)), F.lit(1)).cast("int")


def dealt(rows: DataFrame, key: str, copies: DataFrame, by: Column) -> DataFrame:
    """``rows`` with ``part__``: rows of a heavy host in ``copies`` (host, copies) get one of its parts by the hash ``by``."""
    heavy = copies.where("copies > 1").select(F.col("host").alias("heavy__"), F.col("copies").alias("copies__"))
    marked = rows.join(F.broadcast(heavy), F.col(key) == F.col("heavy__"), "left")
    return marked.withColumn("part__", F.pmod(by, F.coalesce("copies__", F.lit(1))).cast("int")).drop("heavy__", "copies__")


def in_parts(table: DataFrame) -> DataFrame:
    """A table of one row per host once for each part of the host, ``to_part__``, that its ``copies`` make."""
    return table.withColumn("to_part__", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")


def spread(edges: DataFrame, hosts: DataFrame, seed: str, damping: float, rounds: int | None = None) -> DataFrame:
    """Personalised PageRank: (host, rank), from ``hosts`` (host, ``seed``: weights that sum to 1 or
    are all 0) over ``edges`` (src, dst, w). What reaches a host without links goes back to the seeds.

    Rounds go on until one changes the ranks by TOLERANCE in all at most, and each by RELATIVE of
    itself at most, so that it reaches no new host either; or for exactly ``rounds``. The total change
    shrinks by ``damping`` each round at least. Every LOOK rounds this is looked at.
    """
    total = materialise(edges.groupBy(F.col("src").alias("host")).agg(F.sum("w").alias("all_w"), F.count(F.lit(1)).alias("n")), "sources")
    sources = total.select("host", "all_w", copies_of(total, "n").alias("copies"))
    share = materialise(
        dealt(edges, "src", sources, F.xxhash64("dst"))
        .join(in_parts(sources), (F.col("src") == F.col("host")) & (F.col("part__") == F.col("to_part__")))
        .select("src", "part__", "dst", (F.col("w") / F.col("all_w")).alias("share")),
        "shares",
    )
    start = materialise(
        hosts.join(sources.select(F.col("host").alias("from_"), "copies"), F.col("host") == F.col("from_"), "left")
        .select("host", F.col(seed).alias("seed"), F.coalesce("copies", F.lit(1)).alias("copies"), F.col(seed).alias("rank")),
        "start",
    )
    release(total)
    rank = start
    last, done = None, 0
    while rounds is None or done < rounds:
        sent = (
            share.join(in_parts(rank.select(F.col("host").alias("at"), "rank", "copies")), (F.col("src") == F.col("at")) & (F.col("part__") == F.col("to_part__")))
            .groupBy(F.col("dst").alias("to")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        )
        rank = materialise(  # cuts the lineage
            rank.join(sent, F.col("host") == F.col("to"), "left").select(
                "host", "seed", "copies", F.col("rank").alias("before"),
                (F.lit(1 - damping) * F.col("seed") + F.lit(damping) * F.coalesce("got", F.lit(0.0))).alias("rank"),
            ),
            "rank",
        )
        seeds, kept = rank.agg(F.sum("seed"), F.sum("rank")).first()
        whole = F.col("rank") + F.lit((seeds or 0.0) - (kept or 0.0)) * F.col("seed")
        release(start if last is None else last)
        last, done = rank, done + 1
        if rounds is None and done % LOOK == 0:
            change = F.abs(whole - F.col("before"))
            total, open_ = rank.agg(F.sum(change), F.count_if((change > RELATIVE * whole) & (whole > LEAST))).first()
            settled = (total or 0.0) <= TOLERANCE and not open_
        else:
            settled = False
        rank = rank.select("host", "seed", "copies", whole.alias("rank"))
        if settled:
            break
    release(share)
    return rank.select("host", "rank")


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], url: str = "url", html: str | None = "html", damping: float = 0.85, rounds: int | None = None, bias: float = 1.0
) -> DataFrame:
    """``pages`` without ``html``, with host, path, rule (null if none fits), verdict, trust and
    distrust of its host.

    A rule decides its pages. Pages that rules allow are the trusted seeds of their hosts, those that
    they block the blocked seeds. Trust spreads along the absolute links between hosts, distrust
    against them (a host that links to bad ones is suspect). A page without a rule is blocked if its
    host's distrust is more than ``bias`` times its trust; so a host that nothing is known about is
    allowed. Ranks are settled ones unless ``rounds`` says how many rounds to spread.

    A null url, or one without ``://``, has an empty host and path, fits no rule and is allowed. Null
    html has no links. Repeated rows are judged alike, and each counts as a page. Columns with names
    of results are replaced. Everything is DataFrame operations; links are counted per pair of hosts
    where they are read, so a host with a third of all pages is one row in the graph. Pages of such a
    host, and links of a host that very many are linked to, meet its ranks in several tasks.
    """
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "trust", "distrust", html)]
    match, at, source = fresh("match"), fresh("at"), fresh("src")
    judged = pages.withColumns({"host": host_of(col(url)), "path": path_of(col(url))})
    judged = judged.withColumn(match, matching_rule(F.col("host"), F.col("path"), rules))
    pages_of = materialise(
        judged.groupBy("host").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum((col(match)["verdict"] == "allow").cast("double")).alias("good"), F.sum((col(match)["verdict"] == "block").cast("double")).alias("bad")
        ),
        "hosts",
    )
    counted = pages_of.where("host <> ''")
    if html:
        links = judged.select(F.col("host").alias(source), F.explode(F.regexp_extract_all(col(html), F.lit(LINK))).alias(at))
        links = links.select(F.col(source).alias("src"), host_of(F.concat(F.lit("://"), F.regexp_replace(at, "^(?i)(https?:)?//", ""))).alias("dst"))
        edges = links.where("src <> dst AND src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))
        edges = materialise(edges, "edges")
        every = counted.select("host", "good", "bad").unionByName(
            edges.select(F.col("dst").alias("host"), F.lit(0.0).alias("good"), F.lit(0.0).alias("bad"))
        ).groupBy("host").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    else:
        every = counted
    sums = counted.agg(F.sum("good"), F.sum("bad")).first()
    seeds = every.select(
        "host", (F.coalesce("good", F.lit(0.0)) / F.lit(sums[0] or 1.0)).alias("good"), (F.coalesce("bad", F.lit(0.0)) / F.lit(sums[1] or 1.0)).alias("bad")
    )
    if html and not edges.isEmpty():
        seeds = materialise(seeds, "seeds")
        trust = spread(edges, seeds, "good", damping, rounds)
        distrust = spread(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"), seeds, "bad", damping, rounds)
        scores = trust.select("host", F.col("rank").alias("trust")).join(distrust.select("host", F.col("rank").alias("distrust")), "host")
    else:  # without links the ranks are the seeds
        scores = seeds.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust"))
    copies = pages_of.select("host", copies_of(pages_of, "n").alias("copies"))
    heavy = copies.where("copies > 1").select(F.col("host").alias(source), "copies")
    scores = scores.join(F.broadcast(heavy), F.col("host") == F.col(source), "left").select(
        F.col("host").alias(at), "trust", "distrust", F.coalesce("copies", F.lit(1)).alias("copies")
    )
    parted = [c for c in names if not any(kind in pages.schema[c].dataType.simpleString() for kind in ("map<", "variant"))]
    rows = dealt(judged.select(*[col(c) for c in names], "host", "path", match), "host", copies, F.xxhash64("host", *[col(c) for c in parted]))
    joined = rows.join(in_parts(scores), (F.col("host") == F.col(at)) & (F.col("part__") == F.col("to_part__")), "left")
    trust, distrust = (F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust"))
    verdict = F.coalesce(col(match)["verdict"], F.when(distrust > bias * trust, "block").otherwise("allow"))
    return joined.select(
        *[col(c) for c in names], "host", "path", col(match)["rule"].alias("rule"), verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust")
    )
