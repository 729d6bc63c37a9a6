"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import functools
import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from limewash.llm.common import col
from limewash.llm.words import small_batches

#: Comments, declarations and tags. Quotes count only where a value of an attribute begins.
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+)>", re.S
)
ATTRIBUTE = re.compile(r"([^\s=>/\"'][^\s=>/]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?")
NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title noscript xmp iframe template".split())
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements, and words of names in class, id or role, that hold no article text.
APART = set("head nav footer aside form script style textarea noscript template button select option iframe svg canvas dialog menu object audio video title".split())
APART_WORD = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banners?|cookies?|consent|notice|popup|modal|overlay|sidebar|menu|nav\w*|breadcrumbs?"
    r"|comments?|replies|respond|disqus|share|sharing|social|related|recommend\w*|widgets?|footer|masthead|siteheader|login|signup|subscribe"
    r"|newsletter|pagination|pager|skip|hidden|complementary|contentinfo|search|toolbar|alert"
)
#: What may stand beside such a word in a name: places and kinds of boxes, not what is said of another element.
BESIDE = re.compile(
    r"site|page|posts?|articles?|entry|global|primary|secondary|main|top|bottom|left|right|upper|lower|inner|outer|mobile|desktop|sticky|fixed|google|header"
    r"|box|bar|area|lists?|items?|wrap|wrapper|container|holder|section|block|slot|unit|panel|column|col|row|group|links?|buttons?|icons?|form|field|input"
    r"|stories|content|body|title|text|media|message|policy|dialog|thread|trail|toggle|\d+"
)
#: Elements that no name sets apart.
NEVER_APART = set("html body main article h1 h2 h3 h4 h5 h6".split())
#: Elements that an opening tag of the kind ends, as far as an element of the second set.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
BLOCKY = set("address article aside blockquote center div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
PUNCTUATION = re.compile(r"[.,;:!?、。，！？؟।]")
SPACES = re.compile(r"\s+")
#: Labels of elements that name themselves the article, and elements that are only pieces of one.
CONTENT = re.compile(r"^(?:article|main)\b|(?:^|[.\s_-])(?:main|article|content|post|entry|story)(?:$|[\s_-](?:main|body|content|text|article)\b)")
PIECES = set("p h1 h2 h3 h4 h5 h6 li dt dd td th tr ul ol dl table blockquote pre figure".split())


HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Elements that only divide a page; at the edge of an article one without any content path is not part of it.
BOXES = set("div section center".split())


class Block(NamedTuple):
    path: tuple[str, ...]  # labels of the elements around it, from the root on
    apart: bool
    text: str
    nodes: tuple[int, ...]  # the same elements, by number
    signs: int  # punctuation marks of the text


@functools.lru_cache(1 << 14)
def apart_by_names(labels: str) -> bool:
    """Whether a class, id or role as a whole is made of words that hold no article text."""
    for name in labels.split():
        parts = [p for p in re.split("[-_]+", re.sub("site[-_]header", "siteheader", name)) if p]
        words = [bool(APART_WORD.fullmatch(p)) for p in parts]
        if any(words) and all(w or BESIDE.fullmatch(p) for w, p in zip(words, parts)):
            return True
    return False


@functools.lru_cache(1 << 14)
def named_and_hidden(inside: str) -> tuple[str, bool]:
    """Class, id and role of a tag, in lower case, and whether an attribute hides the element."""
    values: dict[str, str] = {}
    for name, *value in ATTRIBUTE.findall(inside):
        values.setdefault(name.lower(), "".join(value))
    labels = " ".join(values[k] for k in values if k in ("class", "id", "role") and values[k]).lower()
    hidden = "hidden" in values or values.get("aria-hidden", "").lower() == "true" or bool(NOT_SHOWN.search(values.get("style", "")))
    return labels, hidden


@dataclass
class Named:
    """An element that its name sets apart."""

    path: tuple[str, ...]
    outer: int  # the next such element around it, or -1


def parsed(page: str) -> tuple[list[tuple[Block, int]], list[Named]]:
    """Every block (apart: by tag or style) with the innermost element around it that a name sets
    apart, in page order, and these elements.

    A block is the text between two block-level tags; inline elements do not part it and ``br`` is a
    space. Open elements that a tag implies to end (a paragraph before a block, an item before the
    next) end there, a closing tag ends everything opened since, and one that fits nothing is ignored.
    """
    out: list[tuple[Block, int]] = []
    marks: list[Named] = []
    none = ("", "", False, -1, -1)
    stack: list[tuple[str, str, bool, int, int]] = []  # element, its label in paths, set apart, innermost mark, number
    pieces: list[str] = []
    at = elements = 0

    def close_block():
        text = SPACES.sub(" ", entities.unescape("".join(pieces))).strip()
        pieces.clear()
        if text:
            _, _, apart, mark, _ = (stack or [none])[-1]
            nodes = tuple(number for name, _, _, _, number in stack if name not in INLINE)
            out.append((Block(path_now(), apart, text, nodes, len(PUNCTUATION.findall(text))), mark))

    def path_now():
        return tuple(label for name, label, _, _, _ in stack if name not in INLINE)

    def pop_to(names: set[str], wall: set[str]):
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                del stack[k:]
                return
            if stack[k][0] in wall:
                return

    while at < len(page):
        m = TOKEN.search(page, at)
        if not m:
            pieces.append(page[at:])
            break
        pieces.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name == "br":
            pieces.append(" ")
        elif name in VOID and name != "hr":
            continue
        elif m[1]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if k is not None:
                if name not in INLINE or stack[-1][2:4] != (stack[k - 1] if k else none)[2:4]:
                    close_block()
                del stack[k:]
        else:
            labels, hidden = named_and_hidden(m[3]) if m[3] else ("", False)
            apart = name in APART or hidden
            if name == "header" and not any(s[0] in ("article", "main") for s in stack):
                apart = True
            marked = name not in NEVER_APART and apart_by_names(labels)
            if name in INLINE:
                if apart and not (stack and stack[-1][2]) or marked:
                    close_block()
            else:
                close_block()
                if name in BLOCKY:
                    pop_to({"p"}, {"article", "td", "th", "button"})
                if name in ENDS:
                    pop_to(*ENDS[name])
            if name == "hr" or m[3].rstrip().endswith("/") and name in ("svg", "path"):
                continue
            if name in RAW:
                end = re.compile(f"</{name}\\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
                continue
            _, _, around, mark, _ = (stack or [none])[-1]
            if marked:
                marks.append(Named((), mark))
                mark = len(marks) - 1
            stack.append((name, f"{name}.{labels}" if labels else name, around or apart, mark, elements))
            elements += 1
            if marked:
                marks[mark].path = path_now()
    close_block()
    return out, marks


def blocks_of(page: str) -> list[Block]:
    """Every block, in page order.

    A name does not set an element apart that holds more than half of the score of all blocks,
    unless an article or main element elsewhere holds text that nothing sets apart.
    """
    found, marks = parsed(page)
    apart_by_name = [True] * len(marks)
    if marks:
        score = ratios([block for block, _ in found])
        held = [0.0] * len(marks)
        for (_, mark), s in zip(found, score):
            if mark >= 0:
                held[mark] += float(s)
        for k in range(len(marks) - 1, -1, -1):
            if marks[k].outer >= 0:
                held[marks[k].outer] += held[k]
        large = [k for k in range(len(marks)) if held[k] > score.sum() / 2]
        if large:
            articles = {
                block.path[: k + 1] for block, mark in found if not block.apart and mark < 0
                for k, label in enumerate(block.path) if label.split(".")[0] in ("article", "main")
            }
            for k in large:
                apart_by_name[k] = any(marks[k].path[: len(a)] != a for a in articles)
        for k, mark in enumerate(marks):
            apart_by_name[k] |= mark.outer >= 0 and apart_by_name[mark.outer]
    return [block._replace(apart=block.apart or mark >= 0 and apart_by_name[mark]) for block, mark in found]


def path_ratios(blocks: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """Per block the two ratios of its path: text length, and punctuation marks, of all blocks of the
    path divided by their number. Blocks set apart have none."""
    length, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for path, _, text, _, signs in blocks:
        length[path] += len(text)
        marks[path] += signs
        count[path] += 1
    inside = np.array([not b.apart for b in blocks])
    return np.array([length[b.path] / count[b.path] for b in blocks]) * inside, np.array([marks[b.path] / count[b.path] for b in blocks]) * inside


def ratios(blocks: list[Block]) -> np.ndarray:
    """The fused, smoothed score of every block: the ratios of the paths are smoothed over neighbouring
    blocks and multiplied. Blocks set apart score nothing."""
    inside = np.array([not b.apart for b in blocks])
    kernel = np.array([0.25, 0.5, 0.25])
    smooth = [np.convolve(np.pad(x, 1), kernel, "valid") * inside for x in path_ratios(blocks)]
    return smooth[0] * (1 + smooth[1])


def content_of(blocks: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """Which blocks are content, and which stand on a path that the threshold selects.

    The threshold is the spread of all scores. A path is selected if its own fused ratio reaches it; a
    block of such a path is content if its smoothed score reaches it too, so neither a short neighbour
    of long text nor a lone long line counts. If that leaves none, the smoothed score decides alone.
    """
    score = ratios(blocks)
    least = min(score.std(), score.max())
    length, marks = path_ratios(blocks)
    high = (score >= least) & (score > 0)
    chosen = (length * (1 + marks) >= least) & (length > 0)
    return (high & chosen if (high & chosen).any() else high), chosen


def main_text(page: str) -> str:
    """The article of one page: blocks joined by one space, in page order.

    The path ratios select content blocks (``content_of``). The article is the outermost element
    around all of them that names itself so; without one, the innermost element around all of them
    that is more than a paragraph, heading or the like. All blocks of the element that are not set
    apart belong to the article, so short paragraphs and headings stay with it. Where no name tells
    the article, boxes at its begin and end none of whose paths the ratios select (menus, notices of
    rights) do not belong to it, and headings right before it do.
    """
    blocks = blocks_of(page)
    if not any(not b.apart for b in blocks):
        return ""
    content, chosen = content_of(blocks)
    where = np.flatnonzero(content)
    at, labels = (blocks[where[0]].nodes, blocks[where[0]].path) if len(where) else ((), ())
    for k in where[1:]:
        at = at[: _shared(at, blocks[k].nodes)]
    depth = len(at)
    while depth and labels[depth - 1].split(".")[0] in PIECES:
        depth -= 1
    named = next((k for k, label in enumerate(labels[:depth]) if CONTENT.search(label)), None)
    if named is not None:
        depth = named + 1
    at = at[:depth]
    inside = np.array([not b.apart and b.nodes[:depth] == at for b in blocks])
    if named is None and len(where):
        first = int(np.flatnonzero(inside)[0])
        telling = {b.nodes[depth] for b, c in zip(blocks, chosen) if c and b.nodes[:depth] == at and len(b.nodes) > depth}
        for k in [*range(where[0]), *range(where[-1] + 1, len(blocks))]:
            b = blocks[k]
            if inside[k] and len(b.nodes) > depth and b.path[depth].split(".")[0] in BOXES and b.nodes[depth] not in telling:
                inside[k] = False
        for k in range(first - 1, -1, -1):
            b = blocks[k]
            if b.apart or not b.path or b.path[-1].split(".")[0] not in HEADINGS or b.nodes[:-1] != at[: len(b.nodes) - 1]:
                break
            inside[k] = True
    return " ".join(b.text for b, kept in zip(blocks, inside) if kept)


def _shared(a: tuple[int, ...], b: tuple[int, ...]) -> int:
    """How many elements two blocks share from the root on."""
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def extract(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``df`` with the main text of each page instead of its html.

    A null or empty page, and one without an article, gives an empty text. Every row is judged on its
    own, so repeated rows are alike, nothing is shuffled and a common host has no hot task. A column
    named like ``out`` is replaced.
    """
    names = [c for c in df.columns if c not in (html, out)]
    kept = df.select(*[col(c) for c in names], col(html).alias("html__page"))
    schema = "".join(f"`{c.replace('`', '``')}` {df.schema[c].dataType.simpleString()}, " for c in names) + f"`{out}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "html__page"):
            texts = [main_text(p) if p else "" for p in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(texts, pa.string())], names=[*names, out])

    return kept.mapInArrow(run, schema)
