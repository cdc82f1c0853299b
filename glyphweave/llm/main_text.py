"""Main text of web pages by tag-path ratios.

Every text node has a root-to-leaf tag path. The paths of a page form a tree; text length, punctuation,
link text and node count are summed for each path and, from the leaves up, for each subtree. The two
ratios per node are smoothed down the tree, half of a path's own subtree and half of what its parent
has; fused; and paths below a share of the best are dropped. Element, role, class or id are a prior on
the score: paths in an article or main element weigh more, paths through menus, footers, adverts,
forms, comments and the like a hundredth, and where a class or id only hints at such a zone a fifth.
An article of which any path is kept stays with all its paths, headings, lists and cells too; a zone
or a part in doubt within it is judged by its own. What is left is put out block by block in page order.

A page is decided from its own paths alone, so pages need no shuffle and very short ones no corpus.
Reading and scoring are linear in a page's length, however deep its elements or broken its quotes.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: A path is kept if its fused score is at least this share of the page's best.
THRESHOLD = 0.05

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: Elements that hold nothing of a page's text.
SILENT = frozenset("head script style button select option textarea template noscript iframe object svg math canvas audio video title".split())
ZONES = frozenset("nav header footer aside form dialog menu".split())
#: Elements whose paths are kept together, if one of them is, whatever their own scores.
SUBTREES = ("article", "main")
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: Words of a class or id that name such a zone.
ZONE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer sidebar aside widget cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup subscription "
    "comment comments disqus replies reply discussion share sharing social related recommended pagination pager toolbar form search login".split()
)
#: Words beside them in a token that names a zone as a whole (ad-container, comment-list); any other word leaves it in doubt (has-sidebar, related-work).
LAYOUT = frozenset(
    "area bar block body bottom box button buttons column container count footer group icons inner item items left link links list main message module outer page panel post posts "
    "primary region right secondary section site slot title top unit widgets wrap wrapper".split()
)
#: Words that name a zone, but a subject too where they are the id of a part of an article.
SUBJECTS = frozenset("advertising advertisement alert consent discussion form navigation notice notices related search sharing social subscription".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ZONE = " "
#: What a path weighs in an article or main element, in an element that is in doubt, and in a zone.
ARTICLE, DOUBT, OUTSIDE = 4.0, 0.2, 0.01
#: Elements that an opening tag ends, innermost first, up to the elements that hold them.
ENDS = {
    "p": (frozenset({"p"}), frozenset("article section div main body td th li blockquote nav aside footer header form fieldset button".split())),
    "li": (frozenset({"li"}), frozenset("ul ol menu".split())),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
ENDS_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>|[^<]+|<",
    re.DOTALL,
)
#: Tags of a page in which a quote runs to the end: they end at the first angle bracket.
_BROKEN = re.compile(r"<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>[^>]*)>")
_PLAIN = re.compile(r"(?P<close>)(?P<name>(?!))|<!--.*?(?:-->|\Z)|<[!?][^>]*>?|[^<]+|<", re.DOTALL)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_PUNCTUATION = re.compile(r"[^\w\s]")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.IGNORECASE) for name in RAW}


@dataclass(eq=False, slots=True)
class _Open:
    """An element, and what holds for all that is in it."""

    name: str
    parent: _Open | None
    silent: bool
    zone: bool
    link: bool
    inside: bool
    #: Whether a class or id names a zone: "" no, ZONE yes, else the token that has such a word among others.
    said: str = ""
    #: Whether it or an element around it is said to be a zone, or in doubt.
    hinted: bool = False
    chars: int = 0
    path: int = 0
    below: bool = False


@dataclass(slots=True)
class Leaf:
    holder: _Open
    block: int
    text: str


@dataclass(slots=True)
class Path:
    """A root-to-leaf tag path: a node of the tree of a page's paths."""

    name: str
    parent: int
    prior: float
    zone: bool
    #: The path of the element with which it is kept: an article or main element, a zone, or one in doubt.
    root: int | None
    kind: str
    chars: int = 0
    marks: int = 0
    linked: int = 0
    nodes: int = 0


def _said(name: str, attrs: list[tuple[str, str]], inside: bool) -> str:
    """What class and id say of an element, inside an article or outside of one."""
    if name in ("html", "body", "article", "main") or name in HEADINGS:
        return ""
    doubt = ""
    for key, value in attrs:
        for token in value.split() if key in ("class", "id") else ():
            words = set(_WORD.findall(token))
            if not words & ZONE_WORDS:
                continue
            if words <= ZONE_WORDS | LAYOUT and not (key == "id" and inside and words <= SUBJECTS):
                return ZONE
            doubt = doubt or token
    return doubt


def _spare(elements: list[_Open], texts: list[Leaf]) -> None:
    """Take back what is said of elements that hold the page's largest article or main element, or else most of its text."""
    total = free = 0
    for leaf in texts:
        x = leaf.holder
        n = 0 if x.silent or x.zone else len(leaf.text.strip())
        total += n
        free += 0 if x.hinted else n
        x.chars += n
    for x in reversed(elements):
        if x.parent is not None:
            x.parent.chars += x.chars
    largest = max((x for x in elements if x.name == "main" and x.chars), key=lambda x: x.chars, default=None)
    for x in elements:
        x.below = x.parent is not None and (x.parent.below or x.parent is largest)
    # An article beside a larger main element is a comment or a teaser.
    articles = (x for x in elements if x.name == "article" and x.chars and (largest is None or x.below or x.chars > largest.chars))
    for best in (largest, max(articles, key=lambda x: x.chars, default=None)):
        if best is not None and best.chars >= free:
            while (best := best.parent) is not None:
                best.said = ""
    if not any(x.name in SUBTREES and x.chars for x in elements):
        for x in elements:
            if 2 * x.chars > total:
                x.said = ""


def read_page(html: str) -> tuple[list[_Open], list[Leaf]]:
    """The elements of a page and its text nodes; text between the same two block borders has one block number."""
    top = _Open("", None, False, False, False, False)
    elements, texts, stack = [top], [], [top]
    opened: Counter[str] = Counter()
    block = at = 0
    broken = False
    closing = html.rfind(">")

    def close(k: int) -> None:
        opened.subtract(x.name for x in stack[k:])
        del stack[k:]

    while at < len(html):
        m = _TOKEN.match(html, at) if not broken else _BROKEN.match(html, at) or _PLAIN.match(html, at)
        token = m.group()
        if token == "<" and not broken and at < closing and _BROKEN.match(html, at):
            broken = True
            continue
        at = m.end()
        name = m["name"]
        if name is None and token == "<" and at > closing:
            token, at = html[at - 1 :], len(html)  # no tag ends any more
        if name is None:
            if not token.startswith(("<!", "<?")):
                texts.append(Leaf(stack[-1], block, entities.unescape(token)))
            continue
        name = name.lower()
        if name not in INLINE and name != "br":
            block += 1
        if m["close"]:
            if opened[name] > 0:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name))
            continue
        if name == "br":
            texts.append(Leaf(stack[-1], block, " "))
            continue
        if name in VOID:
            continue
        for ended, holders in ([ENDS["p"]] if name in ENDS_P else []) + ([ENDS[name]] if name in ENDS else []):
            low, left = None, sum(opened[x] for x in ended)
            for k in range(len(stack) - 1, 0, -1):
                if not left or stack[k].name in holders and stack[k].name not in ended:
                    break
                if stack[k].name in ended:
                    low, left = k, left - 1
            if low is not None:
                close(low)
        attrs = m["attrs"]
        if name in RAW:
            end = _RAW_END[name].search(html, at)
            at = end.end() if end else len(html)
            continue
        if not attrs.endswith("/") or name not in ("svg", "math"):
            named = [(key.lower(), value.strip("\"'").lower()) for key, value in _ATTR.findall(attrs)]
            hidden = any(key == "hidden" or key == "aria-hidden" and value == "true" for key, value in named)
            zone = name in ZONES or any(key == "role" and value in ROLES for key, value in named)
            up = stack[-1]
            x = _Open(name, up, up.silent or hidden or name in SILENT, up.zone or zone, up.link or name == "a", up.inside or name in SUBTREES)
            x.said = _said(name, named, up.inside)
            x.hinted = up.hinted or bool(x.said)
            elements.append(x)
            stack.append(x)
            opened[name] += 1
    return elements, texts


def tag_paths(elements: list[_Open], texts: list[Leaf]) -> list[Path]:
    """The tree of a page's paths, parents first, with the sums of the text right on each path."""
    paths = [Path("", -1, 1.0, False, None, "")]
    known: dict[tuple[int, str, bool, str], int] = {}
    for x in elements[1:]:
        up = x.parent.path
        if x.name in INLINE and not x.said:
            x.path = up
            continue
        own_zone = x.said == ZONE or x.zone
        mark = (up, x.name, own_zone, x.said)
        if mark not in known:
            p = paths[up]
            n = known[mark] = len(paths)
            prior, zone, root, kind = p.prior, p.zone or own_zone, p.root, p.kind
            if zone and not p.zone:
                prior, root, kind = prior * OUTSIDE, n, "zone"
            elif x.said and not zone:
                prior, root, kind = prior * DOUBT, n, "doubt"
            elif x.name == "article" and kind in ("", "main") or x.name == "main" and not kind:
                prior, root, kind = prior * (1 if kind else ARTICLE), n, x.name
            paths.append(Path(x.name, up, prior, zone, root, kind))
        x.path = known[mark]
    for leaf in texts:
        text = leaf.text.strip()
        if text and not leaf.holder.silent:
            p = paths[leaf.holder.path]
            p.chars += len(text)
            p.marks += len(_PUNCTUATION.findall(text))
            p.linked += len(text) if leaf.holder.link else 0
            p.nodes += 1
    return paths


def path_scores(paths: list[Path]) -> list[float]:
    """The fused, smoothed ratios of every path with text on it, by its prior; 0 for the others."""
    chars, marks, nodes = ([getattr(p, k) for p in paths] for k in ("chars", "marks", "nodes"))
    for k in range(len(paths) - 1, 0, -1):
        up = paths[k].parent
        chars[up] += chars[k]
        marks[up] += marks[k]
        nodes[up] += nodes[k]
    length, mark = [0.0] * len(paths), [0.0] * len(paths)
    out = [0.0] * len(paths)
    for k, p in enumerate(paths):
        a, b = (chars[k] / nodes[k], marks[k] / nodes[k]) if nodes[k] else (0.0, 0.0)
        length[k] = a if k == 0 else 0.5 * a + 0.5 * length[p.parent]
        mark[k] = b if k == 0 else 0.5 * b + 0.5 * mark[p.parent]
        if p.nodes:
            out[k] = length[k] * (1 + mark[k]) * (1 - 0.9 * p.linked / p.chars) * p.prior
    return out


def main_text(html: str | None, threshold: float = THRESHOLD) -> str:
    """The page's article, a block a line; empty if there is none."""
    if not html:
        return ""
    elements, texts = read_page(html)
    if any(x.said for x in elements):
        _spare(elements, texts)
    paths = tag_paths(elements, texts)
    scores = path_scores(paths)
    best = max((s for s, p in zip(scores, paths, strict=True) if not p.zone), default=0.0)
    if best <= 0:
        return ""
    kept = [s > 0 and s >= threshold * best for s in scores]
    roots = {p.root for p, k in zip(paths, kept, strict=True) if k and p.root is not None}
    blocks: dict[int, list[str]] = {}
    for leaf in texts:
        x = leaf.holder
        if not x.silent and (kept[x.path] or paths[x.path].root in roots or not leaf.text.strip()):
            blocks.setdefault(leaf.block, []).append(leaf.text)
    lines = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
    return "\n".join(x for x in lines if x)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
        )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    Null or empty html, and a page without text outside the zones, give the empty text. Broken markup
    (no end tags, an open comment, raw elements cut off) is read to the end. Ids and urls are passed
    through, null or repeated as they are; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
