"""Main text of web pages, with a site style tree built from all pages of a host.

The pages of a host are merged into one tree of styles: a node is a path of elements with their classes and
ids. A node's importance comes from two entropies over the pages that have it: of the elements it consists of
(presentation) and of its text (content). A menu or a notice that is the same on page after page has little of
both. Branches of low importance are removed from each page, besides those whose element or name says what
they are, unless they hold the article; the article's own paragraphs are never removed for being common.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.storage import materialize
from tracewell.llm.common import free_name, others

# Fixed names from the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg annotation annotation-xml object select".split())
FOREIGN = {"svg", "math"}  # what ends with a slash here is empty
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure "
             "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section "
             "summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCKS - set("body dd dt head html li tbody td tfoot th thead title tr".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}}
HOLDERS = set("ul ol dl table body article section div".split())  # an implied end does not reach beyond these
#: What the elements' names, roles, classes and ids say about them.
NOISE = set("head nav header footer aside form menu button dialog search".split())
_NOISE_WORDS = (
    r"(?:ads?|advert\w*|banner|breadcrumbs?|comments?|commentlist|complementary|contentinfo|consent|cookies?|disqus|"
    r"footer|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|notification|"
    r"popup|promo\w*|related|replies|reply|respond|search|share|sharing|sidebar|social|sponsor\w*|subscribe|"
    r"toolbar|widget)")
NOISE_NAME = re.compile(rf"(?:^|[^a-z]){_NOISE_WORDS}(?:$|[^a-z])")
#: Inside an article a class or id must say nothing else: a paragraph may well be on related-work.
_PART_WORDS = r"(?:area|articles?|bar|block|box|buttons?|container|form|item|links?|list|panel|posts?|section|signup|slot|wrapper)"
NOISE_TOKEN = re.compile(rf"(?:^|\s)(?:{_PART_WORDS}[-_]+)*{_NOISE_WORDS}(?:[-_]+(?:{_NOISE_WORDS}|{_PART_WORDS}))*(?:$|\s)")
#: Classes and ids of what readers wrote, which may well be longer than the article.
TALK = re.compile(r"(?:^|\s)(?:comments?|commentlist|disqus|replies|reply|respond)(?:$|\s)")
HEAD = set("base basefont bgsound link meta noframes noscript script style template title".split())
WHOLE = set("html body article main".split())  # never noise for their names
CONTAINERS = BLOCKS - set("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot html body head title hr pre".split())
MAIN = {"article", "main"}
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
SPECIAL = re.compile("[>\"']")
#: More open elements than this are not nested: the innermost one ends where the next begins.
MAX_DEPTH = 512
#: A style path of more characters than this is known by its hash.
PATH_CHARS = 256
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|\bstyle\s*=\s*(?:\"[^\"]*|'[^']*|[^\s\"']*)display\s*:\s*none", re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


@dataclass
class Node:
    """An open element. ``path`` is its style path, of which a long beginning is a hash, ``main`` whether it is or is in an article or main part.

    ``noise`` says that its tag or one above is noise; ``weak`` and ``part`` are the innermost weak element and
    main part it is or is in, or -1, and ``article`` whether it is or is in an article.
    """

    tag: str
    path: str
    noise: bool
    main: bool
    named: bool
    first: int  # index of its first block
    weak: int = -1
    part: int = -1
    article: bool = False
    children: list[str] = field(default_factory=list)


@dataclass
class Branch:
    """A closed container: its blocks are ``[first, last)``; ``holds`` says whether an article is inside.

    ``main`` says whether it is or is in an article or main part.
    """

    path: str
    first: int
    last: int
    children: str
    holds: bool
    main: bool


@dataclass
class Page:
    """A page's blocks of text, whether each is noise by name and in the main part, and its branches."""

    blocks: list[str] = field(default_factory=list)
    noise: list[bool] = field(default_factory=list)
    main: list[bool] = field(default_factory=list)
    branches: list[Branch] = field(default_factory=list)


@dataclass
class Weak:
    """An element that is noise by its name or as a form, unless the page says otherwise; ``up`` is the one above."""

    up: int
    talk: bool  # it is or is in what readers wrote


@dataclass
class Part:
    """An article or main part that may be the page's own; ``up`` is the one it is in."""

    up: int
    weak: int


def dead(weak: list[Weak], parts: list[Part], blocks: list[tuple[int, int, int]]) -> list[bool]:
    """Of each weak element whether it is noise; ``blocks`` are size, weak element and part of those that may stay.

    Those around the page's own article aren't: if no article is outside all of them, the ones around the
    articles that are in the fewest. Nor are those that hold more than half of the text of these articles, or of
    the page if it has none; what readers wrote only if nothing else is there. A main part with more text outside
    its articles than inside counts as one itself.
    """
    own, whole, depth = [0] * len(parts), [0] * len(parts), []
    for size, _, part in blocks:
        if part >= 0:
            own[part] += size
    for i in range(len(parts) - 1, -1, -1):
        whole[i] += own[i]
        if parts[i].up >= 0:
            whole[parts[i].up] += whole[i]
    for w in weak:
        depth.append(1 + (depth[w.up] if w.up >= 0 else 0))
    over = [depth[p.weak] if p.weak >= 0 else 0 for p in parts]
    chosen = [i for i in range(len(parts)) if 2 * own[i] > whole[i]]
    alive = [False] * len(weak)
    least = min((over[i] for i in chosen), default=0)
    for i in chosen:
        at = parts[i].weak if over[i] == least else -1
        while at >= 0 and not alive[at]:
            alive[at], at = True, weak[at].up
    core = [p.weak < 0 or alive[p.weak] for p in parts]
    held = [(size, at) for size, at, part in blocks if part >= 0 and core[part]] or [(size, at) for size, at, _ in blocks]
    total, inside = sum(size for size, _ in held), [0] * len(weak)
    for size, at in held:
        if at >= 0:
            inside[at] += size
    for i in range(len(weak) - 1, -1, -1):
        if weak[i].up >= 0:
            inside[weak[i].up] += inside[i]
        alive[i] |= 2 * inside[i] > total and (not weak[i].talk or inside[i] == total)
    out: list[bool] = []
    for w, lives in zip(weak, alive, strict=True):
        out.append(not lives or (w.up >= 0 and out[w.up]))
    return out


class Tags:
    """Where the tags of a text end. Each quote and bracket is followed once, however many tags are left open."""

    def __init__(self, html: str):
        self.html, self.known = html, {-1: -1}
        self.seen, self.next = 0, -1  # the first bracket or quote from ``seen`` on is at ``next``
        self.last = html.rfind(">")

    def _special(self, at: int) -> int:
        found = SPECIAL.search(self.html, at)
        return found.start() if found else -1

    def end(self, at: int) -> int:
        """The end of the tag whose attributes begin at ``at``, outside quotes; -1 if it has none."""
        if not self.seen <= at <= self.next:
            if self.next < 0 < self.seen <= at:
                return -1
            self.seen, self.next = at, self._special(at)
        p, way = self.next, []
        while p not in self.known:
            way.append(p)
            if self.html[p] == ">":
                self.known[p] = p + 1
                break
            close = self.html.find(self.html[p], p + 1)
            p = self._special(close + 1) if close >= 0 else -1
        out = self.known[way[-1]] if way and way[-1] in self.known else self.known[p]
        for q in way:
            self.known[q] = out
        return out

    def token(self, at: int) -> tuple[int, int, bool, str | None, str] | None:
        """Start and end of the next piece of markup from ``at`` on, whether it is an end tag, its name and attributes."""
        html = self.html
        while (start := html.find("<", at)) >= 0:
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(html), False, None, ""
            closing = html.startswith("/", start + 1)
            name = NAME.match(html, start + 1 + closing)
            if name and (end := self.end(name.end())) >= 0:
                return start, end, closing, name[0], html[name.end():end - 1]
            if html[start + 1:start + 2] in ("!", "?", "/") and self.last > start + 1:
                return start, html.find(">", start + 2) + 1, False, None, ""
            at = start + 1
        return None


def read(html: str) -> Page:
    """The page that a browser would more or less see: implied ends are supplied, stray ends ignored."""
    page, buffer = Page(), []
    stack = [Node("", "", False, False, False, 0)]
    weak: list[Weak] = []
    parts: list[Part] = []
    places: list[tuple[int, int]] = []  # of each block its weak element and part

    def flush() -> None:
        text = " ".join(unescape("".join(buffer)).split()) if buffer else ""
        buffer.clear()
        if text:
            page.blocks.append(text)
            page.noise.append(stack[-1].noise)
            page.main.append(stack[-1].main)
            places.append((stack[-1].weak, stack[-1].part))

    def close(depth: int) -> None:
        flush()
        while len(stack) > depth:
            node = stack.pop()
            inner = marks.pop(len(stack), set()) | ({node.weak} if node.tag in MAIN else set())
            if node.tag in CONTAINERS or node.named:
                page.branches.append(
                    Branch(node.path, node.first, len(page.blocks), " ".join(node.children), bool(inner), node.main))
                held.append(inner)

    marks: dict[int, set[int]] = {}  # weak elements of the articles seen inside an open element, by its depth
    held: list[set[int]] = []  # the same of each branch
    at, size, tags = 0, len(html), Tags(html)
    while at < size:
        token = tags.token(at)
        if token is None:
            buffer.append(html[at:])
            break
        start, end, closing, tag, attributes = token
        if start > at:
            buffer.append(html[at:start])
        at = end
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    above = stack[depth - 1]
                    if tag in BLOCKS or (stack[depth].noise, stack[depth].weak) != (above.noise, above.weak):
                        close(depth)
                    elif not any(n.tag in BLOCKS for n in stack[depth + 1:]):  # text goes on in the same block
                        del stack[depth:]
                        marks.pop(depth, None)
                    break
                if tag not in BLOCKS and stack[depth].tag in BLOCKS:
                    break
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag in FOREIGN and attributes.endswith("/"):
            continue
        if tag in ("mtr", "mtd"):
            buffer.append(" ")
        if stack[-1].tag == "head" and tag not in HEAD:
            close(len(stack) - 1)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else size
            continue
        if tag == "p" or tag in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    close(depth)
                    break
                if stack[depth].tag in BLOCKS:
                    break
        if tag in SAME:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in HOLDERS and stack[depth].tag != tag:
                    break
                if stack[depth].tag in SAME[tag]:
                    close(depth)
                    if tag not in ("tr", "tbody"):
                        break
        if tag in BLOCKS:
            flush()
        if tag in VOID:
            continue
        if len(stack) > MAX_DEPTH:
            close(len(stack) - 1)
        above, style = stack[-1], tag
        names = " ".join(x or y or z for _, x, y, z in ATTRIBUTE.findall(attributes)).lower() if attributes else ""
        if names:
            style += "." + ".".join(re.sub(r"\d+", "9", names).split())
        above.children.append(style)
        inside = above.main or tag in MAIN or "main" in names.split()
        said = names.replace("header", "") if above.article else names
        hidden = bool(attributes) and tag not in WHOLE and bool(HIDDEN.search(attributes))
        noise = above.noise or hidden or (tag in NOISE and tag != "form" and not (tag == "header" and above.article))
        within, part = above.weak, above.part
        if tag == "form" or (
                tag not in WHOLE and said and (NOISE_TOKEN if above.article else NOISE_NAME).search(said)):
            talk = bool(TALK.search(names)) or (within >= 0 and weak[within].talk)
            weak.append(Weak(within, talk))
            within = len(weak) - 1
        elif inside and (tag in MAIN or "main" in names.split()) and not above.article and not noise:
            if within < 0 or not weak[within].talk:
                parts.append(Part(part, within))
                part = len(parts) - 1
        if tag in MAIN and not noise:
            for depth in range(1, len(stack)):
                marks.setdefault(depth, set()).add(within)
        if names and tag not in BLOCKS and (noise, within) != (above.noise, above.weak):
            flush()  # an inline part with a name of its own ends the block
        path = f"{above.path}>{style}"
        if len(path) > PATH_CHARS:
            path = "#" + xxhash.xxh3_64_hexdigest(path)
        stack.append(Node(tag, path, noise, inside, bool(names), len(page.blocks), within, part,
                          above.article or tag == "article"))
    close(1)
    if weak:
        gone = dead(weak, parts, [(len(b), *at) for b, n, at in zip(page.blocks, page.noise, places, strict=True) if not n])
        for branch, inner in zip(page.branches, held, strict=True):
            branch.holds = any(at < 0 or not gone[at] for at in inner)
        page.noise = [n or (at >= 0 and gone[at]) for n, (at, _) in zip(page.noise, places, strict=True)]
    return page


def kept(page: Page) -> list[bool]:
    """Of each block whether it is in the page's article or, without one, not noise."""
    keep = [not n for n in page.noise]
    if any(k and m for k, m in zip(keep, page.main, strict=True)):
        keep = [k and m for k, m in zip(keep, page.main, strict=True)]
    return keep


def main_text(html: str | None, low: set[str] = frozenset()) -> str:
    """The blocks of a page's article, joined by line ends; ``low`` are paths of unimportant branches.

    A page without an article or main part gives all that is not noise. A branch stays, however unimportant
    its path, if it holds the article, is in it, or has half of the text that is left when its end is reached.
    """
    page = read(html or "")
    keep = kept(page)
    sizes = [len(b) * k for b, k in zip(page.blocks, keep, strict=True)]
    left = sum(sizes)
    for branch in page.branches:
        if branch.path in low and not branch.holds and not branch.main:
            own = sum(sizes[branch.first:branch.last])
            if 2 * own < left:
                left -= own
                for i in range(branch.first, branch.last):
                    keep[i], sizes[i] = False, 0
    return "\n".join(b for b, k in zip(page.blocks, keep, strict=True) if k)


def host(url: str = "url") -> Column:
    """The host of an address, in lower case; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(
        F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def style_nodes(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host, page, path, children, text, n, open``: how often each distinct page has a style node of these hashes.

    ``page`` is a hash of the whole page, so that equal pages of a host are one; ``open`` says whether the node
    has text of the page that would go with it.
    """
    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for site, key, source in zip(batch["host"], batch["page"], batch["html"], strict=True):
                page, seen, may_go = read(source or ""), Counter(), set()
                keep = kept(page)
                for b in page.branches:
                    if not b.holds:
                        if not b.main and any(keep[b.first:b.last]):
                            may_go.add(b.path)
                        text = "\n".join(page.blocks[b.first:b.last])
                        seen[b.path, xxhash.xxh3_64_intdigest(b.children) >> 1, xxhash.xxh3_64_intdigest(text) >> 1] += 1
                out += [(site, key, *node, n, node[0] in may_go) for node, n in seen.items()]
            yield pd.DataFrame(out, columns=["host", "page", "path", "children", "text", "n", "open"])

    found = pages.select(host(url).alias("host"), F.xxhash64(F.col(f"`{html}`").cast("string")).alias("page"), F.col(
        f"`{html}`").cast("string").alias("html")).mapInPandas(
        nodes, "host string, page long, path string, children long, text long, n long, open boolean")
    return materialize(found.groupBy("host", "page", "path", "children", "text").agg(
        F.max("n").alias("n"), F.max("open").alias("open")), "style-nodes")


def style_tree(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host, path, pages, presentation, content, importance`` of each style node that is a container.

    ``presentation`` and ``content`` are entropies over the occurrences of a node, in units of the highest that
    so many occurrences can have: 0 if all are alike, 1 if all differ, and 1 for a single one. ``importance``
    weighs content twice. Texts and element lists enter as hashes, and equal pages of a host once.
    """
    return _tree(style_nodes(pages, url, html))


def _tree(nodes: DataFrame) -> DataFrame:
    counted = nodes.groupBy("host", "path", "children", "text").agg(F.sum("n").alias("count"))

    def entropy(of: str) -> DataFrame:
        each = counted.groupBy("host", "path", of).agg(F.sum("count").alias("n"))
        total = each.groupBy("host", "path").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("s"))
        return total.select("host", "path", "pages", F.when(F.col("pages") > 1, F.greatest(
            F.lit(0.0), 1 - F.col("s") / (F.col("pages") * F.log("pages")))).otherwise(1.0).alias(of))

    both = entropy("children").join(entropy("text").drop("pages"), ["host", "path"])
    return both.select("host", "path", "pages", F.col("children").alias("presentation"), F.col("text").alias("content"),
                       ((F.col("children") + 2 * F.col("text")) / 3).alias("importance"))


def extracted(pages: DataFrame, url: str = "url", html: str = "html", text: str = "text", least_pages: int = 3,
              low: float = 0.2) -> DataFrame:
    """``pages`` with the main text of each whole page, which replaces a column named ``text``.

    Style nodes that occur at least ``least_pages`` times, on equal pages once, are removed if their importance is
    below ``low``, however many pages their host has: each page is joined with those of its own that are low. A null or empty page
    has an empty text; equal pages of a host have equal texts; pages without a host form one site; an empty table gives no rows.
    Markup that is left open and elements nested beyond ``MAX_DEPTH`` are read in one pass, however long the page.
    """
    nodes = style_nodes(pages, url, html)
    poor = _tree(nodes).where((F.col("pages") >= least_pages) & (F.col("importance") < low)).select("host", "path")
    lows = materialize(nodes.where("open").select("host", "page", "path").join(poor, ["host", "path"]).groupBy(
        "host", "page").agg(F.collect_set("path").alias("_low")), "low-branches")
    columns, site, key = others(pages, [text]), free_name(pages, "_host"), free_name(pages, "_page")
    first, second = free_name(pages, "_low"), free_name(pages, "_html")
    source = pages.withColumns({site: host(url), key: F.xxhash64(F.col(f"`{html}`").cast("string"))}).join(
        lows.select(F.col("host").alias(site), F.col("page").alias(key), F.col("_low").alias(first)), [site, key],
        "left").select(first, F.col(f"`{html}`").cast("string").alias(second), *(F.col(f"`{c}`") for c in columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                texts = [main_text(h, set(low or ())) for low, h in zip(
                    part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[2:], pa.array(texts, pa.string())], names=[*columns, text])

    schema = source.drop(first, second).schema.add(text, "string")
    return source.mapInArrow(run, schema)
