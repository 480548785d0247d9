"""Operator 7: main text of web pages by composite text density.

Every DOM node gets a density: characters per tag, adjusted by the characters and tags inside
links (on a page without links, characters per tag alone). A block's sum is that of its children's
densities, or its own density where no block is inside. The smallest density on the path from the block
of the largest sum to the body is the threshold; in every block that reaches it the block of the
largest sum is content, whole. Menus, headers, footers, asides, adverts, notices, forms, scripts,
styles and reader comments, known by their tag, role or the words of a class or id, never count;
the header of an article is its heading and counts.

Cases: null or empty html, html without text: empty text. Pages of nothing but links are content.
Unclosed, crossed and stray tags are repaired; a last ``<`` without an end is text. Repeated rows give
repeated results. Only page_id, url and html are read, so other columns can't clash. Long pages are
read whole, in linear time; memory is that of a slice of pages.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massweave.llm.common import map_rows, table

NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
#: The rest of a tag. Quotes count only as delimiters of a value; one that never closes is a character.
REST = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+>""")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'<>=`]++))?+""")
#: Elements whose content isn't the page's text.
RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "noscript", "template", "textarea", "svg", "iframe")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th thead tbody tfoot caption blockquote pre figure figcaption address details summary hr center fieldset header footer nav aside form".split())
CLOSES_P = BLOCK - {"html", "body"}
NOISE_TAGS = frozenset("head nav footer aside form button select option menu dialog object title".split())
#: Words of class, id and role values that mark what isn't the article, at the front or the end of a hyphenated name.
NOISE_WORD = re.compile(r"ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|footer|sidebar\w*|aside|widgets?|comments?|respond|disqus\w*|cookies?|consent|notices?|popup|modal|newsletter|subscribe|share|sharing|social|related|login|search|pagination|pager|complementary|contentinfo|navigation|masthead|header")
#: In front of "header" these mean the page's; any other word the heading of what it names.
PAGE_WORDS = frozenset("site page global top main blog masthead".split())
WORD_ENDS = re.compile(r"[-_]+")
HIDDEN = re.compile(r"display\s*:\s*none", re.I)
LIST_SCOPE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIST_STOP = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}


class Node:
    __slots__ = ("tag", "up", "kids", "noise", "depth", "block", "chars", "tags", "link_chars", "link_tags", "density", "sum")

    def __init__(self, tag: str, up: Node | None, noise: bool = False) -> None:
        self.tag, self.up, self.noise, self.kids = tag, up, noise, []
        self.depth = up.depth + 1 if up else 0
        self.block = self if up is None or tag in BLOCK else up.block  # the nearest block that it is in, or the root
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def noise_name(value: str) -> bool:
    """Whether a class, id or role value has a name that marks noise."""
    for name in value.lower().split():
        words = [w for w in WORD_ENDS.split(name) if w]
        for w in {*words[:1], *words[-1:]}:
            if NOISE_WORD.fullmatch(w) and (w != "header" or words[0] == w or words[0] in PAGE_WORDS):
                return True
    return False


def noisy(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in NOISE_TAGS or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and HIDDEN.search(value):
            return True
        if name in ("class", "id", "role") and noise_name(value):
            return True
    return False


def tokens(page: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(start, end, tag or None for what is no element, whether it closes, attributes), in order."""
    at, last = page.find("<"), page.rfind(">")
    while 0 <= at < last:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, None, False, ""
        elif page[at + 1] in "!?":
            end = page.find(">", at) + 1
            yield at, end, None, False, ""
        elif m := NAME.match(page, at + 1):
            close, tag = page[at + 1] == "/", m[1].lower()
            end = page.find(">", m.end()) + 1
            attributes = page[m.end() : end - 1]
            if ('"' in attributes or "'" in attributes) and (rest := REST.match(page, m.end())):
                end = rest.end()
                attributes = page[m.end() : end - 1]
            if tag not in RAW:
                yield at, end, tag, close, attributes
            elif not close and not attributes.rstrip().endswith("/"):
                done = RAW[tag].search(page, end)
                end = done.end() if done else len(page)
                yield at, end, None, False, ""
            else:
                yield at, end, None, False, ""
        else:
            end = at + 1
        at = page.find("<", end)


def parse(page: str) -> Node:
    """The page as a tree; strings are text leaves, still with character references."""
    root = at = Node("#root", None)
    last = 0
    opened: defaultdict[str, list[Node]] = defaultdict(list)  # the open elements of each tag, so that none is looked for on the way up

    def up_to(node: Node) -> Node:
        """Close all that is open inside the node."""
        here = at
        while here is not node:
            opened[here.tag].pop()
            here = here.up
        return node

    for start, end, tag, close, attributes in tokens(page):
        if start > last:
            at.kids.append(page[last:start])
        last = end
        if tag is None:
            continue
        if close:
            up = opened[tag][-1] if opened[tag] else None
            # An inline element's end doesn't cross the block that it stands in.
            if up is not None and (tag in BLOCK or up.depth > at.block.depth):
                at = up_to(up.up)
            continue
        if tag == "br":
            at.kids.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                at.kids.append(Node("hr", at))
            continue
        if tag in CLOSES_P:
            up = at.block
            if up.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and (up.tag == "p" or tag[0] == "h"):
                at = up_to(up.up)
            elif up is not at and up.tag in BLOCK:
                at = up_to(up)  # inline tags left open end with their block
        if tag in LIST_SCOPE:
            up = max((opened[t][-1] for t in LIST_STOP[tag] | LIST_SCOPE[tag] if opened[t]), key=lambda x: x.depth, default=root)
            if up.tag in LIST_SCOPE[tag]:
                at = up_to(up.up)
        if attributes and attributes.rstrip().endswith("/") and tag not in BLOCK and tag != "a":
            continue
        child = Node(tag, at, noisy(tag, attributes, bool(opened["article"])))
        at.kids.append(child)
        opened[tag].append(child)
        at = child
    if last < len(page):
        at.kids.append(page[last:])
    return root


def measure(root: Node) -> list[Node]:
    """Characters and tags of every node outside noise, with those in links; parents come first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.noise:
            continue
        order.append(node)
        stack.extend(x for x in reversed(node.kids) if isinstance(x, Node))
    for node in reversed(order):
        for x in node.kids:
            if isinstance(x, str):
                node.chars += len(x) if not x.isspace() else 0
            elif not x.noise:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.chars if x.tag == "a" else x.link_chars
                node.link_tags += x.link_tags + (x.tag == "a")
    return order


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Composite text density; ``share``: the body's link characters by its characters."""
    if not chars:
        return 0.0
    c, t, lc, lt = chars, max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    if not share:
        return c / t
    base = math.log(c / max(c - link_chars, 1) * link_chars + share * c + math.e)
    return max(c / t * math.log(c / lc * t / lt) / math.log(base), 0.0)


def content(root: Node) -> set[Node]:
    """The blocks that are content: of every block that reaches the threshold, the one of the largest sum."""
    order = measure(root)
    body = next((x for x in order if x.tag == "body"), root)
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in order:
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, share)
    inside = {body}
    blocks = [body]
    for node in order:
        if node.up in inside:
            inside.add(node)
            if node.tag in BLOCK:
                blocks.append(node)
    holds = set()
    for node in blocks[1:]:
        up = node.up
        while up not in holds:
            holds.add(up)
            if up is body:
                break
            up = up.up
    for node in blocks:
        node.sum = sum(x.density for x in node.kids if isinstance(x, Node) and not x.noise) if node in holds else node.density
    # Of each subtree its first block of the largest sum.
    peak: dict[Node, Node] = {}
    for node in reversed([x for x in order if x in inside]):
        best = node if node.tag in BLOCK or node is body else None
        for x in node.kids:
            if isinstance(x, Node) and (other := peak.get(x)) and (best is None or other.sum > best.sum):
                best = other
        if best is not None:
            peak[node] = best
    best = peak[body]
    if not best.sum:
        return {body}
    threshold, up = best.density, best
    while up is not body:
        up = up.up
        threshold = min(threshold, up.density)
    return {peak[node] for node in blocks if node.density >= threshold and node.chars}


def blocks(root: Node, chosen: set[Node]) -> list[str]:
    """The lines of the chosen nodes outside noise, in page order."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        if line and (s := " ".join(entities.unescape("".join(line)).split())):
            out.append(s)
        line.clear()

    stack: list = [(root, False)]
    while stack:
        x, on = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            if on:
                line.append(x)
        elif not x.noise:
            on = on or x in chosen
            if x.tag in BLOCK:
                end()
                stack.append((None, on))
            stack.extend((k, on) for k in reversed(x.kids))
    end()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    return "\n".join(blocks(root, content(root)))


def visible_text(page: str | None) -> str:
    """All text that a page shows, menus included: block by block."""
    if not page:
        return ""
    root = parse(page)
    stack = [root]
    while stack:
        x = stack.pop()
        x.noise = x.tag in ("head", "title")
        stack.extend(k for k in x.kids if isinstance(k, Node))
    return "\n".join(blocks(root, {root}))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def task():
        def each(x: dict[str, list]) -> dict:
            texts = [main_text(h) for h in x["html"]]
            return {"page_id": x["page_id"], "url": x["url"], "text": texts, "n_chars": [len(t) for t in texts]}

        return each

    return map_rows(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), task, "page_id long, url string, text string, n_chars long")


def op7_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
