"""Main text of HTML pages by tree scoring.

The page is parsed into a tree, leniently: unclosed and misnested tags are normal. Parts that are not content by their tag,
role or visibility go, as do readers' comments. Each text block then earns points for its length and its commas, less its share
of linked text, and passes them to the elements around it, halving on the way. An element whose class or id names page furniture
counts a quarter of its points, and goes unless even so it outweighs the rest of the page. The element with the most points, again
less its own link share, is the container; it is kept with those of its siblings that look like content too.

Embedded elements (EMBEDDED) go with what they hold only if they have an end tag; without one they end where their parent
does and their content stays. Every pass is linear in the length of the page, however deep it is nested.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm import common as C

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup; it goes with them.
RAW = ("script", "style", "textarea", "title", "xmp", "noscript", "template", "iframe", "noframes")
EMBEDDED = frozenset("svg math select object canvas video audio".split())
NOT_CONTENT = frozenset("head nav footer aside form button menu dialog fieldset label option datalist applet map".split())
BLOCKS = frozenset(
    "p div section article main body html h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre "
    "figure figcaption address hgroup header details summary center hr".split()
)
CLOSES_P = BLOCKS - {"body", "html"}
#: Opening the first closes an open one of the second, unless one of the third lies between.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "tr": (("tr", "td", "th"), ("table",)),
    "tbody": (("thead", "tbody", "tr"), ("table",)), "option": (("option",), ("select", "datalist")),
}
NOT_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
_NEGATIVE = (
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner cookie cookies "
    "consent gdpr notice notices alert notification popup modal overlay sidebar "
    "sidenav nav navbar navigation navi menu breadcrumb breadcrumbs footer foot footnav header masthead topbar share sharing social "
    "related recommended recommendations subscribe subscription newsletter signup login widget widgets pagination pager toolbar skip "
    "outbrain taboola tags tagcloud disclaimer"
)
NEGATIVE = frozenset(_NEGATIVE.split())
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
#: What the points of an element with a negative name count.
NAME_FACTOR = 0.25
_EXEMPT = re.compile(r"^(?:has|with|no|without|hide|show)[-_]")

_TOKEN = re.compile(
    r"<!--(?s:.*?)(?:-->|$)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b(?P<rawattrs>(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*)>(?s:.*?)(?:</(?P=raw)\s*>|$)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs2>[^<>]*)>"
    r"|<[!?/][^<>]*>",
    re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_COMMA = re.compile("[,،、，]")
_NAMES = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")

#: Blocks that hold text themselves; their points go to what is around them.
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
LEAVES = frozenset((*HEADINGS, *"p pre li td th dd dt blockquote figcaption".split()))
SIBLING_SHARE = 0.2
LINK_LIMIT = 0.5


class Node:
    __slots__ = ("tag", "parent", "items", "points", "chars", "linked", "hidden", "named", "closed", "depth", "in_article", "outer")

    def __init__(self, tag: str, parent: Node | None, hidden: bool = False, named: bool = False):
        self.tag, self.parent, self.hidden, self.named, self.closed = tag, parent, hidden, named, False
        self.items: list[str | Node] = []
        self.points, self.chars, self.linked = 0.0, 0, 0
        self.depth = parent.depth + 1 if parent else 0
        self.in_article = parent is not None and (parent.in_article or parent.tag in ("article", "main"))
        #: The nearest element around the text that is not inline, the node itself included.
        self.outer: Node = self if parent is None or tag in BLOCKS else parent.outer


def _marks(tag: str, attrs: str) -> tuple[bool, bool]:
    """Whether role, visibility or a comment's name say that an element is not content; whether its class or id do."""
    if not attrs or attrs.isspace():
        return False, False
    found = {name.lower(): a or b or c for name, a, b, c in _ATTRIBUTE.findall(attrs)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "")):
        return True, False
    if found.get("role", "").lower() in NOT_CONTENT_ROLES:
        return True, False
    if tag in ("article", "main", "body", "html"):
        return False, False
    parts = {
        part.lower() for name in f"{found.get('class', '')} {found.get('id', '')}".split() if not _EXEMPT.match(name)
        for part in _NAMES.findall(name)
    }
    return not parts.isdisjoint(COMMENTS), not parts.isdisjoint(NEGATIVE)


def parse(html: str) -> tuple[Node, list[Node]]:
    """The root and all elements in page order, parents before children."""
    root = Node("html", None)
    path, every, done = [root], [root], 0
    open_at: dict[str, list[int]] = {}

    def deepest(tags) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    def leave(depth: int) -> None:
        while len(path) > depth:
            open_at[path.pop().tag].pop()

    def close(tags: tuple[str, ...], stops: tuple[str, ...]) -> None:
        while (depth := deepest(tags)) > deepest(stops):
            leave(depth)

    for m in _TOKEN.finditer(html):
        if m.start() > done:
            path[-1].items.append(html[done : m.start()])
        done = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if m["close"] or m["close2"]:
            depth = deepest((tag,))  # an inline end tag doesn't reach out of its cell or list item
            if depth and (tag in BLOCKS or depth >= deepest(("td", "th", "li"))):
                path[depth].closed = True
                leave(depth)
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P:
            close(("p",), ("table", "td", "th", "li", "blockquote", "article", "section", "div"))
            close(("option", "optgroup"), ())
        if tag in CLOSES:
            close(*CLOSES[tag])
        attrs = m["attrs"] or m["attrs2"] or ""
        node = Node(tag, path[-1], *_marks(tag, attrs))
        path[-1].items.append(node)
        every.append(node)
        if tag not in VOID and not attrs.endswith("/"):
            open_at.setdefault(tag, []).append(len(path))
            path.append(node)
    if done < len(html):
        path[-1].items.append(html[done:])
    return root, every


def _clean(text: str) -> str:
    return " ".join((unescape(text) if "&" in text else text).split())


def _dropped(node: Node, hints: bool) -> bool:
    if node.tag in NOT_CONTENT or node.tag in EMBEDDED and node.closed or hints and node.hidden:
        return True
    return node.tag == "header" and not node.in_article  # a page's header goes, an article's own holds its heading


def _inline(node: Node) -> bool:
    return node.tag not in BLOCKS


def blocks(top: Node, hints: bool) -> list[tuple[Node, str, int]]:
    """(element, text, linked characters) of every text block below top in page order, content parts only (hidden counts with hints)."""
    out: list[tuple[Node, str, int]] = []
    run: list[str] = []
    linked: list[str] = []
    owner = top

    def flush(next_owner: Node) -> None:
        nonlocal owner
        text = _clean("".join(run))
        if text:
            out.append((owner, text, min(len(text), sum(len(_clean(x)) for x in linked))))
        run.clear()
        linked.clear()
        owner = next_owner

    # Explicit stack: pages can be nested deeper than Python's.
    stack: list[tuple[Node, Iterator, bool]] = [(top, iter(top.items), False)]
    while stack:
        node, items, in_link = stack[-1]
        for item in items:
            if isinstance(item, str):
                run.append(item)
                if in_link:
                    linked.append(item)
                continue
            if _dropped(item, hints):
                if not _inline(item):
                    flush(owner)
                continue
            if item.tag in ("br", "wbr"):
                run.append(" " if item.tag == "br" else "")
                continue
            if not _inline(item):
                flush(item)
            stack.append((item, iter(item.items), in_link or item.tag == "a"))
            break
        else:
            stack.pop()
            if stack and not _inline(node):
                flush(stack[-1][0].outer)
    flush(top)
    return out


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _score(found: list[tuple[Node, str, int]], every: list[Node]) -> list[Node]:
    """Points, characters and linked characters of all elements; those with text in page order."""
    for node in every:
        node.points, node.chars, node.linked = 0.0, 0, 0
    for block, text, linked in found:
        block.chars += len(text)
        block.linked += linked
        (block.parent if block.tag in LEAVES and block.parent is not None else block).points += _points(text, linked)
    for node in reversed(every):  # children before parents
        if node.parent is not None:
            node.parent.points += node.points / 2
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    return [node for node in every if node.chars]


def _points(text: str, linked: int) -> float:
    return (min(1.0, len(text) / 25) + len(_COMMA.findall(text)) + min(len(text) / 100, 3.0)) * (1 - linked / len(text))


def _hide_furniture(found: list[tuple[Node, str, int]], every: list[Node]) -> bool:
    """Hides elements with a negative name, unless their points count more than the rest of the page's even at NAME_FACTOR."""
    named = [node for node in every if node.named]
    if not named:
        return False
    inside: dict[int, float] = {}
    for block, text, linked in found:
        inside[id(block)] = inside.get(id(block), 0.0) + _points(text, linked)
    for node in reversed(every):
        own = inside.get(id(node))
        if own and node.parent is not None:
            inside[id(node.parent)] = inside.get(id(node.parent), 0.0) + own
    total = inside.get(id(every[0]), 0.0)
    for node in named:
        own = inside.get(id(node), 0.0)
        node.hidden = node.hidden or own * NAME_FACTOR <= total - own
    return True


def _container(nodes: list[Node]) -> Node:
    """The best element; an article or main around it is preferred, as it holds the whole text."""
    best = max(nodes, key=lambda n: (n.points * (1 - _density(n)), -n.depth))
    above: Node | None = best
    while above is not None:
        if above.tag in ("article", "main"):
            best = above
            if above.tag == "article":
                break
        above = above.parent
    return best


def _kept_siblings(best: Node) -> list[Node]:
    """best and the siblings that are content: enough points of their own kind, or headings and paragraphs with few links."""
    if best.parent is None:
        return [best]
    limit = max(2.0, SIBLING_SHARE * best.points * (1 - _density(best)))
    kept = []
    for item in best.parent.items:
        if item is best:
            kept.append(item)
        elif isinstance(item, Node) and item.chars and best.tag not in ("article", "main"):
            plain = item.tag in (*HEADINGS, "p", "blockquote", "pre", "ul", "ol", "table") and _density(item) < LINK_LIMIT
            if plain or item.points * (1 - _density(item)) >= limit:
                kept.append(item)
        elif isinstance(item, Node) and item.tag == best.tag and item.points * (1 - _density(item)) >= limit:
            kept.append(item)
    return kept


def main_text(html: str | None) -> str:
    """Main text of a page; blocks joined by an empty line; empty for null, empty and text-free pages."""
    if not html:
        return ""
    root, every = parse(html)
    found = blocks(root, hints=True)
    if _hide_furniture(found, every):
        found = blocks(root, hints=True)
    found = found or blocks(root, hints=False)
    if not found:
        return ""
    kept = _kept_siblings(_container(_score(found, every)))
    inside = {id(n) for n in kept}
    cache: dict[int, bool] = {}

    def belongs(node: Node | None) -> bool:
        path = []
        while node is not None and id(node) not in inside and id(node) not in cache:
            path.append(node)
            node = node.parent
        answer = node is not None and (id(node) in inside or cache[id(node)])
        cache.update((id(x), answer) for x in path)
        return answer

    return "\n\n".join(text for block, text, linked in found if belongs(block) and not _is_link_list(block, text, linked))


def _is_link_list(block: Node, text: str, linked: int) -> bool:
    """Menus and link lists inside the container: list items that are nothing but a link."""
    return block.tag == "li" and linked >= len(text) and block.parent is not None and _density(block.parent) > 0.9 and len(block.parent.items) > 2


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages. Null and empty pages give an empty text; repeated pages each count."""
    C.bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html) for html in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    narrow = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col(html_col).alias("html"))
    return narrow.mapInArrow(run, f"page_id {narrow.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(C.table(spark, sf_dir, "pages"))


QUERIES = {"op8_html_text": op8_html_text}
ORACLE_SQL: dict[str, str] = {}
