"""Main text of web pages by scoring a tree of elements.

Every paragraph gives points for its length and commas to its ancestors, less the
farther they are; an element's points are discounted by its link density. The
best container, those siblings that score alike, and the paragraphs, lists and loose text beside it that are
not links are kept, and their blocks are the text; nothing in them is left out for its links. Elements that are never part of an article (menus, headers, footers,
side columns, notices, adverts, forms, scripts, styles, comments of readers) are
cut off before the scoring, by tag, role or names in class and id. A name counts if all its words
say so (``cookie-notice``, ``sidebar-left``, not ``with-sidebar`` or ``related-work``). What a name
or a form would cut off stays if the article itself is in it, or if nothing would be left.

Character references are decoded once; white space in a block becomes one space;
blocks are joined by one space in page order. Nothing is dropped by size.

Defined cases: a null or empty page, and one without text, gives the empty string.
Unclosed or misplaced tags are repaired as browsers do for paragraphs, list items
and table cells; a cut-off page keeps what is there. Depth is not bounded by
recursion, and the time is linear in the page, however many elements are left open. Rows are independent, so repeated rows repeat; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby "
    "s samp small span strike strong sub sup time tt u var wbr "
    "math mfrac mi mn mo mroot mrow ms msqrt mstyle msub msubsup msup mtext semantics".split()
)
PARAGRAPHS = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 figcaption".split())
PROSE = PARAGRAPHS | INLINE | frozenset("ul ol dl table".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
# a start tag closes an open element of its group, up to the nearest scope element
IMPLIED = {
    "li": ("li", "ul ol menu"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "option": ("option", "select"),
    "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"),
    "th": ("td th", "tr table"),
    "tbody": ("thead tbody tfoot tr td th", "table"),
    "tfoot": ("thead tbody tfoot tr td th", "table"),
    "thead": ("thead tbody tfoot tr td th", "table"),
}
IMPLIED = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in IMPLIED.items()}
P_SCOPE = frozenset("table td th caption button object html body article section div li".split())
BLOCK_ENDS = CLOSES_P - INLINE

# What is no part of an article, by tag, role, and words of a name in class or id.
DROP_TAGS = frozenset(
    "nav footer aside script style noscript template iframe object embed applet svg canvas audio video "
    "button select input textarea fieldset dialog menu head title xmp noembed noframes".split()
)
DROP_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split()
)
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner breadcrumb breadcrumbs "
    "comment comments commentlist disqus cookie cookies consent gdpr disclaimer footer footnav header masthead "
    "menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall "
    "popup promo promos promoted promotion recommended related replies respond share sharing sidebar signup "
    "social sponsor sponsored sponsors subscribe subscription teaser teasers toolbar topbar widget widgets".split()
)
# Words that say where or in what shape, and nothing about the content.
FRAME_WORDS = frozenset(
    "area bar block bottom box button buttons center col column container content desktop fixed form global holder icon icons "
    "inner item items left link links list main mobile module outer page panel placeholder posts primary region right row secondary "
    "section site slot sticky stories tab tabs text thread title top unit wrap wrapper".split()
)
HEADER_WORDS = frozenset(("header", "masthead", "banner"))
KEEP_WHOLE = frozenset(("html", "body", "main", "article"))
FORM_SHARE = 0.5

COMMENT_OR_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
# one attribute; an unquoted value ends at white space or >, and so does one whose quote is never closed
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
TAG_END = re.compile(r"[\s/=]*(?:>|\Z)")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

MIN_PARAGRAPH = 25
SIBLING_SHARE = 0.2
LINK_DENSITY = 0.25


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "suspect", "depth", "block", "points", "n_text", "n_link")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, suspect: bool = False):
        self.tag, self.parent, self.dropped, self.suspect = tag, parent, dropped, suspect
        self.children: list[Node | str] = []
        self.depth = parent.depth + 1 if parent else 0
        # depth of the nearest block, which end tags of inline elements do not reach across
        self.block = self.depth if tag in BLOCK_ENDS or not parent else parent.block
        self.points, self.n_text, self.n_link = 0.0, 0, 0


def names_boilerplate(name: str, in_article: bool) -> bool:
    """Whether a name in class or id stands for something beside the article: all its words do, but for those of its frame."""
    words = {w.lower() for w in WORD.findall(name)}
    telling = words & DROP_WORDS
    if in_article:  # an article's own header holds its title
        telling -= HEADER_WORDS
    return bool(telling) and words <= telling | FRAME_WORDS


def judged(tag: str, attributes: list[tuple[str, str]], in_article: bool) -> tuple[bool, bool]:
    """(dropped, suspect) of an element: never part of an article, or not if the article is elsewhere."""
    if tag in DROP_TAGS or (tag == "header" and not in_article):
        return True, False
    suspect = tag == "form"
    for name, value in attributes:
        name = name.lower()
        if name in ("class", "id"):
            suspect = suspect or any(names_boilerplate(x, in_article) for x in value.split())
        elif tag not in KEEP_WHOLE and (
            name == "hidden"
            or (name == "role" and value.lower() in DROP_ROLES)
            or (name == "aria-hidden" and value.lower() == "true")
            or (name == "style" and HIDDEN.search(value))
        ):
            return True, False
    return False, suspect


def read_attributes(page: str, where: int) -> tuple[list[tuple[str, str]], int]:
    """The attributes of a tag and where it ends."""
    found = []
    while True:
        end = TAG_END.match(page, where)
        if end:
            return found, end.end()
        one = ATTRIBUTE.match(page, where)
        if not one:  # a lone sign that begins no name
            where += 1
            continue
        found.append((one[1], one[2] or one[3] or one[4] or ""))
        where = one.end()


class Tree:
    """The elements of a page as they open and close; knows the open ones of each tag, so that no step walks up the tree."""

    def __init__(self):
        self.root = self.at = Node("#root", None, False)
        self.open: dict[str, list[Node]] = {}

    def enter(self, node: Node) -> None:
        self.at = node
        self.open.setdefault(node.tag, []).append(node)

    def leave(self, node: Node) -> None:
        """Close ``node`` and all that is open inside it."""
        while self.at is not node.parent:
            self.open[self.at.tag].pop()
            self.at = self.at.parent

    def deepest(self, tags: Iterable[str]) -> int:
        return max((stack[-1].depth for t in tags if (stack := self.open.get(t))), default=0)

    def close(self, tag: str) -> None:
        """The effect of an end tag; a stray one changes nothing, and one of an inline element closes no block around it."""
        stack = self.open.get(tag)
        if stack and not (tag in INLINE and stack[-1].depth < self.at.block):
            self.leave(stack[-1])

    def close_implied(self, tag: str) -> None:
        """The end tags that a start tag implies."""
        if tag in CLOSES_P:
            stack = self.open.get("p")
            if stack and stack[-1].depth > self.deepest(P_SCOPE):
                self.leave(stack[-1])
        elif tag in IMPLIED:
            group, scope = IMPLIED[tag]
            border = self.deepest(scope)
            while (inner := self.deepest(group)) > border:
                self.leave(next(self.open[t][-1] for t in group if self.open.get(t) and self.open[t][-1].depth == inner))


def parse(page: str) -> Node:
    """The tree of elements; text of dropped elements and comments is left out."""
    tree = Tree()
    where, size = 0, len(page)
    while where < size:
        found = COMMENT_OR_TAG.search(page, where)
        end = found.start() if found else size
        if end > where and not tree.at.dropped:
            tree.at.children.append(html.unescape(page[where:end]))
        if not found:
            break
        where = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        attributes, where = read_attributes(page, where)
        if found[1]:
            tree.close(tag)
            continue
        tree.close_implied(tag)
        at = tree.at
        dropped, suspect = (True, False) if at.dropped else judged(tag, attributes, bool(tree.open.get("article")))
        node = Node(tag, at, dropped, suspect)
        at.children.append(node)
        if tag in RAW:
            stop = re.compile(f"</{tag}[\\s/>]", re.I).search(page, where)
            where = stop.start() if stop else size
            tree.enter(node)
        elif tag not in VOID and not (tag in ("path", "circle", "rect") and page[where - 2 : where - 1] == "/"):
            tree.enter(node)
    settle(tree.root)
    return tree.root


def settle(root: Node) -> None:
    """Drop suspects, but not those around the article itself, and none if no text is left otherwise."""
    order = in_order(root)
    prose: dict[int, int] = {}
    main: dict[int, bool] = {}
    left: dict[int, bool] = {}
    for node in reversed(order):
        kids = [c for c in node.children if isinstance(c, Node) and not c.dropped]
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        prose[id(node)] = 0 if node.tag == "a" else own + sum(prose[id(c)] for c in kids)
        main[id(node)] = not (node.suspect and node.tag in KEEP_WHOLE) and (
            node.tag in ("article", "main") or any(main[id(c)] for c in kids)
        )
    whole = prose[id(root)]
    for node in order:
        if node.suspect:
            around = node.tag in KEEP_WHOLE or main[id(node)]
            node.suspect = not (around or (node.tag == "form" and prose[id(node)] >= FORM_SHARE * whole > 0))
    for node in reversed(order):
        kids = [c for c in node.children if isinstance(c, Node) and not c.dropped]
        text = any(isinstance(c, str) and c.strip() for c in node.children)
        left[id(node)] = not node.suspect and (text or any(left[id(c)] for c in kids))
    if left[id(root)]:
        for node in order:
            node.dropped = node.dropped or node.suspect


def in_order(root: Node) -> list[Node]:
    """Kept elements, parents before children."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in reversed(node.children) if isinstance(c, Node) and not c.dropped]
    return order


def score(order: list[Node]) -> None:
    """Lengths and link lengths bottom-up, then the points of paragraphs to their ancestors."""
    own_commas = {}
    for node in reversed(order):
        commas = own = 0
        for child in node.children:
            if isinstance(child, str):
                text = child.strip()
                node.n_text += len(text)
                own += len(text)
                commas += text.count(",") + text.count("，") + text.count("、")
            elif not child.dropped:
                node.n_text += child.n_text
                node.n_link += child.n_link
                if child.tag in INLINE:
                    o, c = own_commas[id(child)]
                    own += o
                    commas += c
        if node.tag == "a":
            node.n_link = node.n_text
        own_commas[id(node)] = (own, commas)
    for node in order:
        own, commas = own_commas[id(node)]
        if node.tag in INLINE or not own:
            continue
        points = (1 if own >= MIN_PARAGRAPH else own / MIN_PARAGRAPH) + commas + own / 100
        points *= 1 - node.n_link / max(1, node.n_text)
        at, share = (node.parent if node.tag in PARAGRAPHS else node), 1.0
        while at and share > 0.1:
            at.points += points * share
            at, share = at.parent, share / 2
    for node in order:
        node.points *= 1 - node.n_link / max(1, node.n_text)


def containers(order: list[Node]) -> list[Node | str]:
    """The best container and its siblings that score alike or are prose, or the whole of an enclosing article."""
    candidates = [n for n in order if n.tag not in INLINE and n.tag not in PARAGRAPHS]
    best = max(candidates, key=lambda n: n.points, default=None)
    if best is None or best.points <= 0:
        return order[:1]
    at = best
    while at and at.tag not in ("article", "main"):
        at = at.parent
    best = at or best
    if best.parent is None:
        return [best]
    least = max(1.0, best.points * SIBLING_SHARE)
    beside = best.tag not in ("article", "main")
    kept: list[Node | str] = []
    for node in best.parent.children:
        if isinstance(node, str):
            if beside:
                kept.append(node)
            continue
        if node.dropped:
            continue
        density = node.n_link / max(1, node.n_text)
        heading = node.tag in ("h1", "h2") and best.parent.tag != "body"
        prose = beside and (node.tag in VOID or (node.tag in PROSE and node.n_text and density < LINK_DENSITY))
        if node is best or node.points >= least or heading or prose:
            kept.append(node)
    return kept


def text_of(tops: list[Node | str]) -> str:
    """Blocks of the kept elements in page order, white space folded, joined by one space."""
    out: list[str] = []
    stack: list[Node | str] = list(reversed(tops))
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
        elif item.tag == "br" or item.tag == "hr":
            out.append(" ")
        elif not item.dropped:
            if item.tag in INLINE:
                stack += reversed(item.children)
            else:
                stack.append(" ")
                stack += reversed(item.children)
                stack.append(" ")
    return " ".join("".join(out).split())


def main_text(page: str | None) -> str:
    if not page:
        return ""
    order = in_order(parse(page))
    score(order)
    return text_of(containers(order))


def extract_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row a page: page_id, url, text, n_chars."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(x) for x in batch.pop("html")]
            yield batch.assign(text=texts, n_chars=[len(x) for x in texts])

    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")
    )
    return rows.mapInPandas(run, "page_id bigint, url string, text string, n_chars bigint")
