"""HTML extraction by scoring the tree.

A page becomes a tree of its block elements (inline tags only mark links). Parts that are never article
text are cut first: scripts, styles, forms, navigation, page headers, footers, asides, hidden elements,
and elements whose class, id or role names them as menus, adverts, cookie or subscription notices,
sidebars or reader comments. A name that an article may have too (header, warning, search, discussion,
related and the like) cuts nothing by itself: it only halves the element's score, and inside the article
the element goes if its structure agrees, that is, if it consists of links to a third, or is a short
piece without a title of the article.

Then each paragraph gives points for its length and commas to its parent, and half to its grandparent
(a third and less further up); a container's points are discounted by the share of its text that stands
in links. The best container is kept together with siblings that score well or read like prose, and with
the headings, lists, tables, quotes and loose text of few links between and right beside them.

Defined cases: null, empty and text-free pages give an empty text; unclosed and misnested tags, cut-off
tags, comments and references are read as browsers read them; a page of text without any markup is kept
whole; equal scores go to the element that comes first; repeated rows are each returned; very long pages
are read whole, in one pass, in time that follows their length; deep nesting uses no recursion; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names by their role in HTML.
_NAMES = {
    "void": "area base br col embed hr img input link meta param source track wbr",
    "raw": "script style noscript template iframe noembed noframes object svg canvas audio video select textarea title annotation",
    "cut": "nav header footer aside form button menu dialog head fieldset label option datalist",
    "inline": "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr label img math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle semantics",
    "closes_p": "address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul",
    "text_block": "p h1 h2 h3 h4 h5 h6 li pre blockquote td dd dt th summary address",
    "heading": "h1 h2 h3 h4 h5 h6",
}
VOID, RAW, CUT, INLINE, CLOSES_P, TEXT_BLOCK, HEADING = (frozenset(_NAMES[k].split()) for k in ("void", "raw", "cut", "inline", "closes_p", "text_block", "heading"))
#: Words in class, id or role that name what is never the article.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus "
    "gdpr login masthead menu modal nav navbar navigation newsletter outbrain pager pagination paywall popup promo promoted promotion replies sidebar signup "
    "sponsor sponsored subscribe taboola toolbar topbar".split()
)
#: Words that parts of an article have too: the structure decides.
DOUBTFUL = frozenset(
    "alert banner copyright disclaimer discussion feedback footer header notice notices notification related reply respond search share sharing skip social tags "
    "teaser warning widget".split()
)
#: A doubtful part of so many characters, or of this share of its article, is no notice.
LEAST_CHARS, LEAST_SHARE, LINK_SHARE = 400, 0.1, 1 / 3
#: Words that mark a container as the article whatever else is in its name.
ARTICLE = frozenset("article content main post entry story body text".split())
#: Elements of an article that may stand beside its container.
LOOSE = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure".split())
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+))|([^\s=\"'/>]+)")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("name", "parent", "children", "cut", "named", "doubt", "score", "chars", "own_links", "links", "order")

    def __init__(self, name: str, parent: Node | None, cut: bool, named: bool, doubt: bool, order: int) -> None:
        self.name, self.parent, self.cut, self.named, self.doubt, self.order = name, parent, cut, named, doubt, order
        #: nodes, text (str) and ends of blocks (None)
        self.children: list[Node | str | None] = []
        self.score, self.chars, self.own_links, self.links = 0.0, 0, 0, 0

    @property
    def density(self) -> float:
        return min(1.0, self.links / self.chars) if self.chars else 0.0


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        name = (m[1] or m[5]).lower()
        out.setdefault(name, unescape(m[2] or m[3] or m[4] or ""))
    return out


def _words(value: str) -> set[str]:
    return {w.lower() for w in _WORD.findall(value)}


def _is_cut(name: str, attrs: dict[str, str]) -> tuple[bool, bool, bool]:
    """(cut out, named as the article, doubtful)."""
    if name in ("body", "html", "article", "main"):
        return False, name in ("article", "main"), False
    if "hidden" in attrs or attrs.get("aria-hidden", "") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")):
        return True, False, False
    if name in CUT:
        return True, False, False
    if name in HEADING or name == "p":
        classes = _words(attrs.get("class", "") + " " + attrs.get("id", ""))
        return bool(classes & {"ad", "ads", "advert", "advertisement", "sponsored", "promo", "cookie", "notice", "comment", "copyright", "disclaimer"}), False, False
    tokens = attrs.get("class", "").split() + [attrs.get("id", ""), attrs.get("role", ""), attrs.get("itemprop", "")]
    named = doubt = False
    for token in tokens:
        words = _words(token)
        if words & {"has", "no", "off", "with", "without"}:
            continue
        if words & BOILERPLATE:
            return True, False, False
        named = named or bool(words & ARTICLE)
        doubt = doubt or bool(words & DOUBTFUL)
    return False, named and not doubt, doubt


#: What an opening tag ends: the elements that it closes, and those beyond which it does not look.
_CELLS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("table",)), "th": (("td", "th"), ("table",))}
_HOLDS_P = frozenset("td th div section article li main table aside blockquote".split())


def parse(html: str) -> Node:
    """The tree of block elements; text keeps its place among them."""
    root = Node("html", None, False, False, False, 0)
    node, open_links, at, count = root, 0, 0, 0
    opened: Counter[str] = Counter()
    #: an inline advert: its tag, how many of that tag are open in it, and the block that it stands in
    hushed, depth, host = "", 0, root
    size = len(html)

    def add(text: str) -> None:
        if text and not node.cut and not hushed:
            node.children.append(unescape(text))
            if open_links:
                node.own_links += len(text.strip())

    def close(to: Node) -> None:
        nonlocal node, hushed
        while True:
            opened[node.name] -= 1
            if node is host:
                hushed = ""
            node, last = node.parent, node
            if last is to:
                return

    while at < size:
        m = _TAG.search(html, at)
        if not m:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if not closing and m.end() == size and html[-1:] != ">":
            break  # a tag that the page's end cuts off
        if name in RAW and not closing:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else size
            continue
        if name == "br" or name == "hr":
            if node.name not in ("pre",) or name == "hr":
                node.children.append(None if name == "hr" else " ")
            continue
        if name in VOID:
            continue
        if name in INLINE and name != "label":
            if name == hushed:
                depth += -1 if closing else 1
                hushed = hushed if depth else ""
            elif not closing and not hushed and m[3].strip() and _is_cut(name, _attributes(m[3]))[0]:
                hushed, depth, host = name, 1, node  # ends with its tag, or with the block around it
            if name == "a":
                open_links = 0 if closing else 1
            continue
        if closing:
            up, found = node, None
            while opened[name] and up is not root:
                if up.name == name:
                    found = up
                    break
                if name == "p" and up.name in CLOSES_P and up.name != "p":
                    break
                up = up.parent
            if found is not None:
                close(found)
                open_links = 0
            else:
                node.children.append(None)
            continue
        if name in ("html", "body"):
            continue
        # an open paragraph or list item ends before a block that cannot stand in it
        if name in CLOSES_P and opened["p"]:
            up = node
            while up is not root and up.name not in _HOLDS_P:
                if up.name == "p":
                    close(up)
                    break
                up = up.parent
        if name in _CELLS and any(opened[x] for x in _CELLS[name][0]):
            same, stop = _CELLS[name]
            up, last = node, None
            while up is not root and up.name not in stop:
                if up.name in same:
                    last = up
                    if name != "tr":
                        break
                up = up.parent
            if last is not None:
                close(last)
        if name in HEADING and node.name in HEADING:
            close(node)
        count += 1
        cut, named, doubt = _is_cut(name, _attributes(m[3]) if m[3].strip() else {})
        if name == "header" and opened["article"] and not node.cut:
            # the heading of an article stands in its header
            end = html.find("</header", at)
            cut = not re.compile(r"<h[1-3][\s>]", re.I).search(html, at, end if end >= 0 else size)
        child = Node(name, node, node.cut or cut or bool(hushed), named, doubt, count)
        if not child.cut:
            node.children.append(child)
        if m[3].rstrip().endswith("/") and name not in CLOSES_P and name not in TEXT_BLOCK:
            continue
        opened[name] += 1
        node = child
    return root


def _walk(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack.extend(c for c in reversed(n.children) if isinstance(c, Node))
    return out


def blocks_of(parts: list[Node | str | None]) -> list[str]:
    """Text blocks of and below ``parts`` in page order, white space collapsed."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        if run:
            text = _SPACE.sub(" ", "".join(run)).strip()
            if text:
                out.append(text)
            run.clear()

    stack: list[Node | str | None] = parts[::-1]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            run.append(item)
        elif item is None:
            end()
        else:
            end()
            stack.append(None)
            stack.extend(reversed(item.children))
    end()
    return out


def _measure(nodes: list[Node]) -> None:
    for n in reversed(nodes):  # children before parents
        n.chars = sum(len(c.strip()) if isinstance(c, str) else c.chars if c is not None else 0 for c in n.children)
        n.links = n.own_links + sum(c.links for c in n.children if isinstance(c, Node))


def _drop_doubtful(nodes: list[Node]) -> bool:
    """Cut doubtful parts whose structure says that they are no part of the article; whether any was."""
    titled = {id(n) for n in nodes if n.name == "h1"}
    for n in reversed(nodes):
        if any(isinstance(c, Node) and id(c) in titled for c in n.children):
            titled.add(id(n))
    home: dict[int, Node] = {}
    gone = False
    for n in nodes:
        home[id(n)] = around = n if n.parent is None or n.named else home[id(n.parent)]
        if not n.doubt or not n.chars:
            continue
        title = id(n) in titled and around.parent is not None
        if n.density >= LINK_SHARE or not (title or n.chars >= LEAST_CHARS or n.chars >= LEAST_SHARE * around.chars):
            n.cut = gone = True
    return gone


def best_container(root: Node) -> list[Node | str | None]:
    """The best container and those of its siblings that belong to it, in page order."""
    nodes = _walk(root)
    _measure(nodes)
    if _drop_doubtful(nodes):
        for n in nodes:
            n.children = [c for c in n.children if not (isinstance(c, Node) and c.cut)]
        nodes = _walk(root)
        _measure(nodes)
    for n in nodes:
        own = [c for c in n.children if isinstance(c, str)]
        text = " ".join(own).strip()
        if n.name not in TEXT_BLOCK and not text:
            continue
        if n.name in TEXT_BLOCK and any(isinstance(c, Node) for c in n.children) and not text:
            continue
        if len(text) < 2 or n.name in HEADING:
            continue
        points = (1 + text.count(",") + min(len(text) / 100, 30)) * (1 - n.density)
        up, share = (n.parent if n.name in TEXT_BLOCK else n), 1.0
        while up is not None and share > 0.1:
            up.score += points * share
            up, share = up.parent, share / (2 if share == 1.0 else 1.5)
    for n in nodes:
        if n.named:
            n.score *= 1.25
        if n.doubt or n.name in ("ul", "ol", "dl", "table", "tr", "tbody"):
            n.score *= 0.5
    held = [n for n in nodes if n.chars and n.name not in TEXT_BLOCK]
    if not held:
        return [root]
    top = max(held, key=lambda n: (n.score * (1 - n.density), -n.order))
    # an article or main element around the best container holds the whole article
    up = top
    while up is not None:
        if up.name in ("article", "main"):
            top = up
            break
        up = up.parent
    if top.parent is None or top.name == "main":
        return [top]
    least, around = max(5.0, 0.2 * top.score), top.parent.children

    def belongs(c: Node) -> bool:
        if c is top:
            return True
        if c.name == "p":
            return c.chars > 80 and c.density < 0.25
        if c.name in ("h1", "h2") and c.density < 0.3 and c.chars and top.name != "article" and c.order < top.order:
            return True
        return c.score >= least and c.density < 0.3 and not c.doubt and (c.name == top.name or c.named)

    keep = [isinstance(c, Node) and belongs(c) for c in around]
    if top.name != "article":
        # what stands between and right beside the kept parts, up to the next container
        first, last = keep.index(True), len(keep) - 1 - keep[::-1].index(True)
        loose = [c is None or isinstance(c, str) or (c.name in LOOSE and c.density < 0.3 and not c.doubt) for c in around]
        while first > 0 and loose[first - 1]:
            first -= 1
        while last + 1 < len(keep) and loose[last + 1]:
            last += 1
        keep = [k or (first <= i <= last and loose[i]) for i, k in enumerate(keep)]
    return [c for c, k in zip(around, keep, strict=True) if k]


def extract(html: str | None) -> str:
    """The main text of a page: its blocks in page order, joined by one space."""
    if not html:
        return ""
    return " ".join(blocks_of(best_container(parse(html))))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(h.as_py()) for h in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row for each page: page_id, url, text, n_chars."""
    slim = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").cast("string").alias("html"))
    return slim.mapInArrow(_batches, "page_id long, url string, text string, n_chars long")
