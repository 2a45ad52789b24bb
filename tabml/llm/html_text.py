"""Main text of HTML pages by tree scoring.

A page becomes a light element tree. Boilerplate subtrees by tag, role or hiding are left out of it; those with a boilerplate class or
id go too, unless they hold the page's text: a ``main`` element, or, where no article stands outside, over half of the unlinked text (a quarter
with all first-level headings; a reader-comment name is never spared by its text). Names that say how a wrapper looks (``has-sidebar``) don't count.
Each paragraph-like element earns points for length and commas and passes them to its ancestors, halved per step;
an element's score is discounted by its link density. The best element is the container; if it stands in an
``article`` or ``main`` element, that one is (headings beside the body belong to it). Siblings of the container with a good share
of its score, with long text and few links, of the same kind as a ``section``, or headings are kept too, and so is the last
first-level heading before a container that has none. Without any scored paragraph the body's remaining text is kept.
Time and memory grow with the page's length, however deep it is nested.

Blocks are runs of text between block-level tags; references are decoded, white space becomes one space, blocks are
joined by ``\\n`` in page order. Nothing is capped.

Nulls and empty pages give an empty text. Markup cut off in the middle is read as far as it goes. A page is one row of one
task. Ties between containers go to the first in page order. Repeated rows are each extracted; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from tabml.llm.columns import add_struct

# Element and name lists.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
DROP_TAGS = frozenset("head nav footer aside form button select option dialog menu object canvas audio video map".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
DROP_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination "
    "popup promo promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription tags toolbar topbar widget".split())
READER_NAMES = frozenset("comment comments disqus reply replies respond".split())
LOOK_NAMES = frozenset("has have with no without show hide layout".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: An opening tag ends an open element of these names, unless one of the second set stands between.
IMPLIED_END = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
               "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
               "option": ({"option"}, {"select"})}
SCORED = frozenset("p pre td blockquote li dd div section article main body".split())

_TAG = re.compile(r"""<(?:(!--.*?(?:-->|\Z))|(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>|([!?/][^>]*>)|(/?[a-zA-Z][^>]*(?:>|\Z)))""", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "parent", "kids", "points", "chars", "link_chars", "order", "doubt")

    def __init__(self, tag: str, parent: Node | None, order: int):
        self.tag, self.parent, self.order = tag, parent, order
        self.kids: list[Node | str] = []
        self.points, self.chars, self.link_chars = 0.0, 0, 0
        self.doubt = ""  # "name": boilerplate by its names, "reader": by a name of reader comments


def boilerplate(tag: str, attrs: str, in_article: bool) -> bool:
    """Boilerplate by tag, role or hiding."""
    if tag in DROP_TAGS or (tag == "header" and not in_article):
        return True
    if not attrs or tag in ("html", "body"):
        return False
    return bool(_HIDDEN.search(attrs)) or any(
        m[1].lower() == "role" and (m[2] or m[3] or m[4] or "").strip().lower() in DROP_ROLES for m in _NAMES.finditer(attrs))


def doubt(tag: str, attrs: str) -> str:
    """Boilerplate by a word of a class or id."""
    got = ""
    if attrs and tag not in ("html", "body", "article", "main"):
        for m in _NAMES.finditer(attrs):
            if m[1].lower() == "role":
                continue
            for name in (m[2] or m[3] or m[4] or "").split():
                parts = [x.lower() for x in _SPLIT.split(name) if x]
                if parts and parts[0] in LOOK_NAMES:
                    continue
                if any(x in READER_NAMES for x in parts):
                    return "reader"
                if any(x in DROP_NAMES for x in parts):
                    got = "name"
    return got


class Open:
    """The open elements, and where on their stack each tag stands, so that no look-up walks the stack."""

    def __init__(self, root: Node):
        self.stack = [(root, True)]  # (element, kept)
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, node: Node, kept: bool) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append((node, kept))

    def cut(self, i: int) -> None:
        while len(self.stack) > i:
            node, _ = self.stack.pop()
            self.at[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()

    def last(self, tags) -> int:
        """Place of the innermost open element of these tags; 0 if none is open."""
        return max((at[-1] for t in tags if (at := self.at.get(t))), default=0)

    def first_after(self, tags, i: int) -> int:
        """Place of the outermost open element of these tags inside place i; 0 if none."""
        return min((at[k] for t in tags if (at := self.at.get(t)) and (k := bisect_right(at, i)) < len(at)), default=0)

    def end(self, tag: str) -> None:
        i = self.last((tag,))
        if i and (tag in BLOCK or not self.blocks or i >= self.blocks[-1]):  # an inline end tag doesn't close blocks
            self.cut(i)

    def implied(self, tag: str) -> None:
        if tag in CLOSES_P and (i := self.last(("p",))) > self.last(("td", "th", "table", "button", "object")):
            self.cut(i)
        if tag in IMPLIED_END:
            ends, stops = IMPLIED_END[tag]
            i = self.first_after(ends, self.last(stops)) if tag == "tr" else self.last(ends)
            if i > self.last(stops):
                self.cut(i)


def parse(page: str) -> Node:
    """Element tree without boilerplate; unclosed and misnested tags are closed as browsers mostly do."""
    root = Node("#root", None, 0)
    opened = Open(root)
    at, n, size = 0, 1, len(page)
    while at < size:
        m = _TAG.search(page, at)
        end = m.start() if m else size
        top, kept = opened.stack[-1]
        if end > at and kept:
            top.kids.append(page[at:end])
        if not m:
            break
        at = m.end()
        if m[1] or m[5]:
            continue
        if m[6]:  # broken attributes or the page's cut end
            name = re.match(r"(/?)([a-zA-Z][^\s/>]*)", m[6])
            if not m[6].endswith(">"):
                break
            slash, tag, attrs = name[1], name[2].lower(), m[6][name.end():-1]
        else:
            slash, tag, attrs = m[2], m[3].lower(), m[4]
        if slash:
            opened.end(tag)
            continue
        if tag in RAW:
            if not attrs.rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = close.end() if close else size
            continue
        opened.implied(tag)
        top, kept = opened.stack[-1]
        node = Node(tag, top, n)
        n += 1
        kept = kept and not boilerplate(tag, attrs, bool(opened.last(("article", "main"))))
        if kept:
            node.doubt = doubt(tag, attrs)
            top.kids.append(node)
        if tag not in VOID:
            opened.push(node, kept)
    settle(root)
    return root


def settle(root: Node) -> None:
    """Removes the doubtful subtrees that don't hold the page's text."""
    nodes = walk(root)
    if not any(e.doubt for e in nodes):
        return
    links, text, heads, mains, articles = {}, {}, {}, {}, {}
    for e in nodes:
        links[e.order] = e.tag == "a" or (e.parent is not None and links[e.parent.order])
        text[e.order] = 0 if links[e.order] else sum(len(k.strip()) for k in e.kids if isinstance(k, str))
        heads[e.order], mains[e.order], articles[e.order] = int(e.tag == "h1"), int(e.tag == "main"), int(e.tag in ("article", "main"))
    for e in reversed(nodes):
        if e.parent is not None:
            for count in (text, heads, mains, articles):
                count[e.parent.order] += count[e.order]

    def holds_text(e: Node) -> bool:
        """No article stands outside, and a good part of the text inside: over half, or over a quarter and all first-level headings."""
        i, r = e.order, root.order
        share = 4 if heads[i] and heads[i] == heads[r] else 2
        return articles[i] == articles[r] and share * text[i] > text[r]

    spared = {e.order for e in nodes if not e.doubt or mains[e.order] or (e.doubt == "name" and holds_text(e))}
    for e in nodes:
        e.kids = [k for k in e.kids if isinstance(k, str) or k.order in spared]


def walk(root: Node) -> list[Node]:
    """Elements in page order, without recursion."""
    out, todo = [], [root]
    while todo:
        e = todo.pop()
        out.append(e)
        todo.extend(k for k in reversed(e.kids) if isinstance(k, Node))
    return out


def score(root: Node) -> list[Node]:
    nodes = walk(root)
    links = {}
    for e in nodes:
        links[e.order] = e.tag == "a" or (e.parent is not None and links[e.parent.order])
        own = [" ".join(k.split()) for k in e.kids if isinstance(k, str)]
        e.chars = sum(map(len, own))
        e.link_chars = e.chars if links[e.order] else 0
        e.points = 0.0
    near: dict[int, Node | None] = {}  # the paragraph of a text is the nearest scored element
    paragraphs: dict[int, list] = {}
    for e in nodes:
        p = near[e.order] = e if e.tag in SCORED else near[e.parent.order] if e.parent is not None else None
        if p is not None and not links[e.order]:
            for k in e.kids:
                if isinstance(k, str) and (s := k.strip()):
                    got = paragraphs.setdefault(p.order, [p, 0, 0])
                    got[1] += len(s)
                    got[2] += s.count(",")
    for p, size, commas in paragraphs.values():
        up = p.parent if p.tag in ("p", "pre", "li", "dd", "td", "blockquote") else p
        if up is not None:
            up.points += min(1.0, size / 25) + commas + min(size / 100, 3.0)
    for e in reversed(nodes):
        if e.parent is not None:
            e.parent.chars += e.chars
            e.parent.link_chars += e.link_chars
            e.parent.points += e.points / 2
    root.points = 0.0
    for e in nodes:
        e.points *= 1 - e.link_chars / max(e.chars, 1)
    return nodes


def chosen(root: Node) -> list[Node]:
    """The container and the siblings to keep, in page order."""
    nodes = score(root)
    best = max(nodes, key=lambda e: (e.points, -e.order))
    if best.points <= 0:
        return [root]
    up = best
    while up.parent is not None:
        up = up.parent
        if up.tag in ("article", "main"):
            best = up
            if up.tag == "article":
                break
    if best.parent is None or best.parent.tag in ("#root", "html"):
        keep = [best]
    else:
        keep = [k for k in best.parent.kids if isinstance(k, Node) and (k is best or beside(k, best))]
    heads, inside = [e for e in nodes if e.tag == "h1" and e.chars], {e.order for k in keep for e in walk(k)}
    if heads and not any(h.order in inside for h in heads):
        title = [h for h in heads if h.order < best.order and 2 * h.link_chars < h.chars][-1:]
        return title + keep
    return keep


def beside(k: Node, best: Node) -> bool:
    """Whether a sibling of the container belongs to the text."""
    density = k.link_chars / max(k.chars, 1)
    if k.points >= max(10.0, 0.2 * best.points) or (k.tag == "p" and k.chars > 80 and density < 0.25):
        return True
    return density < 0.25 and ((k.tag == best.tag == "section") or (k.tag in HEADINGS and best.parent.tag != "body"))


def blocks(tops: list[Node]) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def flush():
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    for top in tops:
        todo: list[Node | str | None] = [top]
        while todo:
            k = todo.pop()
            if k is None:
                flush()
            elif isinstance(k, str):
                run.append(k)
            elif k.tag == "br":
                run.append(" ")
            else:
                block = k.tag in BLOCK
                if block:
                    flush()
                    todo.append(None)
                todo.extend(reversed(k.kids))
        flush()
    return out


def main_text(page: str | None) -> str:
    return "\n".join(blocks(chosen(parse(page)))) if page else ""


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with a struct ``extracted`` (text, n_chars)."""
    def run(column: pa.Array):
        got = [main_text(x.as_py()) for x in column]
        return {"text": pa.array(got, pa.string()), "n_chars": [len(x) for x in got]}

    return add_struct(pages, html_col, "extracted", "text string, n_chars long", run)
