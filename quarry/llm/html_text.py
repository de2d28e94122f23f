"""Main text of web pages by tree scoring.

The page becomes a tree (implied ends of p, li, td and the like; raw text of scripts and styles skipped). Subtrees that
are page furniture by tag, role, class or id are cut; where forms or such class words wrap the page's main text, they
are opened. Each paragraph gives points for its length and commas to its
parent, half to its grandparent and less further up; a container's points are discounted by the share of its text that
is in links. The best container is kept with all that stands beside it and isn't mostly links, whatever its tag or length,
and so level by level up to the article or main element it lies in; the blocks of text are given in page order.

A null or empty page, and one without text, gives the empty string; pages of any length are read whole; broken and
unclosed markup is read as browsers do; repeated rows are alike and an empty table gives no rows. Only the named columns
are read, so further columns cannot clash.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean_batches

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</\s*([A-Za-z][^\s>/]*)[^>]*(?:>|\Z)|<([A-Za-z][^\s>/]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPACE = re.compile(r"\s+")
_COMMA = re.compile("[,،、，]")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript textarea template iframe title noframes xmp".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_CUT = frozenset("head script style noscript template iframe title nav aside footer form button select option input textarea label fieldset svg canvas object embed applet audio video map dialog menu noframes xmp".split())
_CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
_ENDS_P = _BLOCK - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "legend"}
_RAW_END = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in _RAW}

#: Words of class and id that mark page furniture; whole words of the attribute, or its first part for the second set.
_FURNITURE = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side rail header masthead topbar footer foot bottombar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus respond replies reply discussion share sharing social related recommended recommendations toolbar pagination pager widget widgets skip copyright legal disclaimer tags paywall form search hidden".split())
_PART = re.compile(r"[a-z]+|[0-9]+")
_KEPT = frozenset("article content main body entry post story text".split())
_POSITIVE = re.compile(r"article|body|content|entry|main|page|post|story|text|blog", re.I)
_BASE = {"article": 10.0, "main": 8.0, "div": 5.0, "section": 3.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "ol": -3.0, "ul": -3.0, "dl": -3.0, "li": -3.0, "dd": -3.0, "dt": -3.0, "address": -3.0, "h1": -5.0, "h2": -5.0, "h3": -5.0, "th": -5.0}
#: Class words that, named last, are cut whatever they hold, and first parts that only tell of such a part.
_READERS = frozenset("comment comments commentlist disqus respond replies reply discussion".split())
_TELLS = frozenset("has with no without show hide".split())
#: Cut by class, id or form only; opened if it holds so many characters of text, and so many times those outside.
SOFT, OPENED, TIMES = 2, 250, 4
#: A block beside the best container with this share of its text in links, or more, is left out.
LINKS = 0.33
#: Containers that may be chosen whole.
_CONTAINER = frozenset("article main section div td body html blockquote center details".split())


class Node:
    __slots__ = ("tag", "parent", "items", "cut", "marks", "points", "chars", "linked", "commas", "stands_for")

    def __init__(self, tag, parent, marks="", cut=False):
        self.tag, self.parent, self.items, self.cut, self.marks = tag, parent, [], cut, marks
        self.points, self.chars, self.linked, self.commas, self.stands_for = 0.0, 0, 0, 0, None


def _is_furniture(tag: str, attributes: str, open_tags: list) -> tuple[int, str]:
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return SOFT if tag == "form" else tag in _CUT, ""
    marks = ""
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) or name == "role" and value in _CUT_ROLES:
            return True, marks
        if name in ("class", "id"):
            marks += " " + value
    if tag in _CUT and tag != "form":
        return True, marks
    cut = SOFT if tag == "form" else False
    if marks and tag not in ("html", "body", "article", "main", "p", "a", "b", "i", "em", "strong", "h1"):
        for word in marks.split():
            parts = _PART.findall(word)
            kept = any(p in _KEPT for p in parts if p not in ("body", "text", "post", "content") or len(parts) == 1)
            if any(p in _FURNITURE for p in parts) and not (kept and (parts[-1] not in _FURNITURE or parts[-1] == "header")):
                if parts[-1] in _READERS and parts[0] not in _TELLS:
                    return True, marks
                cut = SOFT
    return cut, marks


def _open(root: Node) -> None:
    """Opens the softly cut subtree that holds the page's main text, if little of it lies outside such subtrees, and those around it."""
    held, outside, articles = {}, 0, set()
    stack: list = [(root, None)]
    while stack:
        node, soft = stack.pop()
        if node.cut and node.cut != SOFT or node.tag == "a":
            continue
        if node.cut:
            soft = node
        elif node.tag in ("article", "main"):
            articles.add(id(soft))
        for x in node.items:
            if not isinstance(x, str):
                stack.append((x, soft))
            elif len(x) >= 25 and len(x.strip()) >= 25:
                if soft is None:
                    outside += len(x)
                else:
                    size, _ = held.get(id(soft), (0, soft))
                    held[id(soft)] = size + len(x), soft
    weight = lambda h: TIMES if id(h[1]) in articles else 1
    best = max(held.values(), key=lambda h: h[0] * weight(h), default=None)
    if best and (best[0] >= OPENED or weight(best) > 1) and best[0] * weight(best) > TIMES * outside:
        node = best[1]
        while node is not None:
            node.cut = False
            node = node.parent


#: Groups of elements that a start tag closes, up to the nearest element of their scope: (closed by, closes, scope).
_GROUPS = (
    (_ENDS_P, {"p"}, {"td", "th", "table", "button", "article", "section", "div", "li", "blockquote", "body", "main", "aside"}),
    ({"li"}, {"li"}, {"ul", "ol", "menu"}), ({"dt", "dd"}, {"dt", "dd"}, {"dl"}), ({"tr"}, {"tr", "td", "th"}, {"table"}), ({"td", "th"}, {"td", "th"}, {"table", "tr"}), ({"option"}, {"option"}, {"select"}),
)


class _Open:
    """The open elements. What a tag closes is looked up, not searched for, so broken markup costs no more than good."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.depths: dict[str, list[int]] = {}
        self.blocks = [0]
        #: By group: depths of its open elements, and -1 for an element of its scope.
        self.groups: list[list[int]] = [[] for _ in _GROUPS]

    def push(self, node: Node) -> None:
        depth, tag = len(self.stack), node.tag
        self.stack.append(node)
        self.depths.setdefault(tag, []).append(depth)
        if tag in _BLOCK:
            self.blocks.append(depth)
        for held, (_, closes, scope) in zip(self.groups, _GROUPS, strict=True):
            if tag in closes:
                held.append(depth)
            elif tag in scope:
                held.append(-1)

    def cut_back(self, depth: int) -> None:
        """Closes the elements from this depth on."""
        while len(self.stack) > depth:
            tag = self.stack.pop().tag
            self.depths[tag].pop()
            if tag in _BLOCK:
                self.blocks.pop()
            for held, (_, closes, scope) in zip(self.groups, _GROUPS, strict=True):
                if tag in closes or tag in scope:
                    held.pop()

    def starts(self, tag: str) -> None:
        """Closes what the start tag implies closed."""
        for held, (by, _, _) in zip(self.groups, _GROUPS, strict=True):
            if tag in by and held and held[-1] >= 0:
                k = len(held) - 1
                while k and held[k - 1] >= 0:
                    k -= 1
                self.cut_back(held[k])

    def ends(self, tag: str) -> None:
        """Closes the nearest open element of the tag; an inline end never closes a block."""
        at = self.depths.get(tag)
        if at and (tag in _BLOCK or at[-1] > self.blocks[-1]):
            self.cut_back(at[-1])

    def within(self, *tags: str) -> bool:
        return any(self.depths.get(t) for t in tags)


def parse(page: str) -> Node:
    """The page as a tree; items of a node are its children and pieces of text, in order."""
    root = Node("html", None)
    at, n, opened = 0, len(page), _Open(root)
    find = _TOKEN.search
    while at < n:
        m = find(page, at)
        text = page[at : m.start()] if m else page[at:]
        node = opened.stack[-1]
        if text:
            node.items.append(text)
        if not m:
            break
        at = m.end()
        if m[2]:
            tag = m[2].lower()
            if tag in ("html", "body") and node is root:
                continue
            opened.starts(tag)
            node = opened.stack[-1]
            cut, marks = _is_furniture(tag, m[3], [])
            if tag == "header" and not cut and not opened.within("article", "main"):
                cut = True
            if tag in _RAW:
                end = _RAW_END[tag].search(page, at)
                at = page.find(">", end.start()) + 1 or n if end else n
                continue
            child = Node(tag, node, marks, cut)
            node.items.append(child)
            if tag not in _VOID and not m[3].endswith("/"):
                opened.push(child)
        elif m[1]:
            tag = m[1].lower()
            if tag == "p" and not opened.within("p"):
                node.items.append(Node("p", node))
            else:
                opened.ends(tag)
        elif m[0].startswith("<![CDATA["):
            node.items.append(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
    _open(root)
    return root


def _inside(node, tags) -> bool:
    while node is not None:
        if node.tag in tags:
            return True
        node = node.parent
    return False


def blocks(root: Node) -> list[str]:
    """Texts of the blocks below a node in page order, without its cut subtrees; references decoded, white space folded.

    A line break is white space in its block; two or more in a row end the block.
    """
    out: list[str] = []
    now: list[str] = []
    broken = False

    def flush():
        if now:
            text = _SPACE.sub(" ", html.unescape("".join(now))).strip()
            if text:
                out.append(text)
            now.clear()

    stack: list = [root]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            broken = broken and x.isspace()
            now.append(x)
        elif x.tag == "br":
            if broken:
                flush()
            now.append(" ")
            broken = True
        elif not x.cut:
            if x.tag in _BLOCK:
                flush()
                stack.append(None)
            stack.extend(reversed(x.items))
    flush()
    return out


def _measure(root: Node) -> list[Node]:
    """Sets chars, linked (characters in links) and commas of each kept node; nodes in page order."""
    order, stack = [], [(root, False)]
    while stack:
        node, in_link = stack.pop()
        if node.cut:
            continue
        order.append(node)
        in_link = in_link or node.tag == "a"
        own = 0
        for x in node.items:
            if isinstance(x, str):
                if not x.isspace():
                    own += len(x)
                    node.commas += len(_COMMA.findall(x))
            else:
                stack.append((x, in_link))
        node.chars, node.linked = own, own if in_link else 0
    for node in reversed(order):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
            node.parent.commas += node.commas
    return order


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def main_nodes(root: Node) -> list[Node]:
    """The best container with what goes with it, as one node."""
    order = _measure(root)
    for node in order:
        own = [x for x in node.items if isinstance(x, str) and not x.isspace()]
        if node.tag in ("p", "pre", "td", "blockquote", "dd", "h1", "h2", "h3"):
            chars, text = node.chars, None
        elif own and node.tag in ("div", "section", "article", "main", "body", "li", "html"):
            chars, text = sum(map(len, own)), own
        else:
            continue
        if not chars or node.tag not in ("h1", "h2", "h3") and chars < 25 and node.tag != "p":
            continue
        commas = node.commas if text is None else sum(len(_COMMA.findall(t)) for t in text)
        points = (1.0 if chars >= 25 else 0.2) + commas + min(chars / 100.0, 30.0)
        up, share = (node if text is not None else node.parent), 1.0
        level = 0
        while up is not None and level < 5:
            up.points += points * share
            level += 1
            share = 0.5 if level == 1 else 1.0 / (3.0 * level)
            up = up.parent
    scored = []
    for node in order:
        if node.tag in _CONTAINER and node.points > 0:
            bonus = _BASE.get(node.tag, 0.0) + (5.0 if node.marks and _POSITIVE.search(node.marks) else 0.0)
            scored.append(((node.points + bonus) * (1.0 - _density(node)), node))
    if not scored:
        return [root]
    best = max(scored, key=lambda s: s[0])[1]
    rises = best.tag not in ("article", "main") and best.parent is not None and _inside(best.parent, ("article", "main"))
    while best.parent is not None:
        rises = rises and best.tag not in ("article", "main")
        best = _with_siblings(best)
        if not rises:
            break
    return [best]


def _with_siblings(node: Node) -> Node:
    """A copy of the parent: the node and what stands beside it, loose text with its inline tags as one block."""
    up = node.parent
    kept, run = Node(up.tag, up.parent, up.marks), []

    def flush():
        chars = sum((len(x) if not x.isspace() else 0) if isinstance(x, str) else x.chars for x in run if isinstance(x, str) or not x.cut)
        if sum(x.linked for x in run if not isinstance(x, str) and not x.cut) < LINKS * chars or not chars:
            kept.items.extend(run)
        run.clear()

    at = node.stands_for or node
    for x in up.items:
        if x is at or not isinstance(x, str) and x.tag in _BLOCK:
            flush()
            run.append(node if x is at else x)
            if x is at:
                kept.items.extend(run)
                run.clear()
            flush()
        else:
            run.append(x)
    flush()
    kept.stands_for = up
    return kept


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return "\n".join(t for node in main_nodes(parse(page)) for t in blocks(node))


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row a page: page_id, url, text, n_chars (code points)."""
    lean_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        return pages.map(main_text)

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), text(F.col(page)).alias("text"))
    return rows.withColumn("n_chars", F.char_length("text").cast("long"))


def op2_html_extraction(spark, sf_dir):
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
