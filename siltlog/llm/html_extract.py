"""Operator 3: main-text extraction by tree scoring.

A page is read into a light element tree. Paragraphs pass points (one, plus one per comma, plus up to three
for length, times one minus their link density) to their ancestors, whole to the nearest and less to farther
ones; elements that mark an article start with a bonus. The best container is taken, widened to the article
element around it, with the siblings that score well beside it. Without an article element it is widened to
what holds all containers with a good share of its points, and every block beside them stays that is mostly
no links, however short. Boilerplate inside it is left out: by element kind, role, hiding, and by name where
the name does not cover the bulk of the page. A page is read with one cursor and a tree of bounded depth, so
time grows with its length whatever its markup.
"""

from __future__ import annotations

import html as html_module
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"[^>\"']*")
#: Deeper elements are read as part of the one at this depth, as browsers do; none of their text is lost.
MAX_DEPTH = 128
_MARKS = re.compile(r"""(?<![\w-])(class|id|role|style|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_HIDDEN_MARK = re.compile(r"(?:^|[\s\"'/])hidden(?=$|[\s/=])", re.I)
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_WORD = re.compile(r"[a-z0-9]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Names that tell what a layout has around it, not what the element is.
_MODIFIER = re.compile(r"(?:has|no|not|with|without|show|hide|is|layout)[-_]")

#: Element names of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
_TABLE_PARTS = frozenset(("tr", "thead", "tbody", "tfoot"))
_CELLS = frozenset(("td", "th", "br", "option"))
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table article section div body html main td th".split())

_BOILERPLATE_TAGS = frozenset("nav footer aside form button select dialog menu svg canvas object audio video head".split())
_BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
_BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted sidebar sidebars rail nav navbar navigation menu menus breadcrumb breadcrumbs "
    "footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription social share sharing related recommended recommendations "
    "pagination pager widget widgets toolbar skip login signup banner alert".split()
)
_COMMENT_WORDS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
_PAGE_HEADER_WORDS = frozenset(("header", "topbar"))
#: A header of one of these belongs to the article.
_ARTICLE_TITLES = frozenset("article entry post story".split())
_ARTICLE_WORDS = frozenset("article content entry main post story text body blog hentry".split())
_START_POINTS = {"article": 25.0, "main": 25.0, "div": 5.0, "section": 5.0, "blockquote": 3.0, "pre": 3.0, "td": 3.0, "form": -3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "li": -3.0, "address": -3.0}
_PARAGRAPHS = frozenset("p pre blockquote li dd dt figcaption tr h1 h2 h3 h4 h5 h6".split())
#: A sibling of the best container is kept from this share of its score on; without an article element, the text is widened to containers from this share of its points on.
SIBLING_SHARE = 0.2
#: From this share of linked characters on, a block beside the best container is a list of links.
LINK_SHARE = 0.25


class _Node:
    __slots__ = ("at", "chars", "drop", "end", "holds", "linked", "parent", "score", "suspect", "tag", "words")

    def __init__(self, tag: str, parent: _Node | None, at: int) -> None:
        self.tag, self.parent, self.at, self.end = tag, parent, at, -1
        self.score = self.chars = self.linked = 0
        self.drop = self.holds = False
        self.suspect: _Node | None = None
        self.words: frozenset[str] = frozenset()


def _attributes(node: _Node, source: str) -> None:
    """Reads class, id and role; marks what is hidden or bears a boilerplate role."""
    words: set[str] = set()
    if "hidden" in source.lower() and _HIDDEN_MARK.search(_QUOTED.sub('""', source)):
        node.drop = True
    for name, a, b, c in _MARKS.findall(source):
        value, name = a or b or c, name.lower()
        if name == "role":
            node.drop = node.drop or not _BOILERPLATE_ROLES.isdisjoint(_WORD.findall(value.lower()))
            continue
        if name in ("style", "aria-hidden"):
            node.drop = node.drop or (value.strip().lower() == "true" if name == "aria-hidden" else bool(_HIDDEN.search(value)))
            continue
        for part in value.split():
            if not _MODIFIER.match(part.lower()):
                words.update(_WORD.findall(part.lower()))
                words.update(_WORD.findall(_HUMP.sub("-", part).lower()))
    node.words = frozenset(words)


class _Tags:
    """Finds tags with one cursor: no part of a page is read twice, whatever its markup lacks."""

    def __init__(self, source: str) -> None:
        self.source = source
        self.last = {c: source.rfind(c) for c in "<>\"'"}

    def _end(self, at: int) -> int:
        """The place of the '>' that ends a tag whose attributes start here; quotes that never close are letters."""
        source, start = self.source, at
        while True:
            at = _PLAIN.match(source, at).end()
            if at >= len(source):
                return source.find(">", start)
            c = source[at]
            if c == ">":
                return at
            if at >= self.last[c]:
                return source.find(">", start)
            at = source.find(c, at + 1) + 1

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, whether it closes, name or nothing, attributes) of the first tag, comment or such from here on."""
        source = self.source
        while at <= self.last["<"]:
            start = source.find("<", at)
            if source.startswith("<!--", start):
                end = source.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(source), False, "", ""
            if start > self.last[">"]:
                return None
            if source.startswith(("<!", "<?"), start):
                return start, source.find(">", start) + 1, False, "", ""
            m = _OPEN.match(source, start)
            if m:
                end = self._end(m.end())
                return start, end + 1, bool(m[1]), m[2].lower(), source[m.end() : end]
            at = start + 1
        return None


def extract(source: str) -> str:
    """The main text: blocks with single spaces, joined by one newline; empty if there is none."""
    root = _Node("#root", None, 0)
    stack, nodes, pieces = [root], [root], []  # pieces: (node, text) in page order; a None text ends a block
    position, tags, n = 0, _Tags(source), len(source)
    flat: dict[str, int] = {}  # open elements too deep for the tree

    def close(k: int) -> None:
        for node in stack[k:]:
            node.end = len(nodes)
            if node.tag in _BLOCK:
                pieces.append((node, None))
            elif node.tag in _CELLS:
                pieces.append((node, " "))
        del stack[k:]

    while position < n:
        m = tags.next(position)
        if m is None:
            pieces.append((stack[-1], source[position:]))
            break
        start, end, slash, tag, attributes = m
        if start > position:
            pieces.append((stack[-1], source[position:start]))
        position = end
        if not tag:
            continue
        if slash:
            if flat.get(tag):
                flat[tag] -= 1
                if tag in _BLOCK:
                    pieces.append((stack[-1], None))
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag not in _BLOCK and stack[k].tag in _SCOPE:
                    break
            if tag == "p":
                pieces.append((stack[-1], None))
            continue
        if tag in _RAW:
            if not attributes.endswith("/") or tag in ("script", "style", "textarea", "title"):
                end = re.compile(f"</{tag}", re.I).search(source, position)
                close_at = source.find(">", end.end()) if end else -1
                position = close_at + 1 if close_at >= 0 else n
            continue
        if tag in _BLOCK:
            for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in _SCOPE:
                    break
        for ended in _ENDS.get(tag, ()):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == ended:
                    close(k)
                    break
                if stack[k].tag in _SCOPE and stack[k].tag != ended and not (tag == "tr" and stack[k].tag in ("td", "th")):
                    break
        if tag in _VOID:
            pieces.append((stack[-1], None if tag == "hr" else " " if tag == "br" else ""))
            continue
        if tag in _BLOCK:
            pieces.append((stack[-1], None))
        if len(stack) > MAX_DEPTH:
            flat[tag] = flat.get(tag, 0) + 1
            continue
        node = _Node(tag, stack[-1], len(nodes))
        if attributes:
            _attributes(node, attributes)
        nodes.append(node)
        if not attributes.endswith("/") or tag in _BLOCK:
            stack.append(node)
        else:
            node.end = len(nodes)
    close(0)

    _mark_boilerplate(nodes)
    return _main_text(nodes, _blocks(pieces))


def _mark_boilerplate(nodes: list[_Node]) -> None:
    """Sets ``drop`` below elements that are boilerplate by kind, and ``suspect`` below those whose names say so."""
    for node in nodes[1:]:
        if node.tag in ("article", "main") and _COMMENT_WORDS.isdisjoint(node.words):
            up = node.parent
            while up is not None and not up.holds:
                up.holds = True
                up = up.parent
    inside_article = [False] * len(nodes)
    for node in nodes[1:]:
        up = node.parent
        inside_article[node.at] = inside_article[up.at] or up.tag in ("article", "main")
        flagged = node.tag in _BOILERPLATE_TAGS or not _COMMENT_WORDS.isdisjoint(node.words)
        named = not _BOILERPLATE_WORDS.isdisjoint(node.words)
        if node.tag == "header" or not _PAGE_HEADER_WORDS.isdisjoint(node.words):
            if not (inside_article[node.at] or not _ARTICLE_TITLES.isdisjoint(node.words)):
                flagged, named = flagged or node.tag == "header", True
        protected = node.tag in ("html", "body", "main") or node.holds or (node.tag == "article" and node.words.isdisjoint(("comment", "comments", "reply", "ad", "ads", "advert", "sponsored", "promo", "related")))
        node.drop = up.drop or (node.drop and node.tag not in ("html", "body")) or (flagged and not protected)
        node.suspect = up.suspect or (node if named and not protected else None)


def _blocks(pieces: list[tuple[_Node, str | None]]) -> list[tuple[_Node, str, int]]:
    """(element, text, linked characters) of each block outside of what is dropped.

    Elements that are boilerplate by name alone are dropped too, but for one that holds more text that is no link
    than all that is beside such elements: the bulk of a page is not its boilerplate, whatever it is called.
    """
    blocks: list[tuple[_Node, str, int]] = []
    parts: list[str] = []
    linked, first = 0, None

    def flush() -> None:
        nonlocal linked, first
        if first is not None:
            text = " ".join(html_module.unescape("".join(parts)).split())
            if text:
                blocks.append((first, text, linked))
        parts.clear()
        linked, first = 0, None

    for node, text in pieces:
        if text is None:
            flush()
        elif not node.drop:
            if first is None and text.strip():
                first = node
            parts.append(text)
            up = node
            while up is not None and up.tag not in _BLOCK:
                if up.tag == "a":
                    linked += len(text)
                    break
                up = up.parent
    flush()
    plain, bulk = 0, {}
    for node, text, linked in blocks:
        if linked < LINK_SHARE * len(text):
            if node.suspect is None:
                plain += len(text)
            else:
                bulk[node.suspect] = bulk.get(node.suspect, 0) + len(text)
    kept = {node for node, size in bulk.items() if size > plain}
    return [b for b in blocks if b[0].suspect is None or b[0].suspect in kept]


def _main_text(nodes: list[_Node], blocks: list[tuple[_Node, str, int]]) -> str:
    """The text of the best container and of what belongs beside it."""
    for block in blocks:
        _pass_points(*block)
    if not blocks:
        return ""
    root = nodes[0]
    best, top, points = None, float("-inf"), [0.0] * len(nodes)
    for node in nodes:
        if node.drop or (not node.chars and node.tag not in ("article", "main")):
            continue
        points[node.at] = node.score * (1.0 - node.linked / node.chars if node.chars else 1.0)
        start = _START_POINTS.get(node.tag, 0.0) + (25.0 if not _ARTICLE_WORDS.isdisjoint(node.words) else 0.0)
        node.score = (node.score + start) * (1.0 - node.linked / node.chars if node.chars else 1.0)
        if node.score > top and (node.tag in _BLOCK or node.tag in _CELLS or node is root):
            best, top = node, node.score
    if best is None:
        return ""
    up = best
    while up is not None:
        if up.tag in ("article", "main"):
            best = up
            if up.tag == "article":
                break
        up = up.parent
    kept = [best]
    home = None
    if best.parent is not None and best.tag not in ("article", "main", "body"):
        home = _widen(best, nodes, points, kept)
    elif best.parent is not None and best.tag != "body":
        for node in nodes[best.parent.at + 1 : best.parent.end]:
            if node.parent is best.parent and node is not best and not node.drop:
                density = node.linked / node.chars if node.chars else 1.0
                if node.tag == "p":
                    good = density < LINK_SHARE and node.chars > 80
                else:
                    # another article is a teaser, or another text
                    good = node.tag in _BLOCK and node.tag != "article" and node.chars and density < LINK_SHARE and node.score >= max(10.0, SIBLING_SHARE * top) and node.tag == best.tag
                if good:
                    kept.append(node)
    inside = bytearray(len(nodes) + 1)
    reach = 0
    for k in sorted(kept, key=lambda k: k.at):
        for at in range(max(k.at, reach), k.end):
            inside[at] = 1
        reach = max(reach, k.end)
    return "\n".join(text for node, text, linked in blocks if inside[node.at] or (home is not None and _beside(node, home, linked / len(text))))


def _listed(node: _Node) -> bool:
    return node.tag in _BLOCK and node.chars > 0 and node.linked >= LINK_SHARE * node.chars


def _widen(best: _Node, nodes: list[_Node], points: list[float], kept: list[_Node]) -> _Node:
    """The least element around the best container and all others near it in points, which are added to ``kept``."""
    home = best.parent
    for node in nodes[1:]:
        if node.at <= best.at < node.end or best.at <= node.at < best.end or kept[-1].at <= node.at < kept[-1].end:
            continue
        if node.tag in _BLOCK and node.chars and not node.drop and not _listed(node) and points[node.at] >= SIBLING_SHARE * points[best.at]:
            kept.append(node)
            while not home.at < node.at < home.end:
                home = home.parent
    while home.tag in _TABLE_PARTS and home.parent is not None:  # rows and cells beside it are beside the text
        home = home.parent
    return home


def _beside(node: _Node, home: _Node, density: float) -> bool:
    """Whether a block lies in ``home`` and neither it nor an element around it there is a list of links."""
    if density >= LINK_SHARE or not home.at <= node.at < home.end:
        return False
    while node is not home:
        if _listed(node):
            return False
        node = node.parent
    return True


def _pass_points(node: _Node, text: str, linked: int) -> None:
    """Gives a block's points to its ancestors; all of them count its characters and linked characters."""
    while node.tag not in _BLOCK and node.parent is not None:
        node = node.parent
    density = min(1.0, linked / len(text))
    points = (1.0 + text.count(",") + min(len(text) / 100.0, 3.0)) * (1.0 - density)
    up = node.parent if node.tag in _PARAGRAPHS and node.parent is not None else node
    if up is not node:
        node.chars += len(text)
        node.linked += min(linked, len(text))
        node.score += points / 2
    level = 0
    while up is not None:
        up.chars += len(text)
        up.linked += min(linked, len(text))
        up.score += points if level == 0 else points / 2 if level == 1 else points / (3 * level)
        up = up.parent
        level += 1


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, max(1, batch.num_rows), 512):
            part = batch.slice(lo, 512)
            texts = [extract(source or "") for source in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), part.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page; one task reads one page at a time, nothing is shuffled.

    A null or empty page, and one without a main text, gives an empty text. Cut-off markup ends where the
    page ends. Very long and broken pages take time in proportion to their length. Repeated rows give repeated
    rows, an empty table none; extra columns are ignored.
    """
    return pages.select("page_id", "url", "html").mapInArrow(_extract_batches, "page_id long, url string, text string, n_chars long")
