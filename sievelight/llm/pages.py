"""Main text of web pages by minimum-cut labelling.

A page becomes a sequence of text blocks. A classifier on marks of the enclosing elements, length, sentence ends
and share of link text gives each block a cost of calling it content and one of calling it
boilerplate: the capacities of its edges to the two terminals. Smoothness edges join blocks that
follow each other and blocks in the same element, past blocks marked as boilerplate, which have no edges.
The maximum flow between the terminals gives the cheapest labelling; blocks that the source still reaches are
content. On a page without content marks unmarked text is content by default, as far as it is not links.
"""

from __future__ import annotations

import html as html_module
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import tidy, without

#: Elements whose contents are no markup; without an end tag they run to the end of the page.
_RAW = "script|style|noscript|iframe|textarea|title"
_FOREIGN = frozenset("svg math".split())
#: Elements without text of the page; without an end tag they end with their parent.
_SILENT = _FOREIGN | frozenset("template object canvas audio video select".split())
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)"
    # the end tag of a head may be missing
    r"|<(?P<head>head)\b[^>]*>.*?(?:</head\s*>|(?=<(?:body|header|nav|main|article|section|div|p|h[1-6])\b))"
    rf"|(?P<start><(?P<silent>{_RAW})(?=[\s/>])[^>]*>).*?(?:</(?P=silent)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest2>[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Tags that end an open ``svg`` or ``math``, unless inside an element of these that may hold markup.
_BREAKS = (_BLOCKS - {"title"}) | frozenset("b big body br code em embed head i img nobr ruby s small span strong strike sub sup tt u var".split())
_POINTS = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends an open element of these kinds, unless one of the fences lies between.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
_AWAY = frozenset("nav footer aside form menu dialog button search fieldset".split())
_HERE = frozenset("article main".split())
_WRAPS = frozenset("form fieldset".split())
#: Kinds of boilerplate marks. A weak one gives way to a content mark nearer to the block. Any is lifted
#: from an element that holds the content: ``main``, or most of the sentences. Where the page has marked content
#: outside of it, this is true of weak marks only; a firm one needs marked content inside.
_WEAK, _STRONG, _FIRM = 1, 2, 3
_AWAY_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising advertorial adbox adslot adunit banner sponsor sponsored promo promoted promotion cookie cookies consent gdpr "
    "cookiebar cookiebanner cookieconsent cookienotice notice notices notification alert popup modal overlay sidebar aside rail widget nav navbar navigation navigate menu breadcrumb breadcrumbs "
    "pagination pager toolbar footer masthead topbar comment comments commentlist disqus reply replies respond discussion "
    "related recommended recommendations teaser teasers share sharing social follow subscribe subscription newsletter signup login "
    "search form copyright legal disclaimer skip hidden complementary contentinfo "
    "werbung anzeige anzeigen fusszeile kopfzeile seitenleiste kommentar kommentare publicite annonce annonces entete pied commentaire commentaires "
    "publicidad anuncio anuncios cabecera pie comentario comentarios".split()
)
_FIRM_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising advertorial adbox adslot adunit sponsor sponsored "
    "cookie cookies consent gdpr cookiebar cookiebanner cookieconsent cookienotice".split()
)
#: Class names that tell what a page has or lacks, not what the element is.
_ABOUT = re.compile(r"(?:has|have|with|no|not|without|is|hide|show|toggle)[-_]", re.I)
_HERE_NAMES = frozenset("article content post entry story main body text".split())
_SENTENCE = re.compile(r"[.!?…。](?:[\s\"'”’)]|$)")
_RIGHTS = re.compile(
    r"(?:©|\(c\)|copyright\b)|.*(?:all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados)\W*$", re.I | re.S
)
_DEFAULT = 2.6  # for link-free unmarked text where nothing is marked as content: above all smoothness edges of a block and the start of -0.5
_STEP, _SAME, _NEAR = 0.5, 0.75, 0.5  # smoothness: neighbours, neighbours in one element, next in the element


class _Block:
    __slots__ = ("text", "links", "away", "here", "heading", "owner", "bare")

    def __init__(self, text: str, links: int, away: int, here: int, heading: bool, owner: int):
        self.text, self.links, self.away, self.here = text, links, away, here
        self.heading, self.owner = heading, owner
        self.bare = False  # in no menu or the like, on a page without marked content


def _marks(tag: str, rest: str, within: int) -> tuple[int, int]:
    """How an element is marked as boilerplate, and whether as content. ``within``: depth of content marks.

    A boilerplate mark is weak where it may only describe what the element has: of a form, or of a
    compound name whose last part says something else. An element keeps both marks.
    """
    away, here = _WEAK if tag in _WRAPS else _STRONG if tag in _AWAY else 0, tag in _HERE
    if tag == "header" and not within:
        away = _STRONG
    if rest and "=" in rest or "hidden" in rest:
        for key, a, b, c in _ATTRIBUTE.findall(rest):
            key, value = key.lower(), a or b or c
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                away = _FIRM
            elif key == "style":
                away = _FIRM if "display:none" in value.replace(" ", "").lower() else away
            elif key != "id" or tag not in _HERE:  # the id of an article tells its topic
                for name in value.split():
                    if _ABOUT.match(name):
                        continue
                    parts = [n.lower() for n in _NAME.findall(name) if not n.isdigit()]
                    bad = [n in _AWAY_NAMES or n == "header" and not within for n in parts]
                    if any(bad):
                        firm = not _FIRM_NAMES.isdisjoint(parts)
                        away = max(away, (_FIRM if firm else _STRONG) if bad[-1] else _WEAK)
                    here = here or not any(bad) and not _HERE_NAMES.isdisjoint(parts)
    return (0, 0) if tag in ("html", "body") else (away, int(here))


class _Tree:
    """The marked elements of a page and the text in them. A mark holds for a chain of elements."""

    def __init__(self) -> None:
        self.elements: list[tuple[str, int, int]] = []  # tag, boilerplate mark, content mark
        self.chains: list[tuple[int, int]] = []  # element, chain around it

    def add(self, element: int, around: int) -> int:
        self.chains.append((element, around))
        return len(self.chains) - 1

    def settle(self, found: list[_Block]) -> None:
        """Sets ``away`` and ``here`` of the blocks, whose ``away`` is the number of their chain."""
        n = len(self.chains)
        plain = [len(b.text) - b.links for b in found]
        said = [p if _SENTENCE.search(b.text) else 0 for p, b in zip(plain, found, strict=True)]
        if not any(said):  # a page without sentence ends
            said = plain
        kinds = [self.elements[e] for e, _ in self.chains]
        nearest = [not away and here for _, away, here in kinds]
        strong = [away >= _STRONG for _, away, _ in kinds]
        for c, (_, around) in enumerate(self.chains):
            strong[c] = strong[c] or around >= 0 and strong[around]
        inside, marked, lead = [0] * n, [0] * n, [0] * n
        total, bare, content_ = sum(said), 0, 0
        for b, size, text in zip(found, said, plain, strict=True):
            c = b.away
            bare += size if c < 0 or not strong[c] else 0
            if c >= 0:
                inside[c] += size
                if nearest[c]:
                    marked[c] += text
                    content_ += text
        sums = [[0, 0, 0] for _ in self.elements]
        for c in range(n - 1, -1, -1):
            element, around = self.chains[c]
            tag, away, _ = kinds[c]
            if tag in _HERE and not away and inside[c]:
                lead[c] = max(lead[c], 2 if tag == "main" else 1)
            if around >= 0:
                inside[around] += inside[c]
                marked[around] += marked[c]
                lead[around] = max(lead[around], lead[c])
            of = sums[element]
            of[0], of[1], of[2] = of[0] + inside[c], of[1] + marked[c], max(of[2], lead[c])
        lifted = []
        for (_, away, _), (text, own, best) in zip(self.elements, sums, strict=True):
            other, most = content_ - own, 2 * text > total
            if away == _WEAK:
                lifted.append(best == 2 or most and other <= text)
            elif away == _STRONG:
                lifted.append(best == 2 or not other and (most or best == 1 and text > bare))
            else:
                lifted.append(bool(away) and not other and bool(own) and most)
        state: list[tuple[int, int, int]] = []  # firm mark, weak mark, content mark
        for c, (element, around) in enumerate(self.chains):
            firm, weak, here = state[around] if around >= 0 else (0, 0, 0)
            _, away, own = kinds[c]
            if away and not lifted[element]:
                firm, weak = (firm, 1) if away == _WEAK else (1, weak)
            elif own:
                weak, here = 0, 1
            state.append((firm, weak, here))
        for b in found:
            b.bare = b.away < 0 or not strong[b.away]
            firm, weak, b.here = state[b.away] if b.away >= 0 else (0, 0, 0)
            b.away = firm or weak
        if any(b.here and not b.away for b in found):
            for b in found:
                b.bare = False


def blocks(page: str) -> list[_Block]:
    """The text blocks of a page in order, with what the classifier needs."""
    out: list[_Block] = []
    stack: list[tuple[str, int, int, int]] = []  # tag, chain of marked elements, content mark, number
    open_ = Counter()
    tree = _Tree()
    here = links = heading = 0
    numbers = 0
    quiet: int | None = None  # place of the outermost silent element on the stack
    inner = Counter()  # open elements from there on
    parts: list[str] = []
    linked: list[str] = []

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html_module.unescape("".join(parts)).split())
            if text:
                owner = next((s[3] for s in reversed(stack) if s[0] not in ("p",)), 0)
                inside = len(" ".join(html_module.unescape("".join(linked)).split()))
                out.append(_Block(text, inside, stack[-1][1] if stack else -1, 0, heading > 0, owner))
        parts, linked = [], []

    def pop() -> None:
        nonlocal here, links, heading
        tag, _, h, _ = stack.pop()
        open_[tag] -= 1
        here -= h
        links -= tag == "a"
        heading -= tag == "h1"

    def end(kinds: set[str], fences: set[str]) -> None:
        """Close the innermost open element of these kinds that lies inside all fences."""
        if not any(open_[k] for k in kinds):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in kinds:
                while len(stack) > i:
                    pop()
                return
            if stack[i][0] in fences:
                return

    def close_silent() -> None:
        """Close the outermost silent element and all in it."""
        nonlocal quiet
        while len(stack) > quiet:
            pop()
        quiet = None
        inner.clear()

    def still_silent(tag: str, closing: bool, rest: str) -> bool:
        """Whether a tag inside a silent element belongs to it; if not, the element ends before the tag."""
        nonlocal numbers, links, heading
        if closing:
            if not inner[tag]:
                if not open_[tag]:
                    return True
                close_silent()
                return False
            while stack[-1][0] != tag:
                inner[stack[-1][0]] -= 1
                pop()
            inner[tag] -= 1
            pop()
            if len(stack) == quiet:
                close_silent()
            return True
        if stack[quiet][0] in _FOREIGN and tag in _BREAKS and not any(inner[k] for k in _POINTS):
            close_silent()
            return False
        kinds, fences = _ENDS.get(tag, ((), ()))
        if any(open_[k] for k in kinds) and not any(inner[k] for k in (*kinds, *fences)):
            close_silent()
            return False
        if tag not in _VOID and not rest.endswith("/"):
            numbers += 1
            stack.append((tag, stack[-1][1], 0, numbers))
            open_[tag] += 1
            inner[tag] += 1
            links += tag == "a"
            heading += tag == "h1"
        return True

    at = 0
    while token := _TOKEN.search(page, at):
        begin = token.start()
        if begin > at and quiet is None:
            text = page[at:begin]
            parts.append(text)
            if links:
                linked.append(text)
        at = token.end()
        tag = token["tag"] or token["tag2"]
        if tag is None:
            if quiet is not None:
                if token["silent"] and token["start"].endswith("/>") and stack[quiet][0] in _FOREIGN:
                    at = token.end("start")
                continue
            if token["silent"] is None and token["head"] is None:  # a comment stands between letters as nothing, others too
                continue
            parts.append(" ")
            continue
        tag = tag.lower()
        closing = bool(token["close"] or token["close2"])
        rest = (token["rest"] if token["tag"] else token["rest2"]) or ""
        if quiet is not None and still_silent(tag, closing, rest):
            continue
        block = tag in _BLOCKS
        if block:
            flush()
        if closing:
            if open_[tag]:
                if block:
                    end({tag}, set())
                elif stack[-1][0] == tag:
                    pop()
                else:  # an inline element does not close the blocks that were opened in it
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == tag:
                            del_tag, chain, h, _ = stack.pop(i)
                            open_[tag] -= 1
                            here -= h
                            links -= del_tag == "a"
                            around = stack[i - 1][1] if i else -1
                            if chain != around:  # the elements in it are marked without it from here on
                                old = chain
                                for k in range(i, len(stack)):
                                    t, c, h, number = stack[k]
                                    if c != old:
                                        old, chain = c, tree.add(tree.chains[c][0], around)
                                        around = chain
                                    stack[k] = (t, around, h, number)
                            break
            continue
        if tag in _VOID:
            if tag in ("br", "img", "input"):
                parts.append(" ")
            continue
        if block:
            if open_["p"] and tag not in ("button",):
                end({"p"}, {"td", "th", "button", "li", "div", "section", "article", "blockquote"})
            if tag in _ENDS:
                end(*_ENDS[tag])
        elif tag == "a" and open_["a"]:
            end({"a"}, _BLOCKS)
        if tag in _SILENT:
            parts.append(" ")
        if rest.endswith("/") and not block:
            continue
        a, h = _marks(tag, rest, here) if block or rest else (0, 0)
        chain = stack[-1][1] if stack else -1
        if a or h:
            tree.elements.append((tag, a, h))
            chain = tree.add(len(tree.elements) - 1, chain)
        h = int(h and not a)
        numbers += 1
        stack.append((tag, chain, h, numbers))
        open_[tag] += 1
        here += h
        links += tag == "a"
        heading += tag == "h1"
        if tag in _SILENT:
            quiet = len(stack) - 1
            inner[tag] += 1
    if quiet is not None:
        close_silent()
    elif at < len(page):
        parts.append(page[at:])
    flush()
    tree.settle(out)
    return out


def leaning(block: _Block) -> float:
    """Cost of calling the block boilerplate less that of calling it content."""
    size = len(block.text)
    score = -0.5 + min(size, 400) / 200 + min(len(_SENTENCE.findall(block.text)), 3) * 0.4
    share = block.links / size
    score -= 3.0 * share
    if size < 300 and _RIGHTS.match(block.text):
        score -= 5.0
    elif block.bare and not block.away:
        score += _DEFAULT * (1 - share)
    if block.here:
        score += 6.0
    if block.heading:
        score += 2.0
    if block.away:
        score -= 14.0
    return score


def content(found: list[_Block]) -> list[bool]:
    """The minimum cut: which blocks are content."""
    n = len(found)
    excess = [leaning(b) for b in found]  # direct paths from source to sink are already used
    if all(e > 0 for e in excess) or all(e <= 0 for e in excess):
        return [e > 0 for e in excess]
    edges: list[dict[int, float]] = [{} for _ in range(n)]

    def join(i: int, j: int, weight: float) -> None:
        edges[i][j] = edges[i].get(j, 0.0) + weight
        edges[j][i] = edges[j].get(i, 0.0) + weight

    last: dict[int, int] = {}
    before = None
    for j, b in enumerate(found):
        if b.away:
            continue
        if before is not None:
            join(before, j, _SAME if found[before].owner == b.owner else _STEP)
        i = last.get(b.owner)
        if i is not None and i != before:
            join(i, j, _NEAR)
        last[b.owner] = before = j
    while True:
        level = _levels(excess, edges)
        if level is None:
            break
        _block_flow(excess, edges, level)
    reached = [e > 1e-9 for e in excess]
    todo = [i for i in range(n) if reached[i]]
    while todo:
        i = todo.pop()
        for j, room in edges[i].items():
            if room > 1e-9 and not reached[j]:
                reached[j] = True
                todo.append(j)
    return reached


def _levels(excess: list[float], edges: list[dict[int, float]]) -> list[int] | None:
    """Distance from the source in the residual graph, up to the nearest sink; None if there is no way."""
    level = [0 if e > 1e-9 else -1 for e in excess]
    todo = deque(i for i, d in enumerate(level) if d == 0)
    goal = None
    while todo:
        i = todo.popleft()
        if goal is not None and level[i] >= goal:
            break
        for j, room in edges[i].items():
            if room > 1e-9 and level[j] < 0:
                level[j] = level[i] + 1
                if excess[j] < -1e-9:
                    goal = level[j]
                todo.append(j)
    return level if goal is not None else None


def _block_flow(excess: list[float], edges: list[dict[int, float]], level: list[int]) -> None:
    """Push along shortest ways until none is left."""
    ways = [iter(list(e)) for e in edges]
    for start in range(len(excess)):
        if level[start] != 0:
            continue
        path = [start]
        while path and excess[start] > 1e-9:
            i = path[-1]
            if excess[i] < -1e-9:
                flow = min(excess[start], -excess[i], *(edges[a][b] for a, b in zip(path, path[1:], strict=False)))
                excess[start] -= flow
                excess[i] += flow
                for a, b in zip(path, path[1:], strict=False):
                    edges[a][b] -= flow
                    edges[b][a] += flow
                path = [start]
                ways[start] = iter(list(edges[start]))
                continue
            step = next((j for j in ways[i] if level[j] == level[i] + 1 and edges[i][j] > 1e-9), None)
            if step is None:
                level[i] = -2
                path.pop()
            else:
                path.append(step)


def main_text(page: str | None) -> str:
    """The content blocks of a page, joined by an empty line; empty if there are none."""
    found = blocks(page or "")
    return "\n\n".join(b.text for b, keep in zip(found, content(found), strict=True) if keep)


def extract(pages: DataFrame, *, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text of ``html`` as ``text`` instead of the page.

    Null pages count as empty and give an empty text; rows that repeat are all extracted. An input column
    named like ``text`` is replaced. Memory is linear in the longest page.
    """
    plain = without(pages, text) if text != html else pages
    rest = [c for c in plain.columns if c != html]
    schema = T.StructType([*(plain.schema[c] for c in rest), T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(p.as_py()) for p in batch.column(html)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), texts], names=[*rest, text])

    return plain.mapInArrow(tidy(run), schema)
