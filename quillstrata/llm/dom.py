"""A lenient reader of HTML: a tree of block elements with their runs of text and the statistics that features need.

Tags are read by HTML's own grammar, so a quoted attribute may hold anything and be of any length. Only scripts, styles,
titles and text areas run to their own end tag. Controls, embedded media and drawings are left out where they are closed;
one that is not closed ends at the next block, as the rest of the page is then inside it only by mistake. Depth, width and
length have no bounds, and each page is read in linear time.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from itertools import count

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Markup inside these is text, up to the end tag or the end of the page; it is never text of the page.
RAW = frozenset("script style textarea title".split())
#: Their content is not text of the page, where they are closed.
SKIPPED = frozenset("noscript template iframe object svg canvas audio video select button datalist annotation annotation-xml".split())
CONTROLS = frozenset("select button input textarea".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input area br "
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd maction semantics".split()
)
#: The frame of a page: their tags make no node, wherever they stand or if they are left out.
FRAME = frozenset("html head body".split())
#: Opening one of these ends an open paragraph.
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: Opening the key ends an open element of the values, up to the nearest of the limits.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}

#: A comment, a tag or a bogus comment. Groups: the slash of an end tag, its name, its attributes.
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|=?+[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+|=)*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+))?+)?+")
_NAMED = frozenset("id class role itemprop aria-label".split())
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}


class Node:
    """An element that is a block. Sizes: code points of text once white space is collapsed."""

    __slots__ = ("tag", "parent", "depth", "children", "runs", "tokens", "hidden", "own", "chars", "links", "blocks", "tags", "stops", "paras", "controls", "kept")

    def __init__(self, tag: str, parent: Node | None, tokens: frozenset[str] = frozenset(), hidden: bool = False):
        self.tag, self.parent, self.tokens, self.hidden = tag, parent, tokens, hidden
        self.depth = parent.depth + 1 if parent else 0
        self.children: list[Node] = []
        self.runs: list[int] = []
        self.own = self.chars = self.links = self.blocks = self.tags = self.stops = self.paras = self.controls = 0
        self.kept = False


def _attributes(source: str) -> tuple[frozenset[str], bool]:
    if "=" not in source and "hidden" not in source:
        return frozenset(), False
    words: list[str] = []
    hidden = False
    for name, *values in _ATTRIBUTE.findall(source):
        name, value = name.lower(), values[0] or values[1] or values[2]
        if name in _NAMED:
            words += _WORD.findall(value)
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
        elif name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
    return frozenset(w.lower() for w in words), hidden


#: start and end in the page, whether it is an end tag, lower-case name ('' for a comment), attributes.
Tag = tuple[int, int, bool, str, str]


def tags_of(html: str) -> list[Tag]:
    """Tags in page order; a raw element is one tag with its content. White space stands where one was."""
    found: list[Tag] = []
    at = 0
    while m := _TOKEN.search(html, at):
        at = m.end()
        tag = (m[2] or "").lower()
        if tag and not html.endswith(">", m.start(), at):
            tag = ""  # the page ends inside of a tag
        if tag in RAW and not m[1]:
            close = _RAW_END[tag].search(html, at)
            at = close.end() if close else len(html)
        found.append((m.start(), at, bool(m[1]), tag, m[3] or ""))
    return found


def closed_by(tags: list[Tag]) -> dict[int, int]:
    """For each start tag of a SKIPPED element that has its own end tag, the place of that tag.

    An element ends unclosed with the end of an outer one, a button at the next button, a drawing at a block.
    """
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    found: dict[int, int] = {}

    def pop(tag: str) -> int:
        while True:
            name, place = stack.pop()
            opened[name] -= 1
            if name == tag:
                return place

    for k, (_, _, ending, tag, source) in enumerate(tags):
        if not tag or tag in FRAME or tag in VOID or tag in INLINE:
            continue
        if ending:
            if opened[tag]:
                place = pop(tag)
                if tag in SKIPPED:
                    found[place] = k
            continue
        if tag in ("button", "select") and opened[tag]:
            pop(tag)
        if opened["svg"] and (tag in _ENDS_P or tag in _ENDS):
            pop("svg")
        if tag in RAW or (tag in SKIPPED and source.endswith("/")):
            continue
        stack.append((tag, k))
        opened[tag] += 1
    return found


def parse(html: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """Block nodes in document order (the first is the root), and runs of text in page order with the node they are of.

    A run is the text between two block boundaries, character references decoded, white space as one space.
    """
    root = Node("html", None)
    nodes, runs = [root], []
    stack: list[tuple[str, Node]] = [("html", root)]  # inline elements stand with the block that they are in
    opened: Counter[str] = Counter()
    text: list[str] = []
    links = 0
    muted = False  # within a skipped element that is not closed, up to the next block
    tags = tags_of(html)
    closed = closed_by(tags)

    def flush() -> None:
        nonlocal text, links, muted
        if text:
            value = " ".join("".join(text).split())
            if value:
                node = stack[-1][1]
                node.runs.append(len(runs))
                runs.append((node, value))
                node.own += len(value)
                node.links += min(links, len(value))
                node.stops += sum(map(value.count, ".,;:!?"))
            text = []
        links, muted = 0, False

    def cut(k: int) -> None:
        """Leave all elements from place ``k`` of the stack on."""
        for tag, _ in stack[k:]:
            opened[tag] -= 1
        del stack[k:]

    def add(part: str) -> None:
        nonlocal links
        if part and not muted:
            part = unescape(part) if "&" in part else part
            text.append(part)
            if opened["a"]:
                links += len(part.strip())

    at = skip = 0
    for k, (start, end, ending, tag, source) in zip(count(), tags):
        if k < skip:
            continue
        add(html[at:start])
        at = end
        if not tag:
            continue
        block = stack[-1][1]
        if ending:
            if tag in INLINE:
                if tag == "br":
                    add(" ")
                if opened[tag]:
                    for j in range(len(stack) - 1, 0, -1):
                        if stack[j][0] not in INLINE:
                            break
                        if stack[j][0] == tag:
                            del stack[j]
                            opened[tag] -= 1
                            break
                continue
            if tag in SKIPPED:
                continue
            if opened[tag]:
                for j in range(len(stack) - 1, 0, -1):
                    if stack[j][0] == tag:
                        flush()
                        cut(j)
                        break
                    if stack[j][0] == "table" and tag not in ("div", "article", "section", "main"):
                        break
            elif tag not in FRAME:
                flush()
            continue
        if tag in RAW or tag in SKIPPED:
            block.controls += tag in CONTROLS
            add(" ")
            if k in closed:
                skip = closed[k] + 1
                at = tags[closed[k]][1]
            elif tag in SKIPPED and not source.endswith("/"):
                muted = True
            continue
        if tag in INLINE:
            block.tags += 1
            if tag == "br":
                add(" ")
            elif tag == "input":
                block.controls += 1
            elif tag not in VOID:
                if tag == "a" and opened["a"]:
                    for j in range(len(stack) - 1, 0, -1):
                        if stack[j][0] == "a":
                            del stack[j]
                            opened["a"] -= 1
                            break
                        if stack[j][0] not in INLINE:
                            break
                stack.append((tag, block))
                opened[tag] += 1
            continue
        flush()
        if tag in VOID or tag in FRAME:
            continue
        if tag in _ENDS_P and opened["p"]:
            for j in range(len(stack) - 1, 0, -1):
                if stack[j][0] == "p":
                    cut(j)
                    break
                if stack[j][0] not in INLINE:
                    break
        if tag in _ENDS:
            ended, limits = _ENDS[tag]
            lowest = None
            if any(opened[t] for t in ended):
                for j in range(len(stack) - 1, 0, -1):
                    if stack[j][0] in limits:
                        break
                    if stack[j][0] in ended:
                        lowest = j
            if lowest is not None:
                cut(lowest)
        parent = stack[-1][1]
        node = Node(tag, parent, *_attributes(source))
        stack.append((tag, node))
        opened[tag] += 1
        parent.children.append(node)
        nodes.append(node)
        parent.tags += 1
    add(html[at:])
    flush()
    for node in reversed(nodes):
        node.chars += node.own
        node.blocks += len(node.runs)
        node.paras += node.tag == "p" and node.own > 0
        if (p := node.parent) is not None:
            for name in ("chars", "links", "blocks", "tags", "stops", "paras", "controls"):
                setattr(p, name, getattr(p, name) + getattr(node, name))
    return nodes, runs
