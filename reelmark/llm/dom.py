"""A small, forgiving HTML reader: a page as a tree of blocks with their text."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

#: Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("head script style noscript template svg math iframe object canvas audio video select textarea button title".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template")
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr br input".split()
)
#: Elements that can stand in a head; the start tag of any other, or text, ends it, as its end tag may be left out.
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: A start tag (key) ends these open elements, up to the nearest of the bounds.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
OPENING = re.compile(r"<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)")
RAW_OPENING = re.compile(r"<(" + "|".join(RAW) + r")\b", re.I)
RAW_CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
MARKS = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
BLANKS = re.compile(r"\s+")


class Node:
    """A block: its element, the words of class, id and role, its place in the tree, and its own text runs."""

    __slots__ = ("name", "marks", "parent", "chars", "linked")

    def __init__(self, name: str, marks: str, parent: int):
        self.name, self.marks, self.parent = name, marks, parent
        self.chars = self.linked = 0


def _tag_ends(page: str) -> tuple[list[int], list[int]]:
    """Places of ``>`` and quotes, and where a tag ends that reads on from there outside quotes; -1 if nowhere.

    One pass from the back, so that tags without an end cost no search each.
    """
    places = [m.start() for m in re.finditer("[>\"']", page)]
    ends, same = [-1] * (len(places) + 1), {}
    for i in range(len(places) - 1, -1, -1):
        sign = page[places[i]]
        if sign == ">":
            ends[i] = places[i] + 1
        else:
            if sign in same:
                ends[i] = ends[same[sign] + 1]
            same[sign] = i
    return places, ends


def _tokens(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of tags in order; comments and the like have no name. Linear in the page."""
    places, ends = _tag_ends(page)
    last = page.rfind(">")
    at = page.find("<")
    while 0 <= at:
        stop, name, closing, attributes = -1, "", False, ""
        raw, tag = RAW_OPENING.match(page, at), OPENING.match(page, at)
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            stop = len(page) if stop < 0 else stop + 3
        elif at < last:
            if tag:
                stop = ends[bisect_left(places, tag.end())]
            if raw and stop > 0:
                close = RAW_CLOSING[raw[1].lower()].search(page, stop)
                stop = close.end() if close else len(page)
            elif tag and stop > 0:
                name, closing, attributes = tag["name"].lower(), bool(tag["close"]), page[tag.end() : stop - 1]
            elif page[at + 1 : at + 2] in ("!", "?", "/"):
                stop = page.find(">", at + 1) + 1
        if stop > 0:
            yield at, stop, name, closing, attributes
        at = page.find("<", max(stop, at + 1))


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Blocks, parents before children, and (block, text) runs in page order; the root is block 0."""
    nodes = [Node("html", "", -1)]
    runs: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements with the block they are in
    places: dict[str, list[int]] = {"html": [0]}  # of each name in the stack
    skipped = links = 0
    text: list[str] = []

    def flush() -> None:
        if text:
            run = BLANKS.sub(" ", html.unescape("".join(text)) if "&" in "".join(text) else "".join(text)).strip()
            text.clear()
            if run:
                block = stack[-1][1]
                runs.append((block, run))
                nodes[block].chars += len(run)

    def pop() -> None:
        nonlocal skipped, links
        name, _ = stack[-1]
        if name not in INLINE:
            flush()
        skipped -= name in SKIPPED
        links -= name == "a"
        stack.pop()
        places[name].pop()

    def is_open(name: str) -> bool:
        return bool(places.get(name))

    def topmost(names) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    def end(names, bounds=frozenset()) -> None:
        found = topmost(names)
        if found > max(0, topmost(bounds)):
            while len(stack) > found:
                pop()

    at = 0
    for start, stop, name, closing, attributes in _tokens(page):
        if start > at and stack[-1][0] == "head" and page[at:start].strip():
            end({"head"})
        if start > at and not skipped:
            piece = page[at:start]
            text.append(piece)
            if links:
                nodes[stack[-1][1]].linked += len(piece)
        at = stop
        if not name:
            continue
        if closing:
            if name not in VOID:
                end({name})
            continue
        if skipped == 1 and name not in HEAD:
            end({"head"})
        if name in VOID:
            if name in ("br", "hr", "img"):
                text.append(" ")
            if name == "hr":
                flush()
            continue
        if name not in INLINE:
            end({"p", "h1", "h2", "h3", "h4", "h5", "h6"} if name != "span" else (), {"li", "td", "th", "div", "section", "article", "main", "aside", "blockquote", "button"})
            flush()
        if name in ENDS:
            end(*ENDS[name])
        if name in ("html", "body") and len(stack) > 1 and is_open(name):
            continue
        if name == "head" and (is_open("head") or is_open("body")):
            continue
        if attributes.rstrip().endswith("/") and name in ("path", "use"):
            continue
        block = stack[-1][1]
        if name not in INLINE:
            marks = " ".join(a or b or c for a, b, c in MARKS.findall(attributes)) if attributes else ""
            nodes.append(Node(name, marks.lower(), block))
            block = len(nodes) - 1
        places.setdefault(name, []).append(len(stack))
        stack.append((name, block))
        skipped += name in SKIPPED
        links += name == "a"
    if at < len(page) and stack[-1][0] == "head" and page[at:].strip():
        end({"head"})
    if at < len(page) and not skipped:
        text.append(page[at:])
    while len(stack) > 1:
        pop()
    flush()
    return nodes, runs
