"""A small HTML reader: block elements as a tree, with the text between them.

Inline elements do not make nodes; their text belongs to the block they are in. Line breaks count as white space. End
tags that HTML leaves out are supplied for paragraphs, list items, table parts and the like. Character references are
decoded. Elements that are nested deeper than ``DEEPEST`` are taken as children of the last level: their text is kept.
"""

from __future__ import annotations

import html
import re

DEEPEST = 150
TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>)", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data dfn em font i ins del kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "audio video object noscript math annotation mfrac mi mn mo mover mroot mrow ms mspace msqrt msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track".split())
#: Content that is no text of the page.
RAW = frozenset("script style template iframe svg canvas textarea select".split())
BLOCKS_END_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: For a start tag, the open elements that it ends and those beyond which it does not look.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"}),
}
SPACES = re.compile(r"[ \t\n\r\f\v\xa0\s]+")


class Node:
    """An element: its tag, a signature of tag and class, what it holds in order: nodes, or (text, characters in links)."""

    __slots__ = ("attributes", "children", "sign", "slot", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]) -> None:
        self.tag, self.attributes, self.children, self.slot = tag, attributes, [], -1
        names = " ".join(sorted(attributes.get("class", "").split()))
        self.sign = f"{tag}.{names}" if names else tag


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def parse(page: str) -> Node:
    root = Node("#root", {})
    stack = [root]
    text: list[str] = []
    links = 0
    linked = 0  # characters of the current text that are in links
    at = 0

    def flush() -> None:
        nonlocal linked
        if text:
            clean = SPACES.sub(" ", html.unescape("".join(text))).strip()
            if clean:
                stack[-1].children.append((clean, min(linked, len(clean))))
            text.clear()
        linked = 0

    def add(part: str) -> None:
        nonlocal linked
        if part:
            text.append(part)
            if links:
                linked += len(part)

    def close(tags: set[str] | frozenset[str], beyond: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                flush()
                del stack[k:]
                return
            if stack[k].tag in beyond:
                return

    while True:
        m = TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name == "br":
            add(" ")
        elif name in INLINE:
            if name == "a":
                links = max(0, links - 1) if m[1] else 1
        elif m[1]:
            if name == "p" and not any(n.tag == "p" for n in stack):
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    flush()
                    del stack[k:]
                    break
        elif name in RAW or name == "title":
            flush()
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
        else:
            flush()
            links = 0
            if name in BLOCKS_END_P:
                close({"p"}, {"table", "button"} | BLOCKS_END_P - {"p"})
            if name in ENDS:
                for _ in range(3):
                    close(*ENDS[name])
            node = Node(name, attributes(m[3]) if m[3].strip(" /") else {})
            stack[-1].children.append(node)
            if name not in VOID and len(stack) < DEEPEST:
                stack.append(node)
    flush()
    return root
