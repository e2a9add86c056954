"""HTML pages as sequences of leaf blocks with the tags above them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

#: a quote delimits a value only right after the equals sign, and only if it is closed
_TAG = re.compile(
    r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+))?+)*+)>"""
)
_TO_NEXT = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|\s(hidden)(?=[\s/>]|$)""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

#: HTML elements by how they take part in the text (fixed by the HTML standard)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style title template iframe textarea noembed noframes xmp svg".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var object math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover "
    "mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover "
    "semantics annotation annotation-xml".split()
)
#: elements that end an open element of the same group
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
#: elements within which a sibling element of an outer list or table stays open
SCOPES = frozenset("ul ol dl table body article main section div td th blockquote".split())


@dataclass
class Block:
    """Text between two block-level tags, and what stands above it."""

    text: str
    #: tags, class and id parts and roles of the open elements
    path: frozenset[str]
    tag: str
    #: share of the characters that are link text
    linked: float


@dataclass
class _Open:
    name: str
    path: frozenset[str]


@dataclass
class _Reader:
    blocks: list[Block] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=lambda: [_Open("", frozenset())])
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    anchors: int = 0

    def say(self, text: str) -> None:
        self.parts.append(text)
        if self.anchors:
            self.linked += len(text)

    def flush(self) -> None:
        if self.parts:
            raw = "".join(self.parts)
            text = " ".join((unescape(raw) if "&" in raw else raw).split())
            if text:
                top = self.stack[-1]
                self.blocks.append(Block(text, top.path, top.name, min(1.0, self.linked / len(raw))))
            self.parts = []
        self.linked = self.anchors = 0

    def open(self, name: str, attributes: str) -> None:
        self.flush()
        ends = SIBLINGS.get(name)
        if self.stack[-1].name == "p":
            self.stack.pop()
        if ends:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].name in ends:
                    del self.stack[i:]
                    if name != "tr":
                        break
                elif self.stack[i].name in SCOPES:
                    break
        above = self.stack[-1].path
        self.stack.append(_Open(name, above | {name, *attribute_words(attributes)} if attributes else above | {name}))

    def close(self, name: str) -> None:
        self.flush()
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].name == name:
                del self.stack[i:]
                return


def attribute_words(attributes: str) -> set[str]:
    words = set()
    for name, value, hidden in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            words |= {"." + w.lower() for w in _PART.findall(value)}
        elif name == "role":
            words.add("role=" + value.lower())
        elif hidden or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display:\s*none", value):
            words.add("=hidden")
    return words


def read_blocks(html: str | None) -> list[Block]:
    """Leaf blocks of a page in order; scripts, styles, comments and the title are no text.

    A tag that the page's end cuts off, and an unseen element that is never
    closed, end the text, but an svg element that is never closed does not.  A
    tag that has no end because of its quotes ends at the next ``>``.
    """
    if not html:
        return []
    reader, at, lowered, unclosed = _Reader(), 0, None, False
    while True:
        start = html.find("<", at)
        if start < 0:
            reader.say(html[at:])
            break
        if start > at:
            reader.say(html[at:start])
        following = html[start + 1 : start + 2]
        is_tag = following.isascii() and (following.isalpha() or following == "/" and html[start + 2 : start + 3].isalpha())
        if not is_tag:
            other = _OTHER.match(html, start)
            if other is None:
                reader.say("<")
                at = start + 1
            else:
                at = other.end()
            continue
        tag = _TAG.match(html, start) or _TO_NEXT.match(html, start)
        if tag is None:
            break
        at = tag.end()
        closing, name, attributes = tag.group(1), tag.group(2).lower(), tag.group(3)
        if name in INLINE:
            if name == "a":
                reader.anchors = 0 if closing else 1
        elif name == "br":
            reader.say(" ")
        elif name == "hr":
            reader.flush()
        elif name in VOID:
            continue
        elif name in UNSEEN:
            if closing or attributes.endswith("/") or name == "svg" and unclosed:
                continue
            if lowered is None:
                lowered = html.lower() if len(html.lower()) == len(html) else _ascii_lower(html)
            end = lowered.find(f"</{name}", at)
            if end < 0 and name == "svg":
                unclosed = True
                continue
            if end < 0:
                break
            end = html.find(">", end)
            if end < 0:
                break
            at = end + 1
        elif closing:
            reader.close(name)
        else:
            reader.open(name, attributes)
    reader.flush()
    return reader.blocks


def _ascii_lower(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)
