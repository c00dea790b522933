"""Leaf blocks of a page: runs of text between block-level tags, each with its tag path."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

# Elements that do not break a block, that hold no text of the page, that have no end.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span"
    " strike strong sub sup time tt u var wbr".split()
)
# Elements without text of the page. Only of the first four does an open one reach to the end of the page.
RAW = frozenset("script style title textarea template iframe xmp".split())
TO_THE_END = frozenset("script style title textarea".split())
# Formulas and drawings stand in a line of text, with all that is in them.
IN_LINE = frozenset("math svg".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article aside body div fieldset footer form header html li main nav section table td th tr ul ol dl".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",)}

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[|\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""",
    re.S,
)
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
PARTS = re.compile(r"[a-zA-Z]+")


@dataclass(slots=True)
class Leaf:
    text: str
    path: tuple[str, ...]
    linked: int


def names_of(attributes: str) -> str:
    """Class, id and role words as ``.word`` marks after the tag name."""
    found = [p.lower() for m in NAMES.finditer(attributes) for p in PARTS.findall(m[1] or m[2] or m[3] or "")]
    if HIDDEN.search(attributes):
        found.append("hidden")
    return "".join(f".{name}" for name in dict.fromkeys(found))


def leaves(html: str | None) -> list[Leaf]:
    """Blocks with text, in page order. References are decoded, white space inside becomes one space, ends are trimmed."""
    found: list[Leaf] = []
    stack: list[str] = []
    marks: list[str] = []
    held: list[str] = []
    path: tuple[str, ...] = ()
    linked = 0

    def say(raw: str) -> None:
        nonlocal path, linked
        text = unescape(raw) if "&" in raw else raw
        if not held:
            path = tuple(marks)
        held.append(text)
        if "a" in stack:
            linked += len(text)

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                found.append(Leaf(text, path, linked))
            held.clear()
        linked = 0

    html = html or ""
    at = 0
    while match := TAG.search(html, at):
        if match.start() > at:
            say(html[at: match.start()])
        at = match.end()
        tag = (match[2] or match[5] or "").lower()
        if not tag:
            continue
        attributes = match[3] if match[2] else match[6]
        inline = tag in INLINE or tag in IN_LINE or not IN_LINE.isdisjoint(stack)
        if match[1] or match[4]:
            if not inline:
                flush()
            if tag in stack:
                while stack.pop() != tag:
                    marks.pop()
                marks.pop()
            continue
        if tag in RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
            if end or tag in TO_THE_END:
                at = end.end() if end else len(html)
                continue
        if tag in CONTAINERS or tag in ("p", "h1", "h2", "h3"):
            # An open formula or drawing ends where a part of the page begins.
            while stack and not IN_LINE.isdisjoint(stack):
                stack.pop()
                marks.pop()
            inline = False
        if not inline:
            flush()
        if tag in CLOSES:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth] in CLOSES[tag]:
                    del stack[depth:], marks[depth:]
                    break
                if stack[depth] in CONTAINERS:
                    break
        if tag == "br":
            held.append(" ") if held else None
        if tag not in EMPTY and not attributes.endswith("/"):
            stack.append(tag)
            marks.append(tag + names_of(attributes) if attributes else tag)
    if at < len(html):
        say(html[at:])
    flush()
    return found
