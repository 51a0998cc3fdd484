"""Leaf blocks of an HTML page: their text, tag path and markup facts.

One scan over the tags.  Block-level tags end a block, inline tags and ``br`` do
not (``br`` reads as white space).  Comments, scripts, styles and other raw elements hold no
blocks; one that closes itself (``<svg/>``) or has no end tag holds nothing, but an open script or
style goes to the end of the page.  Formulas are inline text.  Unclosed paragraphs and list items are closed by the next one; an end tag
without a start is ignored.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

from .common import SPACE_PATTERN

# HTML element classes.
RAW = frozenset("script style noscript template iframe object svg title textarea select canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s "
                   "samp small span strike strong sub sup time tt u var wbr "
                   "math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup "
                   "msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mtd maction mspace semantics "
                   "annotation annotation-xml".split())
OPEN_RAW = frozenset(("script", "style"))      # without an end tag they go to the end of the page
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
                  r"""|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_HINT = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Za-z]+")
_SPACES = re.compile(SPACE_PATTERN)


class Block(NamedTuple):
    text: str
    path: tuple[str, ...]     # tags and hint words (".word") of the open elements, outermost first
    linked: int               # characters inside links


def blocks(page: str | None) -> list[Block]:
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked, in_link, at = 0, 0, 0
    endless: set[str] = set()                              # raw elements that no end tag follows

    def flush() -> None:
        nonlocal linked
        text = _SPACES.sub(" ", html.unescape("".join(parts))).strip(" ")
        if text:
            out.append(Block(text, tuple(t for _, ts in stack for t in ts), linked))
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    while True:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at: m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue                                       # comment or declaration
        name, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if name in INLINE:
            if name == "a":
                in_link = max(0, in_link + (-1 if closing else 1))
            elif name == "br":
                add(" ")
            continue
        flush()
        in_link = 0
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        elif name in RAW:
            if name == "svg" and attributes.endswith("/"):
                continue
            end = None if name in endless else re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            if end:
                at = end.end()
            else:
                endless.add(name)
                at = len(page) if name in OPEN_RAW else at
        elif name not in VOID:
            if name in SELF_CLOSING and stack and stack[-1][0] == name:
                stack.pop()
            elif stack and stack[-1][0] == "p":             # a block ends an open paragraph
                stack.pop()
            hints = tuple("." + w.lower() for h in _HINT.finditer(attributes)
                          for w in _PARTS.findall(h[1] or h[2] or h[3] or ""))
            stack.append((name, (name, *hints)))
    flush()
    return out
