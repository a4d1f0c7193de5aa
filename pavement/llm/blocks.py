"""Leaf blocks of a page: runs of text between block-level tags, with the path of tags above them.

Tags are found in one pass; unclosed, misnested and cut-off markup is taken as
browsers take it where that matters for blocks (a paragraph ends where the next
block begins, an end tag closes what is open inside it, a cut-off tag is dropped).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|<\Z", re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")
#: Elements whose content is no text of the page: scripts, styles, form controls, and a frame's stand-in.
RAW = frozenset("script style title textarea select iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q ruby s samp small span "
    "strike strong sub sup time tt u var wbr br "
    "math semantics annotation mrow mi mn mo ms mtext mspace mstyle mfrac msqrt mroot msub msup msubsup munder mover munderover "
    "svg g path rect circle ellipse line polyline polygon text tspan defs use".split())
#: What an opening tag of a kind closes if it is the innermost open element.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
          "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}


@dataclass
class Block:
    path: tuple[str, ...]   # tags and the words of their class, id and role, outermost first
    text: str               # decoded, white space as single spaces
    linked: int             # characters that stand in links


def blocks(html: str | None) -> list[Block]:
    """The non-empty leaf blocks of a page in page order; none for null or empty."""
    if not html:
        return []
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    links = linked = 0
    hidden = 0  # open elements of the page's head

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text and not hidden:
                out.append(Block(tuple(x for _, names in stack for x in names), text, min(linked, len(text))))
        parts, linked = [], 0

    def close(tag: str) -> None:
        nonlocal hidden
        for at in range(len(stack) - 1, -1, -1):
            if stack[at][0] == tag:
                hidden -= sum(t == "head" for t, _ in stack[at:])
                del stack[at:]
                return

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        if m is None:
            parts.append(html[at:])
            break
        if m.start() > at:
            parts.append(html[at:m.start()])
            if links:
                linked += m.start() - at
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, more = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in RAW:
            if not closing and not more.endswith("/"):
                found = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
                at = found.end() if found else end
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                links = 0 if closing else 1
            continue
        flush()
        links = 0
        if closing:
            close(tag)
        elif tag not in VOID:
            if stack and (stack[-1][0] in CLOSES.get(tag, ()) or stack[-1][0] == "p"):
                stack.pop()
                while stack and stack[-1][0] in CLOSES.get(tag, ()):
                    stack.pop()
            if tag == "body":
                close("head")
            names = [tag]
            for found in _NAMED.finditer(more):
                names += _PART.findall((found[1] or found[2] or found[3] or "").lower())
            stack.append((tag, tuple(names)))
            hidden += tag == "head"
    flush()
    return out
