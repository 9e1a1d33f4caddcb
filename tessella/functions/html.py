"""A reader of HTML as it comes: tags, texts and attributes in page order, whatever is broken.

It takes time in proportion to the text: a search for an end that isn't there is not made again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

# Fixed values of the HTML standard.
RAW = frozenset("script style noscript iframe noembed noframes textarea title".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(\s*=\s*)?")
_BARE = re.compile(r"[^\s>]*")
_RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in RAW}


def attributes(html: str, at: int, missing: set[str]) -> tuple[dict[str, str], int]:
    """Attributes of the tag whose name ends at ``at``, the first of each name, and the place after its ">": -1 if it never ends.

    ``missing`` holds the quotes that don't occur any more.
    """
    out, n = {}, len(html)
    while at < n:
        if html[at] == ">":
            return out, at + 1
        m = _ATTRIBUTE.match(html, at)
        if not m:
            at += 1
            continue
        at, value = m.end(), ""
        if m.group(2):
            quote = html[at : at + 1]
            quoted = quote in ('"', "'") and quote not in missing
            end = html.find(quote, at + 1) if quoted else -1
            if end >= 0:
                value, at = html[at + 1 : end], end + 1
            else:
                if quoted:
                    missing.add(quote)
                b = _BARE.match(html, at)
                value, at = b.group(), b.end()
        out.setdefault(m.group(1).lower(), unescape(value) if "&" in value else value)
    return out, -1


def events(html: str) -> Iterator[tuple[str, str, dict[str, str] | None]]:
    """("start", element, attributes), ("end", element, None), ("text", text with references decoded, None) and, for the
    content of scripts and the like, ("raw", text as it stands, None) after their start. Elements are in lower case."""
    missing: set[str] = set()
    at, n = 0, len(html)
    while at < n:
        mark = html.find("<", at)
        if mark != at:
            text = html[at:mark] if mark > at else html[at:]
            yield "text", unescape(text) if "&" in text else text, None
            if mark < 0:
                return
        after = html[mark + 1 : mark + 2]
        if after.isascii() and after.isalpha():
            m = _NAME.match(html, mark + 1)
            name = m.group().lower()
            values, at = attributes(html, m.end(), missing)
            if at < 0:
                return
            yield "start", name, values
            if name in RAW:
                m = _RAW_END[name].search(html, at)
                yield "raw", html[at : m.start()] if m else html[at:], None
                at = html.find(">", m.end()) + 1 if m else 0
                yield "end", name, None
                if not at:
                    return
        elif html.startswith("!--", mark + 1):
            at = html.find("-->", mark + 2) + 3
            if at < 3:
                return
        elif after == "/" and (m := _NAME.match(html, mark + 2)):
            at = html.find(">", m.end()) + 1
            if not at:
                return
            yield "end", m.group().lower(), None
        elif after and after in "!?/":
            at = html.find(">", mark + 1) + 1
            if not at:
                return
        else:
            yield "text", "<", None
            at = mark + 1


def references(html: str) -> list[tuple[str, str, str, str]]:
    """(kind, target, text, title) of a page's links, in the order in which they end, then of its images (text: the alternative one).

    A link in a link ends first; links that don't end don't count. Targets are as they stand.
    """
    opened: list[tuple[str, list[str]]] = []
    links, images = [], []
    for kind, name, values in events(html):
        if kind == "start" and name == "a" and values.get("href"):
            opened.append((values["href"], []))
        elif kind == "start" and name == "img" and values.get("src"):
            images.append(("image", values["src"], values.get("alt", "").strip(), values.get("title", "").strip()))
        elif kind == "end" and name == "a" and opened:
            href, parts = opened.pop()
            links.append(("link", href, " ".join(parts).strip(), ""))
        elif kind in ("text", "raw") and opened and name.strip():
            opened[-1][1].append(name.strip())
    return links + images
