"""Trees of web pages: a forgiving reader of HTML, shapes of pages, and simple tree matching of shapes.

Everything here takes time in proportion to the text, whatever the markup is like: searches for an end that isn't there are
remembered, and no function calls itself more often than DEPTH times.
"""

from __future__ import annotations

import json
import re
from html import unescape

import xxhash

#: Levels of a tree; blocks that lie deeper belong to their ancestor at that level.
DEPTH = 60

# Fixed values of the HTML standard: element kinds.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript iframe noembed noframes textarea title".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label map mark nobr output picture q rb rp rt ruby s samp small source span strike strong sub sup time tt u var".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
SCOPES = set("table td th caption object template".split())
TRANSPARENT = set("html head body".split())
#: A start tag ends the open elements of the first list, looked for up to an element of the second.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("thead tbody tfoot tr td th", "table"), "thead": ("thead tbody tfoot tr td th", "table"), "tfoot": ("thead tbody tfoot tr td th", "table")}
ENDS = {k: (set(a.split()), set(b.split())) for k, (a, b) in ENDS.items()}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*)?")
_BARE = re.compile(r"[^\s>]*")
_RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in RAW}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[^\s_-]+")


class Node:
    """A node of a page or of a wrapper. A leaf "#" is a run of text; its digests, lengths and links are summed up by host."""

    __slots__ = ("key", "kids", "pages", "low", "high", "chars", "links", "text", "to", "keep")

    def __init__(self, key: str):
        self.key, self.kids, self.pages = key, [], 1
        self.low = self.high = self.chars = self.links = 0
        self.text, self.to, self.keep = None, None, False

    def nodes(self):
        yield self
        for kid in self.kids:
            yield from kid.nodes()

    def signature(self) -> str:
        return self.key if not self.kids else f"{self.key}({' '.join(k.signature() for k in self.kids)})"

    def rows(self) -> list:
        return [self.key, self.pages, self.low, self.high, self.chars, self.links, [k.rows() for k in self.kids]]

    def dump(self) -> str:
        return json.dumps(self.rows(), separators=(",", ":"))

    @classmethod
    def load(cls, rows) -> Node:
        if isinstance(rows, str):
            rows = json.loads(rows)
        node = cls(rows[0])
        node.pages, node.low, node.high, node.chars, node.links = rows[1:6]
        node.kids = [cls.load(r) for r in rows[6]]
        return node


def _key(name: str, attributes: dict[str, str]) -> str:
    """Element, words of class, id and role without those that hold digits, in order; "!" marks what isn't shown."""
    if "hidden" in attributes or _HIDDEN.search(attributes.get("style", "")):
        return name + ".!"
    marks = []
    for part in " ".join(attributes.get(a, "") for a in ("class", "id", "role", "itemprop")).split():
        words = _WORDS.findall(part.lower())
        if words and words[0] not in ("has", "with", "no", "is", "js"):
            marks += [w for w in words if w.isalpha()]
    return ".".join([name, *sorted(set(marks))])


def _attributes(html: str, at: int, missing: set) -> tuple[dict[str, str], int]:
    """Attributes of the tag whose name ends at ``at``, and the place after its ">"; -1 if the tag never ends."""
    out, n = {}, len(html)
    while at < n:
        if html[at] == ">":
            return out, at + 1
        m = _ATTRIBUTE.match(html, at)
        if not m:
            at += 1
            continue
        at, value = m.end(), ""
        if m.end() > m.end(1) and "=" in html[m.end(1) : at]:
            quote = html[at : at + 1]
            end = html.find(quote, at + 1) if quote in ('"', "'") and quote and quote not in missing else -1
            if end >= 0:
                value, at = html[at + 1 : end], end + 1
            else:
                if quote in ('"', "'") and quote:
                    missing.add(quote)  # none further on either
                b = _BARE.match(html, at)
                value, at = b.group(), b.end()
        out.setdefault(m.group(1).lower(), unescape(value) if "&" in value else value)
    return out, -1


def read(html: str) -> tuple[Node, list[Node]]:
    """The tree of a page and its runs of text in page order. Broken markup is mended the way browsers do."""
    root, leaves, missing = Node("root"), [], set()
    stack: list[tuple[str, Node | None]] = [("root", root)]  # inline elements have no node
    opened: dict[str, int] = {}
    inside = [root]  # the nodes of the stack
    run: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(run).split())
        if text:
            leaf = Node("#")
            leaf.text, leaf.chars, leaf.links = text, len(text), min(linked, len(text))
            leaf.low = leaf.high = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
            inside[-1].kids.append(leaf)
            leaves.append(leaf)
        run.clear()
        linked = 0

    def pop(to: int) -> None:
        while len(stack) > to:
            name, node = stack.pop()
            opened[name] -= 1
            if node is not None:
                flush()
                if node is inside[-1]:
                    inside.pop()

    def add(text: str) -> None:
        nonlocal linked
        if "&" in text:
            text = unescape(text)
        run.append(text)
        if opened.get("a"):
            linked += len(text.strip())

    def find(names, until=SCOPES) -> int:
        """Place of the innermost open element of ``names``, 0 if there is none before one of ``until``."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                return k
            if stack[k][0] in until:
                return 0
        return 0

    def end(name: str) -> None:
        if name in HEADINGS:
            names = HEADINGS
        else:
            names = (name,)
        if not any(opened.get(x) for x in names):
            if name == "p":
                flush()
            return
        if name in INLINE:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    if all(node is None for _, node in stack[k:]):
                        pop(k)
                    else:  # it ends, the blocks opened in it go on
                        opened[name] -= 1
                        del stack[k]
                    return
            return
        if k := find(names, SCOPES - {name}):
            pop(k)

    def start(name: str, attributes: dict[str, str]) -> None:
        if name in CLOSES_P and opened.get("p") and (k := find(("p",), SCOPES | {"button"})):
            pop(k)
        if name in HEADINGS and stack[-1][0] in HEADINGS:
            pop(len(stack) - 1)
        if name in ENDS and any(opened.get(x) for x in ENDS[name][0]):
            names, until = ENDS[name]
            while k := find(names, until):
                pop(k)
        if name == "br":
            run.append(" ")
        elif name == "hr":
            flush()
        elif name in VOID or name in TRANSPARENT:
            pass
        elif name in INLINE:
            if name == "a" and opened.get("a"):
                end("a")
            stack.append((name, None))
            opened[name] = opened.get(name, 0) + 1
        else:
            flush()
            node = inside[-1]
            if len(inside) < DEPTH:
                node = Node(_key(name, attributes))
                inside[-1].kids.append(node)
                inside.append(node)
            stack.append((name, node))
            opened[name] = opened.get(name, 0) + 1

    at, n = 0, len(html)
    while at < n:
        mark = html.find("<", at)
        if mark < 0:
            add(html[at:])
            break
        if mark > at:
            add(html[at:mark])
        after = html[mark + 1 : mark + 2]
        if after.isascii() and after.isalpha():
            m = _NAME.match(html, mark + 1)
            name = m.group().lower()
            attributes, at = _attributes(html, m.end(), missing)
            if at < 0:
                break
            if name in RAW:
                m = _RAW_END[name].search(html, at)
                if m is None:
                    break
                at = html.find(">", m.end())
                if at < 0:
                    break
                at += 1
            else:
                start(name, attributes)
        elif html.startswith("!--", mark + 1):
            at = html.find("-->", mark + 2)
            if at < 0:
                break
            at += 3
        elif after == "/" and (m := _NAME.match(html, mark + 2)):
            at = html.find(">", m.end())
            if at < 0:
                break
            at += 1
            end(m.group().lower())
        elif after and after in "!?/":
            at = html.find(">", mark + 1)
            if at < 0:
                break
            at += 1
        else:
            add("<")
            at = mark + 1
    pop(1)
    flush()
    return root, leaves


def matched(a: Node, b: Node, memo: dict) -> int:
    """Simple tree matching: how many nodes of two trees with equal roots can be paired in order, level by level."""
    if a.key != b.key:
        return 0
    found = memo.get((id(a), id(b)))
    if found is None:
        found = memo[id(a), id(b)] = 1 + sum(w for _, _, w in aligned(a.kids, b.kids, memo))
    return found


def aligned(a: list[Node], b: list[Node], memo: dict) -> list[tuple[int, int, int]]:
    """Pairs (i, j, nodes matched) of two rows of siblings, in order, that pair the most nodes. Rows of equal keys are paired in place."""
    if len(a) == len(b) and all(x.key == y.key for x, y in zip(a, b)):
        return [(i, i, matched(x, y, memo)) for i, (x, y) in enumerate(zip(a, b))]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        row, above = best[i + 1], best[i]
        for j, y in enumerate(b):
            w = above[j] + matched(x, y, memo)
            row[j + 1] = max(above[j + 1], row[j], w)
    out, i, j = [], len(a), len(b)
    while i and j:
        w = matched(a[i - 1], b[j - 1], memo)
        if w and best[i][j] == best[i - 1][j - 1] + w:
            out.append((i - 1, j - 1, w))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def merge(a: Node, b: Node, memo: dict, same_page: bool = False) -> None:
    """Take ``b`` into ``a``: paired nodes add up, others are put in where they stand between pairs."""
    b.to = a
    a.pages = max(a.pages, b.pages) if same_page else a.pages + b.pages
    a.low, a.high, a.chars, a.links = min(a.low, b.low), max(a.high, b.high), a.chars + b.chars, a.links + b.links
    if not b.kids:
        return
    pairs = aligned(a.kids, b.kids, memo)
    kids, i, j = [], 0, 0
    for x, y, _ in [*pairs, (len(a.kids), len(b.kids), 0)]:
        kids += a.kids[i:x] + b.kids[j:y]
        if x < len(a.kids):
            merge(a.kids[x], b.kids[y], memo, same_page)
            kids.append(a.kids[x])
        i, j = x + 1, y + 1
    a.kids = kids


def shape(node: Node) -> Node:
    """Fold repeated siblings of a page's tree, in place: runs of one key, and periods of two and three, become one node each."""
    for kid in node.kids:
        shape(kid)
    for period in (1, 2, 3):
        out: list[Node] = []
        for kid in node.kids:
            out.append(kid)
            if len(out) > period and period == 1:
                if out[-2].key == kid.key:
                    merge(out[-2], out.pop(), {}, True)
            elif len(out) >= 2 * period and [x.key for x in out[-2 * period : -period]] == [x.key for x in out[-period:]]:
                again = out[-period:]
                del out[-period:]
                for x, y in zip(out[-period:], again):
                    merge(x, y, {}, True)
        node.kids = out
    return node


def final(node: Node) -> Node:
    while node.to is not None:
        node = node.to
    return node
