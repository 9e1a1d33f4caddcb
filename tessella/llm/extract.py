"""Main text of web pages by wrapper induction.

Pages of a host share a template. Every page becomes a tree of blocks whose repeated siblings are folded; the trees of a
host's pages are aligned by simple tree matching and merged into the host's wrapper, whose nodes know on how many pages
they stand, the smallest and largest digest of their texts, and how much of these are links. A run of text that is the same
on every page is template, varying runs are slots. Slots count as content where the wrapper's article lies, or, on hosts
without one, in the branch that holds most of the varying text that isn't links; menus, headers, footers, asides, forms,
notices, adverts and comments are known by element, class, id and role, and drop out.

Hosts differ in size by any factor, so a task folds its pages by host and shape, the folds are dealt by host and a
digest of the shape, merged as a stream in a fixed order, and the SALTS wrappers of a host are merged the same way: the
result depends on the pages alone, and no task holds more than a wrapper. Wrappers are shipped to the workers while they
take WRAPPER_BYTES at most, and meet their pages in a shuffle by host and page beyond.

Blocks are what block elements, list items and table cells delimit; a line break is white space. White space is what
``str.split`` takes for it. Character references are decoded as HTML 5 says.

Nulls and edges: a null html is an empty page, its text is empty. A null or broken URL belongs to the host "". Repeated
pages count once each. A host of fewer than SUPPORT pages, or of pages that are all alike, has no constant nodes: what is
constant there may be content. A main heading within an article is content even if it is constant. A page without the
host's article is judged alone. Tables without rows give no rows; further columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch, parked, sliced
from .dom import Node, aligned, final, merge, read, shape

#: Pages of a host that a constant run must stand on; parts that a host's shapes are dealt to; bytes of wrappers that are shipped.
SUPPORT, SALTS, WRAPPER_BYTES = 8, 32, 32 << 20
#: Shapes that a task remembers.
SHAPES = 20_000

# Elements and words of class, id and role that mark what isn't main text.
NEVER = set("nav footer aside form button select option optgroup datalist dialog template svg math canvas audio video object search".split())
ASIDE = set(
    "ad ads adsense advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline-share comment comments commentlist complementary consent contentinfo cookie cookies dialog disclaimer "
    "discussion disqus footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promos promotion recommended "
    "related replies reply respond search share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription toast toolbar topbar tracking widget widgets".split()
)
#: Words that keep an article from being the main one.
NOT_MAIN = set("ad ads advert advertisement comment comments commentlist disqus promo recommended related replies reply respond sidebar sponsored".split())
BODY = set("main articlebody".split())
NAMED = set("article entry post story content".split())
PROSE = set("# p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure li".split())


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _out(node: Node, article: bool) -> bool:
    """Whether a node and all in it aren't main text, within an article or outside."""
    name, *marks = node.key.split(".")
    if name in NEVER or "!" in marks:
        return True
    if name == "article":
        return not NOT_MAIN.isdisjoint(marks)
    return not ASIDE.isdisjoint(marks) or not article and (name == "header" or "header" in marks)


def _articles(node: Node, out: list[Node], wanted) -> list[Node]:
    """The topmost nodes that ``wanted`` takes and that hold text, outside of what can't be main."""
    name, *marks = node.key.split(".")
    if name in ("nav", "footer", "aside") or "!" in marks or not NOT_MAIN.isdisjoint(marks):
        return out
    if wanted(name, marks) and any(x.chars for x in node.nodes()):
        out.append(node)
        return out
    for kid in node.kids:
        _articles(kid, out, wanted)
    return out


def _weight(node: Node) -> int:
    """Characters of main text outside links in a node."""
    if _out(node, False):
        return 0
    return max(0, node.chars - 2 * node.links) if node.key == "#" else sum(map(_weight, node.kids))


def regions(root: Node) -> tuple[list[Node], bool]:
    """(nodes that hold the main text, whether their elements say so)."""
    for wanted in (
        lambda name, marks: name == "article",
        lambda name, marks: name == "main" or not BODY.isdisjoint(marks),
        lambda name, marks: name in ("div", "section", "td") and not NAMED.isdisjoint(marks),
    ):
        if found := _articles(root, [], wanted):
            return found, True
    node = root
    while inner := [k for k in node.kids if k.key.split(".")[0] not in PROSE and 10 * _weight(k) >= 7 * max(1, _weight(node))]:
        node = inner[0]
    return [node], False


def _slots(node: Node, named: bool, heading: bool, out: list[tuple[Node, bool]]) -> list[tuple[Node, bool]]:
    """(run of text, whether it is in a main heading) of a region."""
    for kid in node.kids:
        if kid.key == "#":
            if named or 2 * kid.links <= kid.chars:
                out.append((kid, heading))
        elif not _out(kid, named):
            _slots(kid, named, heading or kid.key.split(".")[0] == "h1", out)
    return out


def decide(root: Node, support: int = SUPPORT) -> Node:
    """Mark the content of a wrapper, or of a page: slots of its regions that aren't constant."""
    found, named = regions(root)
    slots = [s for node in found for s in _slots(node, named, False, [])]
    varied = any(x.low != x.high and x.pages >= support for x, _ in slots)
    for leaf, heading in slots:
        constant = varied and leaf.low == leaf.high and leaf.pages >= support and 2 * leaf.pages >= root.pages
        leaf.keep = not constant or named and heading
    for node in found:
        node.keep = node.keep or node.key != "#"
    return root


def _folded(batches) -> Iterator[pa.RecordBatch]:
    """Folds of the pages of a task, by host and shape."""
    held: dict[tuple[str, str], Node] = {}

    def given():
        rows = [(h, sig, xxhash.xxh64_intdigest(sig) % SALTS, node.pages, node.dump()) for (h, sig), node in held.items()]
        held.clear()
        columns = list(zip(*rows)) or [[]] * 5
        kinds = pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string()
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["host", "signature", "salt", "pages", "wrapper"])

    for batch in batches:
        for part in sliced(batch):
            for h, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                tree = shape(read(html or "")[0])
                sig = tree.signature()
                if (h, sig) in held:
                    merge(held[h, sig], tree, {})
                else:
                    held[h, sig] = tree
            if len(held) > SHAPES:
                yield given()
    yield given()


def _merged(keys: list[str]):
    """Merge wrappers that arrive in the order of ``keys``: one row a value of them."""

    def run(batches):
        key, root, n = None, None, 0
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                here = tuple(row[k] for k in keys)
                if here != key:
                    if root is not None:
                        yield given(key, root)
                    key, root = here, Node.load(row["wrapper"])
                else:
                    merge(root, Node.load(row["wrapper"]), {})
        if root is not None:
            yield given(key, root)

    def given(key, root):
        values = dict(zip(keys, key))
        return pa.RecordBatch.from_arrays([pa.array([values["host"]], pa.string()), pa.array([values.get("salt", 0)], pa.int32()), pa.array([root.dump()], pa.string())], ["host", "salt", "wrapper"])

    return run


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) of every host: its pages' trees merged into one. Shapes are merged in the order of their digests."""
    folds = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(_folded, "host string, signature string, salt int, pages long, wrapper string")
    dealt = folds.repartition("host", "salt").sortWithinPartitions("host", "salt", F.xxhash64("signature"), "signature", "wrapper").select("host", "salt", "wrapper")
    some = dealt.mapInArrow(_merged(["host", "salt"]), "host string, salt int, wrapper string")
    whole = some.repartition("host").sortWithinPartitions("host", "salt").mapInArrow(_merged(["host"]), "host string, salt int, wrapper string")
    return whole.select("host", "wrapper")


def _verdicts(a: Node, b: Node, memo: dict, out: dict[int, bool]) -> dict[int, bool]:
    """What the wrapper ``b`` says of the nodes of a page's shape that are aligned with its own, by their identity."""
    out[id(a)] = b.keep
    for i, j, _ in aligned(a.kids, b.kids, memo):
        _verdicts(a.kids[i], b.kids[j], memo, out)
    return out


class Extractor:
    """Main texts of pages of one host. Decisions are remembered by shape."""

    def __init__(self, wrapper: str | None):
        self.wrapper = decide(Node.load(wrapper)) if wrapper else None
        self.known: dict[str, list[bool | None]] = {}

    def _said(self, tree: Node, sig: str) -> list[bool | None]:
        """What the wrapper says of each of a shape's nodes; None where it says nothing."""
        if sig not in self.known:
            if len(self.known) >= SHAPES:
                self.known.clear()
            said = _verdicts(tree, self.wrapper, {}, {})
            self.known[sig] = [said.get(id(x)) for x in tree.nodes()]
        return self.known[sig]

    def text(self, html: str | None) -> str:
        root, leaves = read(html or "")
        tree = shape(root)
        said = self._said(tree, tree.signature()) if self.wrapper is not None else [None]
        nodes = list(tree.nodes())
        if not any(said):
            decide(tree)  # nothing of the host's main text is here
        else:
            if None in said:
                decide(tree)
            for node, keep in zip(nodes, said):
                node.keep = node.keep if keep is None else keep
        return "\n".join(leaf.text for leaf in leaves if final(leaf).keep)


def _texts(part: pa.RecordBatch, extractor) -> pa.RecordBatch:
    page, url, h, html = (part.column(i) for i in range(4))
    texts = [extractor(a).text(b) for a, b in zip(h.to_pylist(), html.to_pylist())]
    return pa.RecordBatch.from_arrays([page, url, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame, shipped_bytes: int = WRAPPER_BYTES) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    made = parked(wrappers(pages), "wrappers")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host(F.col("url")).alias("host"), "html")
    schema = "page_id long, url string, text string, n_chars long"
    if (made.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0) <= shipped_bytes:
        shipped = {r["host"]: r["wrapper"] for r in made.collect()}

        def here(batch):
            return _texts(batch, extractor)

        ready: dict[str, Extractor] = {}

        def extractor(h):
            if h not in ready:
                ready[h] = Extractor(shipped.get(h))
            return ready[h]

        return by_batch(rows, here, schema)

    # Wrappers come before the pages of their host and part.
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)).cast("int")).withColumn("wrapper", F.lit(None).cast("string"))
    heads = made.select(F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), "host", F.lit(None).cast("string").alias("html"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "wrapper")
    stream = heads.unionByName(dealt).repartition("host", "salt").sortWithinPartitions("host", "salt", F.col("wrapper").asc_nulls_last())

    def met(batches):
        key, one = None, None
        for batch in batches:
            for part in sliced(batch):
                heads = part.column("wrapper")
                at, keys = 0, list(zip(part.column("host").to_pylist(), part.column("salt").to_pylist()))
                for k in range(part.num_rows + 1):
                    if k < part.num_rows and not heads[k].is_valid and keys[k] == key:
                        continue
                    if k > at:
                        yield _texts(part.slice(at, k - at), lambda h: one)  # noqa: B023
                    if k < part.num_rows:
                        key, one = keys[k], Extractor(heads[k].as_py())
                        at = k + 1 if heads[k].is_valid else k

    return stream.select("page_id", "url", "host", "html", "salt", "wrapper").mapInArrow(met, schema)
