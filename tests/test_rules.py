import html.parser

import pytest
from pyspark.sql import functions as F
from tessella.functions.html import references
from tessella.operators import contract, graph, mdx, records, stats


def test_json_is_read_to_its_end(spark):
    texts = ["{}", '{"a": 1} x', "1] 2", "{}, {}", '{"a": [1, 2', "[1, 7919]", "7919", '"x"', "", None, " null "]
    got = [r.v for r in spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", F.to_json(contract.parsed(F.col("x"))).alias("v")).orderBy("i").collect()]
    assert got == ["{}", None, None, None, None, "[1,7919]", "7919", '"x"', None, None, "null"]


def test_objects_of_any_depth(spark):
    deep = '{"a": ' * 40 + '{"k": "}{"}' + "}" * 40
    rows = [(1, f"```json\n{deep}\n```"), (2, "no object"), (3, "[1]"), (4, "{broken"), (5, None), (6, 'x {"a": 1} y {"b": 2}')]
    got = {r.i: r.v for r in spark.createDataFrame(rows, "i int, x string").select("i", contract.object_in(F.col("x")).isNotNull().alias("v")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}


def test_nodes_that_stand_twice_are_an_error(spark):
    nodes, edges = spark.range(5).withColumnRenamed("id", "n"), spark.createDataFrame([(0, 1), (1, 9), (None, 2)], "source_id bigint, target_id bigint")
    n, e = graph.ingested(nodes, edges, "n")
    assert n.count() == 5 and [tuple(r) for r in e.collect()] == [(0, 1)]
    with pytest.raises(Exception, match="a node stands twice: 3"):
        graph.ingested(nodes.union(spark.createDataFrame([(3,)], "n bigint")), edges, "n")[0].collect()


class Plain(html.parser.HTMLParser):
    """The same with the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.links, self.images, self.open = [], [], []

    def handle_starttag(self, tag, attrs):
        values = {}
        for k, v in attrs:
            values.setdefault(k, v or "")
        if tag == "a" and values.get("href"):
            self.open.append((values["href"], []))
        if tag == "img" and values.get("src"):
            self.images.append(("image", values["src"], values.get("alt", "").strip(), values.get("title", "").strip()))

    def handle_endtag(self, tag):
        if tag == "a" and self.open:
            href, parts = self.open.pop()
            self.links.append(("link", href, " ".join(parts).strip(), ""))

    def handle_data(self, data):
        if self.open and data.strip():
            self.open[-1][1].append(data.strip())


def test_references_of_broken_markup():
    pages = [
        "<a href=x>one</a>", '<a href="a&amp;b" title=\'t\'>one <b>two</b> three</a><img src="i.png" alt=" An alt "><IMG SRC=j.gif>', "<a href='1'>outer <a href='2'>inner</a> rest</a>", "<a>no target</a><a href=>none</a>", "<a href=x>open",
        "text </a> <a href='y'>z</a>", "<!-- <a href='no'>no</a> --><a href='yes'>yes</a>", "<script>'<a href=no>no</a>'</script><a href='q'>r</a>", "<a\nhref = 'sp'\n>s</a>", "<p <a href='u'>v</a>", "", "<", "a < b <a href='w'>x &lt; y</a>",
    ]
    for page in pages:
        plain = Plain()
        plain.feed(page)
        plain.close()
        assert references(page) == plain.links + plain.images, page
    assert references("<a href='unclosed>x</a>") == [("link", "'unclosed", "x", "")]  # a quote that never ends is none


def test_units_of_a_page():
    text = "# Top\nintro ![A b](u.png 'T') x\n## Sec\n<img alt='Bee' src='v.gif'>\ntail ![](u.png)\n"
    rows = records.page_units(7, "p", "Title", text, ["Title\n7\n# Top\nintro ![A b](u.png 'T') x", "Title\n7\n## Sec\n<img alt='Bee' src='v.gif'>\ntail ![](u.png)"])
    assert [(r[3], r[5], r[6], r[8], r[9], r[10]) for r in rows] == [
        ("text_chunk", 0, 1, "Top", 1, 0), ("image_occurrence", 12, 2, "Top", 1, 1), ("text_chunk", 32, 3, "Sec", 2, 2), ("image_occurrence", 39, 4, "Sec", 2, 3), ("image_occurrence", 72, 5, "Sec", 2, 4),
    ]
    assert [r[12] for r in rows] == [None, "7::c0000", None, "7::c0001", "7::c0000"]
    assert [r[11] for r in rows] == [*(r[2] for r in rows[1:]), None]
    assert records.page_units(8, "p", "T", "", []) == []


def test_links_of_a_repository(spark):
    pages = spark.createDataFrame([("/docs/a/b", "[x](../c) [y](c#F%20G) [y](/docs/c) <Link to='https://D.org/docs/a/c/'/>\n## H\n[y](c)"), ("/docs/c", None), ("/docs/a/c", "[self](/docs/a/c)")], "route string, body string")
    got = {(r.source, r.target, r.anchor, r.section, r.target_anchor, r.place) for r in mdx.edges(pages, ["d.org"]).collect()}
    assert got == {("/docs/a/b", "/docs/c", "x", "", "", 1), ("/docs/a/b", "/docs/a/c", "y", "", "f g", 2), ("/docs/a/b", "/docs/c", "y", "", "", 3), ("/docs/a/b", "/docs/a/c", "", "", "", 4), ("/docs/a/b", "/docs/a/c", "y", "H", "", 5)}


def test_passages(spark):
    rows = [(1, "\n".join(["# A", *(f"line {i}" for i in range(30)), "## B", "the word word", "after"]), ["word"]), (2, None, ["x"]), (3, "a\nb", [])]
    got = {r.i: (r.start, r.end, r.section) for r in stats.passages(spark.createDataFrame(rows, "i int, text string, terms array<string>")).collect()}
    assert got == {1: (17, 34, "B"), 2: (1, 1, ""), 3: (1, 2, "")}
