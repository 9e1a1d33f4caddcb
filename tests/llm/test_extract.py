import random

import pytest
from tessella.llm import extract
from tessella.llm.dom import Node, matched, merge, read, shape

SCHEMA = "page_id bigint, url string, html string, host string, text string, wrapper string"


def page(i, body, head="Site"):
    return f"<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var a='<p>no</p>';</script></head><body>{body}</body></html>"


def sites():
    """(url, html, main text) of pages with four templates, broken markup and constant lines."""
    r = random.Random(3)
    say = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))
    out = []
    for i in range(30):  # an article with a constant line, a header of its own, comments, a sidebar
        title, paras = say(4), [say(r.randint(3, 20)) for _ in range(r.randint(1, 5))]
        body = (
            f"<header><h1>The Site</h1></header><nav><ul>{''.join(f'<li><a href=/x>{say(1)}</a>' for _ in range(r.randint(2, 5)))}</ul></nav><div class='cookie-notice'>We {say(1)}</div>"
            f"<main><article><header><h1>{title}</h1></header>{''.join(f'<p>{p}' for p in paras)}<div class=body><div>Follow this site for more</div></div></article>"
            f"<section id=comments><article class='comment'><p>{say(5)}</p></article></section></main><aside>{say(4)}</aside><form><label>Mail</label><input></form><footer>&copy; {say(2)}</footer>"
        )
        out.append((f"https://a.example/{i}", page(i, body), "\n".join([title, *paras])))
    for i in range(20):  # no article element: the branch with the most text
        paras = [say(r.randint(10, 30)) for _ in range(r.randint(2, 5))]
        body = f"<div id='top-menu'><a href=/>{say(1)}</a> <a href=/b>{say(1)}</a></div><div id=wrap><div id=left><ul><li><a href=/>{say(2)}</a></li></ul></div><div id=text>{''.join(f'<p>{p}</p>' for p in paras)}</div></div><div class=footer>{say(3)}</div>"
        out.append((f"http://b.example:8080/{i}", page(i, body), "\n".join(paras)))
    for i in range(3):  # too few pages for constants
        out.append((f"http://c.example/{i}", page(i, f"<article><h1>Same</h1><p>One <b>bold</b> &amp; <i>two</i>&nbsp;x<br>y</p><p>{i}</p></article>"), f"Same\nOne bold & two x y\n{i}"))
    out += [
        (None, None, ""), ("", "", ""), ("nonsense", "just text &lt; 5", "just text < 5"), ("http://d.example/1", "<article>" + "<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>a<p>b</article>", "deep\na\nb"),
        ("http://d.example/2", "<article><p title=\"never closed>found", "found"), ("http://d.example/3", "<article><b><p>x</b> y</p><!-- c --><ul><li>1<li>2</ul><table><tr><td>3<td>4</table></article><script>x", "x y\n1\n2\n3\n4"),
        ("http://d.example/4", "<article></article><div>no article</div>", ""), ("http://d.example/4", "<article>" + "<p>w</p>" * 20_000 + "</article>", "\n".join("w" * 20_000)),
    ]
    return out


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u, h, "x", "y", "z") for i, (u, h, _) in enumerate(sites())]
    return spark.createDataFrame([*rows, rows[0]], SCHEMA).repartition(7)


def texts(df):
    return sorted((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in df.collect())


def test_main_text(spark, pages):
    want = [(i, u, t, len(t)) for i, (u, _, t) in enumerate(sites())]
    key = lambda r: (r[0], r[1] or "")
    assert sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in extract.extracted(pages).collect()), key=key) == sorted([*want, want[0]], key=key)


def test_both_ways_to_meet_wrappers(spark, pages):
    some = pages.where("url IS NOT NULL")
    assert texts(extract.extracted(some)) == texts(extract.extracted(some, shipped_bytes=0))


def test_wrappers_do_not_depend_on_partitions(spark, pages):
    one, many = (sorted(map(tuple, extract.wrappers(pages.repartition(n)).collect())) for n in (1, 13))
    assert one == many and len(one) == 5


def test_empty(spark):
    assert extract.extracted(spark.createDataFrame([], SCHEMA)).collect() == []
    assert extract.extracted(spark.createDataFrame([], SCHEMA), shipped_bytes=-1).collect() == []


def tree(text):
    """A tree of a(b c(d))."""
    root = Node("root")
    stack = [root]
    for part in text.replace("(", " ( ").replace(")", " ) ").split():
        if part == "(":
            stack.append(stack[-1].kids[-1])
        elif part == ")":
            stack.pop()
        else:
            stack[-1].kids.append(Node(part))
    return root.kids[0]


def plain(a, b):
    """Simple tree matching straight from its recurrence."""
    if a.key != b.key:
        return 0

    def rows(i, j):
        if i == len(a.kids) or j == len(b.kids):
            return 0
        return max(rows(i + 1, j), rows(i, j + 1), plain(a.kids[i], b.kids[j]) + rows(i + 1, j + 1))

    return 1 + rows(0, 0)


def test_simple_tree_matching():
    r = random.Random(5)

    def random_tree(depth=0):
        kids = [random_tree(depth + 1) for _ in range(r.randint(0, 3))] if depth < 3 else []
        return r.choice("ab") + (f"({' '.join(kids)})" if kids else "")

    for _ in range(300):
        a, b = tree("r(" + random_tree() + ")"), tree("r(" + random_tree() + " a b)")
        got, want = matched(a, b, {}), plain(a, b)
        same = [x.key for x in a.kids] == [x.key for x in b.kids]
        assert got == want or same or got <= want  # rows of equal keys are paired in place
        if all(len(x.kids) != len(y.kids) for x, y in zip(a.nodes(), b.nodes())):
            assert got == want
        n = len(list(a.nodes())) + len(list(b.nodes()))
        merge(a, b, {})
        assert len(list(a.nodes())) == n - got


def test_shapes_fold_repeats():
    assert shape(read("<ul><li>a<li>b<li>c</ul><h2>x</h2><p>y<p>z<h2>v</h2><p>w")[0]).signature() == "root(ul(li(#)) h2(#) p(#))"


def test_reading_takes_linear_time():
    import time

    for text in ("<", "<p", '<p a="', "<!--", "</", "<b>", "<p><b>", "<a b='", "&amp", "<td>", "<li><div>", "<h1>"):
        began = time.time()
        read(text * 20_000)
        assert time.time() - began < 3, text
