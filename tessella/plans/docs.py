"""Queries over documentation repositories that are computed from ``pages``: links between MDX files, links and images of
question pages, front matter. Each engine computes the repository from the table; what is found in it is compared."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mdx, qa, records
from ..storage import built
from .registry import query, table
from .retrieval import PAGES, documents

SITE = r"""pg AS (SELECT lower(regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '(\.html)?/*$', '')) AS p, page_id FROM pages),
base AS (SELECT p, min(page_id) AS i FROM pg WHERE p <> '' GROUP BY p),
near AS (SELECT a.p, a.i, coalesce(b.p, '/none/0') AS n FROM base a LEFT JOIN base b ON b.i = a.i + 1)"""


def bases(spark: SparkSession, d: str) -> DataFrame:
    """(p, i, n): the paths of the pages, the first page of each, and the path of the next page."""
    p = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "[?#].*$", ""), r"(\.html)?/*$", ""))
    base = table(spark, d, "pages").select(p.alias("p"), "page_id").where("p <> ''").groupBy("p").agg(F.min("page_id").alias("i"))
    after = base.select(F.col("p").alias("n"), (F.col("i") - 1).alias("i"))
    return base.join(after, "i", "left").fillna("/none/0", ["n"])


def files(spark: SparkSession, d: str) -> DataFrame:
    """(source_path, declared, body) of a repository: a file for every path, two where one of them is of an old version."""
    n, i = F.col("n"), F.col("i")
    kinds = [F.concat(F.lit(".."), n), F.concat(F.lit("/docs"), n, F.lit("/")), F.concat(F.lit("https://Docs.Example.org/docs"), n, F.lit("?x=1#Part%20A")), F.concat(F.lit("https://elsewhere.org/docs"), n)]
    body = F.concat(
        F.lit("# Page "), i.cast("string"), F.lit("\n\nStart [Next `one`]("), F.element_at(F.array(*kinds), (i % 4 + 1).cast("int")), F.lit(' "t") and [self](#top), [mail](mailto:a@b.c), <Card href="'), n,
        F.lit('" />\nAgain <a href="'), n, F.lit('#Later%20On">it</a>\n\n## Part {x}  two\n[Next one](./../'), F.substring(n, 2, 10_000), F.lit("#Again) or <Link to='../../../../docs"), n, F.lit("'> and [none](/docs/none/at-all)\n"),
    )
    rows = bases(spark, d).select("p", "i", body.alias("body"))
    plain = F.struct(F.concat(F.substring("p", 2, 10_000), F.when(i % 3 == 0, "/index").otherwise(""), F.lit(".mdx")).alias("source_path"), F.lit(None).cast("string").alias("declared"), F.col("body"))
    old = F.struct(F.concat(F.lit("v2"), "p", F.lit(".mdx")).alias("source_path"), F.col("p").alias("declared"), F.lit("[Old](/docs/none)").alias("body"))
    return rows.select(F.explode(F.filter(F.array(plain, F.when(i % 3 == 0, old)), lambda x: x.isNotNull())).alias("f")).select("f.*")


@query(
    "grf02_mdx_links",
    f"""WITH {SITE}, b AS (SELECT p, i, n, '# Page ' || i || chr(10) || chr(10) || 'Start [Next `one`](' || CASE i % 4 WHEN 0 THEN '..' || n WHEN 1 THEN '/docs' || n || '/' WHEN 2 THEN 'https://Docs.Example.org/docs' || n || '?x=1#Part%20A' ELSE 'https://elsewhere.org/docs' || n END
      || ' "t") and [self](#top), [mail](mailto:a@b.c), <Card href="' || n || '" />' || chr(10) || 'Again <a href="' || n || '#Later%20On">it</a>' || chr(10) || chr(10) || '## Part {{x}}  two' || chr(10) || '[Next one](./../' || substr(n, 2) || '#Again) or <Link to=''../../../../docs' || n || '''> and [none](/docs/none/at-all)' || chr(10) AS body FROM near),
    e AS (SELECT *, 'Next one' AS anchor, '' AS section, CASE i % 4 WHEN 2 THEN 'part a' ELSE '' END AS target_anchor, strpos(body, '[Next `') AS pos, 1 AS k FROM b WHERE i % 4 <> 3
      UNION ALL SELECT *, '', '', 'later on', strpos(body, 'href="' || n || '#Later'), 2 FROM b UNION ALL SELECT *, 'Next one', 'Part x two', 'again', strpos(body, '[Next one]'), 3 FROM b UNION ALL SELECT *, '', 'Part x two', '', strpos(body, 'to=''..'), 4 FROM b)
    SELECT '/docs' || p AS source, '/docs' || n AS target, anchor, section, trim(regexp_replace(substr(body, greatest(pos - 160, 1), pos + 240 - greatest(pos - 160, 1)), '\\s+', ' ', 'g')) AS context, target_anchor, row_number() OVER (PARTITION BY p ORDER BY k) AS place FROM e WHERE n <> '/none/0'""",
)
def grf02(spark, d):
    """Links between the files of an MDX repository: relative, absolute, on the site's hosts, in Markdown and in attributes."""
    pages = mdx.one_page_a_route(files(spark, d).withColumn("route", mdx.route(F.col("source_path"), F.col("declared"), "declared")))
    out = mdx.edges(pages, ["docs.example.org"], "/docs/")
    return out.withColumn("place", F.col("place").cast("bigint"))


@query(
    "grf03_route_arbitration",
    f"""WITH {SITE} SELECT '/docs' || p AS route, substr(p, 2) || CASE WHEN i % 3 = 0 THEN '/index' ELSE '' END || '.mdx' AS source_path, CAST(1 + CASE WHEN i % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_files FROM base""",
)
def grf03(spark, d):
    """The file that answers a route, and how many claim it."""
    rows = files(spark, d).withColumn("route", mdx.route(F.col("source_path"), F.col("declared"), "declared"))
    n = rows.groupBy("route").agg(F.count("*").alias("n_files"))
    return mdx.one_page_a_route(rows).select("route", "source_path").join(n, "route")


@query(
    "txt12_front_matter",
    """SELECT doc_id, CASE WHEN bad THEN NULL ELSE 'Doc ' || doc_id || ': it''s ' || lang END AS title, CASE WHEN NOT bad THEN 'src, ' || source END AS second_tag, CASE WHEN NOT bad THEN n_chars END AS size, CASE WHEN NOT bad THEN source END AS part,
    CASE WHEN NOT bad THEN doc_id % 7 END AS rank, CASE WHEN NOT bad THEN doc_id END AS inner_id, CASE WHEN NOT bad THEN 'first ' || lang || chr(10) || '  second' || chr(10) END AS note, CASE WHEN NOT bad THEN doc_id % 2 = 0 END AS draft,
    CASE WHEN NOT bad THEN round(n_chars / 2.0, 1) END AS half, sha256(coalesce(text, '')) AS body FROM (SELECT *, doc_id % 10 = 9 AS bad FROM documents)""",
)
def txt12(spark, d):
    """Front matter made of every document's columns, read again; that of one in ten is broken and counts as empty."""
    i = F.col("doc_id").cast("string")
    front = F.concat(
        F.lit("---\ntitle: 'Doc "), i, F.lit(": it''s "), "lang", F.lit("' # the title\ntags: ["), "lang", F.lit(', "src, '), "source", F.lit('", {k: [~]}]\nmeta:\n  size: '), F.col("n_chars").cast("string"), F.lit("\n  parts:\n    - name: "), "source", F.lit("\n      rank: "),
        (F.col("doc_id") % 7).cast("string"), F.lit("\n    - - x\n      - "), i, F.lit("\n  note: |\n    first "), "lang", F.lit("\n      second\ndraft: "), F.when(F.col("doc_id") % 2 == 0, "yes").otherwise("no"), F.lit("\nhalf: "), F.format_string("%.1f", F.col("n_chars") / 2),
        F.when(F.col("doc_id") % 10 == 9, "\nbroken: [1,").otherwise(""), F.lit("\n---\n"), F.coalesce("text", F.lit("")),
    )
    read = mdx.with_front_matter(table(spark, d, "documents").select("doc_id", front.alias("text")))
    get = lambda path, kind: F.try_variant_get("metadata", path, kind)
    return read.select(
        "doc_id", get("$.title", "string").alias("title"), get("$.tags[1]", "string").alias("second_tag"), get("$.meta.size", "bigint").alias("size"), get("$.meta.parts[0].name", "string").alias("part"), get("$.meta.parts[0].rank", "bigint").alias("rank"),
        get("$.meta.parts[1][1]", "bigint").alias("inner_id"), get("$.meta.note", "string").alias("note"), get("$.draft", "boolean").alias("draft"), get("$.half", "double").alias("half"), F.sha2("body", 256).alias("body"),
    )


@query(
    "txt25_page_references",
    r"""WITH a AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') AS root, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS x, generate_subscripts(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>'), 1) - 1 AS place FROM pages)
    SELECT page_id, CAST(place AS BIGINT) AS place, 'link' AS kind, root || regexp_replace(replace(replace(regexp_extract(x, 'href="([^"]*)"', 1), '&amp;', '&'), '&quot;', '"'), '^/[.]{1,2}$', '/') AS url, replace(replace(trim(regexp_extract(x, '>([^<]*)<', 1)), '&amp;', '&'), '&quot;', '"') AS text FROM a""",
)
def txt25r(spark, d):
    """Every link and image of all pages with its text, targets joined with the page's address."""
    pages = table(spark, d, "pages").select("page_id", "url", "html")
    found = qa.resolved(qa.with_references(pages, "html").select("page_id", F.col("url").alias("base"), "html_references"), "html_references", "base")
    return found.select("page_id", F.col("place").cast("bigint").alias("place"), "kind", "url", "text")


def question_files(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, url, html): pages with structured data behind their own HTML: nested, in lists, after broken data, without an answer."""
    i = F.col("page_id").cast("string")
    asked = F.concat(F.lit('<p>Why <a href="../x?a=1#f">link <b>one</b></a> and <a href=\'/abs/./p\'>two</a> <img src="img/'), i, F.lit('.png" alt=" An alt " title=T> <a name=x>none</a> <a href="unclosed">'))
    said = F.concat(F.lit("<div>See <a href=\"https://o.example/"), i, F.lit('">that</a><br><IMG SRC=//cdn.example/'), i, F.lit(".gif></div>"))
    answer = F.array(F.struct(said.alias("text")))
    question = lambda field: F.struct(F.lit("Question").alias("@type"), F.concat(F.lit("T "), i).alias("name"), asked.alias(field), answer.alias("acceptedAnswer"))
    graph = F.to_json(F.struct(F.array(F.struct(F.lit("WebPage").alias("@type"), F.array(F.struct(F.lit(1).alias("y"))).alias("x"))).alias("before"), F.array(F.struct(F.lit("QAPage").alias("@type"), question("text").alias("mainEntity"))).alias("@graph")))
    single = F.to_json(question("description"))
    silent = F.to_json(F.struct(F.lit("Question").alias("@type"), F.lit("no answer").alias("name"), F.array().cast("array<string>").alias("acceptedAnswer")))
    script = lambda x: F.concat(F.lit("<script async type='application/ld+json'>\n"), x, F.lit("\n</script>"))
    kinds = [script(graph), script(single), F.concat(script(F.lit("{oops")), script(silent), script(graph)), script(silent)]
    return table(spark, d, "pages").select("page_id", "url", F.concat(F.coalesce("html", F.lit("")), F.element_at(F.array(*kinds), (F.col("page_id") % 4 + 1).cast("int"))).alias("html"))


@query(
    "hlp07_question_pages",
    r"""WITH b AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') AS root, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/]*$', '') AS folder FROM pages WHERE page_id % 4 <> 3)
    SELECT page_id, 'T ' || page_id AS title, 'Why link one and two none' AS question_text, 'See that' AS answer_text, k AS place, side, kind,
      CASE k WHEN 0 THEN root || CASE WHEN folder = '/' THEN '/' ELSE regexp_replace(folder, '[^/]*/$', '') END || 'x?a=1#f' WHEN 1 THEN root || '/abs/p' WHEN 2 THEN root || folder || 'img/' || page_id || '.png' WHEN 3 THEN 'https://o.example/' || page_id ELSE scheme || '://cdn.example/' || page_id || '.gif' END AS url, text, t AS image_title
    FROM b, (VALUES (0, 'question', 'link', 'link one', ''), (1, 'question', 'link', 'two', ''), (2, 'question', 'image', 'An alt', 'T'), (3, 'answer', 'link', 'that', ''), (4, 'answer', 'image', '', '')) AS v(k, side, kind, text, t)""",
)
def hlp07(spark, d):
    """Questions and accepted answers of pages with structured data, with the links and images of both."""
    found = qa.question_pages(question_files(spark, d))
    each = found.select("page_id", "title", "question_text", "answer_text", F.posexplode("references").alias("place", "r"))
    return each.select("page_id", "title", "question_text", "answer_text", "place", "r.side", "r.kind", "r.url", "r.text", F.col("r.title").alias("image_title"))


# Documents with a heading, an image, a second heading and another image put into them
ILLUSTRATED = rf"""{PAGES}, t0 AS (SELECT doc_id, project, replace(title, '#', '+') AS title, replace(coalesce(text, ''), '#', '+') AS t FROM docs),
t1 AS (SELECT *, '# Top ' || doc_id || chr(10) || substr(t, 1, 1500) || chr(10) AS a, '![Fig ' || doc_id || '](img/' || doc_id % 50 || '.png "Ti")' || chr(10) || '## Sec ' || doc_id % 3 || chr(10) || substr(t, 1501) || chr(10) AS b, '<img class="x" src="img/b' || doc_id || '.gif" alt=''Bee'' title="tt">' || chr(10) AS c FROM t0),
pg AS (SELECT doc_id, project, title, a || b || c AS text, length(a) AS at1, length(a) + length(b) AS at2 FROM t1),
ck AS (SELECT *, title || chr(10) || doc_id || chr(10) || substr(text, 1400 * k + 1, 1400) AS chunk FROM (SELECT *, unnest(range(0, CAST(ceil(length(text) / 1400.0) AS BIGINT))) AS k FROM pg)),
cb AS (SELECT *, regexp_replace(regexp_replace(array_to_string(string_split(chunk, chr(10))[3:], chr(10)), '^\s+', ''), '\s+$', '') AS body FROM ck),
cu AS (SELECT doc_id, project, title, text, k, chunk, printf('%d::c%04d', doc_id, k) AS unit_id, CASE WHEN body = '' THEN 1400 * k ELSE coalesce(nullif(strpos(text, body), 0), nullif(strpos(text, substr(body, 1, 500)), 0), nullif(strpos(text, substr(body, 1, 200)), 0), nullif(strpos(text, substr(body, 1, 80)), 0), 1400 * k + 1) - 1 END AS pos,
  coalesce(nullif(regexp_extract(chunk, '(?m)^(#{{1,6}})\s+(.+?)\s*$', 2), ''), title) AS section, CAST(greatest(1, length(regexp_extract(chunk, '(?m)^(#{{1,6}})\s+(.+?)\s*$', 1))) AS BIGINT) AS level FROM cb),
im AS (SELECT doc_id, project, title, text, 0 AS k, 'img/' || doc_id % 50 || '.png' AS url, 'Fig ' || doc_id AS alt, at1 AS pos, 'Top ' || doc_id AS section, 1 AS level FROM pg UNION ALL SELECT doc_id, project, title, text, 1, 'img/b' || doc_id || '.gif', 'Bee', at2, 'Sec ' || doc_id % 3, 2 FROM pg),
iu AS (SELECT *, 'image-occurrence-' || substr(sha256(doc_id || chr(0) || k || chr(0) || url), 1, 24) AS unit_id, 'image-asset-' || substr(sha256(project || chr(0) || url), 1, 24) AS asset_id FROM im),
un AS (SELECT doc_id, text, unit_id, pos, 0 AS kind, k AS place, section, level FROM cu UNION ALL SELECT iu.doc_id, text, unit_id, pos, 1, n + k, section, level FROM iu JOIN (SELECT doc_id, count(*) AS n FROM cu GROUP BY doc_id) c ON c.doc_id = iu.doc_id),
ord AS (SELECT *, 'section-' || substr(sha256(doc_id || chr(0) || level || chr(0) || replace(lower(section), 'ß', 'ss')), 1, 24) AS section_id, row_number() OVER w - 1 AS ordinal, lead(unit_id) OVER w AS following, length(substr(text, 1, CAST(pos AS BIGINT))) - length(replace(substr(text, 1, CAST(pos AS BIGINT)), chr(10), '')) + 1 AS line FROM un WINDOW w AS (PARTITION BY doc_id ORDER BY pos, kind, unit_id)),
near AS (SELECT iu.unit_id, coalesce(min(cu.unit_id) FILTER (WHERE contains(chunk, url) OR contains(chunk, alt)), min(cu.unit_id)) AS near FROM iu JOIN cu ON cu.doc_id = iu.doc_id GROUP BY iu.unit_id)"""


def illustrated(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    i, t = F.col("doc_id").cast("string"), F.replace(F.coalesce("text", F.lit("")), F.lit("#"), F.lit("+"))
    text = F.concat(
        F.lit("# Top "), i, F.lit("\n"), F.substring(t, 1, 1500), F.lit("\n![Fig "), i, F.lit("](img/"), (F.col("doc_id") % 50).cast("string"), F.lit('.png "Ti")\n## Sec '), (F.col("doc_id") % 3).cast("string"), F.lit("\n"), F.substring(t, 1501, 1 << 30),
        F.lit('\n<img class="x" src="img/b'), i, F.lit(".gif\" alt='Bee' title=\"tt\">\n"),
    )
    pages = docs.select("doc_id", "project", F.replace("title", F.lit("#"), F.lit("+")).alias("title"), text.alias("text"))
    return pages.withColumn("chunks", records.slices(F.col("title"), F.col("doc_id"), F.col("text")))


@query(
    "grf04_graph_records",
    f"""WITH {ILLUSTRATED} SELECT DISTINCT 'project' AS label, project AS id, '' AS ref, 0 AS n FROM pg UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR), project, 0 FROM pg
    UNION ALL SELECT 'section', section_id, CAST(any_value(doc_id) AS VARCHAR), CAST(min(place) AS BIGINT) FROM ord GROUP BY section_id UNION ALL SELECT 'unit', unit_id, section_id, ordinal FROM ord UNION ALL SELECT 'line', unit_id, '', CAST(line AS BIGINT) FROM ord
    UNION ALL SELECT 'next', unit_id, following, 0 FROM ord WHERE following IS NOT NULL UNION ALL SELECT 'asset', asset_id, any_value(url), min(doc_id) FROM iu GROUP BY asset_id UNION ALL SELECT 'occurrence', unit_id, asset_id, 0 FROM iu UNION ALL SELECT 'near', unit_id, near, 0 FROM near""",
)
def grf04(spark, d):
    """All records of a graph over documents with headings and images put into them."""
    pages = illustrated(spark, d)
    made = built(table(spark, d, "documents"), "graph-units", lambda: records.units(pages))
    r = records.records(pages, made)
    row = lambda label, df, a, b, n: df.select(F.lit(label).alias("label"), F.col(a).cast("string").alias("id"), b.cast("string").alias("ref"), n.cast("bigint").alias("n"))
    zero, none, c = F.lit(0), F.lit(""), F.col
    return reduce(DataFrame.union, [
        row("project", r["projects"], "project_id", none, zero), row("document", r["documents"], "doc_id", c("project_id"), zero), row("section", r["sections"], "section_id", c("doc_id"), c("ordinal")), row("unit", r["units"], "unit_id", c("section_id"), c("ordinal")),
        row("line", r["units"], "unit_id", none, c("source_line")), row("next", r["next_edges"], "source", c("target"), zero), row("asset", r["image_assets"], "asset_id", c("source_url"), c("first_doc_id")), row("occurrence", r["image_occurrences"], "occurrence_id", c("asset_id"), zero), row("near", r["near_edges"], "occurrence_id", c("unit_id"), zero),
    ])
