"""Links, routing pages, sections and citations of all documents, resolved (MET07, NRM01-NRM05)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import normalise as N
from .registry import query, table
from .retrieval import PAGES, documents, questions

TERMS = "list_distinct(list_filter(list_transform(regexp_extract_all(lower({x}), '[a-z0-9][a-z0-9._-]*'), lambda t: trim(t, '.-')), lambda t: length(t) > 1))"
SLUG = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-')"
SHARE = "len(list_intersect({a}, {b})) / greatest(1, len({a}))"
ROUTE_STOP = "[" + ", ".join(f"'{w}'" for w in N.ROUTE_WORDS) + "]"


def _slug(x):
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def _pages(spark, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", "project", "title", F.concat_ws("/", "route", F.col("doc_id").cast("string")).alias("route"), "text")


# Every question names a page and an anchor; the anchor is the title of another page, for a third of them without its last word.
RECORDS = f"""{PAGES}, n AS (SELECT max(doc_id) + 1 AS size FROM docs),
topics AS (SELECT doc_id, project, [{SLUG.format(x="title")}] AS anchors, {TERMS.format(x="title")} AS terms, route || '/' || doc_id AS route FROM docs),
records AS (SELECT qid AS record, m.project, t.doc_id AS target, CASE WHEN qid % 3 = 0 THEN regexp_replace(m.anchors[1], '-[^-]*$', '') ELSE m.anchors[1] END AS anchor,
  list_filter({TERMS.format(x="replace(replace(t.route, '/', ' '), '-', ' ')")}, lambda w: NOT list_contains({ROUTE_STOP}, w)) AS rterms FROM qs, n JOIN topics t ON t.doc_id = (qid * 37) % size JOIN topics m ON m.doc_id = (qid * 53 + 11) % size)"""


@query("nrm01_resolution_index", f"WITH {RECORDS}, x AS (SELECT project, doc_id, unnest(terms) AS term FROM topics) SELECT project, term, count(*) AS docs, min(doc_id) AS first_doc FROM x GROUP BY project, term")
def nrm01(spark, d):
    """The inverted index: which pages of a project have a term in their title."""
    rows = _pages(spark, d).select("project", "doc_id", F.explode(N.terms(F.col("title"))).alias("term"))
    return rows.groupBy("project", "term").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))


@query(
    "nrm03_historical_recovery",
    f"""WITH {RECORDS}, a AS (SELECT r.*, {TERMS.format(x="replace(anchor, '-', ' ')")} AS asked, t.terms AS now, t.anchors AS na FROM records r JOIN topics t ON t.doc_id = target),
    b AS (SELECT *, {SHARE.format(a='asked', b='now')} AS before, {SHARE.format(a='rterms', b='now')} AS rbefore FROM a WHERE len(asked) > 0 AND NOT list_contains(na, anchor)),
    c AS (SELECT b.*, p.doc_id, list_contains(p.anchors, anchor) AS exact, {SHARE.format(a='asked', b='p.terms')} AS coverage, {SHARE.format(a='rterms', b='p.terms')} AS route FROM b JOIN topics p ON p.project = b.project AND p.doc_id <> target AND len(list_intersect(asked, p.terms)) > 0),
    s AS (SELECT *, round(1000 * exact::INT + 100 * coverage + 10 * route, 9) AS score FROM c),
    w AS (SELECT *, lead(score) OVER o AS next, row_number() OVER o AS pos FROM s WINDOW o AS (PARTITION BY record ORDER BY score DESC, coverage DESC, exact DESC, doc_id DESC))
    SELECT record, doc_id, CASE WHEN exact THEN 'exact_anchor' ELSE 'topic' END AS method, round(score, 6) AS score, round(score - next, 6) AS margin, round(before, 6) AS coverage_before, round(coverage, 6) AS coverage FROM w
    WHERE pos = 1 AND (exact OR next IS NULL OR score - next >= 8) AND (len(rterms) = 0 OR route >= rbefore) AND ((exact AND (before < 0.75 OR coverage >= before + 0.2)) OR (coverage >= 0.75 AND coverage >= before + 0.2))""",
)
def nrm03(spark, d):
    """Pages that took over the topic of a link whose anchor its page no longer has."""
    pages = _pages(spark, d).select("doc_id", "project", "route", F.array(_slug(F.col("title"))).alias("anchors"), N.terms(F.col("title")).alias("terms"))
    size = pages.agg((F.max("doc_id") + 1).alias("size"))
    asked = questions(spark, d).select(F.col("qid").alias("record")).crossJoin(F.broadcast(size))  # one row
    asked = asked.select("record", (F.col("record") * 37 % F.col("size")).alias("target"), ((F.col("record") * 53 + 11) % F.col("size")).alias("moved"))
    target = pages.select(F.col("doc_id").alias("target"), N.terms(F.regexp_replace("route", "[/-]", " "), N.ROUTE_WORDS).alias("route_terms"))
    moved = pages.select(F.col("doc_id").alias("moved"), "project", F.get("anchors", F.lit(0)).alias("whole"))
    records = asked.join(target, "target").join(moved, "moved").withColumn("anchor", F.when(F.col("record") % 3 == 0, F.regexp_replace("whole", "-[^-]*$", "")).otherwise(F.col("whole")))
    return N.recovered(records.select("record", "project", "target", "anchor", "route_terms"), pages.drop("route"))


@query(
    "nrm04_empty_pages",
    f"""WITH {PAGES}, asked AS (SELECT qid, project, project || '/src' || qid % 20 || '/' AS prefix, {TERMS.format(x="text")} AS terms FROM qs),
    p AS (SELECT doc_id, project, route || '/' || doc_id AS route, {TERMS.format(x="title")} AS tt, {TERMS.format(x="title || ' ' || text")} AS terms FROM docs),
    p2 AS (SELECT *, {TERMS.format(x="replace(route, '/', ' ')")} AS rt FROM p), size AS (SELECT project, count(*) AS size FROM docs GROUP BY project),
    post AS (SELECT project, term, count(*) AS df FROM (SELECT project, unnest(terms) AS term FROM p) GROUP BY project, term),
    hit AS (SELECT qid, prefix, doc_id, route, tt, rt, p2.project, unnest(list_intersect(asked.terms, p2.terms)) AS term FROM asked JOIN p2 ON p2.project = asked.project AND starts_with(p2.route, prefix)),
    s AS (SELECT qid, prefix, doc_id, round(sum(ln(1 + size / greatest(1, df)) * (1 + CASE WHEN list_contains(tt, term) THEN 3 ELSE 0 END + CASE WHEN list_contains(rt, term) THEN 1.5::DOUBLE ELSE 0 END)) + 0.25::DOUBLE / any_value(len(string_split(substr(route, length(prefix) + 1), '/'))), 9) AS score, count(*) AS matched
      FROM hit JOIN post USING (project, term) JOIN size USING (project) GROUP BY qid, prefix, doc_id)
    SELECT qid, prefix, doc_id, round(score, 6) AS score, matched, row_number() OVER (PARTITION BY qid, prefix ORDER BY score DESC, matched DESC, doc_id) AS rank FROM s QUALIFY rank <= 3""",
)
def nrm04(spark, d):
    """The three pages below a question's directory that answer it best."""
    asked = questions(spark, d).select("qid", "project", F.concat("project", F.lit("/src"), (F.col("qid") % 20).cast("string"), F.lit("/")).alias("prefix"), N.terms(F.col("text")).alias("terms"))
    pages = _pages(spark, d).select("doc_id", "project", "route", N.terms(F.col("title")).alias("title_terms"), N.terms(F.replace("route", F.lit("/"), F.lit(" "))).alias("route_terms"), N.terms(F.concat_ws(" ", "title", "text")).alias("terms"))
    out = N.routed(asked, pages)
    return out.select("qid", "prefix", "doc_id", F.round("score", 6).alias("score"), "matched", F.col("rank").cast("bigint").alias("rank"))


# A page's lines are its sections. It is asked for by the heading of one of its first three lines, as it stands or with an
# ending of its own, or by the question alone.
HEADING = r"regexp_extract(body, '^(\S+(?:\s+\S+){0,3})', 1)"
SECTIONS = rf"""{PAGES}, items AS (SELECT row_number() OVER (ORDER BY qid) - 1 AS k, text AS query, count(*) OVER () AS n FROM qs),
lines AS (SELECT doc_id, generate_subscripts(b, 1) - 1 AS line, unnest(b) AS body FROM (SELECT doc_id, string_split(text, chr(10)) AS b FROM docs)),
placed AS (SELECT *, coalesce(sum(length(body) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM lines),
sec AS (SELECT doc_id AS key, CAST(start AS BIGINT) AS start, {HEADING} AS heading, {SLUG.format(x=HEADING)} AS anchor, body, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS no FROM placed WHERE trim(body) <> ''),
frag AS (SELECT key, arg_max(anchor, no) || CASE WHEN key % 2 = 0 THEN '' ELSE '-old' END AS fragment FROM sec WHERE no <= key % 3 GROUP BY key),
asked AS (SELECT sec.*, CASE WHEN sec.key % 5 = 0 THEN '' ELSE fragment END AS fragment, query FROM sec JOIN frag ON frag.key = sec.key JOIN items ON items.k = sec.key % items.n),
t AS (SELECT *, {TERMS.format(x="heading")} AS ht, {TERMS.format(x="substr(body, 1, 8000)")} AS bt, {TERMS.format(x="query")} AS qt, {TERMS.format(x="replace(fragment, '-', ' ')")} AS ft FROM asked),
p AS (SELECT *, CASE WHEN len(qt) > 0 THEN 12 * len(list_intersect(qt, ht)) / greatest(1, len(ht)) + 8 * len(list_intersect(qt, bt)) / len(qt) ELSE 0 END + 1 / (1 + start / 10000) AS plain0,
  CASE WHEN len(ft) > 0 THEN 80 * len(list_intersect(ft, ht)) / len(ft) + 30 * len(list_intersect(ft, bt)) / len(ft) + 25 * len(list_intersect(ft, ht)) / greatest(1, len(ht)) ELSE 0 END AS extra FROM t),
sc AS (SELECT *, round(plain0, 9) AS plain, CASE WHEN fragment <> '' AND anchor = fragment THEN 10000 ELSE round(extra + plain0, 9) END AS score FROM p),
f AS (SELECT *, lead(score) OVER o AS next, row_number() OVER o AS pos FROM sc WINDOW o AS (PARTITION BY key ORDER BY score DESC, start))"""


def _sections(spark, d: str) -> DataFrame:
    docs = documents(spark, d).select(F.col("doc_id").alias("key"), F.posexplode(F.split("text", "\n", -1)).alias("line", "body"))
    before = Window.partitionBy("key").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("start", F.coalesce(F.sum(F.length("body") + 1).over(before), F.lit(0)).cast("bigint")).where(F.trim("body") != "")
    sec = placed.withColumn("heading", F.regexp_extract("body", r"^(\S+(?:\s+\S+){0,3})", 1)).withColumn("anchor", _slug(F.col("heading")))
    sec = sec.withColumn("no", F.row_number().over(Window.partitionBy("key").orderBy("start")) - 1)
    frag = sec.where(F.col("no") <= F.col("key") % 3).groupBy("key").agg(F.max_by("anchor", "no").alias("whole"))
    fragment = F.when(F.col("key") % 5 == 0, "").otherwise(F.concat("whole", F.when(F.col("key") % 2 == 0, "").otherwise("-old")))
    items = questions(spark, d).select((F.row_number().over(Window.orderBy("qid")) - 1).alias("k"), F.col("text").alias("query"))  # the question set
    n = items.count()
    both = sec.join(frag, "key").withColumn("fragment", fragment).join(F.broadcast(items) if n <= 100_000 else items, F.col("key") % n == F.col("k"))
    return both.select("key", "start", "heading", "anchor", "body", "fragment", "query")


@query(
    "nrm05_section_ranking",
    f"""WITH {SECTIONS} SELECT key, start AS section, CASE WHEN fragment <> '' AND anchor = fragment THEN 'exact_anchor' WHEN fragment <> '' THEN 'ranked_heading' ELSE 'question_guided' END AS method,
    round(score, 6) AS score, round(score - next, 6) AS margin, fragment <> '' AND anchor <> fragment AND (score < 34 OR coalesce(score - next < 4, false)) AS ambiguous FROM f WHERE pos = 1""",
)
def nrm05(spark, d):
    """The section that each page's fragment means."""
    return N.sections_ranked(_sections(spark, d))[0]


@query(
    "nrm05_section_evidence",
    f"""WITH {SECTIONS}, o AS (SELECT key, start, plain AS score, length(body) AS size FROM f WHERE pos > 1 QUALIFY row_number() OVER (PARTITION BY key ORDER BY plain DESC, start) < 4),
    c AS (SELECT key, start, score, length(body) AS size FROM f WHERE pos = 1 UNION ALL SELECT * FROM o),
    r AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY key ORDER BY score DESC, start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
    SELECT key, start AS section, round(score, 6) AS score, CAST(least(size, 18000 - before) AS BIGINT) AS taken FROM r WHERE size > 0 AND before < 18000""",
)
def nrm05e(spark, d):
    """Up to four sections a page as evidence, under a budget of characters."""
    return N.sections_ranked(_sections(spark, d))[1]


PROJECTS = ("en", "fr", "de", "es")
HOSTS = {f"docs.{p}.example.com": p for p in PROJECTS}
DID = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({x}, '\', '/'), '[#?].*$', ''), '/+', '/', 'g'), '\.mdx?$', ''), '/index$', '')"


def _spelled(x: str) -> str:
    bare = f"regexp_replace({x}, '^content/', '')"
    return f"{x}, {bare}, 'content/' || {bare}, {DID.format(x=x)}, regexp_replace({DID.format(x=x)}, '^/+', '')"


# Citations of all pages in six shapes: ids, URLs, paths with back slashes, paths below a project, unknown ones, routes that pages share
CITED = rf"""pg AS (SELECT doc_id AS k, lang || '::' || source || '/' || doc_id AS doc_id, lang AS project, source || '/' || doc_id // 2 AS source_doc_id, source || '/p' || doc_id || '.md' AS source_path, '/' || source || '/r' || doc_id // 3 AS route FROM documents),
cited AS (SELECT k, CASE k % 6 WHEN 0 THEN upper(doc_id) || '#frag' WHEN 1 THEN 'https://docs.' || project || '.example.com/en/v1.2/' || regexp_replace(source_path, '\.md$', '') || '?q=1' WHEN 2 THEN 'content\' || replace(source_path, '/', '\')
  WHEN 3 THEN project || '/' || source_doc_id WHEN 4 THEN 'nowhere/' || k ELSE route || '/' END AS source FROM pg),
alias AS (SELECT alias, any_value(doc_id) AS doc_id FROM (SELECT DISTINCT doc_id, lower(trim(unnest([{DID.format(x='doc_id')}, regexp_replace({DID.format(x='doc_id')}, '^/+', ''), {_spelled('source_doc_id')}, {_spelled('source_path')}, {DID.format(x='route')},
  project || '::' || {DID.format(x='source_doc_id')}, project || '::' || {DID.format(x='source_path')}]))) AS alias FROM pg) WHERE alias <> '' GROUP BY alias HAVING count(DISTINCT doc_id) = 1),
u AS (SELECT k, source, regexp_matches(source, '^[a-zA-Z][a-zA-Z0-9+.-]*://') AS url FROM cited),
h AS (SELECT k, source, CASE WHEN url THEN coalesce(nullif(regexp_extract(lower(source), '^https://docs\.(en|fr|de|es)\.example\.com/', 1), ''), '') ELSE '' END AS hint,
  list_filter(string_split(regexp_replace(replace(url_decode(replace(CASE WHEN url THEN regexp_replace(source, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', '') ELSE source END, '+', '%2B')), '\', '/'), '[#?].*$', ''), '/'), lambda p: p <> '') AS parts FROM u),
a AS (SELECT k, source, CASE WHEN lower(parts[1]) IN ('en', 'fr', 'de', 'es') THEN lower(parts[1]) ELSE hint END AS hint, CASE WHEN lower(parts[1]) IN ('en', 'fr', 'de', 'es') THEN parts[2:] ELSE parts END AS parts FROM h),
b AS (SELECT k, source, hint, CASE WHEN lower(parts[1]) = 'en' THEN parts[2:] ELSE parts END AS parts FROM a),
c AS (SELECT k, source, hint, array_to_string(CASE WHEN regexp_matches(lower(parts[1]), '^(?:latest|v?\d+(?:\.\d+)*|[a-z-]+@[\w.]+)$') THEN parts[2:] ELSE parts END, '/') AS path FROM b),
l AS (SELECT k, source, hint, [{_spelled('path')}] AS s FROM c),
x AS (SELECT k, unnest(t) AS alias, generate_subscripts(t, 1) AS pos FROM (SELECT k, list_transform(list_concat(s, CASE WHEN hint <> '' THEN list_transform(s, lambda v: hint || '::' || {DID.format(x='v')}) ELSE [] END), lambda v: lower(trim(v))) AS t FROM l)),
by_alias AS (SELECT k, arg_min(doc_id, pos) AS doc_id FROM x JOIN alias USING (alias) GROUP BY k),
by_id AS (SELECT l.k, min(pg.doc_id) AS doc_id FROM l JOIN pg ON lower(trim({DID.format(x='l.source')})) = lower(trim({DID.format(x='pg.doc_id')})) WHERE contains(l.source, '::') GROUP BY l.k)"""


@query("met07_source_resolver", f"WITH {CITED} SELECT pg.k AS key, coalesce(by_id.doc_id, by_alias.doc_id) AS doc_id FROM pg LEFT JOIN by_id ON by_id.k = pg.k LEFT JOIN by_alias ON by_alias.k = pg.k")
def met07(spark, d):
    """Ids, URLs and paths that cite pages, to the one page that they name."""
    i, s = F.col("i").cast("string"), lambda k: F.floor(F.col("i") / k).cast("string")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("i"), F.col("lang").alias("project"), "source")
    pages = docs.select(
        "i", F.concat("project", F.lit("::"), "source", F.lit("/"), i).alias("doc_id"), "project", F.concat("source", F.lit("/"), s(2)).alias("source_doc_id"),
        F.concat("source", F.lit("/p"), i, F.lit(".md")).alias("source_path"), F.concat(F.lit("/"), "source", F.lit("/r"), s(3)).alias("route"),
    )
    url = F.concat(F.lit("https://docs."), "project", F.lit(".example.com/en/v1.2/"), F.regexp_replace("source_path", r"\.md$", ""), F.lit("?q=1"))
    back = F.concat(F.lit("content\\"), F.replace("source_path", F.lit("/"), F.lit("\\")))
    shapes = [F.concat(F.upper("doc_id"), F.lit("#frag")), url, back, F.concat_ws("/", "project", "source_doc_id"), F.concat(F.lit("nowhere/"), i), F.concat("route", F.lit("/"))]
    cited = pages.select(F.col("i").alias("key"), F.element_at(F.array(*shapes), (F.col("i") % 6 + 1).cast("int")).alias("source"))
    return N.resolved(cited, pages.drop("i"), HOSTS)
