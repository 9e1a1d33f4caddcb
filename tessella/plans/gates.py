"""Package gates, dataset audits, images, links of pages, reports: over whole tables, by their rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stable_id
from .answers import SCORED, scores
from .checks import EVENTS, _events, fingerprint
from .registry import query, table
from .retrieval import QRELS, qrels

# --- source packages: rows made of documents, some of them wrong in one of five ways, with links to other answers

PACKAGE = """package AS (SELECT doc_id, CASE WHEN doc_id % 23 = 7 THEN doc_id - 1 ELSE doc_id END AS key, CASE WHEN doc_id % 17 = 3 THEN '' ELSE lang END AS dataset, CASE WHEN doc_id % 13 = 5 THEN '' ELSE substr(text, 1, 300) END AS answer,
  CASE WHEN doc_id % 11 = 4 THEN 'http://other.net/' ELSE 'https://docs.example.com/' END || doc_id AS url, CASE WHEN doc_id % 7 = 2 THEN CAST(NULL AS BIGINT) ELSE n_chars END AS n_chars,
  CASE WHEN doc_id % 6 = 0 THEN doc_id + 3 WHEN doc_id % 6 = 3 THEN doc_id - 3 WHEN doc_id % 6 = 1 THEN -1 WHEN doc_id % 6 = 2 THEN doc_id + 2 END AS linked FROM documents)"""


def _package(spark, d: str) -> DataFrame:
    i = F.col("doc_id")
    linked = F.when(i % 6 == 0, i + 3).when(i % 6 == 3, i - 3).when(i % 6 == 1, F.lit(-1)).when(i % 6 == 2, i + 2)
    return table(spark, d, "documents").select(
        "doc_id", F.when(i % 23 == 7, i - 1).otherwise(i).alias("key"), F.when(i % 17 == 3, "").otherwise(F.col("lang")).alias("dataset"), F.when(i % 13 == 5, "").otherwise(F.substring("text", 1, 300)).alias("answer"),
        F.concat(F.when(i % 11 == 4, "http://other.net/").otherwise("https://docs.example.com/"), i.cast("string")).alias("url"), F.when(i % 7 == 2, F.lit(None).cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"), linked.cast("bigint").alias("linked"),
    )


@query(
    "val01_gates",
    f"""WITH {PACKAGE}, n AS (SELECT *, count(*) OVER (PARTITION BY key) AS same FROM package),
    l AS (SELECT n.*, a.doc_id AS t1, a.linked AS back FROM n LEFT JOIN package a ON a.doc_id = n.linked)
    SELECT doc_id, concat_ws(';', CASE WHEN same > 1 THEN 'duplicate_key' END, CASE WHEN dataset = '' THEN 'no_dataset' END, CASE WHEN answer = '' THEN 'no_answer' END, CASE WHEN NOT starts_with(url, 'https://docs.example.com/') THEN 'host' END, CASE WHEN n_chars IS NULL THEN 'no_length' END,
      CASE WHEN linked IS NOT NULL AND t1 IS NULL THEN 'linked_missing' END, CASE WHEN back = doc_id THEN 'linked_cycle' END) AS errors FROM l""",
)
def val01(spark, d):
    """Five structural errors of a package's rows and two of the answers that they link; a row is accepted if it has none."""
    rows = _package(spark, d)
    same = F.count("*").over(Window.partitionBy("key"))
    target = rows.select(F.col("doc_id").alias("linked"), F.lit(True).alias("there"), F.col("linked").alias("back"))
    both = rows.withColumn("same", same).join(target, "linked", "left")
    errors = F.concat_ws(
        ";", F.when(F.col("same") > 1, "duplicate_key"), F.when(F.col("dataset") == "", "no_dataset"), F.when(F.col("answer") == "", "no_answer"), F.when(~F.col("url").startswith("https://docs.example.com/"), "host"),
        F.when(F.col("n_chars").isNull(), "no_length"), F.when(F.col("linked").isNotNull() & F.col("there").isNull(), "linked_missing"), F.when(F.col("back") == F.col("doc_id"), "linked_cycle"),
    )
    return both.select("doc_id", errors.alias("errors"))


@query(
    "val05_verifier",
    f"WITH {QRELS} SELECT (SELECT count(*) FROM documents) AS pages, (SELECT count(*) - count(DISTINCT doc_id) FROM documents) AS repeated_ids, (SELECT count(*) FROM documents WHERE n_chars <> length(text)) AS wrong_lengths, (SELECT count(*) FROM documents WHERE text IS NULL OR trim(text) = '') AS empty_texts, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS dangling_labels, (SELECT count(*) FROM qrels) AS leaks",
)
def val05(spark, d):
    """Counts of what may be wrong with a data set: ids twice, lengths, empty texts, labels without a page, and pages that hold a question."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    one = docs.agg(F.count("*").alias("pages"), (F.count("*") - F.countDistinct("doc_id")).alias("repeated_ids"), F.count_if(F.col("n_chars") != F.length("text")).alias("wrong_lengths"), F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("empty_texts"))
    dangling = labels.join(docs.select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("dangling_labels"))
    return one.crossJoin(dangling).crossJoin(qrels(spark, d).agg(F.count("*").alias("leaks")))  # one row each


@query(
    "val07_frozen_audit",
    """WITH frozen AS (SELECT lang, doc_id, sha256(text) AS h FROM documents WHERE doc_id % 31 <> 4 UNION ALL SELECT lang, -doc_id - 1, 'gone' FROM documents WHERE doc_id % 37 = 8),
    now AS (SELECT lang, doc_id, sha256(CASE WHEN doc_id % 29 = 6 THEN upper(text) ELSE text END) AS h FROM documents),
    j AS (SELECT coalesce(f.lang, n.lang) AS lang, CASE WHEN n.doc_id IS NULL THEN 'missing' WHEN f.doc_id IS NULL THEN 'extra' WHEN f.h <> n.h THEN 'changed' ELSE 'same' END AS status FROM frozen f FULL JOIN now n ON f.lang = n.lang AND f.doc_id = n.doc_id)
    SELECT lang, count(*) FILTER (status = 'same') AS same, count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'extra') AS extra FROM j GROUP BY lang""",
)
def val07(spark, d):
    """A frozen manifest against what is there, by id and digest, for each project."""
    docs, i = table(spark, d, "documents"), F.col("doc_id")
    frozen = docs.where(i % 31 != 4).select("lang", "doc_id", F.sha2("text", 256).alias("f")).union(docs.where(i % 37 == 8).select("lang", -i - 1, F.lit("gone")))
    now = docs.select("lang", "doc_id", F.sha2(F.when(i % 29 == 6, F.upper("text")).otherwise(F.col("text")), 256).alias("n"))
    both = frozen.join(now, ["lang", "doc_id"], "full")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("f").isNull(), "extra").when(F.col("f") != F.col("n"), "changed").otherwise("same")
    return both.select("lang", status.alias("s")).groupBy("lang").agg(*(F.count_if(F.col("s") == k).alias(k) for k in ("same", "changed", "missing", "extra")))


@query("val04_evidence_flags", f"WITH {QRELS}, e AS (SELECT qid, count(*) AS n, count(DISTINCT lang) AS langs, bool_or(n_chars > 5000) AS long FROM qrels JOIN documents USING (doc_id) GROUP BY qid) SELECT item_id AS qid, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 AND long THEN 'single_long' WHEN n = 1 THEN 'single' WHEN langs > 1 THEN 'across_projects' ELSE 'several' END AS category FROM benchmark LEFT JOIN e ON qid = item_id")
def val04(spark, d):
    """What evidence a question has: no page, one, one long one, several, or several of different projects."""
    pages = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    e = qrels(spark, d).join(pages, "doc_id").groupBy("qid").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("langs"), F.bool_or(F.col("n_chars") > 5000).alias("long"))
    category = F.when(F.col("n").isNull(), "none").when((F.col("n") == 1) & F.col("long"), "single_long").when(F.col("n") == 1, "single").when(F.col("langs") > 1, "across_projects").otherwise("several")
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid")).join(e, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), category.alias("category"))


@query("hlp15_screening", r"""WITH u AS (SELECT url FROM pages WHERE page_id % 3 <> 0 UNION ALL SELECT url FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT 'http://bad host/' || page_id FROM pages WHERE page_id % 10 = 1), g AS (SELECT url, regexp_extract(lower(url), '^[a-z]+://([a-z0-9.-]+)(/|$)', 1) AS host FROM u) SELECT host, count(*) AS before, count(DISTINCT url) AS after FROM g WHERE host <> '' GROUP BY host UNION ALL SELECT 'failed', count(*), count(DISTINCT url) FROM g WHERE host = ''""")
def hlp15(spark, d):
    """Candidates of several listings: before and after duplicates go, for each host; what has no host failed."""
    pages, i = table(spark, d, "pages"), F.col("page_id")
    u = pages.where(i % 3 != 0).select("url").union(pages.where(i % 2 == 0).select("url")).union(pages.where(i % 10 == 1).select(F.concat(F.lit("http://bad host/"), i.cast("string"))))
    host = F.regexp_extract(F.lower("url"), "^[a-z]+://([a-z0-9.-]+)(/|$)", 1)
    return u.groupBy(F.when(host == "", "failed").otherwise(host).alias("host")).agg(F.count("*").alias("before"), F.countDistinct("url").alias("after"))


@query(
    "hlp23_preflight",
    """WITH f AS (SELECT 'untouched' AS workspace, doc_id, lang, source FROM documents UNION ALL SELECT 'changed', doc_id, lang, CASE WHEN doc_id = (SELECT min(doc_id) FROM documents) THEN 'x' ELSE source END FROM documents),
    g AS (SELECT workspace, count(*) AS n, sha256(count(*) || ':' || coalesce(sum(('0x' || substr(sha256(doc_id || chr(0) || lang || chr(0) || source), 1, 15))::BIGINT), 0)) AS fingerprint FROM f GROUP BY workspace)
    SELECT workspace, n, fingerprint, fingerprint = (SELECT fingerprint FROM g WHERE workspace = 'untouched') AS equal FROM g""",
)
def hlp23(spark, d):
    """A workspace's digest and count before and after a run: one that was left alone, one in which a file changed."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    first = docs.agg(F.min("doc_id")).first()[0]
    changed = docs.withColumn("source", F.when(F.col("doc_id") == first, "x").otherwise(F.col("source")))
    before = fingerprint(docs, *docs.columns)

    def against(name: str, after: DataFrame) -> DataFrame:
        other = fingerprint(after, *docs.columns).select(F.col("n").alias("m"), F.col("fingerprint").alias("g"))
        return before.crossJoin(other).select(F.lit(name).alias("workspace"), "n", F.col("g").alias("fingerprint"), ((F.col("n") == F.col("m")) & (F.col("fingerprint") == F.col("g"))).alias("equal"))  # one row each

    return against("untouched", docs).union(against("changed", changed))


# --- images: references of questions, of answers and of pages

REFS = r"""refs AS (SELECT 'question' AS role, item_id AS owner, k AS position, 'https://img.example.com/q/' || item_id || '/' || k || '.png' AS url, CASE WHEN k = 1 THEN 'a picture of the settings dialog' ELSE 'pic' END AS alt FROM benchmark, (VALUES (0), (1), (2)) AS v(k) WHERE k <= item_id % 3
  UNION ALL SELECT 'answer', doc_id, 0, CASE WHEN doc_id % 4 = 0 THEN 'http://127.0.0.1/' ELSE 'https://img.example.com/a/' END || doc_id || '.gif', CASE WHEN quality = 1 THEN 'the answer as a longer description' ELSE '' END FROM labels
  UNION ALL SELECT 'document', page_id, pos - 1, 'https://docs.example.com' || href, '' FROM (SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, '<a href="(/[^"]*)"', 1) AS h FROM pages)))"""


def _refs(spark, d: str) -> DataFrame:
    i, k = F.col("item_id"), F.col("k")
    asked = table(spark, d, "benchmark").select("item_id", F.explode(F.sequence(F.lit(0), (i % 3).cast("int"))).alias("k"))
    asked = asked.select(F.lit("question").alias("role"), i.alias("owner"), k.alias("position"), F.concat(F.lit("https://img.example.com/q/"), i.cast("string"), F.lit("/"), k.cast("string"), F.lit(".png")).alias("url"), F.when(k == 1, "a picture of the settings dialog").otherwise("pic").alias("alt"))
    j = F.col("doc_id")
    told = table(spark, d, "labels").select(F.lit("answer"), j, F.lit(0), F.concat(F.when(j % 4 == 0, "http://127.0.0.1/").otherwise("https://img.example.com/a/"), j.cast("string"), F.lit(".gif")), F.when(F.col("quality") == 1, "the answer as a longer description").otherwise(""))
    pages = table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="(/[^"]*)"'), F.lit(1))).alias("pos", "href"))
    return asked.union(told).union(pages.select(F.lit("document"), "page_id", "pos", F.concat(F.lit("https://docs.example.com"), "href"), F.lit("")))


@query("img01_image_references", f"WITH {REFS} SELECT role, owner, CAST(position AS INT) AS position, 'img-' || substr(sha256(role || chr(0) || owner || chr(0) || position || chr(0) || url), 1, 24) AS image_id FROM refs")
def img01(spark, d):
    """Every image that a question, an answer or a page refers to, with an id by role, owner, place and URL."""
    image = stable_id("img", F.col("role"), F.col("owner").cast("string"), F.col("position").cast("string"), F.col("url"))
    return _refs(spark, d).select("role", "owner", "position", image.alias("image_id"))


@query("nrm08_question_upgrade", f"WITH {REFS}, i AS (SELECT owner, string_agg('[image ' || position || '] ' || alt, chr(10) ORDER BY position) AS block FROM refs WHERE role = 'question' AND length(alt) >= 20 GROUP BY owner), {QRELS}, c AS (SELECT qid, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS cited FROM qrels GROUP BY qid) SELECT item_id AS qid, sha256(text || coalesce(chr(10) || block, '')) AS query, coalesce(cited, '') AS citations FROM benchmark LEFT JOIN i ON owner = item_id LEFT JOIN c ON qid = item_id")
def nrm08(spark, d):
    """Questions with what their images show and the pages that they cite."""
    images = _refs(spark, d).where("role = 'question' and length(alt) >= 20").groupBy(F.col("owner").alias("qid")).agg(F.array_sort(F.collect_list(F.struct("position", "alt"))).alias("i"))  # three at most
    block = F.array_join(F.transform("i", lambda x: F.concat(F.lit("[image "), x["position"].cast("string"), F.lit("] "), x["alt"])), "\n")
    cited = qrels(spark, d).groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list("doc_id")), ",").alias("citations"))
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text").join(images, "qid", "left").join(cited, "qid", "left")
    return rows.select("qid", F.sha2(F.concat("text", F.coalesce(F.concat(F.lit("\n"), block), F.lit(""))), 256).alias("query"), F.coalesce("citations", F.lit("")).alias("citations"))


@query("nrm09_replay", "WITH s AS (SELECT item_id AS id, CASE WHEN item_id % 8 = 3 THEN 'v1' ELSE 'v2' END AS contract FROM benchmark WHERE item_id % 9 <> 4 UNION ALL SELECT -1 - item_id, 'v2' FROM benchmark WHERE item_id % 10 = 7) SELECT count(*) FILTER (b.item_id IS NULL) AS unknown, count(*) FILTER (s.id IS NULL) AS missing, count(*) FILTER (b.item_id IS NOT NULL AND s.id IS NOT NULL AND contract <> 'v2') AS other_contract, count(*) FILTER (b.item_id IS NOT NULL AND contract = 'v2') AS replayed FROM benchmark b FULL JOIN s ON s.id = b.item_id")
def nrm09(spark, d):
    """Cached work against the questions: states that no question has, questions without one, states of another contract."""
    items, i = table(spark, d, "benchmark").select("item_id"), F.col("item_id")
    state = items.where(i % 9 != 4).select(i.alias("id"), F.when(i % 8 == 3, "v1").otherwise("v2").alias("contract")).union(items.where(i % 10 == 7).select(-1 - i, F.lit("v2")))
    both = items.join(state, i == F.col("id"), "full")
    here, there = i.isNotNull(), F.col("id").isNotNull()
    return both.agg(
        F.count_if(~here).alias("unknown"), F.count_if(~there).alias("missing"), F.count_if(here & there & (F.col("contract") != "v2")).alias("other_contract"), F.count_if(here & (F.col("contract") == "v2")).alias("replayed"),
    )


# --- rollouts and reports


@query("hlp02_agent_report", f"WITH {SCORED}, s AS (SELECT *, CASE WHEN qid % 2 = 0 THEN 'even' ELSE 'odd' END AS slice FROM scored) SELECT arm, slice, outcome, count(*) AS n, round(avg(coverage), 6) AS coverage, bool_or(NOT integrity) AS flawed, CAST(GROUPING(slice) + 2 * GROUPING(outcome) AS INT) AS level FROM s GROUP BY GROUPING SETS ((arm), (arm, slice), (arm, outcome))")
def hlp02(spark, d):
    """Arms, and slices of them, in one pass; a flag where any answer's citations are unsound."""
    rows = scores(spark, d).withColumn("slice", F.when(F.col("qid") % 2 == 0, "even").otherwise("odd"))
    out = rows.groupingSets([["arm"], ["arm", "slice"], ["arm", "outcome"]], "arm", "slice", "outcome").agg(
        F.count("*").alias("n"), F.round(F.avg("coverage"), 6).alias("coverage"), F.bool_or(~F.col("integrity")).alias("flawed"), F.grouping("slice").alias("a"), F.grouping("outcome").alias("b")
    )
    return out.select("arm", "slice", "outcome", "n", "coverage", "flawed", (F.col("a") + 2 * F.col("b")).cast("int").alias("level"))


@query("hlp03_rollout_outcomes", f"WITH {EVENTS} SELECT a.conv_id, a.turn, CASE WHEN a.turn % 5 = 0 THEN a.turn % 2 = 0 WHEN a.turn % 5 = 1 THEN length(b.text) > 100 WHEN b.text IS NULL THEN NULL ELSE NOT regexp_matches(b.text, '[0-9]') END AS success FROM ev a LEFT JOIN ev b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.tool IS NOT NULL")
def hlp03(spark, d):
    """Whether a call succeeded: as the rollout says, in either of two words, else as its embedded result is no error."""
    ev = _events(spark, d)
    results = ev.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("result"))
    rows = ev.where("tool is not null").select("conv_id", "turn").join(results, ["conv_id", "turn"], "left")
    said, also = F.when(F.col("turn") % 5 == 0, F.col("turn") % 2 == 0), F.when(F.col("turn") % 5 == 1, F.length("result") > 100)
    error = F.when(~(F.col("turn") % 5).isin(0, 1), F.col("result").rlike("[0-9]"))
    return rows.select("conv_id", "turn", F.coalesce(said, also, ~error).alias("success"))


# --- links of pages: by canonical path, a redirect, or a title that one page has


GRAPH_LINKS = r"""pg AS (SELECT page_id, lower(regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '(\.html)?/*$', '')) AS path, regexp_replace(trim(regexp_replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[^a-z0-9]+', '-', 'g'), '-'), '^$', '-') AS slug FROM pages),
hrefs AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN path || '.html#top' WHEN 1 THEN '/old/' || page_id WHEN 2 THEN '/somewhere/' || slug ELSE '/none/' || page_id END AS href FROM pg)"""


def _path(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "^[a-z]+://[^/]*", ""), "[?#].*$", ""), r"(\.html)?/*$", ""))


@query(
    "grf01_link_resolution",
    f"""WITH {GRAPH_LINKS}, a AS (SELECT path, min(page_id) AS t FROM pg GROUP BY path), b AS (SELECT '/old/' || page_id AS path, page_id AS t FROM pg), c AS (SELECT slug, min(page_id) AS t FROM pg GROUP BY slug HAVING count(*) = 1),
    j AS (SELECT h.page_id, a.t AS x, b.t AS y, c.t AS z FROM (SELECT page_id, lower(regexp_replace(regexp_replace(href, '[?#].*$', ''), '(\\.html)?/*$', '')) AS p FROM hrefs) h LEFT JOIN a ON a.path = p LEFT JOIN b ON b.path = p LEFT JOIN c ON c.slug = regexp_extract(p, '([^/]+)$', 1))
    SELECT page_id, coalesce(x, y, z) AS target, CASE WHEN x IS NOT NULL THEN 'canonical' WHEN y IS NOT NULL THEN 'redirect' WHEN z IS NOT NULL THEN 'slug' ELSE 'unresolved' END AS kind FROM j""",
)
def grf01(spark, d):
    """Links to pages by their canonical path, a redirect, or a slug that one title alone has."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    slug = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", ""), "^$", "-")
    pages = table(spark, d, "pages").select("page_id", _path(F.col("url")).alias("path"), slug.alias("slug"))
    i = F.col("page_id")
    shapes = [F.concat("path", F.lit(".html#top")), F.concat(F.lit("/old/"), i.cast("string")), F.concat(F.lit("/somewhere/"), "slug"), F.concat(F.lit("/none/"), i.cast("string"))]
    links = pages.select("page_id", _path(F.element_at(F.array(*shapes), (i % 4 + 1).cast("int"))).alias("p")).withColumn("last", F.regexp_extract("p", "([^/]+)$", 1))
    known = pages.groupBy(F.col("path").alias("p")).agg(F.min("page_id").alias("canonical"))
    moved = pages.select(F.concat(F.lit("/old/"), i.cast("string")).alias("p"), i.alias("redirect"))
    titled = pages.groupBy(F.col("slug").alias("last")).agg(F.min("page_id").alias("slug"), F.count("*").alias("n")).where("n = 1").drop("n")
    out = links.join(known, "p", "left").join(moved, "p", "left").join(titled, "last", "left")
    rules = ("canonical", "redirect", "slug")
    return out.select("page_id", F.coalesce(*rules).alias("target"), F.coalesce(*(F.when(F.col(r).isNotNull(), r) for r in rules), F.lit("unresolved")).alias("kind"))
