"""Episodes, rollouts, resumed work, scopes, closures and URL cascades over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graph
from .answers import RUNS
from .checks import EVENTS, URL, _events, normal_url
from .registry import query, table, views
from .retrieval import LINKS, PAGES, _methods, documents, links, questions, retriever


@query(
    "trc01_call_results",
    f"WITH {EVENTS} SELECT a.conv_id, a.turn, a.tool, CASE WHEN b.text IS NULL THEN 'missing' WHEN length(trim(b.text)) = 0 THEN 'empty' ELSE 'ok' END AS status, CAST(length(b.text) AS BIGINT) AS n, substr(b.text, 1, 2000) AS preview FROM ev a LEFT JOIN ev b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' WHERE a.tool IS NOT NULL",
)
def trc01(spark, d):
    """Calls with their results: status, length, a preview of 2000 characters."""
    ev = _events(spark, d)
    results = ev.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("result"))
    rows = ev.where("tool is not null").select("conv_id", "turn", "tool").join(results, ["conv_id", "turn"], "left")
    status = F.when(F.col("result").isNull(), "missing").when(F.length(F.trim("result")) == 0, "empty").otherwise("ok")
    return rows.select("conv_id", "turn", "tool", status.alias("status"), F.length("result").cast("bigint").alias("n"), F.substring("result", 1, 2000).alias("preview"))


@query("jon11_ordered_results", f"WITH {EVENTS}, c AS (SELECT conv_id, turn // 4 AS id, min(turn) AS called FROM ev WHERE tool IS NOT NULL GROUP BY ALL), r AS (SELECT conv_id, turn // 4 AS id, turn, length(text) AS n FROM ev WHERE role = 'assistant') SELECT c.conv_id, c.id, called, max(r.turn) AS answered, CAST(arg_max(r.n, r.turn) AS BIGINT) AS n FROM c LEFT JOIN r ON r.conv_id = c.conv_id AND r.id = c.id GROUP BY c.conv_id, c.id, called")
def jon11(spark, d):
    """Calls joined with their results by id; of several results the last one stands."""
    ev = _events(spark, d).withColumn("id", F.floor(F.col("turn") / 4))
    calls = ev.where("tool is not null").groupBy("conv_id", "id").agg(F.min("turn").alias("called"))
    results = ev.where("role = 'assistant'").groupBy("conv_id", "id").agg(F.max("turn").alias("answered"), F.max_by(F.length("text"), "turn").cast("bigint").alias("n"))
    return calls.join(results, ["conv_id", "id"], "left")


@query(
    "trc04_trace_summary",
    f"""WITH {EVENTS} SELECT conv_id, count(*) AS steps, count(DISTINCT role) AS speakers, string_agg(coalesce(tool, role), '>' ORDER BY turn) AS sequence, CAST(sum(CASE WHEN role <> 'assistant' THEN ceil(length(text) / 4.0) ELSE 0 END) AS BIGINT) AS input_tokens,
    CAST(sum(CASE WHEN role = 'assistant' THEN ceil(length(text) / 4.0) ELSE 0 END) AS BIGINT) AS output_tokens, count(DISTINCT tool) AS tools, arg_max(role, turn) = 'assistant' AS success FROM ev GROUP BY conv_id""",
)
def trc04(spark, d):
    """An episode in a row: steps, speakers, their sequence, tokens in and out, tools, whether it ends in an answer."""
    tokens = F.ceil(F.length("text") / 4.0)
    answer = F.col("role") == "assistant"
    order = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("tool", "role").alias("what"))))  # of one episode
    out = _events(spark, d).groupBy("conv_id").agg(
        F.count("*").alias("steps"), F.countDistinct("role").alias("speakers"), order.alias("o"), F.sum(F.when(answer, 0).otherwise(tokens)).cast("bigint").alias("input_tokens"),
        F.sum(F.when(answer, tokens).otherwise(0)).cast("bigint").alias("output_tokens"), F.countDistinct("tool").alias("tools"), (F.max_by("role", "turn") == "assistant").alias("success"),
    )
    return out.withColumn("sequence", F.array_join(F.transform("o", lambda x: x["what"]), ">")).drop("o")


STATE = "state AS (SELECT l.doc_id, sha256(CASE WHEN l.doc_id % 4 = 0 THEN 'before ' ELSE '' END || text) AS seen, quality = 1 AS agent_ok FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


@query("trc08_pending", f"WITH {STATE} SELECT d.doc_id, CASE WHEN s.doc_id IS NULL THEN 'new' WHEN NOT agent_ok THEN 'failed' ELSE 'changed' END AS why FROM documents d LEFT JOIN state s ON s.doc_id = d.doc_id WHERE s.doc_id IS NULL OR NOT agent_ok OR seen <> sha256(text)")
def trc08(spark, d):
    """What a resumed run has to do: inputs without a state, failed ones, and those whose fingerprint changed."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    prefix = F.when(F.col("doc_id") % 4 == 0, "before ").otherwise("")
    state = table(spark, d, "labels").join(docs, "doc_id").select("doc_id", F.sha2(F.concat(prefix, "text"), 256).alias("seen"), (F.col("quality") == 1).alias("agent_ok"))
    rows = docs.select("doc_id", F.sha2("text", 256).alias("now")).join(state, "doc_id", "left")
    why = F.when(F.col("seen").isNull(), "new").when(~F.col("agent_ok"), "failed").when(F.col("seen") != F.col("now"), "changed")
    return rows.select("doc_id", why.alias("why")).where("why is not null")


@query(
    "val09_arm_contract",
    f"""WITH r AS (SELECT * FROM ({RUNS}) WHERE NOT (arm = 'graph' AND qid % 13 = 5)), c AS (SELECT *, CASE WHEN arm = 'hybrid' AND qid % 17 = 3 THEN 'k=5' ELSE 'k=10' END AS contract FROM r)
    SELECT arm, count(*) AS n, count(DISTINCT contract) = 1 AS one_contract, (SELECT count(*) FROM benchmark) - count(DISTINCT qid) AS missing, concat_ws(';', CASE WHEN count(DISTINCT qid) <> (SELECT count(*) FROM benchmark) THEN 'ids' END, CASE WHEN count(DISTINCT contract) <> 1 THEN 'contract' END) AS errors FROM c GROUP BY arm""",
)
def val09(spark, d):
    """Rollouts of every arm: the expected questions, and one contract; here an arm lacks some, another mixes two."""
    views(spark, d, "benchmark")
    contract = F.when((F.col("arm") == "hybrid") & (F.col("qid") % 17 == 3), "k=5").otherwise("k=10")
    rows = spark.sql(RUNS).where("NOT (arm = 'graph' AND qid % 13 = 5)").withColumn("contract", contract)
    expected = table(spark, d, "benchmark").agg(F.countDistinct("item_id").alias("expected"))
    out = rows.groupBy("arm").agg(F.count("*").alias("n"), F.countDistinct("contract").alias("contracts"), F.countDistinct("qid").alias("ids")).crossJoin(F.broadcast(expected))  # one row
    errors = F.concat_ws(";", F.when(F.col("ids") != F.col("expected"), "ids"), F.when(F.col("contracts") != 1, "contract"))
    return out.select("arm", "n", (F.col("contracts") == 1).alias("one_contract"), (F.col("expected") - F.col("ids")).alias("missing"), errors.alias("errors"))


@query("val10_linkage", f"WITH r AS ({RUNS}), j AS (SELECT qid, arm FROM r WHERE NOT (arm = 'files' AND qid % 7 = 2) UNION ALL SELECT qid, 'other' FROM r WHERE arm = 'files' AND qid % 9 = 4), x AS (SELECT coalesce(r.qid, j.qid) AS qid, CASE WHEN j.arm IS NULL THEN 'unjudged' WHEN r.arm IS NULL THEN 'unknown_label' END AS error FROM r FULL JOIN j ON r.qid = j.qid AND r.arm = j.arm) SELECT qid, string_agg(error, ';' ORDER BY error) AS errors FROM x WHERE error IS NOT NULL GROUP BY qid")
def val10(spark, d):
    """Judgments whose candidates aren't those that were run: labels that no run has, and runs that no judgment has."""
    views(spark, d, "benchmark")
    runs = spark.sql(RUNS).select("qid", "arm")
    judged = runs.where("NOT (arm = 'files' AND qid % 7 = 2)").union(runs.where("arm = 'files' AND qid % 9 = 4").select("qid", F.lit("other")))
    both = runs.withColumn("run", F.lit(True)).join(judged.withColumn("seen", F.lit(True)), ["qid", "arm"], "full")
    error = F.when(F.col("seen").isNull(), "unjudged").when(F.col("run").isNull(), "unknown_label")
    return both.select("qid", error.alias("e")).where("e is not null").groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list("e")), ";").alias("errors"))  # an error an arm


@query("hlp05_candidate_packet", f"WITH {_methods(False)}, ten AS (SELECT qid, doc_id, rank FROM hybrid WHERE rank <= 10), k AS (SELECT ten.qid, ten.doc_id, ten.rank, docs.text FROM ten JOIN docs ON docs.doc_id = ten.doc_id WHERE docs.doc_id % 6 <> 1) SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS place, sha256(text) AS digest FROM k")
def hlp05(spark, d):
    """The first ten ranked pages of each question with their text, in order; pages that the corpus lacks are passed over."""
    r, q = retriever(spark, d, stored=False), questions(spark, d)
    ranked = r.fused(q).where("rank <= 10").select("qid", "doc_id", "rank")
    texts = documents(spark, d).where("doc_id % 6 <> 1").select("doc_id", F.sha2("text", 256).alias("digest"))
    rows = texts.join(F.broadcast(ranked) if ranked.limit(200_001).count() <= 200_000 else ranked, "doc_id")
    return rows.select("qid", "doc_id", F.row_number().over(Window.partitionBy("qid").orderBy("rank")).cast("bigint").alias("place"), "digest")


@query("scp02_scope_intersection", f"WITH {PAGES}, r AS (SELECT qid, project, project || '/src' || qid % 20 || '/' AS prefix, CASE WHEN qid % 7 = 0 THEN 'xx' ELSE project END AS enforced FROM qs) SELECT qid, count(docs.doc_id) AS pages FROM r LEFT JOIN docs ON docs.project = r.enforced AND starts_with(docs.route, r.prefix) GROUP BY qid")
def scp02(spark, d):
    """Pages below a request's prefix that lie in the project it is held to; a prefix of another project leaves none."""
    asked = questions(spark, d).select("qid", F.concat("project", F.lit("/src"), (F.col("qid") % 20).cast("string"), F.lit("/")).alias("prefix"), F.when(F.col("qid") % 7 == 0, "xx").otherwise(F.col("project")).alias("project"))
    parts = F.split("route", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/")))
    pages = documents(spark, d).select("project", F.explode(above).alias("prefix")).groupBy("project", "prefix").agg(F.count("*").alias("pages"))
    return asked.join(pages, ["project", "prefix"], "left").select("qid", F.coalesce("pages", F.lit(0)).cast("bigint").alias("pages"))


@query("src14_link_closure", f"WITH RECURSIVE {PAGES}, {LINKS}, c(root, node) AS (SELECT root, root FROM (SELECT min(doc_id) AS root FROM docs GROUP BY project) UNION SELECT root, target_id FROM c JOIN lk ON source_id = node) SELECT root, count(*) AS reached, CAST(sum(node) AS BIGINT) AS total FROM c GROUP BY root")
def src14(spark, d):
    """Everything that links lead to from the first page of each project."""
    seeds = documents(spark, d).groupBy("project").agg(F.min("doc_id").alias("root")).select("root")
    return graph.closure(seeds, links(spark, d)).groupBy("root").agg(F.count("*").alias("reached"), F.sum("node").alias("total"))


# Links of all pages: some as they are, some in another spelling, some through a redirect, some to a changed locale or unknown
LINKED = f"""pg AS (SELECT page_id, url, {URL.format(x='url')} AS canonical, regexp_replace(regexp_replace({URL.format(x='url')}, '[?].*$', ''), '/(en|fr|de|es)/', '/') AS plain, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]+)/*$', 1) AS slug FROM pages),
asked AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN upper(url) WHEN 2 THEN 'https://old.example.com/r/' || page_id WHEN 3 THEN regexp_replace(regexp_replace(url, '[?#].*$', ''), '/(en|fr|de|es)/', '/it/') WHEN 4 THEN 'http://moved.example.com/' || slug ELSE 'http://nowhere.example.com/none/' || page_id END AS link, page_id % 6 AS k FROM pg)"""
LADDER = ("exact", "canonical", "redirect", "locale", "slug")


@query(
    "nrm02_url_cascade",
    f"""WITH {LINKED}, ex AS (SELECT url AS key, min(page_id) AS t FROM pg GROUP BY url), ca AS (SELECT lower(canonical) AS key, min(page_id) AS t FROM pg GROUP BY 1), re AS (SELECT 'https://old.example.com/r/' || page_id AS key, page_id AS t FROM pages),
    lo AS (SELECT lower(plain) AS key, min(page_id) AS t FROM pg GROUP BY 1), sl AS (SELECT lower(slug) AS key, min(page_id) AS t FROM pg GROUP BY 1 HAVING count(*) = 1),
    j AS (SELECT a.page_id, ex.t AS e, ca.t AS c, re.t AS r, lo.t AS l, sl.t AS s FROM asked a LEFT JOIN ex ON ex.key = a.link LEFT JOIN ca ON ca.key = lower({URL.format(x='a.link')}) LEFT JOIN re ON re.key = a.link
      LEFT JOIN lo ON lo.key = lower(regexp_replace(regexp_replace({URL.format(x='a.link')}, '[?].*$', ''), '/(en|fr|de|es|it)/', '/')) LEFT JOIN sl ON sl.key = lower(regexp_extract(regexp_replace(a.link, '[?#].*$', ''), '([^/]+)/*$', 1)))
    SELECT page_id, coalesce(e, c, r, l, s) AS target, CASE WHEN e IS NOT NULL THEN 'exact' WHEN c IS NOT NULL THEN 'canonical' WHEN r IS NOT NULL THEN 'redirect' WHEN l IS NOT NULL THEN 'locale' WHEN s IS NOT NULL THEN 'slug' ELSE 'unresolved' END AS method, coalesce(e, c, r) IS NOT NULL AS verified FROM j""",
)
def nrm02(spark, d):
    """Links to pages by the first of five rules that knows them: the URL, its normal form, a redirect, the path without locale, a slug that one page has."""
    bare = lambda u: F.regexp_replace(u, "[?#].*$", "")
    slug = lambda u: F.regexp_extract(bare(u), "([^/]+)/*$", 1)
    plain = lambda u, locales: F.lower(F.regexp_replace(F.regexp_replace(normal_url(u), "[?].*$", ""), f"/({locales})/", "/"))
    url, i = F.col("url"), F.col("page_id")
    pages = table(spark, d, "pages").select("page_id", "url")
    shapes = [url, F.upper(url), F.concat(F.lit("https://old.example.com/r/"), i.cast("string")), F.regexp_replace(bare(url), "/(en|fr|de|es)/", "/it/"), F.concat(F.lit("http://moved.example.com/"), slug(url)), F.concat(F.lit("http://nowhere.example.com/none/"), i.cast("string"))]
    asked = pages.select("page_id", F.element_at(F.array(*shapes), (i % 6 + 1).cast("int")).alias("link"))

    def known(name: str, key: Column, unique: bool = False) -> DataFrame:
        found = pages.groupBy(key.alias(f"{name}_key")).agg(F.min("page_id").alias(name), F.count("*").alias("n"))
        return (found.where("n = 1") if unique else found).drop("n")

    rules = {
        "exact": (known("exact", url), F.col("link")), "canonical": (known("canonical", F.lower(normal_url(url))), F.lower(normal_url(F.col("link")))),
        "redirect": (known("redirect", F.concat(F.lit("https://old.example.com/r/"), i.cast("string"))), F.col("link")),
        "locale": (known("locale", plain(url, "en|fr|de|es")), plain(F.col("link"), "en|fr|de|es|it")), "slug": (known("slug", F.lower(slug(url)), True), F.lower(slug(F.col("link")))),
    }
    for name, (found, key) in rules.items():
        asked = asked.withColumn(f"{name}_key", key).join(found, f"{name}_key", "left").drop(f"{name}_key")
    method = F.coalesce(*(F.when(F.col(r).isNotNull(), r) for r in LADDER), F.lit("unresolved"))
    return asked.select("page_id", F.coalesce(*LADDER).alias("target"), method.alias("method"), F.coalesce(*LADDER[:3]).isNotNull().alias("verified"))
