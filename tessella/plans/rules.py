"""Replies, specifications, summaries and graph nodes by all of their rules, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import stable_id
from ..operators import answers, citations, contract, graph, lexical, projection, stats
from .registry import query, table
from .retrieval import EXPANDED, LINKS, MENTIONS, PAGES, QRELS, _methods, documents, expansion, links, mentions, qrels, questions
from .texts import made, made_sql

REPLIES = [
    '{"answer": "ok §id§", "sources": ["a/§id§", "b"]}', '{"answer": 5, "sources": ["a"]}', '{"answer": "x §lang§"}', '{"answer": "x", "sources": ["a", "a", " ", 3], "zz": 1}', "not json §id§ {",
    "[1, 2]", '{"answer": "x", "sources": ["1", "2", "3", "4", "5", "6", "7", "8", "9", "10", "§id§x"]}', '{"answer": null, "sources": "a", "b": 1, "a": 2}', ' {"sources": [], "answer": ""} ',
]


@query(
    "val11_json_contract",
    """SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN '' WHEN 1 THEN 'answer_not_string' WHEN 2 THEN 'missing_keys:sources;sources_not_array' WHEN 3 THEN 'unexpected_keys:zz;invalid_sources' WHEN 4 THEN 'invalid_json' WHEN 5 THEN 'output_not_object' WHEN 6 THEN 'too_many_sources'
      WHEN 7 THEN 'unexpected_keys:a,b;answer_not_string;sources_not_array' ELSE '' END AS errors, CASE doc_id % 9 WHEN 0 THEN 'ok ' || doc_id WHEN 2 THEN 'x ' || lang WHEN 3 THEN 'x' WHEN 6 THEN 'x' ELSE '' END AS answer,
      CASE doc_id % 9 WHEN 0 THEN 'a/' || doc_id || ',b' WHEN 1 THEN 'a' WHEN 3 THEN 'a' WHEN 6 THEN '1,2,3,4,5,6,7,8,9,10' ELSE '' END AS sources, CASE doc_id % 9 WHEN 3 THEN '1:duplicate,2:empty,3:not_string' ELSE '' END AS invalid FROM documents""",
)
def val11(spark, d):
    """The JSON contract of replies: keys, types, ten distinct sources at most, every source that isn't one."""
    out = contract.replies(table(spark, d, "documents").select("doc_id", made("documents", REPLIES).alias("reply")), "reply")
    return out.select("doc_id", "errors", "answer", F.array_join("sources", ",").alias("sources"), F.array_join("invalid", ",").alias("invalid"))


@query(
    "hlp12_first_json",
    """SELECT doc_id, doc_id % 5 <> 1 AND doc_id % 5 <> 3 AS found, CASE doc_id % 5 WHEN 0 THEN text WHEN 2 THEN text WHEN 4 THEN '}' || n_chars || '{' END AS k FROM documents""",
)
def hlp12(spark, d):
    """The object in a reply: nested seven levels deep behind a fence, among words, with braces in its strings; none where two objects or no object stand."""
    i, k, props = F.col("doc_id") % 5, F.col("n_chars").cast("string"), F.to_json(F.struct(F.col("text").alias("k")))
    deep = F.concat(F.lit('```json\n{"a": {"b": {"c": {"d": {"e": {"f": '), props, F.lit("}}}}}}\n```"))
    text = F.when(i == 0, deep).when(i == 1, "none at all").when(i == 2, F.concat(F.lit('Here: {"a": {"b": '), props, F.lit("}} I hope."))).when(i == 3, F.concat(F.lit("first {} then "), props, F.lit(" {"), F.lit("}"))).otherwise(F.concat(F.lit('So {"k": "}'), k, F.lit('{"}')))
    rows = table(spark, d, "documents").select("doc_id", i.alias("i"), contract.object_in(text).alias("v"))
    path = lambda p: F.try_variant_get("v", p, "string")
    return rows.select("doc_id", F.col("v").isNotNull().alias("found"), F.when(F.col("i") == 0, path("$.a.b.c.d.e.f.k")).when(F.col("i") == 2, path("$.a.b.k")).otherwise(path("$.k")).alias("k"))


@query(
    "src18_specifications",
    """WITH s AS (SELECT doc_id AS c, CASE WHEN doc_id % 12 = 1 THEN 'Bad_' || doc_id WHEN doc_id % 12 = 2 THEN 'same-' || doc_id // 24 ELSE 'source-' || doc_id END AS id, CASE WHEN doc_id % 12 = 3 THEN 'shared/' || doc_id // 24 WHEN doc_id % 12 = 4 THEN '/abs/' || doc_id ELSE 'checkout/' || doc_id END AS checkout FROM documents),
    t AS (SELECT *, count(*) OVER (PARTITION BY id) AS a, count(*) OVER (PARTITION BY checkout) AS b FROM s)
    SELECT id, array_to_string(list_filter([CASE WHEN c % 12 = 1 THEN 'invalid_id' END, CASE WHEN a > 1 THEN 'duplicate_id' END, CASE WHEN b > 1 THEN 'duplicate_checkout' END, CASE WHEN c % 12 = 5 THEN 'revision' END, CASE WHEN c % 12 = 6 THEN 'repository' END, CASE WHEN c % 12 = 7 THEN 'normalizer' END,
      CASE WHEN c % 12 = 8 THEN 'no_hosts' END, CASE WHEN c % 12 = 9 THEN 'no_content_roots' END, CASE WHEN c % 12 IN (4, 10) THEN 'unsafe_path' END], lambda x: x IS NOT NULL), ';') AS errors FROM t""",
)
def src18(spark, d):
    """A specification for every document, and what is wrong with it."""
    c, k = F.col("doc_id"), F.col("doc_id") % 12
    named = lambda head, n: F.concat(F.lit(head), n.cast("string"))
    specs = table(spark, d, "documents").select(
        F.when(k == 1, named("Bad_", c)).when(k == 2, named("same-", F.floor(c / 24))).otherwise(named("source-", c)).alias("id"), F.when(k == 5, F.substring(F.sha1(c.cast("string")), 1, 39)).otherwise(F.upper(F.sha1(c.cast("string")))).alias("revision"),
        F.when(k == 6, "git@github.com:a/b.git").otherwise(F.concat(named("https://github.com/a/r", c), F.lit(".git"))).alias("repository"), F.when(k == 3, named("shared/", F.floor(c / 24))).when(k == 4, named("/abs/", c)).otherwise(named("checkout/", c)).alias("checkout"),
        F.when(k == 7, "other").otherwise("prisma").alias("normalizer"), F.when(k == 8, F.array().cast("array<string>")).otherwise(F.array(F.lit("docs.example.com"))).alias("hosts"),
        F.when(k == 9, F.lit(None)).when(k == 10, F.array(F.lit("docs"), F.lit("a/../b"))).otherwise(F.array(F.lit("docs"))).alias("content_roots"),
    )
    return contract.specifications(specs)


# --- rollouts: a document is an arm's answer to a question

_MEANS = ", ".join(f"round(avg(CASE WHEN doc_id % 17 = {n % 17} THEN 0 ELSE (doc_id * {n + 3} % 11) / 10.0 END), 6) AS {m}" for n, m in enumerate(stats.ROLLOUT_MEASURES))
_TOKENS = ", ".join(f"round(avg(CASE WHEN doc_id % 13 = {n} THEN 0 ELSE n_chars * {n + 1} % 1000 END), 6) AS tokens_{t}" for n, t in enumerate(stats.TOKEN_FIELDS))


@query(
    "agg03_agent_summary",
    f"""SELECT CASE doc_id % 4 WHEN 0 THEN 'fs' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'graph' ELSE 'unknown' END AS arm, count(*) AS questions, {_MEANS}, round(quantile_cont(n_chars / 1000.0, 0.5) * 1000, 6) AS latency_p50_ms, round(quantile_cont(n_chars / 1000.0, 0.95) * 1000, 6) AS latency_p95_ms, {_TOKENS},
    round(avg(CASE WHEN doc_id % 19 = 0 THEN 0 ELSE doc_id % 5 END), 6) AS tool_calls_per_qa, round(avg(CASE WHEN doc_id % 10 = 0 THEN 1.0 ELSE 0 END), 6) AS failure_rate, round(avg(CASE WHEN doc_id % 19 <> 0 AND doc_id % 5 >= 3 THEN 1.0 ELSE 0 END), 6) AS graph_expansion_attempt_rate,
    round(avg(CASE WHEN doc_id % 6 > 3 THEN 1.0 ELSE 0 END), 6) AS graph_application_rate, round(avg(greatest(0, doc_id % 6 - 3)), 6) AS graph_expansion_successes_per_qa, string_agg(DISTINCT 'model-' || source, ',' ORDER BY 'model-' || source) AS models FROM documents GROUP BY 1""",
)
def agg03s(spark, d):
    """A row per arm: all thirty measures, latencies, tokens, tools, failures, expansions, models."""
    i, n = F.col("doc_id"), F.col("n_chars")
    measures = [F.when(i % 17 != k % 17, (i * (k + 3) % 11) / 10.0).alias(m) for k, m in enumerate(stats.ROLLOUT_MEASURES)]
    usage = F.map_from_entries(F.filter(F.array(*(F.when(i % 13 != k, F.struct(F.lit(t), n * (k + 1) % 1000)) for k, t in enumerate(stats.TOKEN_FIELDS))), lambda x: x.isNotNull()))
    tools = F.slice(F.array(*map(F.lit, ("docsqa_search", "docsqa_fetch", "docsqa_expand", "read"))), F.lit(1), (i % 5).cast("int"))
    rollouts = table(spark, d, "documents").select(
        F.element_at(F.array(F.lit("fs"), F.lit("hybrid"), F.lit("graph"), F.lit(None)), (i % 4 + 1).cast("int")).alias("arm"), *measures, (n / 1000.0).alias("latency_seconds"), usage.alias("usage"), F.when(i % 19 != 0, tools).alias("tool_sequence"),
        (i % 10 != 0).alias("agent_ok"), F.array(F.concat(F.lit("model-"), "source")).alias("models"), F.greatest(F.lit(0), i % 6 - 3).alias("expansions"),
    )
    out = stats.agent_summary(rollouts, ["arm"])
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else F.array_join(c, ",").alias(c) if c == "models" else c for c, t in out.dtypes))


@query(
    "txt37_passage",
    rf"""WITH q AS (SELECT item_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]{{3,}}')))[1:6] AS terms FROM benchmark), z AS (SELECT min(item_id) AS low, max(item_id) - min(item_id) + 1 AS n FROM benchmark),
    p AS (SELECT doc_id, coalesce(terms, []) AS terms, string_split({made_sql("documents", ["# Top §id§\n§text§\n## Sec §lang§\n§text§", "§text§"])}, chr(10)) AS b FROM documents CROSS JOIN z LEFT JOIN q ON q.item_id = low + doc_id % n),
    l AS (SELECT doc_id, b, unnest(range(len(b))) AS i, unnest(b) AS body, terms FROM p),
    s AS (SELECT doc_id, b, i, coalesce(list_sum(list_transform(terms, lambda t: (length(lower(body)) - length(replace(lower(body), t, ''))) // length(t))), 0) AS c FROM l),
    m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, i) = 1), e AS (SELECT *, least(len(b), greatest(0, i - 6) + 18) AS stop FROM m)
    SELECT doc_id, CAST(greatest(0, stop - 18) + 1 AS INT) AS start, CAST(stop AS INT) AS "end", coalesce(trim(regexp_replace(list_filter(b[1:i + 1], lambda x: starts_with(x, '#'))[-1], '^#+', '')), '') AS section, sha256(regexp_replace(array_to_string(b[greatest(0, stop - 18) + 1:stop], chr(10)), '^\s+|\s+$', '', 'g')) AS passage FROM e""",
)
def txt37(spark, d):
    """The passage of each document, with headings put in, that answers its question best."""
    asked = table(spark, d, "benchmark").select("item_id", F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)))), 1, 6).alias("terms"))
    n = asked.agg(F.min("item_id").alias("low"), (F.max("item_id") - F.min("item_id") + 1).alias("n"))
    docs = table(spark, d, "documents").select("doc_id", made("documents", ["# Top §id§\n§text§\n## Sec §lang§\n§text§", "§text§"]).alias("text")).crossJoin(F.broadcast(n))  # one row
    met = docs.withColumn("item_id", F.col("low") + F.col("doc_id") % F.col("n")).join(lexical.few(asked, 100_000), "item_id", "left")
    met = met.select("doc_id", "text", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))
    return stats.passages(met).withColumn("passage", F.sha2("passage", 256))


# --- nodes of a graph store

@query("grf08_route_nodes", f"WITH {PAGES} SELECT 'route-' || substr(sha256(project || chr(0) || route), 1, 24) AS id, project, route, count(*) AS document_count FROM docs GROUP BY project, route")
def grf08(spark, d):
    """Routes as nodes of their project, with the number of their pages."""
    out = documents(spark, d).groupBy("project", "route").agg(F.count("*").alias("document_count"))
    return out.select(stable_id("route", F.col("project"), F.col("route")).alias("id"), "project", "route", "document_count")


@query("grf09_reusable_mentions", f"WITH {MENTIONS.split('claims AS')[0].rstrip().rstrip(',')} SELECT entity, count(DISTINCT doc_id) AS document_count FROM (SELECT * FROM mentions UNION ALL SELECT doc_id, kind, entity FROM mentions WHERE doc_id % 5 = 0) WHERE kind = 'shared_reusable' GROUP BY entity")
def grf09(spark, d):
    """Reusables and how many pages mention them, however often each does."""
    made_twice = mentions(spark, d).where("kind = 'shared_reusable'")
    rows = made_twice.union(made_twice.where("doc_id % 5 = 0"))
    return graph.mention_counts(rows).select("entity", "document_count")


@query(
    "grf10_code_mentions",
    f"WITH {PAGES}, {MENTIONS.split('claims AS')[0].rstrip().rstrip(',')} SELECT 'code-' || substr(sha256(project || chr(0) || entity), 1, 24) AS id, project, entity, count(DISTINCT docs.doc_id) AS document_count FROM mentions JOIN docs ON docs.doc_id = mentions.doc_id WHERE kind = 'shared_code_entity' GROUP BY project, entity HAVING count(DISTINCT docs.doc_id) BETWEEN 2 AND 30",
)
def grf10(spark, d):
    """Code entities of a project that 2 to 30 of its pages mention."""
    rows = mentions(spark, d).where("kind = 'shared_code_entity'").join(documents(spark, d).select("doc_id", "project"), "doc_id")
    found = graph.mention_counts(rows, ["project"]).where(F.col("document_count").between(2, 30))
    return found.select(stable_id("code", F.col("project"), F.col("entity")).alias("id"), "project", "entity", "document_count")


@query(
    "grf07_ingest",
    f"""WITH {PAGES}, {LINKS}, k AS (SELECT doc_id FROM docs WHERE doc_id % 9 <> 4), e AS (SELECT edge, source_id, target_id FROM lk WHERE source_id IN (SELECT doc_id FROM k) AND target_id IN (SELECT doc_id FROM k))
    SELECT 'node' AS kind, CAST(doc_id AS VARCHAR) AS id, '' AS other FROM k UNION ALL SELECT 'edge', CAST(source_id AS VARCHAR), CAST(target_id AS VARCHAR) FROM e""",
)
def grf07(spark, d):
    """Pages and links as a store takes them: ids once, links between pages that are there."""
    nodes = documents(spark, d).where("doc_id % 9 <> 4").select("doc_id")
    edges = links(spark, d).select("source_id", "target_id")
    n, e = graph.ingested(nodes, edges, "doc_id")
    return n.select(F.lit("node").alias("kind"), F.col("doc_id").cast("string").alias("id"), F.lit("").alias("other")).union(e.select(F.lit("edge"), F.col("source_id").cast("string"), F.col("target_id").cast("string")))


# --- evidence, path types, projections

@query(
    "met11_bound_evidence",
    """WITH v AS (SELECT doc_id AS qid, CAST(unnest(range(0, 6)) AS BIGINT) AS k FROM documents),
    e AS (SELECT qid, k, (qid + k) % 4 <> 3 AND NOT ((qid + k) % 5 = 1 AND (qid * k) % 3 <> 0) AS good FROM v),
    a AS (SELECT doc_id AS qid, CAST(unnest(range(0, 3)) AS BIGINT) AS a FROM documents),
    n AS (SELECT qid, a, CASE WHEN (qid + a) % 7 = 0 THEN [a, 99] ELSE [a, a + 1] END AS ids FROM a),
    g AS (SELECT qid, coalesce(list(k) FILTER (good), []) AS goods FROM e GROUP BY qid),
    w AS (SELECT n.*, len(list_filter(ids, lambda k: NOT list_contains(goods, k))) > 0 AS bad, list_filter([(a + 1) % 6, (a + 3) % 6, (a + 3) % 6, (a + 4) % 6], lambda k: list_contains(goods, k)) AS c FROM n JOIN g ON g.qid = n.qid),
    u AS (SELECT *, list_filter(c, lambda k, i: list_position(c, k) = i) AS d FROM w)
    SELECT qid, CAST(a AS INT) AS aspect_id, array_to_string(list_transform(CASE WHEN bad AND len(d) > 0 THEN d ELSE ids END, lambda k: 'e' || k), ',') AS evidence_ids, bad AND len(d) > 0 AS repaired FROM u""",
)
def met11b(spark, d):
    """Evidence ids of three aspects a document, bound anew from two claims each where they name evidence that is unknown or can't bear them."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("qid"))
    e = lambda k: F.concat(F.lit("e"), k.cast("string"))
    a, q, k = F.col("aspect_id"), F.col("qid"), F.col("k")
    aspects = docs.select("qid", F.explode(F.array(*map(F.lit, range(3)))).alias("aspect_id"))
    claim = lambda n: F.concat(F.lit(f"c{n}-"), a.cast("string"))
    mapped = aspects.select("qid", "aspect_id", F.when((q + a) % 7 == 0, F.array(e(a), F.lit("e99"))).otherwise(F.array(e(a), e(a + 1))).alias("evidence_ids"), F.array(claim(1), claim(2)).alias("claim_ids"))
    claims = aspects.select("qid", claim(1).alias("claim_id"), F.array(e((a + 1) % 6), e((a + 3) % 6)).alias("evidence_ids")).union(aspects.select("qid", claim(2), F.array(e((a + 3) % 6), e((a + 4) % 6))))
    v = docs.select("qid", F.explode(F.array(*map(F.lit, range(6)))).alias("k"))
    kinds = F.element_at(F.array(*map(F.lit, ("local_document_section", "answer_text", "image_text", "external_page"))), ((q + k) % 4 + 1).cast("int"))
    evidence = v.select("qid", e(k).alias("evidence_id"), kinds.alias("kind"), F.when((q + k) % 5 == 1, q).alias("doc_id"), F.when((q * k) % 3 == 0, "docs/a.md").alias("local_path"))
    return answers.bound_evidence(mapped, claims, evidence).select("qid", "aspect_id", F.array_join("evidence_ids", ",").alias("evidence_ids"), "repaired")


@query("fus03_path_types", f"WITH {_methods(False)}, {EXPANDED} SELECT qid, path, count(*) AS pages FROM (SELECT qid, unnest(string_split(paths, ',')) AS path FROM granked WHERE rank <= 10) GROUP BY qid, path")
def fus03_paths(spark, d):
    """By what kinds of paths the graph reached its first ten pages, for each question."""
    found = expansion(spark, d)[1].where("rank <= 10")
    return found.select("qid", F.explode("paths").alias("path")).groupBy("qid", "path").agg(F.count("*").alias("pages"))


@query(
    "src11_namespaced_questions",
    f"""WITH {PAGES}, {QRELS}, g AS (SELECT qid, list_sort(list(doc_id)) AS ids FROM qrels GROUP BY qid)
    SELECT qs.qid, project || '::' || qs.qid AS question_id, array_to_string(list_transform(coalesce(ids, []), lambda i: project || '::' || i), ',') AS qrel_ids,
      array_to_string(list_transform(list_filter(coalesce(ids, []), lambda i: i % 2 = 0), lambda i: project || '::' || i || '=part-' || i % 7), ',') AS anchors FROM qs LEFT JOIN g ON g.qid = qs.qid""",
)
def src11q(spark, d):
    """Questions in their project's namespace: ids in arrays and as keys of maps; of the anchors those of pages that are still judged."""
    judged = qrels(spark, d).groupBy("qid").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))  # a question's judged pages
    rows = questions(spark, d).join(judged, "qid", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<bigint>")))
    marks = F.map_from_entries(F.transform(F.concat(F.filter("ids", lambda i: i % 2 == 0), F.array(F.lit(-1).cast("bigint"))), lambda i: F.struct(i, F.concat(F.lit("part-"), (i % 7).cast("string")))))
    out = projection.namespaced(rows.withColumn("anchors", marks), "project", "qid", ["ids"], ["anchors"])
    kept = F.map_filter("anchors", lambda k, v: F.array_contains("ids", k))
    pairs = F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select("qid", "question_id", F.array_join("ids", ",").alias("qrel_ids"), F.array_join(pairs, ",").alias("anchors"))


@query(
    "nrm02_qrel_cascade",
    """WITH p AS (SELECT page_id AS q, page_id % 9 AS k FROM pages)
    SELECT q AS qid, CASE k WHEN 0 THEN 'https://x.org/asked/' || q || '#Here%20It' WHEN 1 THEN 'https://x.org/Old/' || q WHEN 2 THEN 'http://y.org/moved/' || q WHEN 3 THEN 'https://x.org/r/page-' || q || '/#A b' WHEN 4 THEN 'https://x.org/elsewhere/page-' || q ELSE 'https://x.org/none/' || q END AS url,
      CASE WHEN k IN (6, 7, 8) THEN NULL ELSE q END AS target, CASE k WHEN 0 THEN 'dataset_url_resolution' WHEN 1 THEN 'corpus_frontmatter_redirect' WHEN 2 THEN 'frozen_redirect_cache' WHEN 3 THEN 'exact_local_route' WHEN 4 THEN 'verified_unique_slug' WHEN 5 THEN 'verified_builder_single_qrel' ELSE 'unresolved' END AS method,
      CASE k WHEN 0 THEN 'live_http_redirect' WHEN 1 THEN 'frontmatter_redirect' WHEN 2 THEN 'redirect_cache' WHEN 3 THEN 'canonical' WHEN 4 THEN 'unique_slug' WHEN 5 THEN 'canonical_path' WHEN 6 THEN 'guessed' WHEN 7 THEN 'canonical' ELSE 'unresolved' END AS kind,
      CASE k WHEN 0 THEN 'part-' || q WHEN 1 THEN CAST(q AS VARCHAR) WHEN 3 THEN 'a-b' WHEN 4 THEN 'page-' || q END AS anchor, k < 6 AS verified FROM p""",
)
def nrm02q(spark, d):
    """A cited URL of every page, by each of six methods, by none, and where a page is known that isn't judged."""
    q = F.col("qid")
    k, name = q % 9, lambda head: F.concat(F.lit(head), q.cast("string"))
    pages = table(spark, d, "pages").select(F.col("page_id").alias("qid"))
    url = F.when(k == 0, F.concat(name("https://x.org/asked/"), F.lit("#Here%20It"))).when(k == 1, name("https://x.org/Old/")).when(k == 2, name("http://y.org/moved/")).when(k == 3, F.concat(name("https://x.org/r/page-"), F.lit("/#A b"))).when(k == 4, name("https://x.org/elsewhere/page-")).otherwise(name("https://x.org/none/"))
    kind = F.when(k == 4, "unique_slug").when(k == 5, "canonical_path").when(k == 6, "guessed").when(k == 7, "canonical")
    cited = pages.select("qid", url.alias("url"), kind.alias("kind"))
    judged = pages.select("qid", q.alias("doc_id")).union(pages.where(k == 7).select("qid", q + 1))
    routes = pages.select(q.alias("doc_id"), name("/r/page-").alias("route")).union(pages.where(k == 8).select(q + 100_000_000, name("/none/")))
    explicit = cited.where(k == 0).select("qid", "url", q.alias("doc_id"), F.lit("live_http_redirect").alias("kind"), name("Part ").alias("anchor")).union(cited.where(k == 8).select("qid", "url", q + 7, F.lit("canonical"), F.lit("x")))
    moved = pages.where(k == 1).select(q.alias("doc_id"), name("/old/").alias("route"))
    cache = cited.where(k == 2).select("url", name("https://x.org/r/page-").alias("redirected"))
    return citations.resolved(cited, judged, routes, explicit, moved, cache)
