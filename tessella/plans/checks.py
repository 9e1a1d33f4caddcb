"""Audits, fingerprints, requests and traces over whole tables, by their rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import delete, parked
from .answers import ARMS, ASPECTS
from .registry import query, table, views
from .retrieval import CHUNKS, EXPANDED, LINKS, MENTIONS, PAGES, QRELS, _methods, chunks, claims, documents, expansion, links, mentions, qrels, questions

# --- fingerprints and snapshots: a sum of row digests, so rows are added up wherever they lie, in any order

SUM = "sha256(count(*) || ':' || coalesce(sum(('0x' || substr(h, 1, 15))::BIGINT), 0))"


def fingerprint(rows: DataFrame, *parts: str) -> DataFrame:
    """One row, (n, fingerprint), of the rows' digests; rows that repeat count as often as they do."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("\0", *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts)), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    total = F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)")).cast("string")
    return rows.agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), total), 256).alias("fingerprint"))


@query("prv01_fingerprint", f"SELECT {SUM} AS fingerprint, count(*) AS n FROM (SELECT sha256(doc_id || chr(0) || lang || chr(0) || source || chr(0) || text) AS h FROM documents)")
def prv01(spark, d):
    """A fingerprint of a table (PRV01, HLP17)."""
    return fingerprint(table(spark, d, "documents"), "doc_id", "lang", "source", "text").select("fingerprint", "n")


SNAPSHOT = f"""{CHUNKS}, {LINKS}, snap AS (SELECT 'pages' AS part, count(*) AS n, {SUM} AS fingerprint FROM (SELECT sha256(doc_id || chr(0) || route || chr(0) || title) AS h FROM docs)
  UNION ALL SELECT 'chunks', count(*), {SUM} FROM (SELECT sha256(chunk_id || chr(0) || text) AS h FROM ch) UNION ALL SELECT 'links', count(*), {SUM} FROM (SELECT sha256(edge || chr(0) || source_id || chr(0) || target_id || chr(0) || text) AS h FROM links))"""


def snapshot(spark, d: str) -> DataFrame:
    parts = [("pages", documents(spark, d), ("doc_id", "route", "title")), ("chunks", chunks(spark, d), ("chunk_id", "text")), ("links", links(spark, d), ("edge", "source_id", "target_id", "text"))]
    return reduce(DataFrame.union, (fingerprint(df, *cols).select(F.lit(name).alias("part"), "n", "fingerprint") for name, df, cols in parts))


@query("grf05_snapshot", f"WITH {SNAPSHOT} SELECT * FROM snap")
def grf05(spark, d):
    """The fingerprints of what a graph store would hold: pages, chunks, links."""
    return snapshot(spark, d)


@query("grf06_snapshot_check", f"WITH {SNAPSHOT} SELECT part, CASE part WHEN 'pages' THEN 'match' WHEN 'chunks' THEN 'mismatch' ELSE 'missing' END AS status FROM snap")
def grf06(spark, d):
    """A snapshot against an observed one that lacks the links and has other chunks."""
    expected = snapshot(spark, d)
    observed = expected.where("part <> 'links'").select("part", F.when(F.col("part") == "chunks", F.reverse("fingerprint")).otherwise(F.col("fingerprint")).alias("observed"))
    status = F.when(F.col("observed").isNull(), "missing").when(F.col("observed") == F.col("fingerprint"), "match").otherwise("mismatch")
    return expected.join(observed, "part", "left").select("part", status.alias("status"))


@query("hlp16_inventory_digest", f"SELECT lang, count(*) AS n, {SUM} AS digest FROM (SELECT DISTINCT lang, lang || '/' || source AS path, sha256(lang || '/' || source || chr(0) || substr(sha256(source), 1, 8)) AS h FROM documents) GROUP BY lang")
def hlp16(spark, d):
    """The digest of a directory's (path, hash) pairs, in any order."""
    rows = table(spark, d, "documents").select("lang", F.concat_ws("/", "lang", "source").alias("path"), F.substring(F.sha2("source", 256), 1, 8).alias("hash")).distinct()
    h = F.conv(F.substring(F.sha2(F.concat_ws("\0", "path", "hash"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.sum(h).cast("string")), 256).alias("digest"))


@query(
    "src17_migration_check",
    f"WITH f AS (SELECT {SUM} AS fingerprint, count(*) AS n FROM (SELECT sha256(doc_id || chr(0) || coalesce(text, '') || chr(0) || coalesce(CAST(n_chars AS VARCHAR), '')) AS h FROM documents)) SELECT side, n, fingerprint, CAST(0 AS BIGINT) AS differing FROM f, (VALUES ('old'), ('new')) AS v(side)",
)
def src17(spark, d):
    """A package without its partition fields, written as JSON Lines and read again, against the old one: what each holds, and rows that the other lacks."""
    from ..sources import jsonl
    from .files import _folder

    old = table(spark, d, "documents").select("doc_id", "text", "n_chars")
    path = _folder(spark, "migrated")
    jsonl.write(old, path)
    new = jsonl.read(spark, path, old.schema)

    def side(name, a, b):
        lacks = a.exceptAll(b).agg(F.count("*").alias("differing"))
        return fingerprint(a, *old.columns).crossJoin(lacks).select(F.lit(name).alias("side"), "n", "fingerprint", "differing")  # one row each

    out = parked(side("old", old, new).union(side("new", new, old)), "migration")
    delete(spark, path)
    return out


@query("hlp01_replay", f"WITH {PAGES} SELECT project, count(*) AS n, round(avg(length(text)), 6) AS chars, count(DISTINCT route) AS routes, true AS same FROM docs GROUP BY project")
def hlp01(spark, d):
    """A summary computed from rows that were written and read again, and whether it is the one of the rows as they stand."""
    from .files import _folder

    summary = lambda rows: rows.groupBy("project").agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 6).alias("chars"), F.countDistinct("route").alias("routes"))
    path = _folder(spark, "report-rows")
    documents(spark, d).write.parquet(path)
    columns = ["project", "n", "chars", "routes"]
    frozen, again = summary(documents(spark, d)).withColumn("there", F.lit(True)), summary(spark.read.parquet(path))
    out = parked(again.join(frozen, columns, "left").select(*columns, F.coalesce("there", F.lit(False)).alias("same")), "replay")
    delete(spark, path)
    return out


# --- records and packages


@query(
    "src03_co_load",
    "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id",
)
def src03(spark, d):
    """Questions and answers as two files, joined one to one; a key twice or on one side only, or a field that isn't known, is an error."""
    closed = {"doc_id", "quality", "toxic"}
    answers = table(spark, d, "labels")
    if set(answers.columns) != closed:
        raise ValueError("answers have other fields than they may have")
    asked = table(spark, d, "documents").join(answers.select("doc_id"), "doc_id", "left_semi").select("doc_id", "lang")
    one, two = (x.withColumn("n", F.count("*").over(Window.partitionBy("doc_id"))) for x in (asked, answers))
    both = one.select(F.col("doc_id").alias("a"), "lang", F.col("n").alias("na")).join(two.select(F.col("doc_id").alias("b"), "quality", "toxic", F.col("n").alias("nb")), F.col("a") == F.col("b"), "full")
    bad = F.col("a").isNull() | F.col("b").isNull() | (F.col("na") > 1) | (F.col("nb") > 1)
    key = F.when(bad, F.raise_error(F.concat(F.lit("keys differ at "), F.coalesce("a", "b").cast("string"))).cast("bigint")).otherwise(F.col("a"))
    return both.select(key.alias("doc_id"), "lang", "quality", "toxic")


@query("src04_vertical_split", "SELECT 'question' AS part, doc_id, lang || '|' || source AS fields FROM documents UNION ALL SELECT 'answer', d.doc_id, coalesce(quality || '|' || toxic, '') FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def src04(spark, d):
    """A wide row as a question's columns and an answer's, two projections of one plan."""
    wide = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    asked = wide.select(F.lit("question").alias("part"), "doc_id", F.concat_ws("|", "lang", "source").alias("fields"))
    return asked.union(wide.select(F.lit("answer"), "doc_id", F.concat_ws("|", F.col("quality").cast("string"), F.col("toxic").cast("string"))))


@query("src12_combine", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN e.n > 1 THEN 'repeated' ELSE 'taken' END AS status FROM (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE doc_id % 13 = 0 UNION ALL SELECT -1 - doc_id FROM labels WHERE doc_id % 17 = 0) GROUP BY doc_id) e LEFT JOIN documents d ON d.doc_id = e.doc_id) GROUP BY status")
def src12(spark, d):
    """Eligible ids against their source: ids that stand twice and ids without a source are told apart from those taken."""
    ids = table(spark, d, "labels").select("doc_id")
    eligible = ids.union(ids.where("doc_id % 13 = 0")).union(ids.where("doc_id % 17 = 0").select((-1 - F.col("doc_id")).alias("doc_id"))).groupBy("doc_id").agg(F.count("*").alias("n"))
    source = table(spark, d, "documents").select("doc_id", F.lit(True).alias("there"))
    status = F.when(F.col("there").isNull(), "missing").when(F.col("n") > 1, "repeated").otherwise("taken")
    return eligible.join(source, "doc_id", "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("hlp18_question_items", "SELECT item_id, CAST(length(text) AS BIGINT) AS n FROM benchmark WHERE item_id % 2 = 1 ORDER BY item_id LIMIT 10")
def hlp18(spark, d):
    """The first ten wanted questions; a wanted id that no question has is an error."""
    items = table(spark, d, "benchmark")
    wanted = items.where("item_id % 2 = 1").select("item_id")
    found = wanted.join(items, "item_id", "left").withColumn("n", F.when(F.col("text").isNull(), F.raise_error(F.lit("a wanted question is missing")).cast("bigint")).otherwise(F.length("text")))
    return found.orderBy("item_id").limit(10).select("item_id", F.col("n").cast("bigint").alias("n"))


@query("hlp11_flat_items", "SELECT item_id, sha256(text) AS digest, CAST(length(text) AS BIGINT) AS n, 3 + item_id % 3 AS aspects FROM benchmark")
def hlp11(spark, d):
    """Questions with their nested aspects made flat."""
    views(spark, d, "benchmark")
    nested = spark.sql(ASPECTS).groupBy("qid").agg(F.array_sort(F.collect_list("aspect_id")).alias("aspects"))  # five at most
    return table(spark, d, "benchmark").join(nested, F.col("item_id") == F.col("qid")).select("item_id", F.sha2("text", 256).alias("digest"), F.length("text").cast("bigint").alias("n"), F.size("aspects").cast("bigint").alias("aspects"))


# --- statistics and audits


@query(
    "agg08_describe",
    f"""WITH a AS (SELECT qid, count(*) AS n, bool_or(critical) AS any_critical, bool_and(n_docs > 0) AS all_documented, sum((n_docs > 0)::INT) AS documented FROM ({ASPECTS}) GROUP BY qid)
    SELECT count(*) AS questions, CAST(sum(n) AS BIGINT) AS aspects, count(*) FILTER (any_critical) AS with_critical, count(*) FILTER (all_documented) AS all_documented, CAST(sum(documented) AS BIGINT) AS documented FROM a""",
)
def agg08(spark, d):
    """Statistics of questions and their aspects, by predicates over the nested ones."""
    views(spark, d, "benchmark")
    nested = spark.sql(ASPECTS).groupBy("qid").agg(F.collect_list(F.struct("critical", "n_docs")).alias("a"))  # five at most
    some = lambda x: x["n_docs"] > 0
    return nested.agg(
        F.count("*").alias("questions"), F.sum(F.size("a")).cast("bigint").alias("aspects"), F.count_if(F.exists("a", lambda x: x["critical"])).alias("with_critical"),
        F.count_if(F.forall("a", some)).alias("all_documented"), F.sum(F.size(F.filter("a", some))).cast("bigint").alias("documented"),
    )


KEYS = {"text": "text", "folded": "replace(lower(trim(text)), 'ß', 'ss')", "title": "title", "size": "project || ':' || length(text)", "route": "nullif(route, '')"}


@query("agg09_duplicate_groups", f"WITH {PAGES}, k AS (" + " UNION ALL ".join(f"SELECT '{n}' AS kind, doc_id, {x} AS key FROM docs" for n, x in KEYS.items()) + ") SELECT kind, min(doc_id) AS first_id, max(doc_id) AS last_id, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS total FROM k WHERE key <> '' GROUP BY kind, key HAVING count(*) > 1")
def agg09(spark, d):
    """Groups of pages with an equal key, by five keys; empty keys form none. Digests are shuffled, and a group is its first and last member, number and sum."""
    docs = documents(spark, d)
    keys = [F.col("text"), T.fold(F.trim("text")), F.col("title"), F.concat_ws(":", "project", F.length("text").cast("string")), F.nullif(F.col("route"), F.lit(""))]
    every = F.array(*(F.struct(F.lit(n).alias("kind"), F.when(k != "", F.sha2(k, 256)).alias("key")) for n, k in zip(KEYS, keys, strict=True)))
    rows = docs.select("doc_id", F.explode(every).alias("k")).select("doc_id", "k.kind", "k.key").where("key is not null")
    return rows.groupBy("kind", "key").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("n"), F.sum("doc_id").alias("total")).where("n > 1").drop("key")


@query("agg17_verification_scores", f"WITH {QRELS}, s AS (SELECT qid, count(*) AS n, min(n_chars) AS least, median(n_chars) AS middle FROM qrels JOIN documents USING (doc_id) GROUP BY qid) SELECT count(*) AS questions, min(n) AS fewest, round(median(n), 6) AS median_pages, min(least) AS shortest, round(median(middle), 6) AS median_chars FROM s")
def agg17(spark, d):
    """Smallest and median scores of the pages that answer questions."""
    per = qrels(spark, d).join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").groupBy("qid").agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.median("n_chars").alias("middle"))
    return per.agg(F.count("*").alias("questions"), F.min("n").alias("fewest"), F.round(F.median("n"), 6).alias("median_pages"), F.min("least").alias("shortest"), F.round(F.median("middle"), 6).alias("median_chars"))


@query("val03_question_gate", f"WITH {QRELS}, n AS (SELECT item_id, count(qrels.doc_id) AS n FROM benchmark LEFT JOIN qrels ON qid = item_id GROUP BY item_id) SELECT item_id, n, CASE WHEN n = 0 THEN 'unresolved' WHEN n > 10 THEN 'too_many' ELSE 'kept' END AS verdict, CASE WHEN n = 1 THEN 'single' WHEN n BETWEEN 2 AND 10 THEN 'several' ELSE '' END AS structure FROM n")
def val03(spark, d):
    """Questions by the pages that answer them: none, ten at most, more."""
    n = qrels(spark, d).groupBy("qid").agg(F.count("*").alias("n"))
    rows = table(spark, d, "benchmark").join(n, F.col("item_id") == F.col("qid"), "left").select("item_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    verdict = F.when(F.col("n") == 0, "unresolved").when(F.col("n") > 10, "too_many").otherwise("kept")
    return rows.select("item_id", "n", verdict.alias("verdict"), F.when(F.col("n") == 1, "single").when(F.col("n").between(2, 10), "several").otherwise("").alias("structure"))


# --- answers: metrics of aspects


@query("met11_frozen_weights", f"SELECT qid, aspect_id, round(importance / sum(importance) OVER (PARTITION BY qid), 8) AS weight FROM ({ASPECTS}) WHERE importance > 0")
def met11(spark, d):
    """Importances as shares of their question, eight digits."""
    views(spark, d, "benchmark")
    rows = spark.sql(ASPECTS).where("importance > 0")
    return rows.select("qid", "aspect_id", F.round(F.col("importance") / F.sum("importance").over(Window.partitionBy("qid")), 8).alias("weight"))


@query(
    "met10_validity",
    f"""WITH a AS ({ASPECTS}), e AS (SELECT qid, concat_ws(';', CASE WHEN count(*) < 4 THEN 'few_aspects' END, CASE WHEN NOT bool_or(critical) THEN 'no_critical' END, CASE WHEN min(importance) < 1 THEN 'importance_range' END, CASE WHEN min(n_docs) = 0 THEN 'unsupported_aspect' END) AS errors,
      round(sum(CASE WHEN n_docs > 0 THEN greatest(importance, 1) ELSE 0 END) / sum(greatest(importance, 1)), 6) AS supported FROM a GROUP BY qid) SELECT qid, errors, supported, errors = '' AND supported >= 0.8 AS valid FROM e""",
)
def met10(spark, d):
    """What is wrong with a question's aspects, and the weight of those that pages support."""
    views(spark, d, "benchmark")
    w = F.greatest(F.col("importance"), F.lit(1))
    rows = spark.sql(ASPECTS).groupBy("qid").agg(
        F.concat_ws(";", F.when(F.count("*") < 4, "few_aspects"), F.when(~F.bool_or("critical"), "no_critical"), F.when(F.min("importance") < 1, "importance_range"), F.when(F.min("n_docs") == 0, "unsupported_aspect")).alias("errors"),
        F.round(F.sum(F.when(F.col("n_docs") > 0, w).otherwise(0)) / F.sum(w), 6).alias("supported"),
    )
    return rows.withColumn("valid", (F.col("errors") == "") & (F.col("supported") >= 0.8))


GRADES = f"""SELECT qid, arm, ((qid * 3 + a) % 4) / 3.0E0 AS coverage, ((qid + a) % 3) / 2.0E0 AS support, CAST((qid + 2 * a) % 5 AS INT) AS correctness, CAST((qid * 2 + a) % 5 AS INT) AS actionability, CAST((qid + a) % 5 AS INT) AS directness, (qid + a) % 4 <> 0 AS integrity
  FROM (SELECT item_id AS qid FROM benchmark) b CROSS JOIN {ARMS}"""


@query("met09_answerability", f"WITH g AS ({GRADES}), s AS (SELECT qid, arm, round(0.35 * coverage + 0.25 * support + 0.2 * correctness / 4 + 0.1 * actionability / 4 + 0.05 * directness / 4 + 0.05 * integrity::INT, 6) AS score, coverage, correctness, integrity FROM g) SELECT qid, arm, score, score >= 0.5 AND coverage > 0 AND correctness >= 2 AND integrity AS passes FROM s")
def met09(spark, d):
    """The weighted grade of an answer and whether it passes all gates."""
    views(spark, d, "benchmark")
    part = lambda c, w: F.lit(w) * F.col(c) / 4
    score = 0.35 * F.col("coverage") + 0.25 * F.col("support") + part("correctness", 0.2) + part("actionability", 0.1) + part("directness", 0.05) + 0.05 * F.col("integrity").cast("int")
    rows = spark.sql(GRADES).withColumn("score", F.round(score, 6))
    return rows.select("qid", "arm", "score", ((F.col("score") >= 0.5) & (F.col("coverage") > 0) & (F.col("correctness") >= 2) & F.col("integrity")).alias("passes"))


@query("met13_distinct_grades", f"WITH g AS (SELECT qid, coverage, correctness FROM ({GRADES}) UNION ALL SELECT qid, coverage, correctness FROM ({GRADES})) SELECT qid, count(*) AS grades FROM (SELECT DISTINCT * FROM g) GROUP BY qid")
def met13(spark, d):
    """Grade rows that say the same are one, inside each question's list."""
    views(spark, d, "benchmark")
    g = spark.sql(GRADES).select("qid", F.struct("coverage", "correctness").alias("g"))
    return g.union(g).groupBy("qid").agg(F.size(F.array_distinct(F.collect_list("g"))).cast("bigint").alias("grades"))  # six a question


@query("met14_primary_metrics", f"WITH {_methods(False)}, {QRELS}, ranks AS (SELECT 'cited' AS kind, qid, doc_id, rank FROM hybrid_rerank WHERE rank <= 10 AND qid % 3 <> 0 UNION ALL SELECT 'visible', qid, doc_id, rank FROM hybrid WHERE rank <= 10), h AS (SELECT kind, ranks.qid, count(qrels.doc_id) AS hits FROM ranks LEFT JOIN qrels ON qrels.qid = ranks.qid AND qrels.doc_id = ranks.doc_id GROUP BY kind, ranks.qid) SELECT qs.qid, c.hits AS cited, v.hits AS visible, coalesce(c.hits, v.hits, 0) AS primary_hits FROM qs LEFT JOIN h c ON c.qid = qs.qid AND c.kind = 'cited' LEFT JOIN h v ON v.qid = qs.qid AND v.kind = 'visible'")
def met14(spark, d):
    """Hits of what an answer cites, else of what its agent saw."""
    from .retrieval import retriever

    r, q = retriever(spark, d, stored=False), questions(spark, d)
    wanted = qrels(spark, d).withColumn("good", F.lit(1))
    hits = lambda ranked, name: ranked.where("rank <= 10").join(wanted, ["qid", "doc_id"], "left").groupBy("qid").agg(F.count("good").alias(name))
    fused = r.fused(q)
    out = q.select("qid").join(hits(r.reranked(fused, q).where("qid % 3 <> 0"), "cited"), "qid", "left").join(hits(fused, "visible"), "qid", "left")
    return out.select("qid", "cited", "visible", F.coalesce("cited", "visible", F.lit(0)).alias("primary_hits"))


# --- graph store


@query("grf11_graph_stats", f"WITH {PAGES}, {LINKS}, {MENTIONS} SELECT 'links_to' AS kind, count(*) AS n FROM lk UNION ALL SELECT 'in_route', count(*) FROM docs UNION ALL SELECT kind, count(*) FROM mentions GROUP BY kind UNION ALL SELECT 'entity', count(*) FROM (SELECT subject FROM claims UNION SELECT object FROM claims) UNION ALL SELECT 'predicate', count(DISTINCT predicate) FROM claims UNION ALL SELECT 'claim', count(*) FROM claims")
def grf11(spark, d):
    """Counts of every kind of node and relationship."""
    count = lambda name, rows: rows.agg(F.lit(name).alias("kind"), F.count("*").alias("n"))
    found = claims(spark, d)
    parts = [count("links_to", links(spark, d)), count("in_route", documents(spark, d)), mentions(spark, d).groupBy("kind").agg(F.count("*").alias("n"))]
    parts += [count("entity", found.select("subject").union(found.select("object")).distinct()), count("predicate", found.select("predicate").distinct()), count("claim", found)]
    return reduce(DataFrame.union, parts)


@query("svc02_expand_requests", f"WITH {_methods(False)}, {EXPANDED} SELECT granked.qid, count(*) AS pages, 'docs://' || min(docs.project) || '/' || min(granked.doc_id) AS first_uri, round(max(score), 6) AS best FROM granked JOIN docs ON docs.doc_id = granked.doc_id GROUP BY granked.qid")
def svc02(spark, d):
    """Requests to expand the first pages of every question: what a response holds."""
    found = expansion(spark, d)[1].join(documents(spark, d).select("doc_id", "project"), "doc_id")
    uri = F.concat(F.lit("docs://"), F.min("project"), F.lit("/"), F.min("doc_id").cast("string"))
    return found.groupBy("qid").agg(F.count("*").alias("pages"), uri.alias("first_uri"), F.round(F.max("score"), 6).alias("best"))


@query("svc03_fetch_requests", f"WITH {CHUNKS}, r AS (SELECT doc_id, chunk_ord, CAST(length(text) AS BIGINT) AS n, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY chunk_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ch) SELECT doc_id, chunk_ord, CAST(least(n, 4 * 500 - before) AS BIGINT) AS taken FROM r WHERE before < 4 * 500")
def svc03(spark, d):
    """Requests for every page under a budget of 500 tokens: the chunks that a response holds, the last one cut."""
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("doc_id").orderBy("chunk_ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = chunks(spark, d).select("doc_id", "chunk_ord", F.length("text").alias("n"), before.alias("before")).where("before < 2000")
    return rows.select("doc_id", "chunk_ord", F.least(F.col("n"), 2000 - F.col("before")).cast("bigint").alias("taken"))


@query("nrm06_evidence_package", f"WITH {PAGES}, {QRELS}, b AS (SELECT qid, doc_id, n_chars, greatest(5000, 24000 // count(*) OVER (PARTITION BY qid)) AS budget FROM qrels JOIN documents USING (doc_id)) SELECT qid, count(*) AS pages, any_value(budget) AS budget, CAST(sum(least(n_chars, budget)) AS BIGINT) AS n_chars FROM b GROUP BY qid")
def nrm06(spark, d):
    """The evidence of each question: its pages, each cut to a share of the budget."""
    rows = qrels(spark, d).join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    budget = F.greatest(F.lit(5000), F.floor(F.lit(24000) / F.count("*").over(Window.partitionBy("qid"))).cast("bigint"))
    return rows.withColumn("budget", budget).groupBy("qid").agg(F.count("*").alias("pages"), F.first("budget").alias("budget"), F.sum(F.least("n_chars", "budget")).cast("bigint").alias("n_chars"))


@query("nrm07_enrichment", f"WITH {PAGES}, {LINKS}, i AS (SELECT page_id AS doc_id, string_agg(t, chr(10) ORDER BY t) AS t FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<a href=\"/([^\"]*)\"', 1))) AS t FROM pages) GROUP BY page_id), e AS (SELECT docs.doc_id, docs.text || coalesce(chr(10) || t, '') AS text FROM docs LEFT JOIN i ON i.doc_id = docs.doc_id), kept AS (SELECT * FROM e WHERE length(text) >= 200) SELECT kept.doc_id, CAST(length(text) AS BIGINT) AS n_chars, count(k.target_id) AS n_links FROM kept LEFT JOIN (SELECT lk.* FROM lk WHERE target_id IN (SELECT doc_id FROM kept)) k ON k.source_id = kept.doc_id GROUP BY kept.doc_id, text")
def nrm07(spark, d):
    """Pages with what stands beside them added, short ones dropped, and their links to dropped pages dropped with them."""
    beside = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1)))), "\n").alias("t")).where("t <> ''")
    rich = documents(spark, d).join(beside, "doc_id", "left").select("doc_id", F.when(F.col("t").isNull(), F.col("text")).otherwise(F.concat("text", F.lit("\n"), "t")).alias("text"))
    kept = rich.where(F.length("text") >= 200).select("doc_id", F.length("text").cast("bigint").alias("n_chars"))
    ids = kept.select("doc_id")
    out = links(spark, d).join(ids.withColumnRenamed("doc_id", "target_id"), "target_id", "left_semi").groupBy(F.col("source_id").alias("doc_id")).agg(F.count("*").alias("n_links"))
    return kept.join(out, "doc_id", "left").fillna(0, ["n_links"])


@query(
    "chk03_source_offset",
    rf"""WITH {CHUNKS}, b AS (SELECT ch.doc_id, ch.chunk_ord, docs.text AS whole, substr(ch.text, length(ch.title) + length(CAST(ch.doc_id AS VARCHAR)) + 3) AS body FROM ch JOIN docs ON docs.doc_id = ch.doc_id)
    SELECT chunk_ord, CAST(coalesce(nullif(strpos(whole, body), 0), nullif(strpos(whole, substr(body, 1, 500)), 0), nullif(strpos(whole, substr(body, 1, 200)), 0), nullif(strpos(whole, substr(body, 1, 80)), 0)) - 1 AS BIGINT) AS start FROM b""",
)
def chk03(spark, d):
    """Where each chunk stands in its page: by its body, else by ever shorter beginnings."""
    body = F.substring(F.col("text"), F.length("title") + F.length(F.col("doc_id").cast("string")) + 3, F.length("text"))
    rows = chunks(spark, d).select("doc_id", "chunk_ord", body.alias("body")).join(table(spark, d, "documents").select("doc_id", F.col("text").alias("whole")), "doc_id")
    find = lambda x: F.nullif(F.position(x, F.col("whole")), F.lit(0))
    start = F.coalesce(find(F.col("body")), *(find(F.substring("body", 1, n)) for n in (500, 200, 80))) - 1
    return rows.select("chunk_ord", start.cast("bigint").alias("start"))


# --- URLs


def normal_url(url: Column) -> Column:
    """Scheme and host in lower case, default ports, fragment and a last slash gone (TXT08)."""
    scheme, rest = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1)), F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path, asked = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1)
    return F.concat(scheme, F.lit("://"), host, F.regexp_replace(path, "/+$", ""), asked)


URL = r"""lower(regexp_extract({x}, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)) || '://' || CASE WHEN lower({x}) LIKE 'http:%' THEN regexp_replace(lower(regexp_extract({x}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), ':80$', '') ELSE regexp_replace(lower(regexp_extract({x}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), ':443$', '') END
  || rtrim(regexp_extract({x}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/') || regexp_extract({x}, '^[^?#]*(\?[^#]*)', 1)"""


@query("txt08_normal_url", f"SELECT page_id, {URL.format(x='u')} AS y FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN upper(url) ELSE replace(replace(url, '.com/', '.com:80/'), '.org/', '.org:443/') || '/' END AS u FROM pages)")
def txt08(spark, d):
    """All pages' URLs, some in capitals, some with ports, in their normal form."""
    i = F.col("page_id") % 3
    u = F.when(i == 0, F.col("url")).when(i == 1, F.upper("url")).otherwise(F.concat(F.replace(F.replace("url", F.lit(".com/"), F.lit(".com:80/")), F.lit(".org/"), F.lit(".org:443/")), F.lit("/")))
    return table(spark, d, "pages").select("page_id", normal_url(u).alias("y"))


PRIVATE = r"^(?:localhost|.*\.(?:local|localhost|internal)|0\.|10\.|127\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.|22[4-9]\.|2[3-5]\d\.|\[?(?:::1|f[cd]|fe80))"


@query(
    "hlp21_safe_urls",
    rf"""WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'ftp://x.org/a' WHEN 2 THEN 'http://10.0.' || page_id % 200 || '.1/x' WHEN 3 THEN 'https://172.' || page_id % 40 || '.0.1/' ELSE 'http://localhost:8080/' END AS u FROM pages)
    SELECT page_id, regexp_matches(lower(u), '^https?://') AND NOT regexp_matches(lower(regexp_extract(u, '^[a-z]+://([^/?#:]*)', 1)), '{PRIVATE}') AS safe FROM u""",
)
def hlp21(spark, d):
    """URLs that may be fetched: a web scheme, and neither a local name nor an address that isn't global."""
    i = F.col("page_id")
    u = F.element_at(F.array(F.col("url"), F.lit("ftp://x.org/a"), F.concat(F.lit("http://10.0."), (i % 200).cast("string"), F.lit(".1/x")), F.concat(F.lit("https://172."), (i % 40).cast("string"), F.lit(".0.1/")), F.lit("http://localhost:8080/")), (i % 5 + 1).cast("int"))
    host = F.lower(F.regexp_extract(u, r"^[a-z]+://([^/?#:]*)", 1))
    return table(spark, d, "pages").select("page_id", (F.lower(u).rlike("^https?://") & ~host.rlike(PRIVATE)).alias("safe"))


@query("val06_allowed_hosts", r"SELECT page_id, regexp_matches(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '(^|\.)example\.(com|org)$') AND regexp_matches(url, '^[a-z]+://[^/]*/(en|fr)/') AS allowed FROM pages")
def val06(spark, d):
    """Candidates by the hosts and path prefixes that are allowed."""
    host = F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#:]*)", 1))
    return table(spark, d, "pages").select("page_id", (host.rlike(r"(^|\.)example\.(com|org)$") & F.col("url").rlike("^[a-z]+://[^/]*/(en|fr)/")).alias("allowed"))


@query("hlp08_link_kinds", r"SELECT page_id, CASE WHEN regexp_matches(u, '/(users|login|signup|profile)(/|$)') THEN 'identity' WHEN regexp_matches(u, '\.(png|jpe?g|gif|svg|webp|mp4)$') THEN 'media' WHEN regexp_matches(u, '/(discussions|questions)/\d+') THEN 'linked_qa' WHEN regexp_matches(u, '^https?://[^/]*example\.(com|org)/') THEN 'internal_doc' ELSE 'other' END AS kind FROM (SELECT page_id, regexp_replace(lower(CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '/[^/]*$', '') || '/users/a' WHEN 2 THEN regexp_replace(url, '/[^/]*$', '') || '/discussions/7' ELSE regexp_replace(url, '/[^/]*$', '') || '/i.PNG' END), '[?#].*$', '') AS u FROM pages)")
def hlp08(spark, d):
    """Links to profiles, media, other questions, pages of the documentation, and others."""
    stem = F.regexp_replace("url", "/[^/]*$", "")
    u = F.element_at(F.array(F.col("url"), F.concat(stem, F.lit("/users/a")), F.concat(stem, F.lit("/discussions/7")), F.concat(stem, F.lit("/i.PNG"))), (F.col("page_id") % 4 + 1).cast("int"))
    rows = table(spark, d, "pages").select("page_id", F.regexp_replace(F.lower(u), "[?#].*$", "").alias("u"))
    rules = ((r"/(users|login|signup|profile)(/|$)", "identity"), (r"\.(png|jpe?g|gif|svg|webp|mp4)$", "media"), (r"/(discussions|questions)/\d+", "linked_qa"), (r"^https?://[^/]*example\.(com|org)/", "internal_doc"))
    return rows.select("page_id", F.coalesce(*(F.when(F.col("u").rlike(p), k) for p, k in rules), F.lit("other")).alias("kind"))


# --- traces: conversations as an agent's turns. Users call tools by turn, assistants answer; a file's path stands for what is read.

EVENTS = """ev AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN (['search', 'read', 'grep'])[CAST(turn % 3 + 1 AS INT)] END AS tool, lower(regexp_extract(text, '([A-Za-z]{3,})', 1)) AS word, text FROM conversations)"""


def _events(spark, d: str) -> DataFrame:
    tool = F.element_at(F.array(*map(F.lit, ("search", "read", "grep"))), (F.col("turn") % 3 + 1).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.when(F.col("role") == "user", tool).alias("tool"), F.lower(F.regexp_extract("text", "([A-Za-z]{3,})", 1)).alias("word"), "text")


@query("trc02_evidence", f"WITH {EVENTS}, c AS (SELECT a.conv_id, a.turn, a.tool, b.text AS result FROM ev a LEFT JOIN ev b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' WHERE a.tool IS NOT NULL) SELECT conv_id, turn, tool, CASE WHEN result IS NULL THEN false WHEN tool = 'read' THEN length(trim(result)) > 0 ELSE regexp_matches(result, '[A-Za-z]{{4,}}') END AS evidence FROM c")
def trc02(spark, d):
    """Whether a call brought evidence: a read any text, a search a hit with a word."""
    ev = _events(spark, d)
    results = ev.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("result"))
    rows = ev.where("tool is not null").select("conv_id", "turn", "tool").join(results, ["conv_id", "turn"], "left")
    some = F.when(F.col("result").isNull(), False).when(F.col("tool") == "read", F.length(F.trim("result")) > 0).otherwise(F.col("result").rlike("[A-Za-z]{4,}"))
    return rows.select("conv_id", "turn", "tool", some.alias("evidence"))


@query("trc05_compact", "SELECT conv_id, turn, CAST(least(length(text), 16000) AS BIGINT) AS n, sha256(substr(text, 1, 16000)) AS digest FROM conversations WHERE role IN ('user', 'assistant', 'tool', 'system')")
def trc05(spark, d):
    """Turns of the four kinds, 16,000 characters at most."""
    body = F.substring("text", 1, 16_000)
    return table(spark, d, "conversations").where(F.col("role").isin("user", "assistant", "tool", "system")).select("conv_id", "turn", F.length(body).cast("bigint").alias("n"), F.sha2(body, 256).alias("digest"))


PATHS = r"""found AS (SELECT conv_id, turn, 'docs/' || word || '.md' AS path FROM ev WHERE tool = 'search' AND word <> ''), opened AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '/work/docs/' ELSE '' END || coalesce(nullif(word, ''), 'none') || '.md' AS path FROM ev WHERE role = 'assistant')"""


def _paths(spark, d: str) -> tuple[DataFrame, DataFrame]:
    ev = _events(spark, d)
    found = ev.where("tool = 'search' and word <> ''").select("conv_id", "turn", F.concat(F.lit("docs/"), "word", F.lit(".md")).alias("path"))
    prefix = F.when(F.col("turn") % 2 == 0, "/work/docs/").otherwise("")
    return found, ev.where("role = 'assistant'").select("conv_id", "turn", F.concat(prefix, F.coalesce(F.nullif("word", F.lit("")), F.lit("none")), F.lit(".md")).alias("path"))


def suffix_joined(found: DataFrame, opened: DataFrame) -> DataFrame:
    """(conv_id, discovery, read, path): paths that were found before they were read, where one is the other's end at a slash (JON09, TRC03).

    Ends meet on their last part, an equality, before they are compared.
    """
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    a = found.select("conv_id", F.col("turn").alias("discovery"), F.col("path").alias("p"), last("path").alias("file"))
    b = opened.select("conv_id", F.col("turn").alias("read"), F.col("path").alias("q"), last("path").alias("file"))
    slash = lambda c: F.concat(F.lit("/"), F.ltrim(F.col(c), F.lit("/")))
    fits = F.endswith(slash("p"), slash("q")) | F.endswith(slash("q"), slash("p"))
    return a.join(b, ["conv_id", "file"]).where((F.col("discovery") < F.col("read")) & fits).select("conv_id", "discovery", "read", F.col("q").alias("path"))


@query("jon09_discovery_before_read", f"WITH {EVENTS}, {PATHS} SELECT f.conv_id, f.turn AS discovery, o.turn AS read, o.path FROM found f JOIN opened o ON o.conv_id = f.conv_id AND f.turn < o.turn AND (ends_with('/' || ltrim(f.path, '/'), '/' || ltrim(o.path, '/')) OR ends_with('/' || ltrim(o.path, '/'), '/' || ltrim(f.path, '/')))")
def jon09(spark, d):
    """Files that a search named before they were read, by the ends of their paths."""
    return suffix_joined(*_paths(spark, d))


@query("trc03_search_read", f"WITH {EVENTS}, {PATHS}, j AS (SELECT f.conv_id, f.turn AS discovery, o.turn AS read FROM found f JOIN opened o ON o.conv_id = f.conv_id AND f.turn < o.turn AND (ends_with('/' || ltrim(f.path, '/'), '/' || ltrim(o.path, '/')) OR ends_with('/' || ltrim(o.path, '/'), '/' || ltrim(f.path, '/')))) SELECT conv_id, read, max(discovery) AS search FROM j GROUP BY conv_id, read")
def trc03(spark, d):
    """Each read with the last search that led to it."""
    return jon09(spark, d).groupBy("conv_id", "read").agg(F.max("discovery").alias("search"))


@query("txt43_paths", rf"WITH {EVENTS}, {PATHS} SELECT conv_id, count(*) AS reads, count(DISTINCT regexp_replace(path, '^/work/', '')) AS files FROM opened WHERE regexp_matches(path, '^[\w./-]+\.mdx?$') GROUP BY conv_id")
def txt43(spark, d):
    """Paths of documentation files in what tools say, with and without the workspace's root."""
    opened = _paths(spark, d)[1].where(F.col("path").rlike(r"^[\w./-]+\.mdx?$"))
    return opened.groupBy("conv_id").agg(F.count("*").alias("reads"), F.countDistinct(F.regexp_replace("path", "^/work/", "")).alias("files"))


@query("txt44_first_sources", f"WITH {EVENTS}, {PATHS}, s AS (SELECT conv_id, regexp_replace(path, '^/work/docs/|^docs/', '') AS source, min(turn) AS first_turn FROM (SELECT * FROM found UNION ALL SELECT * FROM opened) GROUP BY 1, 2) SELECT conv_id, source, first_turn, row_number() OVER (PARTITION BY conv_id ORDER BY first_turn, source) AS place FROM s")
def txt44(spark, d):
    """Sources that were visible in a conversation, in the order of their first appearance."""
    found, opened = _paths(spark, d)
    seen = found.union(opened).groupBy("conv_id", F.regexp_replace("path", "^/work/docs/|^docs/", "").alias("source")).agg(F.min("turn").alias("first_turn"))
    return seen.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("first_turn", "source")).cast("bigint"))


REASONS = ("agent_failed", "no_tool_call", "no_answer", "too_many_sources", "repeated_source", "empty_turn", "no_evidence")


@query(
    "trc06_verdict",
    f"""WITH {EVENTS}, {PATHS}, t AS (SELECT conv_id, count(*) AS turns, bool_or(role = 'system' AND length(text) < 60) AS failed, count(*) FILTER (tool IS NOT NULL) AS calls, count(*) FILTER (role = 'assistant') AS answers, bool_or(length(trim(text)) = 0) AS blank, bool_or(role = 'assistant' AND regexp_matches(text, '[A-Za-z]{{4,}}')) AS told FROM ev GROUP BY conv_id),
    o AS (SELECT conv_id, count(*) AS n, count(DISTINCT path) AS d FROM opened GROUP BY conv_id),
    r AS (SELECT t.conv_id, concat_ws(';', CASE WHEN failed THEN 'agent_failed' END, CASE WHEN calls = 0 THEN 'no_tool_call' END, CASE WHEN answers = 0 THEN 'no_answer' END, CASE WHEN coalesce(d, 0) > 10 THEN 'too_many_sources' END, CASE WHEN coalesce(n, 0) > coalesce(d, 0) THEN 'repeated_source' END, CASE WHEN blank THEN 'empty_turn' END, CASE WHEN NOT told THEN 'no_evidence' END) AS reasons, coalesce(d, 0) AS d FROM t LEFT JOIN o ON o.conv_id = t.conv_id)
    SELECT conv_id, reasons, CASE WHEN reasons = '' THEN 1 ELSE 0 END AS hard, CASE WHEN reasons = '' THEN round(d / 10::DOUBLE, 6) ELSE 0 END AS soft FROM r""",
)
def trc06(spark, d):
    """Why an episode doesn't count: seven reasons; one that has any scores nothing."""
    ev, opened = _events(spark, d), _paths(spark, d)[1]
    t = ev.groupBy("conv_id").agg(
        F.bool_or((F.col("role") == "system") & (F.length("text") < 60)).alias("failed"), F.count("tool").alias("calls"), F.count_if(F.col("role") == "assistant").alias("answers"),
        F.bool_or(F.length(F.trim("text")) == 0).alias("blank"), F.bool_or((F.col("role") == "assistant") & F.col("text").rlike("[A-Za-z]{4,}")).alias("told"),
    )
    rows = t.join(opened.groupBy("conv_id").agg(F.count("*").alias("n"), F.countDistinct("path").alias("d")), "conv_id", "left").fillna(0, ["n", "d"])
    marks = (F.col("failed"), F.col("calls") == 0, F.col("answers") == 0, F.col("d") > 10, F.col("n") > F.col("d"), F.col("blank"), ~F.col("told"))
    reasons = F.concat_ws(";", *(F.when(m, r) for m, r in zip(marks, REASONS, strict=True)))
    rows = rows.withColumn("reasons", reasons)
    good = F.col("reasons") == ""
    return rows.select("conv_id", "reasons", F.when(good, 1).otherwise(0).alias("hard"), F.when(good, F.round(F.col("d") / 10.0, 6)).otherwise(0.0).alias("soft"))
