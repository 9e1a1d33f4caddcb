"""Join, set, sort and window shapes, sources and gates over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph
from .registry import query, sql_query, table


def same(name: str, sql: str, *tables: str) -> None:
    """One statement that both engines read alike."""
    sql_query(name, sql, sql, *tables)


same("jon01_bijection", "SELECT count(*) AS pairs, CAST(sum(CASE WHEN b.doc_id IS NULL OR a.doc_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unmatched FROM documents a FULL OUTER JOIN (SELECT DISTINCT doc_id FROM documents) b ON a.doc_id = b.doc_id", "documents")
same("jon02_lookup", "SELECT l.doc_id, d.lang, l.quality FROM labels l JOIN documents d ON l.doc_id = d.doc_id", "labels", "documents")
same("jon03_left_coalesce", "SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR(10)), CASE WHEN d.lang = 'en' THEN 'assumed' ELSE 'unknown' END) AS verdict FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", "labels", "documents")
same("jon04_semi", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)", "labels", "documents")
same("jon05_anti", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL", "labels", "documents")
same("jon06_reconciliation", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'missing' WHEN b.doc_id IS NULL THEN 'extra' WHEN a.quality <> b.quality THEN 'mismatch' ELSE 'same' END AS status FROM (SELECT * FROM labels WHERE doc_id % 3 <> 0) a FULL OUTER JOIN (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS quality FROM labels WHERE doc_id % 5 <> 0) b ON a.doc_id = b.doc_id", "labels")
same("jon12_scalars", "SELECT o_orderkey, round(o_totalprice / a.m, 6) AS share FROM orders CROSS JOIN (SELECT avg(o_totalprice) AS m FROM orders) a", "orders")
same("jon14_paired", "SELECT a.l_orderkey AS k, CAST(sum(a.l_quantity - b.l_quantity) AS DOUBLE) AS delta FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2 GROUP BY a.l_orderkey", "lineitem")
same("srt01_mixed_order", "SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY c_mktsegment DESC, c_acctbal, c_custkey) AS place FROM customer", "customer")
same("srt02_top_per_group", "SELECT * FROM (SELECT c_mktsegment, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer) t WHERE place <= 5", "customer")
same("set01_union_distinct", "SELECT doc_id FROM labels WHERE quality = 0 UNION SELECT doc_id FROM labels WHERE toxic = 1", "labels")
same("set02_intersect", "SELECT doc_id FROM labels WHERE quality = 0 INTERSECT SELECT doc_id FROM labels WHERE toxic = 1", "labels")
same("set03_except", "SELECT doc_id FROM labels WHERE quality = 0 EXCEPT SELECT doc_id FROM labels WHERE toxic = 1", "labels")
same("fil01_eligible", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '5-LOW' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", "orders")
same("win02_margin", "SELECT c_mktsegment, best, round(best - second, 6) AS margin FROM (SELECT c_mktsegment, c_acctbal AS best, lead(c_acctbal) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS second, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) t WHERE r = 1", "customer")
same("win03_next", "SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations", "conversations")
same("win04_running_budget", "SELECT conv_id, turn, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM conversations", "conversations")
same("win01_rank", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders", "orders")
same("chk06_compact_evidence", "SELECT conv_id, turn, least(n, 400, greatest(0, 2000 - before)) AS kept FROM (SELECT conv_id, turn, n, CAST(coalesce(sum(least(n, 400)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM (SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS n FROM conversations) a) b WHERE before < 2000", "conversations")
same("chk07_fetch_budget", "SELECT conv_id, turn, least(n, 1200 - before) AS taken FROM (SELECT conv_id, turn, n, CAST(coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM (SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS n FROM conversations) a) b WHERE before < 1200", "conversations")
same("chk05_accepted_units", "SELECT conv_id, turn FROM conversations WHERE conv_id IS NOT NULL AND length(text) >= 20", "conversations")

# sources, packaging, gates
same("src06_pages_in_order", "SELECT page_id, CAST(length(html) AS BIGINT) AS n FROM pages ORDER BY page_id", "pages")
same("src10_namespaced_union", "SELECT concat(lang, '::', CAST(doc_id AS VARCHAR(20))) AS id, lang AS project FROM documents UNION ALL SELECT concat('bench::', CAST(item_id AS VARCHAR(20))), 'bench' FROM benchmark", "documents", "benchmark")
same("src15_path_collisions", "SELECT lower(c_name) AS path, count(*) AS n FROM (SELECT c_name FROM customer UNION ALL SELECT upper(c_name) FROM customer WHERE c_custkey % 10 = 0) x GROUP BY lower(c_name) HAVING count(*) > 1", "customer")
same("val08_listing_cap", "SELECT c_mktsegment, count(*) AS n, CASE WHEN count(DISTINCT c_custkey) >= 950 THEN 'fail' ELSE 'ok' END AS guard FROM customer GROUP BY c_mktsegment", "customer")
same("hlp04_expected_ids", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE doc_id % 11 = 0) x GROUP BY doc_id HAVING count(*) > 1", "labels")
same("hlp13_routing_statistics", "SELECT lang AS root, count(*) AS pages, count(DISTINCT source) AS children, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY lang", "documents")
same("hlp14_paths", "SELECT DISTINCT concat(lang, '/', source, '.md') AS path FROM documents", "documents")


@query("src10_edge_scope", "SELECT o.o_custkey AS source_id, l.l_partkey AS target_id, count(*) AS n FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND p.p_size < 25) GROUP BY ALL")
def src10_edges(spark, d):
    """Edges whose target leaves the project are dropped: a semi join with the surviving ids."""
    kept = table(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("l_partkey"))
    lines = table(spark, d, "lineitem").join(kept, "l_partkey", "left_semi")
    both = lines.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.groupBy(F.col("o_custkey").alias("source_id"), F.col("l_partkey").alias("target_id")).agg(F.count("*").alias("n"))


@query("src11_namespaced_arrays", "SELECT conv_id, array_to_string(list_transform(list(turn ORDER BY turn), lambda t: 'conv::' || t), ',') AS turns FROM conversations GROUP BY conv_id")
def src11(spark, d):
    turns = F.array_sort(F.collect_list("turn"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: F.concat(F.lit("conv::"), t.cast("string"))), ",").alias("turns"))


@query("srt03_first_occurrence", "SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY conv_id, role")
def srt03(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first_turn"))


@query("srt04_rotation", "SELECT doc_id, CAST(('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 3 AS BIGINT) AS turn FROM documents")
def srt04(spark, d):
    h = F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 8), 16, 10).cast("bigint")
    return table(spark, d, "documents").select("doc_id", (h % 3).alias("turn"))


@query("agg11_rejections", "SELECT e AS reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN length(text) < 100 THEN 'short' END, CASE WHEN lang NOT IN ('en', 'fr') THEN 'language' END], lambda e: e IS NOT NULL)) AS e FROM documents) GROUP BY e")
def agg11(spark, d):
    checks = F.array(F.when(F.length("text") < 100, "short"), F.when(~F.col("lang").isin("en", "fr"), "language"))
    return table(spark, d, "documents").select(F.explode(F.filter(checks, lambda e: e.isNotNull())).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "val02_closure",
    """WITH RECURSIVE t AS (SELECT doc_id AS id, CASE WHEN doc_id % 6 < 5 THEN doc_id + 1 WHEN doc_id % 12 = 5 THEN doc_id - 5 END AS target FROM documents),
    r(root, node) AS (SELECT id, id FROM t UNION SELECT root, target FROM r JOIN t ON t.id = r.node WHERE target IS NOT NULL)
    SELECT root, count(*) AS reached, coalesce(bool_or(node <> root AND b.id IS NOT NULL), false) AS in_cycle FROM r LEFT JOIN t b ON b.id = r.node AND b.target = r.root GROUP BY root""",
)
def val02(spark, d):
    """What each answer leads to by its linked answers, chains of six and cycles of six, hop by hop until nothing new is met."""
    i = F.col("doc_id")
    target = F.when(i % 6 < 5, i + 1).when(i % 12 == 5, i - 5)
    t = table(spark, d, "documents").select(i.alias("source_id"), target.alias("target_id")).where("target_id IS NOT NULL")
    met = graph.closure(table(spark, d, "documents").select(i.alias("root")), t)
    back = t.select(F.col("source_id").alias("node"), F.col("target_id").alias("root"), F.lit(True).alias("back"))
    return met.join(back, ["node", "root"], "left").groupBy("root").agg(F.count("*").alias("reached"), F.coalesce(F.bool_or((F.col("node") != F.col("root")) & F.col("back")), F.lit(False)).alias("in_cycle"))


@query("win05_prior_occurrences", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS prior FROM conversations")
def win05(spark, d):
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", (F.row_number().over(w) - 1).cast("bigint").alias("prior"))
