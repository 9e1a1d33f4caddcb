"""Summaries, aspect metrics, duplicate audits, bootstrap."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics, stats
from .registry import query, table
from .shapes import same

same("agg02_slices", "SELECT lang, source, count(*) AS n, round(avg(n_chars), 6) AS mean_chars, GROUPING(lang) AS g_lang, GROUPING(source) AS g_source FROM documents GROUP BY GROUPING SETS ((), (lang), (source), (lang, source))", "documents")
same("agg04_group_unknown", "SELECT coalesce(CAST(l.quality AS VARCHAR(10)), 'unknown') AS quality, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1", "documents", "labels")
same("agg07_frequency", "SELECT coalesce(CAST(o_orderstatus AS VARCHAR(10)), 'None') AS value, count(*) AS n FROM orders GROUP BY 1", "orders")
same("agg12_usage_rollup", "SELECT event_type, count(*) AS calls, round(sum(value), 4) AS total FROM events GROUP BY ROLLUP(event_type)", "events")
same("agg13_status_report", "SELECT o_orderstatus AS status, o_orderpriority AS error_code, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority", "orders")


@query("agg03_percentiles", "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def agg03(spark, d):
    """Exact interpolated percentiles (AGG03, AGG06)."""
    p = lambda q: F.round(F.percentile("value", F.lit(q)), 6)
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.round(F.avg("value"), 6).alias("mean"))


@query(
    "agg10_near_duplicates",
    r"""WITH t AS (SELECT min(doc_id) AS doc_id, text, count(*) AS copies FROM documents GROUP BY text), w AS (SELECT doc_id, copies, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{M}\p{N}_]+') AS w FROM t),
    s AS (SELECT doc_id, copies, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) AS sh FROM w WHERE len(w) >= 8),
    f AS (SELECT doc_id, copies, len(sh) AS n, unnest(sh) AS x FROM s), i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb, any_value(a.copies) AS n_a, any_value(b.copies) AS n_b FROM f a JOIN f b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id)
    SELECT a, b, round(k / (na + nb - k), 6) AS jaccard, n_a, n_b FROM i WHERE k / (na + nb - k) + 1e-12 >= 0.8""",
)
def agg10(spark, d):
    return stats.near_duplicate_pairs(table(spark, d, "documents"))


def _deltas(spark, d):
    lines = table(spark, d, "lineitem")
    a = lines.where("l_linenumber = 1").select(F.col("l_orderkey").alias("question_id"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))
    b = lines.where("l_linenumber = 2").select(F.col("l_orderkey").alias("question_id"), F.col("l_quantity").alias("x2"), F.col("l_discount").alias("y2"))
    j = a.join(b, "question_id")
    return j.select("question_id", F.stack(F.lit(2), F.lit("quantity"), F.col("x") - F.col("x2"), F.lit("discount"), F.col("y") - F.col("y2")).alias("metric", "delta"))


@query("agg15_bootstrap")
def agg15(spark, d):
    """Paired percentile bootstrap, 10,000 resamples with a fixed seed (AGG15, AGG16)."""
    return stats.bootstrap_delta(_deltas(spark, d))


@query("agg15_mean_delta", "SELECT metric, round(avg(delta), 6) AS mean_delta FROM (SELECT unnest(['quantity', 'discount']) AS metric, unnest([a.l_quantity - b.l_quantity, a.l_discount - b.l_discount]) AS delta FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2) GROUP BY metric")
def agg15m(spark, d):
    return _deltas(spark, d).groupBy("metric").agg(F.round(F.avg("delta"), 6).alias("mean_delta"))


# aspects of a customer: order priorities with a weight; its documents are orders
ASPECTS = "asp AS (SELECT o_custkey AS qid, o_orderpriority AS aspect_id, CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE count(*) END AS weight, CAST(substr(o_orderpriority, 1, 1) AS INT) AS importance, o_custkey FROM orders GROUP BY o_custkey, o_orderpriority), e AS (SELECT DISTINCT qid, aspect_id, coalesce(nullif(CAST(weight AS DOUBLE), 0), nullif(CAST(importance AS DOUBLE), 0), 1) AS w, o_orderkey AS doc_id FROM asp JOIN orders o ON o.o_custkey = asp.qid AND o.o_orderpriority = asp.aspect_id), rk AS (SELECT o_custkey AS qid, o_orderkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)"


def _aspects(spark, d):
    orders = table(spark, d, "orders")
    a = orders.groupBy(F.col("o_custkey").alias("qid"), F.col("o_orderpriority").alias("aspect_id")).agg(F.count("*").cast("double").alias("n"), F.collect_set("o_orderkey").alias("doc_ids"))
    a = a.select("qid", "aspect_id", F.when(F.col("qid") % 3 == 0, 0.0).otherwise(F.col("n")).alias("weight"), F.substring("aspect_id", 1, 1).cast("int").alias("importance"), "doc_ids")
    ranked = orders.select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("doc_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("rank"))
    return a, ranked


@query("met04_aspect_recall", f"WITH {ASPECTS}, b AS (SELECT qid, aspect_id, any_value(w) AS w, min(rank) AS r FROM e JOIN rk USING (qid, doc_id) GROUP BY ALL) SELECT qid, count(*) AS aspects, " + ", ".join(f"round(coalesce(sum(w) FILTER (r <= {k}), 0) / sum(w), 6) AS weighted_aspect_recall_at_{k}" for k in metrics.CUTOFFS) + " FROM b GROUP BY qid")
def met04(spark, d):
    out = metrics.aspect_recall(*_aspects(spark, d))
    return out.select("qid", "aspects", *(F.round(c, 6).alias(c) for c in out.columns[2:]))


@query("met05_aspect_gain", f"WITH {ASPECTS}, g AS (SELECT qid, rank, w, row_number() OVER (PARTITION BY qid, aspect_id ORDER BY rank) - 1 AS prior FROM e JOIN rk USING (qid, doc_id) WHERE rank <= 10) SELECT qid, round(sum(w * pow(0.5, prior) / log2(rank + 1)), 6) AS dcg FROM g GROUP BY qid")
def met05(spark, d):
    a, ranked = _aspects(spark, d)
    return metrics._novelty(metrics.eligible_aspects(a), ranked, 0.5).select("qid", F.round("dcg", 6).alias("dcg"))


@query("met06_alpha_ndcg")
def met06(spark, d):
    return metrics.alpha_ndcg(*_aspects(spark, d))
