"""Corpus queries: batching, page tables, enrichment, normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batches
from .registry import query, table
from .shapes import same

same("hlp10_audit_records", "SELECT page_id, concat('pages::', lower(url)) AS audit_key FROM pages", "pages")
same("hlp17_revision", "SELECT coalesce(CAST(NULL AS VARCHAR(5)), concat('rows:', CAST(count(*) AS VARCHAR(20)))) AS revision FROM documents", "documents")


@query(
    "chk04_greedy_batches",
    """WITH RECURSIVE u AS (SELECT lang AS project, doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) + length(CAST(doc_id AS VARCHAR)) + 50 AS BIGINT) AS n, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents),
    b AS (SELECT project, doc_id, k, 0 AS batch, n AS used FROM u WHERE k = 1 UNION ALL SELECT u.project, u.doc_id, u.k, CASE WHEN b.used + u.n > 12000 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.used + u.n > 12000 THEN u.n ELSE b.used + u.n END FROM b JOIN u ON u.project = b.project AND u.k = b.k + 1),
    t AS (SELECT b.project, batch, count(*) AS n_units, min(b.doc_id) AS first_doc, max(b.doc_id) AS last_doc, string_agg('<evidence_unit id="' || b.doc_id || '">' || chr(10) || text || chr(10) || '</evidence_unit>', chr(10) || chr(10) ORDER BY b.doc_id) AS payload FROM b JOIN u ON u.doc_id = b.doc_id GROUP BY b.project, batch)
    SELECT project, CAST(batch AS BIGINT) AS batch, n_units, first_doc, last_doc, substr(sha256(project || chr(0) || payload), 1, 24) AS batch_id FROM t""",
)
def chk04(spark, d):
    """Greedy packing of each language's documents under a budget; half of all rows may be one project's."""
    docs = table(spark, d, "documents").select(F.coalesce("lang", F.lit("")).alias("project"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sized = docs.withColumn("n", F.length("text") + F.length(F.col("doc_id").cast("string")) + 50)
    batched = batches.greedy(sized, "doc_id", "n", 12_000)
    ids = batches.batch_ids(batched.join(docs.select("doc_id", "text"), "doc_id"), "doc_id", F.col("text"))
    ends = batched.groupBy("project", "batch").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    return ids.join(ends, ["project", "batch"]).select("project", "batch", "n_units", "first_doc", "last_doc", "batch_id")


@query("ext_event_monitor", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def ext_monitor(spark, d):
    """The streaming extension's aggregate, run over the finished table."""
    from ..streaming.monitor import latencies

    return latencies(table(spark, d, "events")).drop("p95")
