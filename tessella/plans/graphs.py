"""Graph and knowledge-claim queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from .registry import query, table
from .shapes import same

# customers, parts and suppliers as pages; order lines as links
same("grf07_endpoint_matched", "SELECT o.o_orderkey, o.o_custkey FROM orders o JOIN (SELECT c_custkey FROM customer WHERE c_nationkey < 15) c ON o.o_custkey = c.c_custkey", "orders", "customer")


def _edges(spark, d):
    """Suppliers linked to parts that they ship, each edge numbered by its ends."""
    e = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return e.select(F.col("l_suppkey").alias("source_id"), (F.col("l_partkey") + 1_000_000).alias("target_id"), (F.col("l_suppkey") * 10_000_000 + F.col("l_partkey")).alias("edge"))


EDGES = "e AS (SELECT DISTINCT l_suppkey AS source_id, l_partkey + 1000000 AS target_id, l_suppkey * 10000000 + l_partkey AS edge FROM lineitem), s AS (SELECT source_id AS node, target_id AS neighbour, edge FROM e UNION ALL SELECT target_id, source_id, edge FROM e)"

@query("grf14_allowed_edges", f"WITH {EDGES} SELECT e.* FROM e WHERE source_id % 2 = 0 AND target_id % 3 = 0")
def grf14(spark, d):
    """Edges between allowed pages only: a semi join on each end."""
    e = _edges(spark, d)
    nodes = e.select(F.col("source_id").alias("id")).union(e.select("target_id")).distinct()
    allowed = nodes.where("(id < 1000000 and id % 2 = 0) or (id >= 1000000 and id % 3 = 0)")
    return e.join(allowed, e["source_id"] == allowed["id"], "left_semi").join(allowed, e["target_id"] == allowed["id"], "left_semi")


@query("grf15_linked_qrels", f"WITH {EDGES}, q AS (SELECT DISTINCT o_custkey AS qid, x AS doc_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey, LATERAL (SELECT unnest([l_suppkey, l_partkey + 1000000]) AS x) y), p AS (SELECT DISTINCT a.qid FROM q a JOIN e ON a.doc_id = e.source_id JOIN q b ON b.qid = a.qid AND b.doc_id = e.target_id) SELECT DISTINCT q.qid, p.qid IS NOT NULL AS linked FROM q LEFT JOIN p ON q.qid = p.qid")
def grf15(spark, d):
    lines = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    qrels = lines.select(F.col("o_custkey").alias("qid"), F.explode(F.array("l_suppkey", F.col("l_partkey") + 1_000_000)).alias("doc_id"))
    edges = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source_id"), (F.col("l_partkey") + 1_000_000).alias("target_id"))
    return graph.linked_pairs(qrels, edges)
