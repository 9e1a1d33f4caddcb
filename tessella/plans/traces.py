"""Trace analytics over conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import query, table


@query("trc07_event_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def trc07(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("svc01_search_requests", "SELECT item_id, substr(sha256('r1' || chr(0) || 'true' || chr(0) || text), 1, 20) AS query_id, CAST(greatest(1, least(20, item_id % 40)) AS BIGINT) AS k FROM benchmark")
def svc01(spark, d):
    q = F.substring(F.sha2(F.concat_ws("\0", F.lit("r1"), F.lit("true"), "text"), 256), 1, 20)
    return table(spark, d, "benchmark").select("item_id", q.alias("query_id"), F.greatest(F.lit(1), F.least(F.lit(20), F.col("item_id") % 40)).cast("bigint").alias("k"))
