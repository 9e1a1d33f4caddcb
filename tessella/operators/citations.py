"""Cited URLs to the judged pages of their question, by evidence that can be inspected only (NRM02)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U

# The methods in their order, kinds of resolution that count as verified, and those whose slug says what was meant.
METHODS = ("dataset_url_resolution", "corpus_frontmatter_redirect", "frozen_redirect_cache", "exact_local_route", "verified_unique_slug", "verified_builder_single_qrel")
VERIFIED = ("canonical", "canonical_path", "frontmatter_redirect", "redirect", "redirect_cache", "exact_local_route", "live_http_redirect", "unique_slug")
BY_SLUG = ("frontmatter_redirect", "live_http_redirect", "unique_slug")
IMPLIED = {"corpus_frontmatter_redirect": "frontmatter_redirect", "frozen_redirect_cache": "redirect_cache", "exact_local_route": "canonical"}


def slug(x):
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9_\s-]", ""), r"[\s-]+", "-"), "^-+|-+$", "")


def resolved(cited: DataFrame, qrels: DataFrame, routes: DataFrame, explicit: DataFrame, moved: DataFrame, cache: DataFrame) -> DataFrame:
    """(qid, url, target, method, kind, anchor, verified) of every cited URL (qid, url, kind: as its builder recorded it, or null).

    ``qrels``: (qid, doc_id); ``routes``: (doc_id, route); ``explicit``: (qid, url, doc_id, kind, anchor); ``moved``: (doc_id,
    route), redirects that pages declare; ``cache``: (url, redirected). A page that the question isn't judged on is never a
    target. Of pages that claim one address the one with the largest id counts.
    """
    mine = qrels.join(routes, "doc_id").withColumn("route", U.canonical_path(F.col("route")))
    by_route = mine.groupBy("qid", "route").agg(F.max("doc_id").alias("doc_id"))
    tail = F.regexp_extract("route", "([^/]*)$", 1)
    by_slug = mine.groupBy("qid", tail.alias("tail")).agg(F.max("doc_id").alias("m4"), F.count("*").alias("n")).where("n = 1").drop("n")
    by_moved = qrels.join(moved, "doc_id").groupBy("qid", U.canonical_path(F.col("route")).alias("route")).agg(F.max("doc_id").alias("m1"))
    only = qrels.groupBy("qid").agg(F.count("*").alias("n"), F.max("doc_id").alias("m5")).where("n = 1").drop("n")
    told = explicit.join(qrels, ["qid", "doc_id"]).select("qid", "url", F.col("doc_id").alias("m0"), F.col("kind").alias("told_kind"), F.col("anchor").alias("told_anchor"))
    rows = cited.withColumn("route", U.canonical_path(F.col("url"))).withColumn("tail", tail)
    far = cache.withColumn("far", U.canonical_path(F.col("redirected"))).select("url", "far")
    rows = rows.join(told, ["qid", "url"], "left").join(by_moved, ["qid", "route"], "left").join(far, "url", "left")
    rows = rows.join(by_route.select("qid", F.col("route").alias("far"), F.col("doc_id").alias("m2")), ["qid", "far"], "left").join(by_route.withColumnRenamed("doc_id", "m3"), ["qid", "route"], "left")
    rows = rows.join(by_slug, ["qid", "tail"], "left").join(only, "qid", "left")
    recorded = F.coalesce(F.when(F.col("m0").isNotNull(), F.col("told_kind")), F.col("kind"))
    rows = rows.withColumn("recorded", recorded)
    rows = rows.withColumn("m4", F.when(F.col("recorded") == "unique_slug", F.col("m4"))).withColumn("m5", F.when(F.col("recorded").isin(*VERIFIED), F.col("m5")))
    method = F.coalesce(*(F.when(F.col(f"m{k}").isNotNull(), m) for k, m in enumerate(METHODS)), F.lit("unresolved"))
    rows = rows.withColumn("method", method).withColumn("target", F.coalesce(*(F.col(f"m{k}") for k in range(6))))
    implied = F.try_element_at(F.create_map(*(F.lit(x) for kv in IMPLIED.items() for x in kv)), F.col("method"))
    rows = rows.withColumn("kind", F.coalesce("recorded", implied, F.lit("unresolved")))
    said = slug(U.unquoted(U.fragment(F.col("url"))))
    fragment = F.when(F.coalesce("told_anchor", F.lit("")) != "", slug(F.col("told_anchor"))).otherwise(said)
    anchor = F.when(F.col("target").isNull(), F.lit(None)).when(fragment != "", fragment).when(F.col("kind").isin(*BY_SLUG), slug(F.col("tail")))
    return rows.select("qid", "url", "target", "method", "kind", anchor.alias("anchor"), F.col("target").isNotNull().alias("verified"))
