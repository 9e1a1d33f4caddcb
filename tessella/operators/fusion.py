"""Fusion of rankings and the route hierarchy (FUS01, FUS04)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import POLICY


def rrf(*rankings: DataFrame, constant: int = POLICY.rrf_constant, key: str = "doc_id") -> DataFrame:
    """(qid, key, score, rank): each ranking adds 1 / (constant + rank) (FUS01)."""
    every = reduce(DataFrame.unionByName, (r.select("qid", key, "rank") for r in rankings))
    fused = every.groupBy("qid", key).agg(F.round(F.sum(1.0 / (F.lit(float(constant)) + F.col("rank"))), 12).alias("score"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), key)))


def routes_first(ranked: DataFrame, routes: DataFrame) -> DataFrame:
    """A stable sort: documents of a selected route stand first (FUS04). ``routes``: (qid, route); ``ranked`` has route."""
    chosen = routes.select("qid", "route", F.lit(1).alias("chosen")).distinct()
    out = ranked.join(chosen, ["qid", "route"], "left").withColumn("chosen", F.coalesce("chosen", F.lit(0)))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("chosen"), "rank")))
