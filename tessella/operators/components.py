"""Connected components of links, and joins on keys that may hold very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, parked


def salted_join(rows: DataFrame, first: DataFrame, key: str, by: str, salts: int = 8) -> DataFrame:
    """Join of ``rows`` with ``first``, one row a key: each key's rows are dealt to ``salts`` tasks by ``by``."""
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    return dealt.join(first.select("*", salt), [key, "_salt"]).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every end of ``edges`` (a, b): component is the smallest id reachable.

    Every step hooks a node and its larger neighbours to the smallest one in sight, then does the same seen from the
    hooked side, until a step changes nothing. Steps are written to the shared folder and the ones before deleted.
    """
    edges = parked(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        larger = salted_join(both, low, "a", "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = larger.groupBy("a").agg(F.min("b").alias("m"))
        hooked = salted_join(larger, least, "a", "b").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        step = parked(hooked.union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        discard(edges)
        edges = step
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
