"""Ranking, aspect and answer metrics (MET01-MET14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTOFFS = (1, 5, 10, 20)


def _gain(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + F.lit(1.0))


def ranking_metrics(questions: DataFrame, ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """A row per question: recall and hit at each cutoff, ndcg_at_10, all_support_at_10, soft (MET01-MET03).

    ``ranked``: (qid, doc_id, rank); ``qrels``: (qid, doc_id). Questions without qrels score 0, their denominator is 1.
    """
    wanted = qrels.select("qid", "doc_id").distinct()
    n = wanted.groupBy("qid").agg(F.count("*").alias("n_relevant"))
    hit = ranked.join(wanted, ["qid", "doc_id"]).groupBy("qid").agg(
        *(F.count_if(F.col("rank") <= k).alias(f"found_{k}") for k in CUTOFFS), F.sum(F.when(F.col("rank") <= 10, _gain(F.col("rank")))).alias("dcg")
    )
    out = questions.select("qid").join(n, "qid", "left").join(hit, "qid", "left").fillna(0)
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(10), "n_relevant")).cast("int")), F.lit(0.0), lambda s, i: s + _gain(i))
    size = F.greatest(F.lit(1), "n_relevant")
    out = out.select(
        "qid", "n_relevant", *(F.round(F.col(f"found_{k}") / size, 9).alias(f"recall_at_{k}") for k in CUTOFFS),
        *((F.col(f"found_{k}") > 0).cast("double").alias(f"hit_at_{k}") for k in CUTOFFS),
        F.when(F.col("n_relevant") > 0, F.round(F.col("dcg") / ideal, 9)).otherwise(0.0).alias("ndcg_at_10"),
        ((F.col("n_relevant") > 0) & (F.col("found_10") == F.col("n_relevant"))).cast("double").alias("all_support_at_10"),
    )
    return out.withColumn("soft", F.round(0.5 * F.col("ndcg_at_10") + 0.3 * F.col("recall_at_10") + 0.2 * F.col("hit_at_10"), 9))


def eligible_aspects(aspects: DataFrame) -> DataFrame:
    """(qid, aspect_id, w, doc_id): aspects with documents; a weight of 0 or null falls back to importance, then 1."""
    w = F.coalesce(F.nullif(F.col("weight"), F.lit(0.0)), F.nullif(F.col("importance").cast("double"), F.lit(0.0)), F.lit(1.0))
    return aspects.select("qid", "aspect_id", w.alias("w"), F.explode(F.array_distinct("doc_ids")).alias("doc_id"))


def aspect_recall(aspects: DataFrame, ranked: DataFrame) -> DataFrame:
    """Weighted aspect recall at each cutoff (MET04)."""
    e = eligible_aspects(aspects)
    best = e.join(ranked, ["qid", "doc_id"], "left").groupBy("qid", "aspect_id").agg(F.first("w").alias("w"), F.min("rank").alias("r"))
    return best.groupBy("qid").agg(
        F.count("*").alias("aspects"), *(F.round(F.coalesce(F.sum(F.when(F.col("r") <= k, F.col("w"))), F.lit(0.0)) / F.sum("w"), 9).alias(f"weighted_aspect_recall_at_{k}") for k in CUTOFFS)
    )


def _novelty(e: DataFrame, ranked: DataFrame, alpha: float) -> DataFrame:
    prior = F.row_number().over(Window.partitionBy("qid", "aspect_id").orderBy("rank")) - 1
    gains = e.join(ranked.where(F.col("rank") <= 10), ["qid", "doc_id"]).withColumn("prior", prior)
    return gains.groupBy("qid").agg(F.sum(F.col("w") * F.pow(F.lit(1.0 - alpha), "prior") * _gain(F.col("rank"))).alias("dcg"))


def alpha_ndcg(aspects: DataFrame, ranked: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Novelty-aware gain over the greedy ideal order (MET05, MET06). The greedy order is ten picks a question, in one group each."""
    e = eligible_aspects(aspects)

    def greedy(pdf):
        import pandas as pd

        qid = pdf["qid"].iloc[0]
        docs = {d: list(zip(g["aspect_id"], g["w"], strict=True)) for d, g in pdf.groupby("doc_id")}
        seen: dict = {}
        out = []
        while docs and len(out) < 10:
            best = min(docs, key=lambda d: (-sum(w * (1 - alpha) ** seen.get(a, 0) for a, w in docs[d]), d))
            out.append((qid, best, len(out) + 1))
            for a, _ in docs.pop(best):
                seen[a] = seen.get(a, 0) + 1
        return pd.DataFrame(out, columns=["qid", "doc_id", "rank"])

    ideal = e.groupBy("qid").applyInPandas(greedy, f"qid {e.schema['qid'].dataType.simpleString()}, doc_id {e.schema['doc_id'].dataType.simpleString()}, rank int")
    best = _novelty(e, ideal, alpha).withColumnRenamed("dcg", "ideal")
    return best.join(_novelty(e, ranked, alpha), "qid", "left").select("qid", F.round(F.coalesce("dcg", F.lit(0.0)) / F.col("ideal"), 9).alias("alpha_ndcg_at_10"))
