"""Judged answers: weighted aspect coverage, outcomes, summaries and paired intervals (MET08, AGG05, AGG16)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Questions of a benchmark at most: intervals draw from one stream of random numbers, so they are made in one place.
MOST_QUESTIONS = 100_000


def candidate_scores(aspects: DataFrame, judged: DataFrame, issues: DataFrame, runs: DataFrame) -> DataFrame:
    """A row per (qid, arm): coverage, critical success, outcome, issues, integrity (MET08).

    ``aspects``: (qid, aspect_id, weight, importance, critical, n_docs); ``judged``: (qid, arm, aspect_id, coverage, support), one
    row each; ``issues``: (qid, arm, type, severity); ``runs``: (qid, arm, agent_ok, n_invalid, quality). An aspect weighs its
    weight, else its importance, else 1. A run that failed has no coverage and is incorrect, as is one with a critical
    aspect unsupported or contradicted, or with a material or critical issue; with all critical aspects in full an answer
    is complete, with any coverage partial.
    """
    w = F.coalesce(F.nullif(F.col("weight"), F.lit(0.0)), F.nullif(F.col("importance").cast("double"), F.lit(0.0)), F.lit(1.0))
    both = judged.join(aspects.withColumn("w", w), ["qid", "aspect_id"])
    full = (F.col("coverage") == 1.0) & (F.col("support") == "full")
    wrong = F.col("support").isin("unsupported", "contradicted")
    scored = both.groupBy("qid", "arm").agg(
        (F.sum(F.col("w") * F.col("coverage")) / F.sum("w")).alias("weighted"), F.count("*").alias("n_aspects"), F.count_if("critical").alias("n_critical"),
        F.count_if(F.col("critical") & full).alias("full"), F.count_if(F.col("critical") & wrong).alias("wrong"), F.max("coverage").alias("most"), F.count_if(F.col("n_docs") > 0).alias("documented"),
    )
    grave = issues.where(F.col("severity").isin("material", "critical")).groupBy("qid", "arm").agg(
        F.count("*").alias("n_issues"), F.count_if(F.col("type") == "unsupported").alias("n_unsupported"), F.count_if(F.col("type") == "contradicted").alias("n_contradicted")
    )
    out = runs.join(scored, ["qid", "arm"]).join(grave, ["qid", "arm"], "left").fillna(0, ["n_issues", "n_unsupported", "n_contradicted"])
    outcome = F.when(~F.col("agent_ok") | (F.col("wrong") > 0) | (F.col("n_issues") > 0), "incorrect").when(F.col("full") == F.col("n_critical"), "complete").when(F.col("most") > 0, "partial").otherwise("incorrect")
    coverage = F.round(F.when(F.col("agent_ok"), F.col("weighted")).otherwise(0.0), 6)
    return out.select(
        "qid", "arm", coverage.alias("coverage"), (F.col("full") == F.col("n_critical")).alias("critical_full"), F.round(F.col("full") / F.greatest(F.lit(1), F.col("n_critical")), 6).alias("critical_success"),
        outcome.alias("outcome"), "documented", "n_unsupported", "n_contradicted", (F.col("n_invalid") == 0).alias("integrity"), "quality",
    )


def judge_summary(scores: DataFrame) -> DataFrame:
    """A row per arm: means of coverage, critical success and quality, shares of outcomes, of answers with unsupported claims and of sound citations (AGG05)."""
    share = lambda c, name: F.round(F.avg(c.cast("double")), 6).alias(name)
    outcomes = [share(F.col("outcome") == o, o) for o in ("complete", "partial", "incorrect")]
    return scores.groupBy("arm").agg(
        F.count("*").alias("n"), F.round(F.avg("coverage"), 6).alias("coverage"), F.round(F.avg("critical_success"), 6).alias("critical_success"), *outcomes,
        share(F.col("n_unsupported") > 0, "unsupported"), share(F.col("integrity"), "integrity"), F.round(F.avg("quality"), 6).alias("quality"),
    )


def paired_deltas(scores: DataFrame, contrasts: list[tuple[str, str]], metric: str = "coverage") -> DataFrame:
    """(contrast, at, qid, delta) of questions that both arms of a contrast have a value for; a question twice in an arm is an error."""
    rows = scores.where(F.col(metric).isNotNull()).groupBy("qid", "arm").agg(F.first(metric).alias("v"), F.count("*").alias("n"))
    rows = rows.withColumn("v", F.when(F.col("n") > 1, F.raise_error(F.lit("a question has two scores in an arm")).cast("double")).otherwise(F.col("v"))).drop("n")
    named = F.array(*(F.struct(F.lit(i).alias("at"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(contrasts)))
    arms = rows.withColumn("c", F.explode(named))
    one = arms.where("arm = c.a").select("qid", "c", F.col("v").alias("x"))
    two = arms.where("arm = c.b").select("qid", "c", F.col("v").alias("y"))
    return one.join(two, ["qid", "c"]).select(F.concat_ws("_minus_", "c.a", "c.b").alias("contrast"), F.col("c.at").alias("at"), "qid", (F.col("x") - F.col("y")).alias("delta"))


def shared_bootstrap(deltas: DataFrame, samples: int = 10_000, seed: int = 20260831) -> DataFrame:
    """(contrast, n, mean_delta, low, high): percentile intervals, the contrasts one after the other from one random stream (AGG16).

    The stream makes the order part of the result, so all deltas, numbers of a bounded benchmark, meet in one group; more
    than MOST_QUESTIONS of a contrast are an error.
    """

    def one(pdf):
        import random

        import numpy as np
        import pandas as pd

        rng, out = random.Random(seed), []
        for at, part in sorted(pdf.groupby("at")):
            d = part.sort_values("qid")["delta"].to_numpy(float)
            if len(d) > MOST_QUESTIONS:
                raise ValueError("too many questions for one random stream")
            means = np.array([d[[rng.randrange(len(d)) for _ in range(len(d))]].mean() for _ in range(samples)])
            low, high = np.quantile(means, [0.025, 0.975])
            out.append((part["contrast"].iloc[0], len(d), round(float(d.mean()), 9), round(float(low), 9), round(float(high), 9)))
        return pd.DataFrame(out, columns=["contrast", "n", "mean_delta", "low", "high"])

    return deltas.groupBy(F.lit(0).alias("one")).applyInPandas(one, "contrast string, n bigint, mean_delta double, low double, high double")


# Fixed value: kinds of evidence that an aspect may rest on.
DIRECT_KINDS = ("local_document_section", "answer_text", "image_text")


def bound_evidence(aspects: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(qid, aspect_id, evidence_ids, repaired): evidence ids of aspects, taken anew from their claims where one is unknown or can't bear the aspect (MET11).

    ``aspects``: (qid, aspect_id, evidence_ids, claim_ids); ``claims``: (qid, claim_id, evidence_ids); ``evidence``: (qid,
    evidence_id, kind, doc_id, local_path). Evidence bears an aspect if its kind is direct and its page, if it has one, is
    at hand. Ids come in the order of the claims, each once; an aspect whose claims have none to offer stays as it is.
    """
    good = evidence.where(F.col("kind").isin(*DIRECT_KINDS) & (F.col("doc_id").isNull() | F.col("local_path").isNotNull())).select("qid", "evidence_id").distinct().withColumn("good", F.lit(True))
    named = aspects.select("qid", "aspect_id", F.explode("evidence_ids").alias("evidence_id")).join(good, ["qid", "evidence_id"], "left")
    bad = named.where("good IS NULL").select("qid", "aspect_id").distinct().withColumn("bad", F.lit(True))
    mapped = aspects.join(bad, ["qid", "aspect_id"], "left_semi").select("qid", "aspect_id", F.posexplode("claim_ids").alias("i", "claim_id"))
    offered = mapped.join(claims, ["qid", "claim_id"]).select("qid", "aspect_id", "i", F.posexplode("evidence_ids").alias("j", "evidence_id")).join(good, ["qid", "evidence_id"], "left_semi")
    once = offered.groupBy("qid", "aspect_id", "evidence_id").agg(F.min(F.struct("i", "j")).alias("at"))
    bound = once.groupBy("qid", "aspect_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "evidence_id"))), lambda x: x["evidence_id"]).alias("bound"))  # an aspect's evidence
    return aspects.join(bound, ["qid", "aspect_id"], "left").select("qid", "aspect_id", F.coalesce("bound", "evidence_ids").alias("evidence_ids"), F.col("bound").isNotNull().alias("repaired"))
