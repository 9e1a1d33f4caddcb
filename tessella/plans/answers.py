"""Judged answers of all questions in three arms (MET08, AGG05, AGG16, HLP02)."""

from __future__ import annotations

from ..operators import answers as A
from .registry import query, views

# Aspects, judgments, issues and runs of every question, computed; both engines read these statements alike.
ASPECTS = """SELECT item_id AS qid, k AS aspect_id, CAST((item_id + k) % 4 AS DOUBLE) AS weight, CAST(k % 3 AS INT) AS importance, (item_id + k) % 3 = 0 AS critical, (item_id * k) % 3 AS n_docs
  FROM benchmark CROSS JOIN (VALUES (1), (2), (3), (4), (5)) AS v(k) WHERE k <= 3 + item_id % 3"""
ARMS = "(VALUES (0, 'files'), (1, 'hybrid'), (2, 'graph')) AS arms(a, arm)"
JUDGED = f"""SELECT qid, arm, aspect_id, ((qid * 7 + aspect_id * 3 + a * 5) % 3) / 2.0E0 AS coverage, CASE (qid * 7 + aspect_id * 3 + a * 5) % 3 WHEN 2 THEN 'full' WHEN 1 THEN 'partial'
  ELSE CASE WHEN (qid + a) % 5 = 0 THEN 'contradicted' WHEN (qid + aspect_id) % 4 = 0 THEN 'unsupported' ELSE 'none' END END AS support FROM ({ASPECTS}) s CROSS JOIN {ARMS}"""
ISSUES = f"""SELECT item_id AS qid, arm, 'unsupported' AS type, CASE item_id % 3 WHEN 0 THEN 'minor' WHEN 1 THEN 'material' ELSE 'critical' END AS severity FROM benchmark CROSS JOIN {ARMS} WHERE (item_id + a) % 4 = 1
  UNION ALL SELECT item_id, arm, 'contradicted', CASE WHEN item_id % 2 = 0 THEN 'minor' ELSE 'material' END FROM benchmark CROSS JOIN {ARMS} WHERE (item_id * 3 + a) % 7 = 2"""
RUNS = f"SELECT item_id AS qid, arm, (item_id + 2 * a) % 11 <> 0 AS agent_ok, CASE WHEN (item_id + a) % 6 = 0 THEN 1 ELSE 0 END AS n_invalid, CAST(1 + (item_id + a) % 5 AS INT) AS quality FROM benchmark CROSS JOIN {ARMS}"

SCORED = f"""aspects AS ({ASPECTS}), judged AS ({JUDGED}), issues AS ({ISSUES}), runs AS ({RUNS}),
w AS (SELECT j.*, critical, n_docs, CASE WHEN weight <> 0 THEN weight WHEN importance <> 0 THEN importance ELSE 1 END AS w FROM judged j JOIN aspects a ON a.qid = j.qid AND a.aspect_id = j.aspect_id),
g AS (SELECT qid, arm, sum(w * coverage) / sum(w) AS cov, count(*) FILTER (critical) AS crit, count(*) FILTER (critical AND coverage = 1 AND support = 'full') AS got, count(*) FILTER (critical AND support IN ('unsupported', 'contradicted')) AS bad,
  count(*) FILTER (coverage > 0) AS partly, count(*) FILTER (n_docs > 0) AS documented FROM w GROUP BY qid, arm),
i AS (SELECT qid, arm, count(*) AS n, count(*) FILTER (type = 'unsupported') AS u, count(*) FILTER (type = 'contradicted') AS c FROM issues WHERE severity <> 'minor' GROUP BY qid, arm),
scored AS (SELECT runs.qid, runs.arm, round(CASE WHEN agent_ok THEN cov ELSE 0 END, 6) AS coverage, crit = got AS critical_full, round(got / greatest(1, crit), 6) AS critical_success,
  CASE WHEN NOT agent_ok OR bad > 0 OR coalesce(i.n, 0) > 0 THEN 'incorrect' WHEN crit = got THEN 'complete' WHEN partly > 0 THEN 'partial' ELSE 'incorrect' END AS outcome, documented,
  coalesce(u, 0) AS n_unsupported, coalesce(c, 0) AS n_contradicted, n_invalid = 0 AS integrity, quality FROM runs JOIN g ON g.qid = runs.qid AND g.arm = runs.arm LEFT JOIN i ON i.qid = runs.qid AND i.arm = runs.arm)"""
CONTRASTS = [("hybrid", "files"), ("graph", "hybrid"), ("graph", "files")]


def scores(spark, d: str):
    views(spark, d, "benchmark")
    return A.candidate_scores(*(spark.sql(x) for x in (ASPECTS, JUDGED, ISSUES, RUNS)))


@query("met08_candidate_scores", f"WITH {SCORED} SELECT * FROM scored")
def met08(spark, d):
    """Coverage, critical success and outcome of every answer."""
    return scores(spark, d)


@query(
    "agg05_judge_summary",
    f"""WITH {SCORED} SELECT arm, count(*) AS n, round(avg(coverage), 6) AS coverage, round(avg(critical_success), 6) AS critical_success, round(avg((outcome = 'complete')::INT), 6) AS complete, round(avg((outcome = 'partial')::INT), 6) AS partial,
    round(avg((outcome = 'incorrect')::INT), 6) AS incorrect, round(avg((n_unsupported > 0)::INT), 6) AS unsupported, round(avg(integrity::INT), 6) AS integrity, round(avg(quality), 6) AS quality FROM scored GROUP BY arm""",
)
def agg05(spark, d):
    return A.judge_summary(scores(spark, d))


@query(
    "agg16_paired_deltas",
    f"WITH {SCORED} SELECT a.arm || '_minus_' || b.arm AS contrast, count(*) AS n, round(avg(a.coverage - b.coverage), 6) AS mean_delta FROM scored a JOIN scored b ON a.qid = b.qid WHERE (a.arm, b.arm) IN (('hybrid', 'files'), ('graph', 'hybrid'), ('graph', 'files')) GROUP BY 1",
)
def agg16d(spark, d):
    from pyspark.sql import functions as F

    return A.paired_deltas(scores(spark, d), CONTRASTS).groupBy("contrast").agg(F.count("*").alias("n"), F.round(F.avg("delta"), 6).alias("mean_delta"))


@query("agg16_shared_bootstrap")
def agg16(spark, d):
    """Percentile intervals of three contrasts from one random stream."""
    return A.shared_bootstrap(A.paired_deltas(scores(spark, d), CONTRASTS))
