"""Summaries, duplicate audits, bootstrap intervals (AGG01, AGG10, AGG15)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold
from ..storage import parked


def summary(rows: DataFrame, keys: list[str], metrics: list[str], optional: list[str] = ()) -> DataFrame:
    """Means by group; those of ``optional`` only where every row has them (AGG01)."""
    need = [F.when(F.count(m) == F.count("*"), F.round(F.avg(m), 9)).alias(m) for m in optional]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *(F.round(F.avg(m), 9).alias(m) for m in metrics), *need)


def lexical_tokens(text):
    return F.regexp_extract_all(fold(text), F.lit(r"(?U)\b\w+\b"), F.lit(0))


def lexical_shingles(words, k: int = 3):
    """Distinct runs of ``k`` tokens (TXT33); ``words`` is best a column, not an expression, as it is used several times."""
    runs = words
    for i in range(2, k + 1):  # whole arrays are zipped: a lambda that held `words` would evaluate it once an element
        runs = F.zip_with(runs, F.slice(words, i, F.greatest(F.lit(1), F.size(words))), lambda x, y: F.concat_ws(" ", x, y))
    runs = F.slice(runs, F.lit(1), F.greatest(F.lit(0), F.size(words) - k + 1))
    return F.array_distinct(runs)


def near_duplicate_pairs(rows: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, least_tokens: int = 8) -> DataFrame:
    """(a, b, jaccard, n_a, n_b) of different texts whose shingle sets are alike (AGG10): the smallest key of each text and how many rows have it.

    Equal texts are one from the start, so copies cost nothing. Sets are sorted arrays of 64-bit hashes, written once.
    With shingles ordered by how few texts hold them, two sets at the threshold share one among the first
    n - ceil(threshold * n) + 1, at places that leave room for the overlap needed; only such pairs are compared.
    """
    one = rows.where(F.col(text).isNotNull()).groupBy(F.xxhash64(text).alias("same"), F.sha2(text, 256).alias("digest")).agg(F.min(key).alias("id"), F.count("*").alias("copies"))
    first = rows.select(F.col(key).alias("id"), text).join(one.select("id", "copies", "digest"), "id").where(F.sha2(text, 256) == F.col("digest")).dropDuplicates(["id", "digest"])
    words = first.select("id", "copies", lexical_tokens(F.col(text)).alias("words")).where(F.size("words") >= least_tokens)
    place = F.sequence(F.lit(0), F.size("words") - 3)
    hashed = F.transform(place, lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    sets = parked(words.select("id", "copies", F.array_sort(F.array_distinct(hashed)).alias("sh")).withColumn("n", F.size("sh")), "shingles")
    flat = sets.select("id", "n", F.explode("sh").alias("s"))
    held = flat.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    shared = flat.join(held, "s")  # shingles of one text alone match nothing: they only come first in its order
    number = Window.partitionBy("id")
    at = F.col("n") - F.count("*").over(number) + F.row_number().over(number.orderBy("df", "s"))
    prefix = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    ranked = shared.select("id", "n", "s", at.alias("at")).where(F.col("at") <= prefix)
    a, b = (ranked.select("s", F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("at").alias(f"at{x}")) for x in "ab")
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("nb")) - 1e-9)
    fits = (F.col("na") >= threshold * F.col("nb") - 1e-9) & (F.col("nb") >= threshold * F.col("na") - 1e-9)
    first_at = F.min(F.struct("ata", "atb")).alias("p")
    pairs = a.join(b, "s").where("a < b").where(fits).groupBy("a", "b", "na", "nb").agg(first_at)
    pairs = pairs.where(1 + F.least(F.col("na") - F.col("p.ata"), F.col("nb") - F.col("p.atb")) >= need).select("a", "b")
    one, two = (sets.select(F.col("id").alias(x), F.col("sh").alias(f"s{x}"), F.col("copies").alias(f"n_{x}")) for x in "ab")
    joined = pairs.join(one, "a").join(two, "b")
    both = F.size(F.array_intersect("sa", "sb"))
    j = both / (F.size("sa") + F.size("sb") - both)
    return joined.select("a", "b", "n_a", "n_b", j.alias("j")).where(F.col("j") + 1e-12 >= threshold).select("a", "b", F.round("j", 6).alias("jaccard"), "n_a", "n_b")


def bootstrap_delta(paired: DataFrame, samples: int = 10_000, seed: int = 17) -> DataFrame:
    """(metric, mean_delta, low, high) from (metric, question_id, delta): a percentile bootstrap over all deltas (AGG15).

    Equal deltas are counted first, so a metric's group holds each value once: a resample's counts of values are a
    multinomial draw, which has the distribution of drawing the deltas one by one.
    """

    def one(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("delta")
        d, n = pdf["delta"].to_numpy(float), pdf["n"].to_numpy()
        rng, total, step = np.random.default_rng(seed), int(n.sum()), max(1, 4_000_000 // len(n))
        means = np.concatenate([rng.multinomial(total, n / total, min(step, samples - i)) @ d / total for i in range(0, samples, step)])
        low, high = np.quantile(means, [0.025, 0.975])
        return pd.DataFrame({"metric": [pdf["metric"].iloc[0]], "mean_delta": [round(float(n @ d / total), 9)], "low": [float(low)], "high": [float(high)]})

    counted = paired.where("delta is not null").groupBy("metric", "delta").agg(F.count("*").alias("n"))
    return counted.groupBy("metric").applyInPandas(one, "metric string, mean_delta double, low double, high double")


# The measures of a rollout, for its primary ranking, its citations and what its tools showed; its token counts.
MEASURES = ("recall_at_1", "recall_at_5", "recall_at_10", "recall_at_20", "hit_at_1", "hit_at_5", "hit_at_10", "hit_at_20", "ndcg_at_10", "all_support_at_10")
ROLLOUT_MEASURES = tuple(f"{side}{m}" for side in ("", "citation_", "visible_") for m in MEASURES)
TOKEN_FIELDS = ("input_fresh", "input_cached", "input_total", "output", "total")


def agent_summary(rollouts: DataFrame, by: list[str]) -> DataFrame:
    """A row per group of rollouts (AGG03, HLP02): questions, 30 means, latency percentiles in ms, tokens, tool calls, rates of failures and expansions, models.

    ``rollouts``: ``by``, ROLLOUT_MEASURES, latency_seconds, usage (a map of TOKEN_FIELDS), tool_sequence, agent_ok, models and
    expansions (successful ones). A measure that a rollout lacks counts as 0; a null group is "unknown".
    """
    group = [F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in by]
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    expands = F.coalesce(F.array_contains("tool_sequence", "docsqa_expand"), F.lit(False)).cast("double")
    latency = lambda q: (F.percentile(value("latency_seconds"), F.lit(q)) * 1000).alias(f"latency_p{int(q * 100)}_ms")
    rows = rollouts.groupBy(*group).agg(
        F.count("*").alias("questions"), *(F.avg(value(m)).alias(m) for m in ROLLOUT_MEASURES), latency(0.5), latency(0.95),
        *(F.avg(F.coalesce(F.try_element_at("usage", F.lit(t)).cast("double"), F.lit(0.0))).alias(f"tokens_{t}") for t in TOKEN_FIELDS), F.avg(F.greatest(F.lit(0), F.coalesce(F.size("tool_sequence"), F.lit(0)))).alias("tool_calls_per_qa"),
        F.avg(F.when(F.col("agent_ok"), 0.0).otherwise(1.0)).alias("failure_rate"), F.avg(expands).alias("graph_expansion_attempt_rate"), F.avg((value("expansions") > 0).cast("double")).alias("graph_application_rate"), F.avg(value("expansions")).alias("graph_expansion_successes_per_qa"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("models")))).alias("models"),
    )
    return rows


def passages(pages: DataFrame, line_count: int = 18) -> DataFrame:
    """(columns but text and terms, start, end, section, passage): the lines about the one in which a question's terms occur most (TXT37).

    ``pages``: text and ``terms``, an array in lower case. Of equal lines the earliest counts; the section is the nearest
    heading above. Lines are cut and counted within a row, no line leaves it.
    """
    others = [c for c in pages.columns if c not in ("text", "terms")]
    lines = pages.withColumn("_l", F.split(F.coalesce("text", F.lit("")), "\n", -1))
    times = lambda b, t: ((F.length(b) - F.length(F.replace(b, t, F.lit("")))) / F.length(t)).cast("int")
    score = F.transform("_l", lambda b, i: F.struct(F.aggregate("terms", F.lit(0), lambda a, t: a + times(F.lower(b), t)).alias("n"), (-i).alias("neg")))
    best = lines.withColumn("_b", -F.array_max(score)["neg"])
    end = F.least(F.size("_l"), F.greatest(F.lit(0), F.col("_b") - line_count // 3) + line_count)
    spans = best.withColumn("end", end).withColumn("_s", F.greatest(F.lit(0), F.col("end") - line_count))
    above = F.filter(F.slice("_l", F.lit(1), F.col("_b") + 1), lambda b: b.startswith("#"))
    section = F.coalesce(F.btrim(F.regexp_replace(F.get(above, F.size(above) - 1), "^#+", "")), F.lit(""))
    passage = F.regexp_replace(F.array_join(F.slice("_l", F.col("_s") + 1, F.col("end") - F.col("_s")), "\n"), r"^\s+|\s+\z", "")
    return spans.select(*others, (F.col("_s") + 1).alias("start"), "end", section.alias("section"), passage.alias("passage"))
