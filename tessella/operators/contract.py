"""What a model's answer must look like: the JSON contract of an agent's reply, objects in free text, source specifications
(VAL11, HLP12, SRC18). All of it stays in the JVM: texts are parsed to VARIANT once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_SOURCES = 10
KEYS = ("answer", "sources")
# Names that a specification may use.
NORMALISERS = ("github", "tailwind", "prisma", "supabase")


def _kind(x: Column) -> Column:
    return F.schema_of_variant(x)


def parsed(text: Column) -> Column:
    """A JSON text as VARIANT, null if it isn't one from its start to its end. A reader of one value passes over what follows it, so
    the text is read as the first of two elements, of which the second is known."""
    both = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(", 7919]"))), "$", "array<variant>")
    whole = (F.size(both) == 2) & (F.try_variant_get(F.get(both, 1), "$", "int") == 7919)
    return F.when(whole, F.get(both, 0))


def replies(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``errors`` (joined by ";"), ``answer``, ``sources`` (MOST_SOURCES distinct ones at most) and ``invalid`` ("place:reason" each)."""
    v = parsed(F.btrim(F.regexp_replace(text, r"\x1b\[[0-9;?]*[ -/]*[@-~]", "")))
    found = rows.withColumn("_v", v).withColumn("_m", F.when(_kind(F.col("_v")).startswith("OBJECT"), F.try_variant_get("_v", "$", "map<string,variant>")))
    part = lambda k: F.try_element_at("_m", F.lit(k))
    listed = F.when(_kind(part("sources")).startswith("ARRAY"), F.try_variant_get(part("sources"), "$", "array<variant>"))
    found = found.withColumn("_s", F.coalesce(listed, F.array().cast("array<variant>"))).withColumn("_list", listed.isNotNull())
    texts = F.transform("_s", lambda s: F.when(_kind(s) == "STRING", F.try_variant_get(s, "$", "string")))
    found = found.withColumn("_t", texts)
    reason = F.transform("_t", lambda t, i: F.when(t.isNull(), "not_string").when(F.btrim(t) == "", "empty").when(F.array_position("_t", t) <= i, "duplicate"))
    invalid = F.filter(F.transform(reason, lambda r, i: F.when(r.isNotNull(), F.concat(i.cast("string"), F.lit(":"), r))), lambda x: x.isNotNull())
    found = found.withColumn("invalid", invalid)
    keys = F.map_keys("_m")
    lacks, more = F.array_sort(F.array_except(F.array(*map(F.lit, KEYS)), keys)), F.array_sort(F.array_except(keys, F.array(*map(F.lit, KEYS))))
    wrong = F.array(
        F.when(F.size(lacks) > 0, F.concat(F.lit("missing_keys:"), F.array_join(lacks, ","))), F.when(F.size(more) > 0, F.concat(F.lit("unexpected_keys:"), F.array_join(more, ","))),
        F.when(~F.coalesce(_kind(part("answer")) == "STRING", F.lit(False)), "answer_not_string"), F.when(~F.col("_list"), "sources_not_array"),
        F.when(F.size("_s") > MOST_SOURCES, "too_many_sources"), F.when(F.size("invalid") > 0, "invalid_sources"),
    )
    errors = F.when(F.col("_v").isNull(), "invalid_json").when(F.col("_m").isNull(), "output_not_object").otherwise(F.array_join(F.filter(wrong, lambda x: x.isNotNull()), ";"))
    good = F.slice(F.array_distinct(F.filter("_t", lambda t: t.isNotNull() & (F.btrim(t) != ""))), 1, MOST_SOURCES)
    answer = F.coalesce(F.when(_kind(part("answer")) == "STRING", F.try_variant_get(part("answer"), "$", "string")), F.lit(""))
    return found.select(*rows.columns, errors.alias("errors"), answer.alias("answer"), good.alias("sources"), "invalid")


def object_in(text: Column) -> Column:
    """The JSON object between the first and the last brace of a text, fences about it or not, of any depth; null if that is none."""
    bare = F.regexp_replace(F.regexp_replace(F.btrim(text), r"^(?i)```(?:json)?\s*", ""), r"\s*```\z", "")
    v = parsed(F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit("")))
    return F.when(_kind(v).startswith("OBJECT"), v)


def specifications(specs: DataFrame) -> DataFrame:
    """(id, errors) of source specifications (id, revision, repository, checkout, normalizer, hosts, content_roots), what is wrong joined by ";"."""
    twice = specs.groupBy("id").agg(F.count("*").alias("same_id"))
    shared = specs.groupBy("checkout").agg(F.count("*").alias("same_checkout"))
    unsafe = lambda p: (p == "") | p.startswith("/") | F.array_contains(F.split(p, "/"), "..")
    wrong = F.array(
        F.when(~F.coalesce(F.col("id"), F.lit("")).rlike("^[a-z0-9]+(?:-[a-z0-9]+)*$"), "invalid_id"), F.when(F.col("same_id") > 1, "duplicate_id"), F.when(F.col("same_checkout") > 1, "duplicate_checkout"),
        F.when(~F.lower(F.coalesce("revision", F.lit(""))).rlike("^[0-9a-f]{40}$"), "revision"), F.when(~F.coalesce("repository", F.lit("")).rlike(r"^https://github\.com/.*\.git$"), "repository"),
        F.when(~F.coalesce("normalizer", F.lit("")).isin(*NORMALISERS), "normalizer"), F.when(F.coalesce(F.size("hosts"), F.lit(0)) <= 0, "no_hosts"), F.when(F.coalesce(F.size("content_roots"), F.lit(0)) <= 0, "no_content_roots"),
        F.when(F.exists(F.concat(F.array("checkout"), F.coalesce("content_roots", F.array().cast("array<string>"))), unsafe), "unsafe_path"),
    )
    return specs.join(twice, "id").join(shared, "checkout").select("id", F.array_join(F.filter(wrong, lambda x: x.isNotNull()), ";").alias("errors"))
