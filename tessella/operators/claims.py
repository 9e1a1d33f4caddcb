"""Knowledge claims: alias clusters, alignment filter, artifact and its checks (KGX01-KGX07, HLP09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, stable_id
from .components import components

#: Kinds of alignment by what the best unit holds: subject and object, one of both and the predicate or a word, words only.
WEAK = "token_overlap"


def _trigrams(x: Column) -> Column:
    """Distinct runs of three characters of the folded name between two blanks on each side."""
    padded = F.concat(F.lit("  "), x, F.lit("  "))
    return F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))))


def similar(names: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of (id, name) whose trigram sets have a Jaccard similarity of num/den or more: a prefix-filtered join, rare trigrams first."""
    sets = names.select("id", _trigrams(F.col("name")).alias("g")).withColumn("n", F.size("g"))
    flat = sets.select("id", "n", F.explode("g").alias("t"))
    held = flat.groupBy("t").agg(F.count("*").alias("df"))
    order = F.row_number().over(Window.partitionBy("id").orderBy("df", "t"))
    prefix = F.col("n") - F.ceil(F.lit(num) * F.col("n") / F.lit(den) - 1e-9) + 1
    ranked = flat.join(held, "t").withColumn("at", order).where(F.col("at") <= prefix)
    a, b = (ranked.select("t", F.col("id").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    fits = (F.col("na") * den >= F.col("nb") * num) & (F.col("nb") * den >= F.col("na") * num)
    pairs = a.join(b, "t").where("a < b").where(fits).select("a", "b").distinct()
    one, two = (sets.select(F.col("id").alias(x), F.col("g").alias(f"g{x}")) for x in "ab")
    shared = F.size(F.array_intersect("ga", "gb"))
    return pairs.join(one, "a").join(two, "b").where(den * shared >= num * (F.size("ga") + F.size("gb") - shared)).select("a", "b")


def _preferred(group: list[str]) -> Column:
    """The shortest name, then the first in folded and in plain order."""
    return F.row_number().over(Window.partitionBy(*group).orderBy(F.length("name"), fold(F.col("name")), "name"))


def alias_clusters(names: DataFrame, num: int = 7, den: int = 10) -> DataFrame:
    """(name, canonical) of distinct trimmed names (KGX02, HLP09).

    Names that are equal when folded are one; those of similar spelling are joined, and whatever joins reach is a cluster
    with one canonical name. Trigrams need no embedding model.
    """
    distinct = names.select(F.trim("name").alias("name")).where("name <> ''").distinct().withColumn("id", fold(F.col("name")))
    heads = distinct.withColumn("at", _preferred(["id"])).where("at = 1").select("id", F.col("id").alias("folded"))
    found = components(similar(heads.select("id", F.col("folded").alias("name")), num, den))
    members = distinct.join(found, "id", "left").select("name", F.coalesce("component", "id").alias("cluster"))
    canonical = members.withColumn("at", _preferred(["cluster"])).where("at = 1").select("cluster", F.col("name").alias("canonical"))
    return members.join(canonical, "cluster").select("name", "canonical")


def aligned(relations: DataFrame, units: DataFrame) -> DataFrame:
    """Each relation (batch, subject, predicate, object) with its best unit (batch, unit_id, text) and how it is borne out (KGX01).

    A unit scores 4 for the subject, 4 for the object, 1 for the predicate, and the words that it shares with them.
    """
    low = lambda c: F.lower(F.col(c))
    words = lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit(r"[a-z0-9]+"), F.lit(0)))
    has = lambda c: F.contains(low("text"), low(c)).cast("int")
    asked = words(F.lower(F.concat_ws(" ", "subject", "predicate", "object")))
    both = relations.join(units, "batch").withColumn("s", has("subject")).withColumn("o", has("object")).withColumn("p", has("predicate"))
    score = 4 * F.col("s") + 4 * F.col("o") + F.col("p") + F.size(F.array_intersect(asked, words(low("text")))) / F.greatest(F.lit(1), F.size(asked))
    ranked = both.withColumn("score", F.round(score, 6)).withColumn("at", F.row_number().over(Window.partitionBy("batch", "subject", "predicate", "object").orderBy(F.desc("score"), "unit_id")))
    kind = F.when((F.col("s") == 1) & (F.col("o") == 1), "both_entities").when((F.col("s") == 1) | (F.col("o") == 1), "one_entity").otherwise(WEAK)
    return ranked.where("at = 1").select("batch", "unit_id", "subject", "predicate", "object", "score", kind.alias("alignment"))


def artifact(found: DataFrame, num: int = 7, den: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, predicates, claims) of aligned relations with a project (KGX03, KGX04): weakly aligned ones go, names without a
    claim go with them, counts are of what is left; ids are digests of project and canonical name; equal claims of a unit are one."""
    strong = found.where(F.col("alignment") != WEAK)
    ends = strong.select(F.explode(F.array("subject", "object")).alias("name"))
    names, relations = alias_clusters(ends, num, den), alias_clusters(strong.select(F.col("predicate").alias("name")), num, den)
    said = strong
    for end, table in (("subject", names), ("object", names), ("predicate", relations)):
        said = said.withColumn(end, F.trim(end)).join(table.select(F.col("name").alias(end), F.col("canonical").alias(f"{end}_name")), end)
    entity = lambda c: stable_id("ent", F.col("project"), F.col(f"{c}_name"))
    said = said.select("project", "unit_id", "subject", "predicate", "object", "alignment", "subject_name", "object_name", "predicate_name", entity("subject").alias("subject_id"), entity("object").alias("object_id"), stable_id("prd", F.col("project"), F.col("predicate_name")).alias("predicate_id"))
    claims = said.dropDuplicates(["project", "unit_id", "subject_id", "predicate_id", "object_id"])
    claims = claims.withColumn("claim_id", stable_id("clm", F.col("unit_id").cast("string"), F.col("subject_id"), F.col("predicate_id"), F.col("object_id")))
    held = claims.select("project", "claim_id", F.explode(F.array_distinct(F.array(F.struct(F.col("subject_id").alias("id"), F.col("subject_name").alias("name")), F.struct(F.col("object_id").alias("id"), F.col("object_name").alias("name"))))).alias("e"))
    entities = held.groupBy("project", F.col("e.id").alias("entity_id"), F.col("e.name").alias("canonical_name")).agg(F.countDistinct("claim_id").alias("claim_count"))
    predicates = claims.groupBy("project", "predicate_id", F.col("predicate_name").alias("canonical_name")).agg(F.count("*").alias("claim_count"))
    return entities, predicates, claims.select("claim_id", "project", "unit_id", "subject_id", "predicate_id", "object_id", "alignment")


def dangling(entities: DataFrame, predicates: DataFrame, claims: DataFrame, units: DataFrame) -> DataFrame:
    """(kind, n): claims whose ends, predicate or unit are missing, and entities that no claim names (KGX05)."""
    missing = lambda kind, left, key, right, other: left.join(right.select(F.col(other).alias(key)).distinct(), key, "left_anti").agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    ends = claims.select(F.col("subject_id").alias("id")).union(claims.select("object_id")).distinct()
    checks = [
        missing("subject", claims, "subject_id", entities, "entity_id"), missing("object", claims, "object_id", entities, "entity_id"), missing("predicate", claims, "predicate_id", predicates, "predicate_id"),
        missing("unit", claims, "unit_id", units, "unit_id"), missing("orphan", entities, "entity_id", ends, "id"),
    ]
    out = checks[0]
    for x in checks[1:]:
        out = out.union(x)
    return out
