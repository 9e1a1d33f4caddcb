"""Knowledge claims over the first lines of all documents (KGX01-KGX07, HLP09)."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import claims as C
from ..storage import built
from .registry import query, table

# Units are first lines, two a batch; a relation is made of a line's words, its object at times in capitals or with an
# ending, and one document in nine says a relation that no unit bears out.
RELATIONS = """lines AS (SELECT doc_id, lang AS project, string_split(text, chr(10))[1] AS line FROM documents),
units AS (SELECT doc_id // 2 AS batch, doc_id AS unit_id, project, line AS text FROM lines),
word AS (SELECT doc_id, project, regexp_extract_all(line, '[A-Za-z]+') AS w FROM lines),
rel AS (SELECT DISTINCT doc_id // 2 AS batch, CASE WHEN doc_id % 9 = 5 THEN 'zq' || doc_id ELSE w[1] END AS subject, lower(w[2]) AS predicate,
  CASE WHEN doc_id % 9 = 5 THEN 'qz' || doc_id WHEN doc_id % 4 = 0 THEN upper(w[3]) WHEN doc_id % 4 = 1 THEN w[3] || 's' ELSE w[3] END AS object FROM word WHERE len(w) >= 3)"""
LOWER = "regexp_extract_all(lower({x}), '[a-z0-9]+')"
ALIGNED = f"""{RELATIONS}, pairs AS (SELECT r.*, u.unit_id, u.project, contains(lower(u.text), lower(subject))::INT AS s, contains(lower(u.text), lower(object))::INT AS o, contains(lower(u.text), lower(predicate))::INT AS p,
  list_distinct({LOWER.format(x="subject || ' ' || predicate || ' ' || object")}) AS asked, list_distinct({LOWER.format(x="u.text")}) AS has FROM rel r JOIN units u USING (batch)),
aligned AS (SELECT batch, unit_id, project, subject, predicate, object, round(4 * s + 4 * o + p + len(list_intersect(asked, has)) / greatest(1, len(asked)), 6) AS score,
  CASE WHEN s = 1 AND o = 1 THEN 'both_entities' WHEN s = 1 OR o = 1 THEN 'one_entity' ELSE 'token_overlap' END AS alignment FROM pairs QUALIFY row_number() OVER (PARTITION BY batch, subject, predicate, object ORDER BY score DESC, unit_id) = 1),
strong AS (SELECT * FROM aligned WHERE alignment <> 'token_overlap')"""


def _clusters(name: str, source: str) -> str:
    """CTEs of the alias clusters of a CTE's column ``name``: @ has (name, canonical)."""
    return f"""{name}_d AS (SELECT DISTINCT name, lower(name) AS id FROM {source}),
{name}_g AS (SELECT id, list_distinct(list_transform(range(1, length(id) + 3), lambda i: substr('  ' || id || '  ', i, 3))) AS g FROM (SELECT DISTINCT id FROM {name}_d)),
{name}_f AS (SELECT id, len(g) AS n, unnest(g) AS t FROM {name}_g),
{name}_p AS (SELECT a.id AS a, b.id AS b FROM {name}_f a JOIN {name}_f b ON a.t = b.t AND a.id <> b.id GROUP BY a.id, b.id HAVING 10 * count(*) >= 7 * (any_value(a.n) + any_value(b.n) - count(*))),
{name}_r(root, node) AS (SELECT id, id FROM {name}_g UNION SELECT r.root, p.b FROM {name}_r r JOIN {name}_p p ON r.node = p.a),
{name}_c AS (SELECT root AS id, min(node) AS cluster FROM {name}_r GROUP BY root),
{name} AS (SELECT name, first_value(name) OVER (PARTITION BY cluster ORDER BY length(name), lower(name), name) AS canonical FROM {name}_d JOIN {name}_c USING (id))"""


STABLE = "'{p}-' || substr(sha256({x}), 1, 24)"
ARTIFACT = f"""{ALIGNED}, ends AS (SELECT subject AS name FROM strong UNION SELECT object FROM strong), verbs AS (SELECT predicate AS name FROM strong),
{_clusters('nm', 'ends')}, {_clusters('vb', 'verbs')},
said AS (SELECT strong.*, a.canonical AS sn, b.canonical AS onm, v.canonical AS pn, {STABLE.format(p='ent', x="project || chr(0) || a.canonical")} AS subject_id, {STABLE.format(p='ent', x="project || chr(0) || b.canonical")} AS object_id,
  {STABLE.format(p='prd', x="project || chr(0) || v.canonical")} AS predicate_id FROM strong JOIN nm a ON a.name = subject JOIN nm b ON b.name = object JOIN vb v ON v.name = predicate),
claims AS (SELECT DISTINCT project, unit_id, subject_id, predicate_id, object_id, sn, onm, pn, {STABLE.format(p='clm', x="unit_id || chr(0) || subject_id || chr(0) || predicate_id || chr(0) || object_id")} AS claim_id FROM said),
entities AS (SELECT project, entity_id, any_value(name) AS canonical_name, count(DISTINCT claim_id) AS claim_count FROM (SELECT project, claim_id, subject_id AS entity_id, sn AS name FROM claims UNION ALL SELECT project, claim_id, object_id, onm FROM claims) GROUP BY project, entity_id),
predicates AS (SELECT project, predicate_id, any_value(pn) AS canonical_name, count(*) AS claim_count FROM claims GROUP BY project, predicate_id)"""


def units(spark, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(F.floor(F.col("doc_id") / 2).alias("batch"), F.col("doc_id").alias("unit_id"), F.col("lang").alias("project"), F.substring_index("text", "\n", 1).alias("text"))


def relations(spark, d: str) -> DataFrame:
    words = units(spark, d).select("batch", F.col("unit_id").alias("i"), F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("w")).where(F.size("w") >= 3)
    w = lambda k: F.get("w", F.lit(k - 1))
    unknown, i = F.col("i") % 9 == 5, F.col("i")
    subject = F.when(unknown, F.concat(F.lit("zq"), i.cast("string"))).otherwise(w(1))
    object_ = F.when(unknown, F.concat(F.lit("qz"), i.cast("string"))).when(i % 4 == 0, F.upper(w(3))).when(i % 4 == 1, F.concat(w(3), F.lit("s"))).otherwise(w(3))
    return words.select("batch", subject.alias("subject"), F.lower(w(2)).alias("predicate"), object_.alias("object")).distinct()


def aligned(spark, d: str) -> DataFrame:
    found = C.aligned(relations(spark, d), units(spark, d).drop("project"))
    return found.join(units(spark, d).select("unit_id", "project"), "unit_id")


def artifact(spark, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables of the claim artifact, written once."""
    source = table(spark, d, "documents")
    parts = lru_cache(maxsize=1)(lambda: C.artifact(aligned(spark, d)))
    return tuple(built(source, f"claims-{k}", lambda k=k: parts()[k]) for k in range(3))


@query("kgx01_claim_alignment", f"WITH {ALIGNED} SELECT batch, unit_id, subject, predicate, object, score, alignment FROM aligned")
def kgx01(spark, d):
    """Every relation with the unit of its batch that bears it out best."""
    return aligned(spark, d).select("batch", "unit_id", "subject", "predicate", "object", "score", "alignment")


@query("kgx02_alias_clusters", f"WITH RECURSIVE {ALIGNED}, ends AS (SELECT subject AS name FROM strong UNION SELECT object FROM strong), {_clusters('nm', 'ends')} SELECT name, canonical FROM nm")
def kgx02(spark, d):
    """Names by folding, similar spelling and what joins reach, each with its cluster's shortest name."""
    strong = aligned(spark, d).where(F.col("alignment") != C.WEAK)
    return C.alias_clusters(strong.select(F.explode(F.array("subject", "object")).alias("name")))


@query("hlp09_alias_map", f"WITH RECURSIVE {ALIGNED}, ends AS (SELECT subject AS name FROM strong UNION SELECT object FROM strong), {_clusters('nm', 'ends')} SELECT lower(name) AS member, min(canonical) AS canonical, count(*) AS n FROM nm GROUP BY lower(name)")
def hlp09(spark, d):
    """Folded member to canonical name."""
    return kgx02(spark, d).groupBy(F.lower("name").alias("member")).agg(F.min("canonical").alias("canonical"), F.count("*").alias("n"))


@query("kgx03_claims", f"WITH RECURSIVE {ARTIFACT} SELECT claim_id, project, unit_id, subject_id, predicate_id, object_id FROM claims")
def kgx03(spark, d):
    """Claims, one of each unit and triple of canonical names, with hashed ids."""
    return artifact(spark, d)[2].drop("alignment")


@query("kgx03_entities", f"WITH RECURSIVE {ARTIFACT} SELECT * FROM entities")
def kgx03e(spark, d):
    return artifact(spark, d)[0]


@query("kgx04_weak_claims", f"WITH {ALIGNED} SELECT alignment, count(*) AS n, CAST(sum((alignment <> 'token_overlap')::INT) AS BIGINT) AS kept FROM aligned GROUP BY alignment")
def kgx04(spark, d):
    """How relations are aligned; those that only share words are not kept."""
    return aligned(spark, d).groupBy("alignment").agg(F.count("*").alias("n"), F.count_if(F.col("alignment") != C.WEAK).alias("kept"))


@query("kgx04_pruned_predicates", f"WITH RECURSIVE {ARTIFACT} SELECT * FROM predicates")
def kgx04p(spark, d):
    """Predicates that still have a claim after the filter, counted anew."""
    return artifact(spark, d)[1]


@query(
    "kgx05_referential_check",
    f"""WITH RECURSIVE {ARTIFACT}, e AS (SELECT * FROM entities WHERE claim_count > 1), u AS (SELECT * FROM units WHERE unit_id % 10 <> 3)
    SELECT 'subject' AS kind, count(*) AS n FROM claims WHERE subject_id NOT IN (SELECT entity_id FROM e) UNION ALL SELECT 'object', count(*) FROM claims WHERE object_id NOT IN (SELECT entity_id FROM e)
    UNION ALL SELECT 'predicate', count(*) FROM claims WHERE predicate_id NOT IN (SELECT predicate_id FROM predicates) UNION ALL SELECT 'unit', count(*) FROM claims WHERE unit_id NOT IN (SELECT unit_id FROM u)
    UNION ALL SELECT 'orphan', count(*) FROM e WHERE entity_id NOT IN (SELECT subject_id FROM claims UNION SELECT object_id FROM claims)""",
)
def kgx05(spark, d):
    """Both ends, predicate, unit and orphans of an artifact from which single-claim entities and some units were taken."""
    entities, predicates, found = artifact(spark, d)
    return C.dangling(entities.where("claim_count > 1"), predicates, found, units(spark, d).where("unit_id % 10 <> 3"))


@query("kgx06_claim_ingest", f"WITH RECURSIVE {ARTIFACT} SELECT claim_id, a.canonical_name AS subject, p.canonical_name AS predicate, b.canonical_name AS object, CAST(length(text) AS BIGINT) AS unit_chars FROM claims c JOIN entities a ON a.entity_id = subject_id JOIN entities b ON b.entity_id = object_id JOIN predicates p ON p.predicate_id = c.predicate_id JOIN units u ON u.unit_id = c.unit_id")
def kgx06(spark, d):
    """Claims that match all four of their endpoints: subject, object, predicate and unit."""
    entities, predicates, found = artifact(spark, d)
    for end in ("subject", "object"):
        found = found.join(entities.select(F.col("entity_id").alias(f"{end}_id"), F.col("canonical_name").alias(end)), f"{end}_id")
    found = found.join(predicates.select("predicate_id", F.col("canonical_name").alias("predicate")), "predicate_id")
    return found.join(units(spark, d).select("unit_id", F.length("text").cast("bigint").alias("unit_chars")), "unit_id").select("claim_id", "subject", "predicate", "object", "unit_chars")


@query("kgx07_relation_cleanup", f"WITH {RELATIONS} SELECT DISTINCT trim(subject) AS subject, trim(predicate) AS predicate, trim(object) AS object FROM rel WHERE trim(subject) <> '' AND trim(predicate) <> '' AND trim(object) <> ''")
def kgx07(spark, d):
    """Distinct trimmed triples without an empty part."""
    parts = ("subject", "predicate", "object")
    return relations(spark, d).select(*(F.trim(c).alias(c) for c in parts)).where(" AND ".join(f"{c} <> ''" for c in parts)).distinct()
