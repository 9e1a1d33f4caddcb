"""Templates, nested content, repaired citations and the frozen policy (TXT14, TXT15, HLP19, HLP22, MET12, SVC06)."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from ..config import POLICY
from ..operators import nested as N
from .registry import query, table

# Reusables that name each other: a chain, a circle, and one that names what isn't there. The SQL knows what they come to.
REUSABLES = {"r0": "zero {% data reusables.r1 %}", "r1": "one {% data reusables.r2 %}", "r2": "two", "r3": "three {% data reusables.r4 %}", "r4": "four {% data reusables.r5 %}", "r5": "five {% data reusables.r3 %}", "r6": "six {%data reusables.r.nine%}"}
COME_TO = ["zero one two", "one two", "two", "three four five r3", "four five three r4", "five three four r5", "six r nine"]


@query(
    "txt14_templates",
    "SELECT doc_id, sha256('In ' || (["
    + ", ".join(f"'{x}'" for x in COME_TO)
    + "])[CAST(doc_id % 7 + 1 AS INT)] || ' by ' || CASE WHEN doc_id % 5 = 4 THEN 'name 4' ELSE 'Name ' || doc_id % 5 END || '  .' || string_split(text, chr(10))[1]) AS digest FROM documents",
)
def txt14(spark, d):
    """A template of every document, with reusables, variables and version tags."""
    i = F.col("doc_id")
    text = F.concat(F.lit("In {% data reusables.r"), (i % 7).cast("string"), F.lit(" %} by {% data variables.v.name_"), (i % 5).cast("string"), F.lit(" %} {% ifversion x %}."), F.substring_index("text", "\n", 1))
    reusables = spark.createDataFrame(list(REUSABLES.items()), "name string, text string")
    variables = spark.createDataFrame([(f"v.name_{k}", f"Name {k}") for k in range(4)], "name string, value string")
    out = N.rendered(table(spark, d, "documents").select(i.alias("key"), text.alias("text")), reusables, variables)
    return out.select(F.col("key").alias("doc_id"), F.sha2("text", 256).alias("digest"))


@query(
    "txt15_flattened",
    "SELECT event_id, unnest(['a.type', 'a.user.id', 'props.k']) AS path, unnest([event_type, CAST(user_id AS VARCHAR), json_extract_string(props, '$.k')]) AS value FROM events",
)
def txt15(spark, d):
    """Events as nested maps, flat again under dotted paths."""
    user = F.struct(F.col("user_id").alias("id"))
    value = F.to_json(F.struct(F.struct(F.col("event_type").alias("type"), user.alias("user"), F.array(F.lit(1)).alias("list")).alias("a"), F.from_json("props", "k bigint").alias("props")))
    return N.flattened(table(spark, d, "events").select("event_id", value.alias("value")), "event_id", "value")


@query("hlp19_nested_text", "SELECT conv_id, sha256(string_agg(text || chr(10) || role, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def hlp19(spark, d):
    """Conversations as nested tool content; the texts in it, in order."""
    block = lambda c: F.struct(F.lit("text").alias("type"), F.col(c).alias("text"))
    turn = F.struct("turn", F.struct(F.lit("result").alias("type"), F.array(block("text")).alias("content"), F.struct(block("role").alias("inner")).alias("more")).alias("x"))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))  # of one conversation
    value = F.to_json(F.struct(F.transform("t", lambda t: t["x"]).alias("turns")))
    return N.gathered(rows.select("conv_id", value.alias("value")), "conv_id", "value").select("conv_id", F.sha2("text", 256).alias("digest"))


@query(
    "met12_citation_repair",
    """WITH v AS (SELECT doc_id, 'guide/long/route/of/pages/' || doc_id % 7 || '/' || md5(CAST(doc_id AS VARCHAR)) AS doc, 'heading-of-' || md5('h' || doc_id) AS anchor FROM documents)
    SELECT doc_id AS scope, CASE doc_id % 4 WHEN 0 THEN replace(doc, 'route', 'rout') || '#' || anchor ELSE doc || '#' || replace(anchor, 'heading', 'headings') END AS cited, doc || '#' || anchor AS valid, CASE doc_id % 4 WHEN 0 THEN 'anchor_near_document' ELSE 'document_near_anchor' END AS method FROM v WHERE doc_id % 4 < 2""",
)
def met12(spark, d):
    """Cited sections in which a route or a heading was rewritten; made-up ones, and those that are right, stay as they are."""
    i = F.col("doc_id")
    doc = F.concat(F.lit("guide/long/route/of/pages/"), (i % 7).cast("string"), F.lit("/"), F.md5(i.cast("string")))
    anchor = F.concat(F.lit("heading-of-"), F.md5(F.concat(F.lit("h"), i.cast("string"))))
    rows = table(spark, d, "documents").select(i.alias("scope"), doc.alias("doc"), anchor.alias("anchor"))
    join = lambda a, b: F.concat(a, F.lit("#"), b)
    shapes = [join(F.replace("doc", F.lit("route"), F.lit("rout")), F.col("anchor")), join(F.col("doc"), F.replace("anchor", F.lit("heading"), F.lit("headings"))), join(F.lit("made/up"), F.lit("x")), join(F.col("doc"), F.col("anchor"))]
    cited = rows.select("scope", F.element_at(F.array(*shapes), (F.col("scope") % 4 + 1).cast("int")).alias("id"))
    return N.repaired(cited, rows.select("scope", join(F.col("doc"), F.col("anchor")).alias("id")))


@query(
    "svc06_policy",
    "SELECT item_id, CAST(greatest(1, least(item_id % 90, 50)) AS BIGINT) AS depth, CAST(greatest(1, least(item_id % 25, 10)) AS BIGINT) AS results, CAST(greatest(1, least(item_id % 9, 5)) AS BIGINT) AS seeds, CAST(greatest(1, least(item_id % 15, 10)) AS BIGINT) AS neighbours, CAST(greatest(1, least(item_id % 4, 2)) AS BIGINT) AS hops FROM benchmark",
)
def svc06(spark, d):
    """What the frozen policy allows of each request's wishes."""
    wishes = {"depth": (90, POLICY.retrieval_depth), "results": (25, POLICY.results), "seeds": (9, POLICY.seeds), "neighbours": (15, POLICY.neighbours), "hops": (4, POLICY.hops)}
    return table(spark, d, "benchmark").select("item_id", *(F.greatest(F.lit(1), F.least(F.col("item_id") % n, F.lit(most))).cast("bigint").alias(name) for name, (n, most) in wishes.items()))


STABLE = '"b":0.75,"chunk_chars":1400,"degree_cap":20,"discovered":50,"graph_weight":0.25,"hop_decay":0.5,"hops":2,"k1":1.5,"neighbours":10,"rerank_depth":45,"results":10,"retrieval_depth":50,"routes":4,"rrf_constant":60,"seeds":5'


@query("hlp22_stable_config", f"""SELECT item_id, sha256('{{"method":"' || (['bm25', 'dense', 'hybrid'])[CAST(item_id % 3 + 1 AS INT)] || '",{STABLE}}}') AS fingerprint FROM benchmark""")
def hlp22(spark, d):
    """For each run, the digest of what its results depend on: its configuration as canonical JSON without times, hosts and what follows from the rest."""
    import json

    stable = {k: v for k, v in dataclasses.asdict(POLICY).items() if k not in ("edge_hits", "overlap_chars", "collapse_depth")}
    policy = json.dumps(stable, sort_keys=True, separators=(",", ":"), ensure_ascii=False)[1:-1]
    method = F.element_at(F.array(*map(F.lit, ("bm25", "dense", "hybrid"))), (F.col("item_id") % 3 + 1).cast("int"))
    run = F.to_json(F.struct(F.current_timestamp().alias("started_at"), method.alias("method"), F.lit("host-1").alias("host")))
    kept = F.to_json(F.struct(F.get_json_object("run", "$.method").alias("method")))
    text = F.concat(F.regexp_replace(kept, r"\}$", ","), F.lit(policy + "}"))
    return table(spark, d, "benchmark").select("item_id", run.alias("run")).select("item_id", F.sha2(text, 256).alias("fingerprint"))
