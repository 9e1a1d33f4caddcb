"""Link graphs: bounded expansions over edges (GRF01-GRF15)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import POLICY, Policy
from ..storage import discard, parked
from .components import salted_join
from .lexical import few

#: Shares of a question's documents that follow their edges by the end of a round; rows of a round that are broadcast at most.
SHARES, BROADCAST_ROUND = (1 / 40, 1 / 8, 1.0), 2_000_000
#: Rows of a frontier, each with its path, that are broadcast to the edges at most.
BROADCAST_FRONT = 200_000


def undirected(edges: DataFrame) -> DataFrame:
    """(node, neighbour, edge) of each edge in both directions, self-links left out; other columns come along."""
    e, others = edges.where("source_id <> target_id"), [c for c in edges.columns if c not in ("source_id", "target_id")]
    return e.select(F.col("source_id").alias("node"), F.col("target_id").alias("neighbour"), *others).union(e.select("target_id", "source_id", *others))


def capped(sides: DataFrame, cap: int = POLICY.degree_cap) -> DataFrame:
    """``sides`` without nodes of more than ``cap`` distinct neighbours."""
    few = sides.groupBy("node").agg(F.countDistinct("neighbour").alias("degree")).where(F.col("degree") <= cap).select("node")
    return sides.join(few, "node", "left_semi")


def multihop(seeds: DataFrame, edges: DataFrame, edge_rank: DataFrame, scope: DataFrame | None = None, policy: Policy = POLICY, within: DataFrame | None = None) -> DataFrame:
    """(qid, doc_id, boost, hop): best boosts of pages that bounded, query-ranked paths reach (GRF13).

    ``seeds``: (qid, doc_id, rank); ``edges``: (source_id, target_id, edge); ``edge_rank``: (qid, edge, rank). Each hop is
    a join of the frontier with the edges; a page expands ``neighbours`` distinct pages by (edge rank, id), never one that
    lies on its path; at most ``discovered`` new pages of a question are expanded further or boosted, in the order of the
    frontier. A frontier is bounded by seeds, neighbours and hops, whatever the graph's size, so it is written down and goes
    to the edges where they lie. ``scope``, (qid, doc_id), or
    ``within``, (qid, project) beside edges with the project of both their ends, says which pages a question may see.
    """
    sides = undirected(edges.select("source_id", "target_id", "edge", *(["project"] if within is not None else [])))
    front = seeds.where(F.col("rank") <= policy.seeds).select(
        "qid", "doc_id", F.col("rank").alias("seed_rank"), F.lit(0.0).alias("paths"), F.array("doc_id").alias("seen"), F.col("rank").alias("ord")
    )
    front = parked(front, "front")
    known = front.select("qid", "doc_id")
    boosts = None
    for hop in range(1, policy.hops + 1):
        step = few(front.withColumnRenamed("doc_id", "node"), BROADCAST_FRONT).join(sides, "node").where(~F.array_contains("seen", F.col("neighbour")))
        if within is not None:
            step = step.join(within, ["qid", "project"], "left_semi").drop("project")
        if scope is not None:
            step = step.join(scope.withColumnRenamed("doc_id", "neighbour"), ["qid", "neighbour"], "left_semi")
        step = step.join(edge_rank.withColumnRenamed("rank", "edge_rank"), ["qid", "edge"], "left")
        part = F.when(F.col("edge_rank").isNotNull(), 1.0 / (60.0 + F.col("edge_rank"))).otherwise(0.0)
        step = step.withColumn("er", F.coalesce("edge_rank", F.lit(2**31 - 1)))
        per = step.groupBy("qid", "node", "ord", "seed_rank", "paths", "seen", "neighbour").agg(F.min("er").alias("er"), F.max(part).alias("part"))
        per = per.withColumn("at", F.row_number().over(Window.partitionBy("qid", "node", "ord").orderBy("er", "neighbour"))).where(F.col("at") <= policy.neighbours)
        old = known.withColumnRenamed("doc_id", "neighbour").withColumn("old", F.lit(True))
        per = per.join(old, ["qid", "neighbour"], "left").withColumn("old", F.coalesce("old", F.lit(False)))
        first = per.where("not old").groupBy("qid", "neighbour").agg(F.min(F.struct("ord", "at")).alias("first"))
        order = Window.partitionBy("qid").orderBy("first")
        taken = known.groupBy("qid").agg((F.count("*") - F.least(F.count("*"), F.lit(policy.seeds))).alias("taken"))
        first = first.withColumn("n", F.row_number().over(order)).join(taken, "qid", "left").where(F.col("n") + F.coalesce("taken", F.lit(0)) <= policy.discovered)
        per = per.join(first.select("qid", "neighbour", "first", F.col("n").alias("place")), ["qid", "neighbour"], "left").where(F.col("old") | F.col("place").isNotNull())
        per = parked(per, "hop")
        boost = F.lit(policy.graph_weight) * (1.0 / (60.0 + F.col("seed_rank")) + F.col("paths") + F.col("part")) * F.lit(policy.hop_decay ** (hop - 1))
        got = per.select("qid", F.col("neighbour").alias("doc_id"), boost.alias("boost"), F.lit(hop).alias("hop"))
        boosts = got if boosts is None else boosts.union(got)
        front = per.where(~F.col("old") & (F.struct("ord", "at") == F.col("first"))).select(
            "qid", F.col("neighbour").alias("doc_id"), "seed_rank", (F.col("paths") + F.col("part")).alias("paths"), F.concat("seen", F.array("neighbour")).alias("seen"), F.col("place").alias("ord")
        )
        known = known.union(front.select("qid", "doc_id"))
    return boosts.groupBy("qid", "doc_id").agg(F.round(F.max("boost"), 12).alias("boost"), F.min("hop").alias("hop"))


def closure(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, node) of every node that links lead to from a root, itself included (SRC14).

    ``seeds``: (root); ``edges``: (source_id, target_id). A round follows the links of what the round before found anew, and
    is written down, so cycles end and no plan grows with the rounds.
    """
    known = parked(seeds.select("root", F.col("root").alias("node")).distinct(), "closure")
    found, front = [known], known
    while True:
        step = front.join(edges.select(F.col("source_id").alias("node"), "target_id"), "node").select("root", F.col("target_id").alias("node")).where("node is not null").distinct()
        for part in found:
            step = step.join(part, ["root", "node"], "left_anti")
        front = parked(step, "closure")
        if not front.limit(1).count():
            return reduce(DataFrame.union, found)
        found.append(front)


def linked_pairs(qrels: DataFrame, edges: DataFrame, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """(qid, linked): whether any two of a question's documents are joined by an edge (GRF15). Rows may repeat.

    One link settles a question, so documents follow their edges in rounds: of each question not settled yet, those whose
    hash lies within the next of ``shares``, the last of which is 1. Edges are followed from the end that has more distinct
    documents, and so fewer edges each.
    """
    qrels, edges = parked(qrels.select("qid", "doc_id"), "qrels"), edges.select("source_id", "target_id").where("source_id <> target_id")
    ends = edges.agg(F.approx_count_distinct("source_id").alias("s"), F.approx_count_distinct("target_id").alias("t")).first()
    node, other = ("source_id", "target_id") if ends.s > ends.t else ("target_id", "source_id")
    place = F.pmod(F.xxhash64("qid", "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    rest, linked, low = qrels, [], 0.0
    for share in (*[x for x in shares if x < 1.0], 1.0):
        asked = few(rest.where((place >= low) & (place < share)).withColumnRenamed("doc_id", node), BROADCAST_ROUND)
        some = edges.join(asked, node).select("qid", F.col(other).alias("doc_id"))
        linked.append(parked(rest.join(some, ["qid", "doc_id"], "left_semi").select("qid").distinct(), "linked"))
        if share < 1.0:
            settled = few(linked[-1], BROADCAST_ROUND)
            rest, before = parked(rest.join(settled, "qid", "left_anti"), "qrels"), rest
            if before is not qrels:
                discard(before)
            if not rest.limit(1).count():
                break
        low = share
    both = reduce(DataFrame.union, linked).withColumn("linked", F.lit(True))  # a question is settled once
    return qrels.select("qid").distinct().join(both, "qid", "left").select("qid", F.coalesce("linked", F.lit(False)).alias("linked"))


#: Weights of the branches of a typed expansion, and the largest degree of an entity that is followed.
BRANCHES = {"shared_reusable": 0.85, "shared_code_entity": 0.70, "bounded_route": 0.35}
HOP_WEIGHT = {1: 1.0, 2: 0.5}
CLAIM_WEIGHT = 0.90


def _first(rows: DataFrame, order: list, policy: Policy, *by: str) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("qid", "seed", *by).orderBy(*order))
    return rows.withColumn("at", at).where(F.col("at") <= policy.neighbours).drop("at")


def _fine(rows: DataFrame, by: list[str], unit: str, cap: int) -> DataFrame:
    """The distinct ``rows`` of the entities (``by``) that have ``cap`` different ``unit`` at most.

    Which of 64 hash values an entity's units have is counted first, where they lie: more than ``cap`` of those are more than
    ``cap`` units, so the rows of what is mentioned nearly everywhere are never handed on. The rest are few and counted exactly.
    """
    rows = rows.where(F.col(unit).isNotNull())
    value = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(unit), F.lit(64)).cast("int"))
    likely = parked(rows.groupBy(*by).agg(F.bit_count(F.bit_or(value)).alias("n")).where(F.col("n") <= cap).select(*by), "likely")
    rows = parked(rows.join(few(likely, BROADCAST_FRONT), by, "left_semi").distinct(), "likely-rows")
    return rows.join(rows.groupBy(*by).agg(F.countDistinct(unit).alias("n")).where(F.col("n") <= cap).select(*by), by, "left_semi")


def _link_branch(seeds: DataFrame, edges: DataFrame, policy: Policy) -> DataFrame:
    """Pages at the ends of paths of one link, then of two, the first ones by (hops, id); a page may stand at both distances."""
    sides = undirected(edges).select("node", "neighbour")
    one = few(seeds.withColumn("node", F.col("seed")), BROADCAST_FRONT).join(sides, "node").select("qid", "seed", F.col("neighbour").alias("doc_id"))
    one = parked(one.distinct(), "neighbours")
    enough = F.row_number().over(Window.partitionBy("qid", "seed").orderBy("doc_id"))
    first = one.withColumn("at", enough).where(F.col("at") <= policy.neighbours).drop("at")
    hop1 = first.withColumn("hops", F.lit(1))
    # beyond every direct neighbour, not beyond the first ones only; of one neighbour's pages the first ones are enough
    spread = F.row_number().over(Window.partitionBy("qid", "seed", "via").orderBy("doc_id"))
    two = few(one.withColumnRenamed("doc_id", "node"), BROADCAST_FRONT).join(sides, "node").where("neighbour <> seed")
    two = two.select("qid", "seed", F.col("node").alias("via"), F.col("neighbour").alias("doc_id")).distinct()
    two = two.withColumn("at", spread).where(F.col("at") <= policy.neighbours)
    hop2 = two.select("qid", "seed", "doc_id").distinct().withColumn("hops", F.lit(2))
    both = _first(hop1.union(hop2), ["hops", "doc_id"], policy)
    weight = F.when(F.col("hops") == 1, HOP_WEIGHT[1]).otherwise(HOP_WEIGHT[2])
    return both.select("qid", "seed", "doc_id", weight.alias("weight"), F.concat(F.lit("link_"), F.col("hops").cast("string"), F.lit("hop")).alias("path"), "hops")


def _shared_branches(seeds: DataFrame, mentions: DataFrame, cap: int, policy: Policy) -> DataFrame:
    """Pages that mention what a seed mentions, by entities of ``cap`` pages at most, so an entity adds no more than that; a branch a kind."""
    mine = mentions.where(F.col("kind").isin(*BRANCHES)).select("doc_id", "kind", "entity")
    own = few(seeds.withColumnRenamed("seed", "doc_id"), BROADCAST_FRONT).join(mine, "doc_id").select("qid", F.col("doc_id").alias("seed"), "kind", "entity")
    own = parked(own.distinct(), "mentioned")
    asked = few(own.select("kind", "entity").distinct(), BROADCAST_FRONT)
    near = _fine(mine.join(asked, ["kind", "entity"], "left_semi"), ["kind", "entity"], "doc_id", cap)
    found = own.join(near, ["kind", "entity"]).where("doc_id <> seed").select("qid", "seed", "doc_id", "kind").distinct()
    weight = F.create_map(*(F.lit(x) for pair in BRANCHES.items() for x in pair))[F.col("kind")]
    return _first(found, ["doc_id"], policy, "kind").select("qid", "seed", "doc_id", weight.alias("weight"), F.col("kind").alias("path"), F.lit(1).alias("hops"))


def _claim_branch(seeds: DataFrame, claims: DataFrame, cap: int, policy: Policy) -> DataFrame:
    """Pages whose claims share an entity, subject or object, with a seed's claims; the path names the other claim's predicate."""
    ends = claims.select("claim_id", "doc_id", "predicate", F.explode(F.array_distinct(F.array("subject", "object"))).alias("entity"))
    own = few(seeds.withColumnRenamed("seed", "doc_id"), BROADCAST_FRONT).join(ends, "doc_id").select("qid", F.col("doc_id").alias("seed"), "entity")
    own = parked(own.distinct(), "claimed")
    asked = few(own.select("entity").distinct(), BROADCAST_FRONT)
    near = _fine(ends.join(asked, "entity", "left_semi"), ["entity"], "claim_id", cap)
    found = own.join(near, "entity").where("doc_id <> seed").select("qid", "seed", "doc_id", "predicate").distinct()
    return _first(found, ["doc_id", "predicate"], policy).select("qid", "seed", "doc_id", F.lit(CLAIM_WEIGHT).alias("weight"), F.concat(F.lit("claim:"), F.col("predicate")).alias("path"), F.lit(1).alias("hops"))


def expanded(seeds: DataFrame, edges: DataFrame, mentions: DataFrame, claims: DataFrame, relevance: Callable[[DataFrame], DataFrame], policy: Policy = POLICY) -> DataFrame:
    """(qid, doc_id, score, hops, seeds, paths, rank) that a bounded typed expansion reaches (GRF12).

    ``seeds``: (qid, doc_id, rank), the first ones of each question count; ``edges``: (source_id, target_id, edge);
    ``mentions``: (doc_id, kind, entity); ``claims``: (claim_id, doc_id, subject, predicate, object); ``relevance``
    gives (qid, doc_id, cosine), a page's best, for the (qid, doc_id) that are reached. Of every seed five branches give ``neighbours`` pages each, the best of all those by
    weight go on. A page scores its largest weight times its relevance, plus 1 / (60 + its first seed's rank). The seeds, and what
    they mention, go to the edges, mentions and claims where those lie; of these only what meets them is shuffled.
    """
    chosen = parked(seeds.where(F.col("rank") <= policy.seeds).select("qid", "doc_id", "rank"), "seeds")
    own = chosen.select("qid", F.col("doc_id").alias("seed"))
    found = _link_branch(own, edges, policy).union(_shared_branches(own, mentions, policy.degree_cap, policy)).union(_claim_branch(own, claims, policy.degree_cap, policy))
    found = found.join(chosen.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti").select("qid", "seed", "doc_id", "weight", "path", "hops")
    kept = _first(found, [F.desc("weight"), "hops", "doc_id", "path"], policy)
    kept = kept.join(chosen.select("qid", F.col("doc_id").alias("seed"), F.col("rank").alias("seed_rank")), ["qid", "seed"])
    out = kept.groupBy("qid", "doc_id").agg(F.max("weight").alias("w"), F.min("seed_rank").alias("r"), F.min("hops").alias("hops"), F.array_sort(F.collect_set("seed")).alias("seeds"), F.array_sort(F.collect_set("path")).alias("paths"))
    out = parked(out, "reached")  # seeds times neighbours a question
    out = out.join(relevance(out.select("qid", "doc_id")), ["qid", "doc_id"], "left")
    score = F.round(F.col("w") * F.greatest(F.lit(0.0), F.coalesce("cosine", F.lit(0.0))) + 1.0 / (60.0 + F.col("r")), 9)
    out = out.select("qid", "doc_id", score.alias("score"), "hops", "seeds", "paths")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")))


def mention_counts(mentions: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, entity, document_count): how many pages of ``mentions`` (by, doc_id, entity) mention an entity, each once (GRF09, GRF10)."""
    return mentions.select(*by, "entity", "doc_id").distinct().groupBy(*by, "entity").agg(F.count("*").alias("document_count"))


def ingested(nodes: DataFrame, edges: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Nodes whose key is unique, which is an error otherwise, and the edges (source_id, target_id) with both ends among them (GRF07)."""
    counted = nodes.withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    twice = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("a node stands twice: "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.col(key).isNotNull())
    ids = nodes.select(key).distinct()
    kept = edges
    for end in ("source_id", "target_id"):
        kept = salted_join(kept, ids.select(F.col(key).alias(end)), end, "target_id" if end == "source_id" else "source_id")
    return counted.where(twice).drop("_n"), kept.select(*edges.columns)
