"""Operators that SQL can't hold, against step-by-step versions; plans that must keep their shape."""

import io
import math
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from tessella.config import POLICY
from tessella.functions.text import packed, paragraph_chunks
from tessella.operators import fusion, graph, lexical, metrics, neighbours, stats, vector
from tessella.operators.passages import holding
from tessella.plans import retrieval
from tessella.plans.retrieval import CHUNK_FIXTURE
from tessella.sources import jsonl
from tessella.storage import built

SF = "/root/testdata/sf0.001"


def packed(text, size=1400, overlap=180):
    """Greedy packing, said step by step."""
    out, cur = [], ""
    for p in filter(None, (x.strip() for x in text.split("\n\n"))):
        for piece in (p[i : i + size] for i in range(0, len(p), size)):
            if cur and len(cur) + 2 + len(piece) > size:
                out.append(cur.strip())
                cur = cur[-overlap:].strip()
            cur = cur + "\n\n" + piece if cur else piece
    return out + [cur.strip()] * bool(cur.strip())


def test_chunks(spark):
    rows = spark.createDataFrame(CHUNK_FIXTURE, "id string, text string").select("id", paragraph_chunks(F.col("text")).alias("c")).collect()
    assert {r.id: r.c for r in rows} == {i: packed(t) for i, t in CHUNK_FIXTURE}


def test_alpha_ndcg_by_hand(spark):
    aspects = spark.createDataFrame([(1, "a", 2.0, 1, [10, 11]), (1, "b", 0.0, 3, [11]), (1, "c", 1.0, 1, [])], "qid int, aspect_id string, weight double, importance int, doc_ids array<int>")
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "qid int, doc_id int, rank int")
    ideal = 5 / math.log2(2) + 1 / math.log2(3)
    got = metrics.alpha_ndcg(aspects, ranked).first()
    assert abs(got.alpha_ndcg_at_10 - (2 / math.log2(2) + (1 + 3) / math.log2(3)) / ideal) < 1e-9
    recall = metrics.aspect_recall(aspects, ranked).first()
    assert (recall.weighted_aspect_recall_at_1, recall.weighted_aspect_recall_at_5) == (0.4, 1.0)


def test_ranking_metrics_of_empty_questions(spark):
    q = spark.createDataFrame([(1,), (2,)], "qid int")
    out = {r.qid: r for r in metrics.ranking_metrics(q, spark.createDataFrame([(1, 5, 2)], "qid int, doc_id int, rank int"), spark.createDataFrame([(1, 5), (1, 6)], "qid int, doc_id int")).collect()}
    assert out[2].recall_at_10 == 0 and out[2].ndcg_at_10 == 0 and out[1].recall_at_5 == 0.5 and out[1].recall_at_1 == 0


def walked(seeds, edges, rank, policy):
    """Hop by hop, one question."""
    sides = {}
    for s, t, e in edges:
        if s != t:
            sides.setdefault(s, []).append((t, e))
            sides.setdefault(t, []).append((s, e))
    front, known, boosts = [(s, i, 0.0, [s]) for i, s in enumerate(seeds, 1)], list(seeds), {}
    for hop in range(1, policy.hops + 1):
        following = []
        for node, seed, paths, seen in front:
            best = {}
            for n, e in sides.get(node, ()):
                if n not in seen:
                    best[n] = min(best.get(n, 2**31 - 1), rank.get(e, 2**31 - 1))
            for n, er in sorted(best.items(), key=lambda x: (x[1], x[0]))[: policy.neighbours]:
                part = 1 / (60 + er) if er < 2**31 - 1 else 0.0
                if n not in known and len(known) - len(seeds) >= policy.discovered:
                    continue
                boosts[n] = max(boosts.get(n, 0), policy.graph_weight * (1 / (60 + seed) + paths + part) * policy.hop_decay ** (hop - 1))
                if n not in known:
                    known.append(n)
                    following.append((n, seed, paths + part, [*seen, n]))
        front = following
    return boosts


def test_multihop_step_by_step(spark):
    import random

    r = random.Random(3)
    edges = [(r.randint(1, 60), r.randint(1, 60), i) for i in range(300)]
    rank = {e: i for i, e in enumerate(r.sample(range(300), 120), 1)}
    seeds = [3, 9, 27, 41, 55]
    got = graph.multihop(
        spark.createDataFrame([(0, s, i) for i, s in enumerate(seeds, 1)], "qid int, doc_id int, rank int"), spark.createDataFrame(edges, "source_id int, target_id int, edge int"),
        spark.createDataFrame([(0, e, i) for e, i in rank.items()], "qid int, edge int, rank int"),
    )
    want = walked(seeds, edges, rank, POLICY)
    have = {x.doc_id: x.boost for x in got.collect()}
    assert set(have) == set(want) and all(abs(have[k] - want[k]) < 1e-9 for k in want)


def test_rrf_and_ties(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "qid int, doc_id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "x", 2), (1, "z", 3)], "qid int, doc_id string, rank int")
    assert [(r.doc_id, r.rank) for r in fusion.rrf(a, b).orderBy("rank").collect()] == [("x", 1), ("y", 2), ("z", 3)]


def test_near_duplicate_audit(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen".split()
    rows = [(1, " ".join(base)), (2, " ".join([*base, "more"])), (3, " ".join(base)), (4, "one two three"), (5, " ".join(base[::-1])), (6, None)]
    got = stats.near_duplicate_pairs(spark.createDataFrame(rows, "doc_id int, text string"))
    assert [tuple(r) for r in got.collect()] == [(1, 2, round(14 / 15, 6), 2, 1)]


def test_near_duplicates_against_all_pairs(spark):
    import random

    r = random.Random(6)
    rows = []
    for _ in range(40):
        base = [f"w{r.randint(0, 300)}" for _ in range(r.randint(8, 60))]
        for _ in range(r.randint(1, 4)):
            rows.append((len(rows), " ".join(w if r.random() > 0.03 else f"v{r.randint(0, 9)}" for w in base)))
    sets = {}
    for i, t in rows:
        w = t.split()
        sets.setdefault(t, (i, {tuple(w[k : k + 3]) for k in range(len(w) - 2)}))
    texts = sorted(sets.values(), key=lambda x: x[0])
    want = [(a, b) for k, (a, x) in enumerate(texts) for b, y in texts[k + 1 :] if len(x & y) / len(x | y) + 1e-12 >= 0.8]
    got = stats.near_duplicate_pairs(spark.createDataFrame(rows, "doc_id int, text string"))
    assert sorted((r.a, r.b) for r in got.collect()) == sorted(want) and want


def test_bootstrap_is_repeatable(spark):
    df = spark.createDataFrame([("m", i, float(i % 5)) for i in range(50)], "metric string, question_id int, delta double")
    a, b = stats.bootstrap_delta(df, 2000).first(), stats.bootstrap_delta(df.repartition(3), 2000).first()
    assert a == b and a.low <= a.mean_delta <= a.high


def test_json_lines_round_trip(spark, tmp_path):
    rows = [(1, "a\u2028b\u0085c\u2029d"), (2, None), (3, 'quote " and \\')]
    df = spark.createDataFrame(rows, "id int, x string")
    jsonl.write(df, f"{tmp_path}/out", "gzip")
    assert sorted(map(tuple, jsonl.read(spark, f"{tmp_path}/out", df.schema).collect())) == rows
    (tmp_path / "md" / "_skip").mkdir(parents=True)
    (tmp_path / "md" / "a.md").write_text("# A")
    (tmp_path / "md" / "_skip" / "b.md").write_text("# B")
    assert [r.text for r in jsonl.markdown_tree(spark, str(tmp_path / "md")).collect()] == ["# A"]
    assert jsonl.inventory(spark, str(tmp_path / "md")).count() == 1


def test_sources_are_checked(spark):
    with pytest.raises(ValueError):
        retrieval.retriever(spark, SF).search(retrieval.questions(spark, SF), "no such method")


def test_methods_by_steps(spark):
    """The linked method, whole corpus and scoped, against plain loops over the parts that SQL covers."""
    r, q = retrieval.retriever(spark, SF), retrieval.questions(spark, SF).where("qid < 6")
    edges = [tuple(e) for e in r.edges.select("source_id", "target_id", "edge", "project").collect()]
    project = {x.qid: x.project for x in q.collect()}
    for scoped in (False, True):
        fused = sorted(map(tuple, r.fused(q, scoped).select("qid", "rank", "doc_id", "score").collect()))
        ranks = r.edge_ranks(q, scoped).collect()
        got = sorted((x.qid, x.rank, x.doc_id) for x in r.linked(r.fused(q, scoped), q, scoped).collect())
        want = []
        for qid in project:
            mine = [(d, s) for i, _, d, s in fused if i == qid]
            allowed = [e[:3] for e in edges if not scoped or e[3] == project[qid]]
            boosts = walked([d for d, _ in mine[: POLICY.seeds]], allowed, {x.edge: x.rank for x in ranks if x.qid == qid}, POLICY)
            scores = dict(mine)
            for d, b in boosts.items():
                scores[d] = scores.get(d, 0.0) + round(b, 12)
            order = sorted(scores, key=lambda d: (-round(scores[d], 12), d))
            want += [(qid, n, d) for n, d in enumerate(order, 1)]
        assert got == sorted(want)


def test_neighbour_graph_recall(spark):
    """Recall of ten ranks against exact search over the table's questions, and the share of vectors that are looked at."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").cast("bigint").alias("qid"), "embedding")
    exact = {(r.qid, r.vec_id) for r in vector.nearest(q, e, 10).collect()}
    near = neighbours.approximate(q, neighbours.index(e, e, "test"), 10).collect()
    assert sorted({r["rank"] for r in near}) == list(range(1, 11)) and len(near) == 10 * q.count()
    assert len(exact & {(r.qid, r.vec_id) for r in near}) >= 0.9 * len(exact)
    assert sum({r.qid: r.looked for r in near}.values()) < e.count() * q.count() / 3


def test_neighbour_graph_segments_and_copies(spark, monkeypatch):
    """Several segments; clusters without a link between them; a third of the rows one vector; rows without a vector."""
    import numpy as np

    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(c, 0.02, (150, 12)) for c in np.eye(12)[:4]] + [np.tile(r.normal(0, 1, 12), (300, 1))])
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(5000, None), (5001, [])]
    e = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    q = e.where("vec_id % 30 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    monkeypatch.setattr(vector, "BLOCK", 7)
    got = {}
    for row in neighbours.approximate(q, neighbours.graphs(e, segment_rows=200), 5).orderBy("qid", "rank").collect():
        got.setdefault(row.qid, []).append(row.vec_id)
    hits = 0
    for qid, found in got.items():
        s = np.round(unit @ unit[qid], 9)
        want = sorted(range(len(x)), key=lambda i: (-s[i], i))[:5]
        hits += len(set(found) & set(want))
        if qid >= 600:
            assert found == want
    assert len(got) == 30 and hits >= 0.9 * 150
    none = neighbours.graphs(e.limit(0))
    assert neighbours.approximate(q, none, 5).count() == 0
    assert neighbours.approximate(q.limit(0), neighbours.graphs(e), 5).count() == 0


def test_questions_in_blocks(spark, monkeypatch):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").cast("bigint").alias("qid"), "embedding", "label")
    take = lambda: (sorted(map(tuple, vector.nearest(q, e, 7, "label").collect())), sorted(map(tuple, vector.group_best(q, e, "label").collect())))
    whole = take()
    monkeypatch.setattr(vector, "BLOCK", 3)
    assert take() == whole


def test_passages(spark):
    docs = [(1, "say: alpha beta gamma. end"), (2, "alpha beta gamma"), (3, "xalpha beta gammax"), (4, "12 34"), (5, None), (6, "a,b")]
    passages = [(1, "alpha beta gamma"), (2, "12 34"), (3, ""), (4, ","), (5, "beta"), (6, "alpha beta gamma.")]
    d, p = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(passages, "qid int, passage string")
    got = sorted((r.qid, r.doc_id) for r in holding(d, p).collect())
    assert got == sorted((i, k) for i, t in passages if t for k, x in docs if x and t in x)


def test_chunks_of_a_worker(spark):
    """The worker's packing against the column's."""
    import random

    r = random.Random(3)
    texts = ["".join(r.choice(["a", "bc ", "\n", "\n\n", " \u2003", "é", "x" * 50]) for _ in range(r.randint(0, 120))) for _ in range(150)] + [t for _, t in CHUNK_FIXTURE]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, x string")
    for size, overlap in ((1400, 180), (60, 10)):
        got = {x.id: x.c for x in df.select("id", paragraph_chunks(F.col("x"), size, overlap).alias("c")).collect()}
        assert all(packed(t, size, overlap) == got[i] for i, t in enumerate(texts))


def test_indexes_are_written_once(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    spark.range(3).write.parquet(path)
    calls = []
    make = lambda: calls.append(1) or spark.read.parquet(path).selectExpr("id + 1 AS id")
    one, two = built(spark.read.parquet(path), "t", make), built(spark.read.parquet(path), "t", make)
    assert len(calls) == 1 and one.count() == two.count() == 3
    spark.range(5).write.mode("overwrite").parquet(path)
    assert built(spark.read.parquet(path), "t", make).count() == 5 and len(calls) == 2


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_plans(spark):
    docs, q = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet").selectExpr("item_id as qid", "text")
    plan = plan_of(lexical.postings(docs.select("doc_id", "text"), "doc_id"))
    assert "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    plan = plan_of(retrieval.retriever(spark, SF).lexicon.scores(q, ["chunk_ord"]))
    assert "Python" not in plan and "CartesianProduct" not in plan and plan.count("ENSURE_REQUIREMENTS") <= 6
    nearest = plan_of(vector.nearest(spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 3").selectExpr("cast(vec_id as bigint) qid", "embedding"), spark.read.parquet(f"{SF}/embeddings.parquet"), 5))
    assert "CartesianProduct" not in nearest and "NestedLoop" not in nearest


def test_bootstrap_takes_all_pairs(spark):
    from tessella.plans import evaluation

    sf = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    one, two = (lines.where(f"l_linenumber = {k}").select("l_orderkey", F.col("l_quantity").alias(f"q{k}"), F.col("l_discount").alias(f"d{k}")) for k in (1, 2))
    want = one.join(two, "l_orderkey").agg(F.avg(F.col("q1") - F.col("q2")).alias("quantity"), F.avg(F.col("d1") - F.col("d2")).alias("discount")).first()
    got = {r.metric: r for r in evaluation.agg15(spark, sf).collect()}
    assert set(got) == {"quantity", "discount"} and all(abs(got[k].mean_delta - float(want[k])) < 1e-8 and got[k].low < got[k].mean_delta < got[k].high for k in got)


def test_one_stream_for_all_contrasts(spark):
    import random
    import statistics

    from tessella.operators import answers

    rows = [(q, arm, float((q * 7 + k * 3) % 5) / 4 if (q + k) % 6 else None) for q in range(25) for k, arm in enumerate(("x", "y", "z"))]
    scores = spark.createDataFrame(rows, "qid int, arm string, coverage double").repartition(3)
    contrasts = [("y", "x"), ("z", "y"), ("z", "x")]
    got = {r.contrast: r for r in answers.shared_bootstrap(answers.paired_deltas(scores, contrasts), 200).collect()}
    rng, value = random.Random(20260831), {(q, a): v for q, a, v in rows}
    for a, b in contrasts:
        d = [value[q, a] - value[q, b] for q in range(25) if value[q, a] is not None and value[q, b] is not None]
        means = sorted(statistics.fmean(d[rng.randrange(len(d))] for _ in d) for _ in range(200))
        at = lambda p: means[int(p * 199)] + (p * 199 - int(p * 199)) * (means[int(p * 199) + 1] - means[int(p * 199)])  # noqa: E731, B023
        r = got[f"{a}_minus_{b}"]
        assert r.n == len(d) and abs(r.mean_delta - statistics.fmean(d)) < 1e-8 and abs(r.low - at(0.025)) < 1e-8 and abs(r.high - at(0.975)) < 1e-8
    with pytest.raises(Exception):
        answers.paired_deltas(scores.union(scores), contrasts).collect()


def test_bootstrap_interval_draw_by_draw(spark):
    """Ends of the interval from single draws of counts and percentiles by hand."""
    import numpy as np

    deltas = [("m", i, float((i * 7) % 5) / 2 - 1) for i in range(60)] + [("m", 99, None)]
    got = stats.bootstrap_delta(spark.createDataFrame(deltas, "metric string, question_id int, delta double"), samples=500).collect()[0]
    values = sorted({d for _, _, d in deltas if d is not None})
    counts = [sum(d == v for _, _, d in deltas) for v in values]
    total, rng = sum(counts), np.random.default_rng(17)
    means = sorted(sum(c * v for c, v in zip(rng.multinomial(total, np.array(counts) / total), values)) / total for _ in range(500))
    at = lambda p: means[int(p * 499)] + (p * 499 - int(p * 499)) * (means[int(p * 499) + 1] - means[int(p * 499)])
    assert abs(got.low - at(0.025)) < 1e-9 and abs(got.high - at(0.975)) < 1e-9


def test_scores_store_no_postings(spark, tmp_path):
    """Scores against plain loops: nothing but chunks and routes is written for them, blocks and depths lose nothing."""
    import math
    import os

    from tessella import storage
    from tessella.functions.text import terms
    from tessella.operators.retriever import Lexicon

    r, q = retrieval.retriever(spark, SF), retrieval.questions(spark, SF).where("qid < 12")
    r.sparse(q).collect(), r.selected_routes(q).collect()
    made = os.listdir(storage.shared_dir(spark).removeprefix("file://"))
    assert not [x for x in made if "postings" in x or "words-" in x]
    rows = [(1, "alpha beta gamma", "x"), (2, "beta alpha beta", "y"), (3, "", "x"), (4, None, "y"), (5, "gamma gamma beta gamma", None), (6, "delta", "x")] + [(i, "beta alpha", "x") for i in range(7, 60)]
    units = spark.createDataFrame(rows, "k long, text string, project string").repartition(3)
    asked = [(1, "alpha beta", "x"), (2, "gamma delta beta", "y"), (3, "the", "x"), (4, "nothing here", "x")]
    questions = spark.createDataFrame(asked, "qid long, text string, project string")
    split = {t: list(w) for t, w in units.select("text").union(questions.select("text")).distinct().select("text", F.coalesce(terms(F.col("text")), F.array().cast("array<string>"))).collect()}
    avgdl = sum(len(split[t]) for _, t, _ in rows) / len(rows)
    want = {}
    for qid, question, _ in asked:
        for k, t, _ in rows:
            s = 0.0
            for term in set(split[question]) & set(split[t]):
                df, tf = sum(term in split[x] for _, x, _ in rows), split[t].count(term)
                s += tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(split[t]) / avgdl)) * math.log1p((len(rows) - df + 0.5) / (df + 0.5))
            if s > 0:
                want[qid, k] = round(s, 6)
    lexicon = Lexicon(units.select("k", "project", "text"), "k")
    got = {(x.qid, x.k): round(x.score, 6) for x in lexicon.scores(questions, ["k"]).collect()}
    assert got == want and lexicon.stats.first().avgdl == avgdl
    project = {k: p for k, _, p in rows}
    for only in ({}, {"project": questions.select("qid", "project")}):
        mine = {x: s for x, s in want.items() if not only or project[x[1]] == dict((i, p) for i, _, p in asked)[x[0]]}
        best = sorted((i, n, k) for i in range(1, 5) for n, k in enumerate(sorted((k for j, k in mine if j == i), key=lambda k: (-mine[i, k], k))[:3], 1))
        assert best == sorted((x.qid, x["rank"], x.k) for x in lexical.top(lexicon.scores(questions, ["k"], 3, only), "k", 3).collect())


def test_neighbours_are_checked_exactly(spark):
    """Vectors that aren't of unit length, ties after rounding, copies; a walk that finds less than it should."""
    import numpy as np

    r = np.random.default_rng(9)
    x = np.concatenate([r.normal(0, 1, (400, 8)) * r.uniform(0.5, 2, (400, 1)), np.tile(r.normal(0, 1, 8), (60, 1)), [[1.0] + [0.0] * 7] * 2])
    x[-1, 0] += 1e-8  # a larger product, equal to six digits
    e = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>").repartition(3)
    q = e.where("vec_id % 40 = 0 or vec_id > 459").select(F.col("vec_id").alias("qid"), "embedding")
    found = neighbours.approximate(q, neighbours.graphs(e, segment_rows=100), 5)
    want = sorted((int(k), n, i) for k in [*range(0, 460, 40), 460, 461] for n, i in enumerate(sorted(range(len(x)), key=lambda i: (-round(float(x[k] @ x[i]), 6), i))[:5], 1))
    for some in (found, found.where("qid % 3 = 0 or rank > 3")):
        assert sorted((a.qid, a["rank"], a.vec_id) for a in neighbours.checked(q, e, some, 5).collect()) == want


def test_linked_pairs_in_rounds(spark):
    """Against plain loops, with repeated rows, self-links and questions without a link; a hub's edges don't cross its questions."""
    import random

    r = random.Random(4)
    rows = [(q, r.randrange(60)) for q in range(80) for _ in range(r.randint(1, 7))] + [(90, 5), (90, 5), (91, None)]
    links = [(r.randrange(60), r.randrange(60)) for _ in range(60)] + [(5, 5), (7, None)]
    docs = {}
    for q, x in rows:
        docs.setdefault(q, set()).add(x)
    want = sorted((q, any(a in xs and b in xs and a != b for a, b in links)) for q, xs in docs.items())
    qrels, edges = spark.createDataFrame(rows, "qid int, doc_id int"), spark.createDataFrame(links, "source_id int, target_id int")
    for shares in ((1.0,), (0.1, 0.5, 1.0), (0.3,), (0.02, 1.0)):
        assert sorted(map(tuple, graph.linked_pairs(qrels, edges, shares).collect())) == want
    assert {x for _, x in want} == {True, False}
    n = 4000  # all pairs of the hub's questions and edges are 16 million rows
    hub = spark.range(n).selectExpr("id as qid", "explode(array(-1L, id)) as doc_id")
    star = spark.range(n).selectExpr("-1L as source_id", "id as target_id")
    got = graph.linked_pairs(hub, star)
    assert got.where("linked").count() == n and "source_id" not in plan_of(got)  # no edge is joined when the result is read


def written_by(name, sf, tmp_path, monkeypatch, spark):
    """(rows, kind of table: bytes) of a query that starts with an empty shared folder."""
    from tessella import storage
    from tessella.plans import catalog

    monkeypatch.setattr(storage, "shared_dir", lambda _: f"file://{tmp_path}")
    rows = catalog.queries()[name](spark, sf).collect()
    return rows, {f.name.split("-")[1]: sum(x.stat().st_size for x in f.rglob("*") if x.is_file()) for f in tmp_path.iterdir()}


@pytest.mark.parametrize("name", ["grf13_multihop_links", "grf13_scoped_links"])
def test_linked_ranking_writes_its_frontiers(name, spark, tmp_path, monkeypatch):
    rows, made = written_by(name, SF, tmp_path, monkeypatch, spark)
    assert rows and {"front", "hop", "edge"} <= set(made) and not {"postings", "words"} & set(made)


@pytest.mark.parametrize("name", ["lex03_collection", "lex08_collapse", "lex09_chunk_bm25", "lex10_route_selection", "lex11_routed_bm25", "scp01_project_bm25", "met01_ranking_metrics", "lex07_top_k", "lex06_scores"])
def test_lexical_queries_store_no_chunks(name, spark, tmp_path, monkeypatch):
    rows, made = written_by(name, SF, tmp_path, monkeypatch, spark)
    assert rows and "chunks" not in made and not {"postings", "words", "vectors", "links"} & set(made)


@pytest.mark.parametrize("name", ["met14_primary_metrics", "fus03_path_types", "hlp05_candidate_packet", "fus04_soft_hierarchy", "rrf_hybrid", "fus03_graph_fusion", "grf12_typed_expansion"])
def test_fused_queries_store_no_postings(name, spark, tmp_path, monkeypatch):
    rows, made = written_by(name, SF, tmp_path, monkeypatch, spark)
    assert rows and not {"postings", "words"} & set(made)


def test_passages_leave_the_texts_in_place(spark):
    """Both ways of looking for passages against plain containment; that of few passages shuffles no text."""
    texts = [(1, "one two three"), (2, "two, three"), (3, None), (4, ""), (5, "xtwo threex Two"), (6, "été, two three été"), (7, "a.b")]
    asked = [(1, "two three"), (2, "e two t"), (3, ""), (4, "."), (5, "été"), (6, "nowhere"), (7, None), (8, "two three")]
    docs, passages = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(asked, "qid long, passage string")
    want = sorted((q, d) for q, p in asked for d, t in texts if p and t and p in t)
    found = holding(docs, passages)
    for way in (found, holding(docs, passages, whole=0)):
        assert sorted(map(tuple, way.collect())) == want
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_task_hands_on_its_best_only(spark, monkeypatch):
    """No more than ``depth`` units of a question, and with little room to keep them none of the best is lost."""
    from tessella.operators.retriever import Lexicon

    units = spark.createDataFrame([(i, "alpha beta " * (i % 9) + "gamma " * (i % 7) + "delta") for i in range(5000)], "k long, text string").coalesce(1)
    questions = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, "delta")], "qid long, text string")
    every = sorted(map(tuple, lexical.top(Lexicon(units, "k").scores(questions, ["k"]), "k", 5).select("qid", "rank", "k").collect()))
    assert Lexicon(units, "k").scores(questions, ["k"], 5).count() == len(every) == 15
    monkeypatch.setattr(lexical, "HELD", 7)
    few = Lexicon(units, "k").scores(questions, ["k"], 5)
    assert few.count() >= 15 and every == sorted(map(tuple, lexical.top(few, "k", 5).select("qid", "rank", "k").collect()))


def test_one_pass_gives_both_rankings(spark):
    """Lexical and dense rankings of one pass over the tokens are those of two, scoped or not."""
    r, q = retrieval.retriever(spark, SF, stored=False), retrieval.questions(spark, SF).where("qid < 20")
    for scoped in (False, True):
        want = [(k, *x) for k, found in enumerate((r.sparse(q, scoped), r.dense(q, scoped))) for x in found.select("qid", "doc_id", "rank", "best_chunk").collect()]
        assert sorted(want) == sorted(map(tuple, r.both(q, scoped).select("kind", "qid", "doc_id", "rank", "best_chunk").collect()))
    assert r.both(q.where("false")).count() == 0


@pytest.mark.parametrize("name", ["rrf_hybrid", "grf13_scoped_links", "grf13_multihop_links", "grf12_typed_expansion", "fus03_graph_fusion", "fus04_soft_hierarchy", "hlp05_candidate_packet", "fus03_path_types", "met14_primary_metrics"])
def test_fused_queries_store_no_chunks(name, spark, tmp_path, monkeypatch):
    rows, made = written_by(name, SF, tmp_path, monkeypatch, spark)
    assert rows and not {"chunks", "vectors"} & set(made)


@pytest.mark.parametrize("name", ["fus03_path_types", "grf12_typed_expansion", "fus03_graph_fusion"])
def test_expansions_store_no_links(name, spark, tmp_path, monkeypatch):
    rows, made = written_by(name, SF, tmp_path, monkeypatch, spark)
    assert rows and "links" not in made


def reached(seeds, edges, mentions, claims, policy):
    """A typed expansion of one question's seeds, {doc_id: rank}, step by step: {doc_id: (weight, seed's rank, hops, paths)}."""
    near, named, told, best = {}, {}, {}, {}
    for s, t in edges:
        if s != t:
            near.setdefault(s, set()).add(t)
            near.setdefault(t, set()).add(s)
    for d, kind, entity in mentions:
        named.setdefault((kind, entity), set()).add(d)
    for claim, d, subject, predicate, other in claims:
        for entity in {subject, other}:
            told.setdefault(entity, set()).add((claim, d, predicate))
    fine = {e: x for e, x in named.items() if len(x) <= policy.degree_cap}
    known = {e: x for e, x in told.items() if len({c for c, _, _ in x}) <= policy.degree_cap}
    for seed, rank in seeds.items():
        one = near.get(seed, set())
        hops = {(1, d) for d in one} | {(2, d) for v in one for d in near[v] if d != seed}
        found = [(graph.HOP_WEIGHT[h], h, d, f"link_{h}hop") for h, d in sorted(hops)[: policy.neighbours]]
        for kind, weight in graph.BRANCHES.items():
            shared = {d for (k, _), x in fine.items() if k == kind and seed in x for d in x if d != seed}
            found += [(weight, 1, d, kind) for d in sorted(shared)[: policy.neighbours]]
        claimed = {(d, p) for x in known.values() if seed in {d for _, d, _ in x} for _, d, p in x if d != seed}
        found += [(graph.CLAIM_WEIGHT, 1, d, f"claim:{p}") for d, p in sorted(claimed)[: policy.neighbours]]
        found = sorted((x for x in found if x[2] not in seeds), key=lambda x: (-x[0], *x[1:]))[: policy.neighbours]
        for weight, hop, d, path in found:
            w, r, h, paths = best.get(d, (0.0, rank, hop, set()))
            best[d] = max(w, weight), min(r, rank), min(h, hop), paths | {path}
    return best


def shuffled(spark):
    """Rows that this session's tasks have written for a shuffle so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("most", [graph.BROADCAST_FRONT, 0])
def test_expansion_shuffles_what_meets_its_seeds(most, spark, monkeypatch):
    """Entities just within the cap, just beyond it and of a third of all pages, rows that stand twice, links between seeds: as step by
    step. Edges, mentions and claims stay where they are unless the seeds are too many to be sent there."""
    n = 30_000
    pages = spark.range(0, n, 1, 6)
    many = [("shared_reusable", "r20", 100, 120), ("shared_reusable", "r21", 200, 221), ("bounded_route", "b64", 300, 364), ("another", "x", 0, 5)]
    mentions = pages.selectExpr("id as doc_id", "explode(array(named_struct('kind', 'shared_reusable', 'entity', 'r' || id div 7), named_struct('kind', 'bounded_route', 'entity', 'b' || id div 90), if(id % 3 = 0, named_struct('kind', 'shared_code_entity', 'entity', 'everywhere'), null))) as m").where("m is not null").select("doc_id", "m.*")
    mentions = mentions.union(spark.createDataFrame([(d, k, e) for k, e, low, high in many for d in range(low, high)] * 2 + [(None, "shared_reusable", "r20")], "doc_id long, kind string, entity string"))
    edges = pages.selectExpr("id as source_id", "explode(array((id * 7 + 3) % 30000, (id * 13 + 5) % 30000, if(id % 1500 = 0, 33, id))) as target_id").withColumn("edge", F.lit(0))
    claims = pages.selectExpr("id as claim_id", "id as doc_id", "'e' || id % 9001 as subject", "element_at(array('uses', 'needs'), cast(id % 2 + 1 as int)) as predicate", "if(id % 10 = 0, 'all', 'e' || (id * 5 + 1) % 9001) as object")
    claims = claims.union(claims.where("claim_id < 50"))
    asked = {1: [100, 200, 33, 102, 10], 2: [300, 33, 20_000, 5, 12]}
    seeds = spark.createDataFrame([(q, d, i + 1) for q, ds in asked.items() for i, d in enumerate(ds)] + [(1, 7, POLICY.seeds + 1)], "qid long, doc_id long, rank int")
    links = [(r.source_id, r.target_id) for r in edges.collect()]
    named, told = ([tuple(r) for r in x.collect()] for x in (mentions.where("doc_id is not null"), claims.select("claim_id", "doc_id", "subject", "predicate", "object")))
    want = {(q, d): (r, h, sorted(p), round(w * 0.5 + 1 / (60 + r), 9)) for q, ds in asked.items() for d, (w, r, h, p) in reached({d: i + 1 for i, d in enumerate(ds)}, links, named, told, POLICY).items()}
    monkeypatch.setattr(graph, "BROADCAST_FRONT", most)
    before = shuffled(spark)
    got = graph.expanded(seeds, edges, mentions, claims, lambda pairs: pairs.withColumn("cosine", F.lit(0.5))).collect()
    assert {(r.qid, r.doc_id): (r.hops, r.paths, r.score) for r in got} == {k: x[1:] for k, x in want.items()} and len(got) == len(want) > 40
    if most:
        assert shuffled(spark) - before < n / 4


@pytest.mark.parametrize("name", ["fus03_graph_fusion", "grf12_typed_expansion", "rrf_hybrid"])
def test_fused_queries_write_no_routes(name, spark, tmp_path, monkeypatch):
    rows, made = written_by(name, SF, tmp_path, monkeypatch, spark)
    assert rows and "routes" not in made
