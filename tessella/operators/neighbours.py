"""Approximate nearest vectors by stored neighbour graphs (VEC03).

Vectors are dealt by a hash of their id into segments of about SEGMENT_ROWS, as many as the table needs. Each segment is a
graph of its own: a vector is linked with its nearest ones, of which those go that a nearer neighbour already covers, and
links are walked both ways. Vectors that are equal are one node with several ids, and every part of a graph that links
don't reach has an entry. A question walks every segment from the nearest of its entries, keeping a beam of the best
nodes seen, until none of them has a neighbour left to look at; its cosines are exact, and the segments' answers are
merged by score and id.

The index is a table with one row a segment, written once; a task reads a few segments, and a question looks at a few
hundred vectors of each.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import POLICY
from ..storage import built, parked
from .lexical import few, top
from .vector import blocks, dot, nearest

SEGMENT_ROWS, LINKS, POOL, BEAM, SEED = 16_384, 12, 48, 40, 17
#: Found (question, vector) pairs that are broadcast to the vectors at most.
BROADCAST_FOUND = 500_000
SCHEMA = "segment int, dim int, vectors binary, starts binary, ids binary, first binary, links binary, entries binary"


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _nearest(x: np.ndarray, pool: int) -> np.ndarray:
    """The ``pool`` nearest other rows of each row, best first, a block of rows at a time."""
    out = np.zeros((len(x), pool), np.int32)
    for at in range(0, len(x), 512):
        s = x[at : at + 512] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        some = np.argpartition(-s, pool - 1, axis=1)[:, :pool]
        out[at : at + 512] = np.take_along_axis(some, np.argsort(-np.take_along_axis(s, some, 1), axis=1, kind="stable"), 1)
    return out


def linked(x: np.ndarray, links: int = LINKS, pool: int = POOL) -> tuple[np.ndarray, np.ndarray]:
    """(starts, links): row i is linked with ``links[starts[i]:starts[i + 1]]``, of the unit rows ``x``."""
    n, pool = len(x), min(pool, len(x) - 1)
    if n < 2:
        return np.zeros(n + 1, np.int32), np.zeros(0, np.int32)
    near, pairs = _nearest(x, pool), []
    for i in range(n):
        some = x[near[i]]
        mutual, own, kept = some @ some.T, some @ x[i], []
        covered = np.zeros(pool, bool)
        for k in range(pool):
            if not covered[k]:
                kept.append(k)
                covered |= mutual[k] >= own  # nearer to this neighbour than to the row itself
                if len(kept) == links:
                    break
        pairs.append(near[i][kept])
    a, b = np.repeat(np.arange(n, dtype=np.int64), [len(p) for p in pairs]), np.concatenate(pairs).astype(np.int64)
    both = np.unique(np.concatenate([a * n + b, b * n + a]))
    return np.searchsorted(both, np.arange(n + 1, dtype=np.int64) * n).astype(np.int32), (both % n).astype(np.int32)


def entries(starts: np.ndarray, links: np.ndarray, seed: int = SEED) -> np.ndarray:
    """About the square root of the rows, drawn once, and the first row of every part that links don't join with another."""
    n = len(starts) - 1
    part, owner = np.arange(n), np.repeat(np.arange(n), np.diff(starts))
    while True:
        low = part.copy()
        np.minimum.at(low, owner, part[links])
        low = low[low]
        if (low == part).all():
            break
        part = low
    drawn = np.random.default_rng(seed).permutation(n)[: max(1, int(n**0.5))]
    return np.unique(np.concatenate([drawn, np.flatnonzero(part == np.arange(n))])).astype(np.int32)


def walked(x: np.ndarray, starts: np.ndarray, links: np.ndarray, entry: np.ndarray, q: np.ndarray, beam: int) -> tuple[list[tuple[float, int]], int]:
    """(the best nodes for the unit vector ``q`` with their cosines, nodes looked at)."""
    seen = np.zeros(len(x), bool)
    seen[entry] = True
    s = x[entry] @ q
    looked = len(entry)
    ahead = [(-float(v), int(i)) for v, i in zip(s, entry)]
    heapq.heapify(ahead)
    best = heapq.nlargest(beam, ((float(v), -int(i)) for v, i in zip(s, entry)))
    heapq.heapify(best)
    while ahead:
        v, i = heapq.heappop(ahead)
        if len(best) >= beam and -v < best[0][0]:
            break
        near = links[starts[i] : starts[i + 1]]
        near = near[~seen[near]]
        if not len(near):
            continue
        seen[near] = True
        looked += len(near)
        for w, j in zip((x[near] @ q).tolist(), near.tolist()):
            if len(best) < beam or (w, -j) > best[0]:
                heapq.heappush(ahead, (-w, j))
                (heapq.heappush if len(best) < beam else heapq.heappushpop)(best, (w, -j))
    return [(w, -j) for w, j in best], looked


def _segment(key: str):
    def make(rows: pa.Table) -> pa.Table:
        ids = rows.column(key).to_numpy().astype(np.int64)
        column = rows.column("embedding").combine_chunks()
        x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        distinct, node = np.unique(x, axis=0, return_inverse=True)
        order = np.lexsort((ids, node.ravel()))
        first = np.searchsorted(node.ravel()[order], np.arange(len(distinct) + 1)).astype(np.int32)
        starts, links = linked(_unit(distinct))
        parts = distinct, starts, ids[order], first, links, entries(starts, links)
        segment = rows.column("segment")[0].as_py()
        return pa.table([pa.array([segment], pa.int32()), pa.array([x.shape[1]], pa.int32()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)], ["segment", "dim", "vectors", "starts", "ids", "first", "links", "entries"])

    return make


def graphs(vectors: DataFrame, key: str = "vec_id", segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """The index: a row a segment. Rows without a vector aren't in it."""
    rows = vectors.where("embedding IS NOT NULL AND size(embedding) > 0").select(F.col(key).cast("long").alias(key), F.col("embedding").cast("array<double>").alias("embedding"))
    n = max(1, -(-rows.count() // segment_rows))
    dealt = rows.withColumn("segment", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
    return dealt.groupBy("segment").applyInArrow(_segment(key), SCHEMA)


def index(source: DataFrame, vectors: DataFrame, name: str, key: str = "vec_id", segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """:func:`graphs`, written once for the files of ``source``."""
    return built(source, f"graphs-{name}", lambda: graphs(vectors, key, segment_rows))


def approximate(questions: DataFrame, graph: DataFrame, depth: int = POLICY.retrieval_depth, beam: int = BEAM, key: str = "vec_id") -> DataFrame:
    """(qid, key, score, rank, looked): the ``depth`` nearest found of each question (qid, embedding), ties by key.

    ``looked`` is how many vectors of the segment were compared with the question. Of equal vectors those with the
    smallest keys count. A beam is never narrower than ``depth``.
    """
    found = None
    schema = questions.select("qid").schema.add(key, "long").add("score", "double").add("looked", "long")
    for part in blocks(questions.where("embedding IS NOT NULL")):
        rows = part.select("qid", "embedding").orderBy("qid").collect()  # a block of the stated questions
        asked, q = [r.qid for r in rows], _unit(np.array([r.embedding for r in rows], np.float64)) if rows else []

        def search(batches, asked=asked, q=q):
            for batch in batches:
                for row in range(batch.num_rows):
                    if not asked:
                        continue
                    field = lambda c, kind: np.frombuffer(batch.column(c)[row].as_py(), kind)  # noqa: B023, E731
                    x = _unit(field("vectors", np.float64).reshape(-1, batch.column("dim")[row].as_py()))
                    starts, ids, first, links, entry = field("starts", np.int32), field("ids", np.int64), field("first", np.int32), field("links", np.int32), field("entries", np.int32)
                    who, what, score, looks = [], [], [], []
                    for qid, v in zip(asked, q):
                        best, looked = walked(x, starts, links, entry, v, max(beam, depth))
                        mine = sorted((-round(w, 9), int(k)) for w, j in best for k in ids[first[j] : first[j + 1]][:depth])[:depth]
                        who += [qid] * len(mine)
                        what += [k for _, k in mine]
                        score += [-w for w, _ in mine]
                        looks += [looked] * len(mine)
                    yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(what, pa.int64()), pa.array(score, pa.float64()), pa.array(looks, pa.int64())], schema.names)

        one = top(graph.mapInArrow(search, schema), key, depth)
        found = one if found is None else found.union(one)
    return found


def checked(questions: DataFrame, vectors: DataFrame, found: DataFrame, depth: int, digits: int = 6, key: str = "vec_id") -> DataFrame:
    """(qid, key, score, rank): the ``depth`` largest products of the vectors as they are, ties by key after rounding to ``digits``.

    ``found`` are :func:`approximate`'s rows. The least product among them is a question's bound, and one exact pass lets
    through what reaches it: the rows that the walk found, and any that it missed.
    """
    vectors = vectors.where("embedding IS NOT NULL AND size(embedding) > 0").select(F.col(key).cast("long").alias(key), "embedding")
    asked = questions.where("embedding IS NOT NULL").select("qid", "embedding")
    met = vectors.join(few(found.select("qid", key), BROADCAST_FOUND), key).join(asked.select("qid", F.col("embedding").alias("_q")), "qid")
    bounds = met.groupBy("qid").agg(F.count("*").alias("n"), F.min(dot(F.col("_q"), F.col("embedding"))).alias("least")).where(F.col("n") >= depth)
    slack = F.col("least") - F.lit(10.0**-digits)  # rounding on either side
    return nearest(asked.join(parked(bounds.select("qid", slack.alias("least")), "bounds"), "qid", "left"), vectors, depth, key=key, least="least", digits=digits)
