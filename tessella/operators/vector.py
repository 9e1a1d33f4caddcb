"""Embeddings and exact cosine retrieval (VEC01, VEC02, VEC04, SRC09)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..config import POLICY
from ..functions.text import tokens
from ..storage import built, parked
from .lexical import few, top

#: Questions that go to all vectors as one matrix; more go in several passes, one after the other.
BLOCK = 4096
#: Scores that a task holds at once.
SCORES = 1 << 22
#: Words whose places a task remembers; units that it encodes at once.
WORDS, UNITS = 200_000, 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


class EmbeddingProvider(Protocol):
    """Where vectors come from (VEC01): ``name`` identifies the model, ``encode`` adds ``embedding``, L2-normalised, and drops the text."""

    name: str

    def encode(self, units: DataFrame, key: str, text: str = "text") -> DataFrame: ...


class HashedTokens:
    """Embeddings without a model: each token adds 1 or -1 to one of ``size`` dimensions, both told by its MD5 digest."""

    def __init__(self, size: int = 64):
        self.size, self.name = size, f"hashed-tokens-{size}"

    def encode(self, units: DataFrame, key: str, text: str = "text") -> DataFrame:
        """Every unit where it lies; one without tokens has the zero vector."""
        others = [c for c in units.columns if c != text]
        words = units.select(*others, tokens(F.col(text)).alias("_words"))
        schema = StructType([*(units.schema[c] for c in others), StructField("embedding", ArrayType(DoubleType()))])
        size, of = self.size, self.of_tokens

        def run(batches):
            made = of()
            for batch in (whole.slice(at, UNITS) for whole in batches for at in range(0, whole.num_rows, UNITS)):
                unit = made(batch.column(batch.num_columns - 1))
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, unit.size + 1, size), pa.int32()), pa.array(unit.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], vectors], schema.names)

        return words.mapInArrow(run, schema)

    def of_tokens(self) -> Callable[[pa.ListArray], np.ndarray]:
        """What makes vectors, a row a unit, of the units' tokens in a worker."""
        size, known = self.size, {}

        def place(word: str) -> tuple[int, int]:
            digest = hashlib.md5(word.encode()).hexdigest()
            found = int(digest[:8], 16) % size, 1 if digest[8] < "8" else -1
            if len(known) < WORDS:
                known[word] = found
            return found

        def made(lists: pa.ListArray) -> np.ndarray:
            words = lists.flatten().dictionary_encode()
            told = [known.get(w) or place(w) for w in words.dictionary.to_pylist()]
            spot, code = np.array(told, np.int64).reshape(-1, 2), words.indices.to_numpy()
            unit = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            raw = np.bincount(unit * size + spot[code, 0], spot[code, 1], len(lists) * size).reshape(-1, size)
            norm = np.sqrt((raw * raw).sum(1, keepdims=True))
            return np.divide(raw, norm, out=np.zeros_like(raw), where=norm > 0)

        return made


def cached(provider: EmbeddingProvider, source: DataFrame, units: DataFrame, key: str, mark: str | None = None) -> DataFrame:
    """Vectors of ``units``, made once for the model's name and the files that the units come from; ``operators.cache`` has them by content."""
    return built(source, f"vectors-{provider.name}", lambda: provider.encode(units, key), mark)


def blocks(questions: DataFrame) -> list[DataFrame]:
    """The questions in parts of about BLOCK."""
    n = -(-questions.count() // BLOCK)
    return [questions] if n <= 1 else [questions.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i) for i in range(n)]


def nearest(questions: DataFrame, vectors: DataFrame, depth: int = POLICY.retrieval_depth, scope: str | None = None, key: str = "vec_id", keep: list[str] = (), least: str | None = None, digits: int = 9) -> DataFrame:
    """(qid, key, keep, score, rank) of the ``depth`` nearest vectors of each question, ties by key (VEC02).

    With ``scope``, a column of both sides, vectors outside the question's scope are left out. The questions, a stated set,
    go to every batch of vectors as a matrix, BLOCK of them a pass; each batch returns its own best, so a question's rows
    are as many as batches times depth, not as many as vectors. ``least`` names the questions' column of the score below
    which nothing is wanted, null for none; scores have ``digits`` digits.
    """
    schema = vectors.select(key, *keep).schema.add("qid", questions.schema["qid"].dataType).add("score", "double")
    found, parts = None, blocks(questions)
    for block in parts:
        rows = block.select("qid", "embedding", *([scope] if scope else []), *([least] if least else [])).orderBy("qid").collect()  # BLOCK or about as many
        ids, q = np.array([r.qid for r in rows]), np.array([r.embedding for r in rows], np.float64)
        mine = np.array([r[scope] for r in rows], object) if scope else None
        bound = np.array([-np.inf if not least or r[least] is None else r[least] for r in rows])
        part = _best(vectors.select(key, *keep, "embedding", *([F.col(scope).alias("_scope")] if scope else [])), ids, q, mine, bound, digits, depth, len(keep), schema)
        part = top(part, key, depth)
        part = parked(part, "nearest") if len(parts) > 1 else part
        found = part if found is None else found.union(part)
    return found.select("qid", key, *keep, "score", "rank")


def _best(vectors: DataFrame, ids: np.ndarray, q: np.ndarray, mine: np.ndarray | None, bound: np.ndarray, digits: int, depth: int, kept: int, schema) -> DataFrame:
    def block(batches):
        step = max(1, SCORES // max(1, len(ids)))
        for whole in batches:
            for at in range(0, whole.num_rows if len(ids) else 0, step):
                yield best(whole.slice(at, step))

    def best(batch):
        x = np.stack([np.asarray(v, np.float64) for v in batch.column(1 + kept).to_pylist()])
        s = np.round(q @ x.T, digits)
        s[s < bound[:, None]] = -np.inf
        if mine is not None:
            s[mine[:, None] != np.array(batch.column(2 + kept).to_pylist(), object)[None, :]] = -np.inf
        least = np.partition(s, max(0, s.shape[1] - depth), axis=1)[:, max(0, s.shape[1] - depth)]
        who, at = np.nonzero((s >= least[:, None]) & np.isfinite(s))  # the best and what ties with the last of them
        order = np.lexsort((batch.column(0).to_numpy(zero_copy_only=False)[at], -s[who, at], who))
        who, at = who[order], at[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        who, at = who[place < depth], at[place < depth]
        rows = batch.select(list(range(1 + kept))).take(pa.array(at))
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(ids[who]), pa.array(s[who, at])], schema.names)

    return vectors.mapInArrow(block, schema)


def best_per_group(pairs: DataFrame, group: str) -> DataFrame:
    """The largest cosine of a group's units (VEC04)."""
    return pairs.groupBy("qid", group).agg(F.max("score").alias("score"))


def group_best(questions: DataFrame, vectors: DataFrame, group: str) -> DataFrame:
    """(qid, group, score): the largest cosine of each group's vectors (VEC04), a block of vectors at a time: no pair leaves its batch."""
    schema = vectors.select(group).schema.add("qid", questions.schema["qid"].dataType).add("score", "double")
    found, parts = None, blocks(questions)
    for part in parts:
        rows = part.select("qid", "embedding").orderBy("qid").collect()  # BLOCK or about as many
        ids, q = np.array([r.qid for r in rows]), np.array([r.embedding for r in rows], np.float64)

        def block(batches, ids=ids, q=q):
            for batch in batches:
                if not batch.num_rows or not len(ids):
                    continue
                s = np.round(q @ np.stack([np.asarray(v, np.float64) for v in batch.column(1).to_pylist()]).T, 9)
                names, code = np.unique(np.array(batch.column(0).to_pylist()), return_inverse=True)
                best = np.stack([s[:, code == k].max(1) for k in range(len(names))], 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(names, len(ids)), batch.schema[0].type), pa.array(np.repeat(ids, len(names))), pa.array(best.ravel())], schema.names)

        one = vectors.select(group, "embedding").mapInArrow(block, schema).groupBy("qid", group).agg(F.max("score").alias("score"))
        one = parked(one, "group-best") if len(parts) > 1 else one
        found = one if found is None else found.union(one)
    return found


def pair_best(pairs: DataFrame, questions: DataFrame, vectors: DataFrame, group: str, most: int = 200_000) -> DataFrame:
    """(qid, group, score): the largest cosine of the vectors of each group that ``pairs`` (qid, group) names, and of no other."""
    asked = pairs.select("qid", group).distinct().join(questions.select("qid", F.col("embedding").alias("_q")), "qid")
    met = vectors.select(group, "embedding").join(few(asked, most), group)
    return met.groupBy("qid", group).agg(F.max(F.round(dot(F.col("_q"), F.col("embedding")), 9)).alias("score"))
