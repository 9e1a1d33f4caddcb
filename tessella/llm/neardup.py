"""N-gram Jaccard join by a token-group matrix.

Candidates. With H the most tokens in which two sets that meet the threshold can differ, a split of all tokens into more
than H segments leaves them a segment in common, token for token. Documents are put into groups by (size level, segment,
tokens in it). Segments without a token that is less frequent than a few hundredths of the documents' say nothing and are
left out, as long as more are left than H allows to differ; else all of them are kept. Either way no pair is lost.

Matrix. Groups that share documents form a part. A part, or a pair of bounded blocks of a large one, is one task: it
partitions the sets into groups of similar ones, stores each group's token union, counts a query's tokens in all unions
at once, and opens only the groups whose count reaches the least overlap that a partner there would need. Sets that are
connected already are not compared again, so a task returns a forest, never all pairs.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch, components, discard, mixed, parked, salted_join, shingle_hashes, sliced, utf8, word_hashes

BUCKETS = 1 << 20
#: A token is frequent above this share of the rows, or three times the buckets' median.
FREQUENT = 0.002
#: Tokens of a block; ids that are broadcast at once; members of a group.
BLOCK_TOKENS, BROADCAST_IDS, GROUP = 1_000_000, 1_000_000, 32
#: Passes over the texts, of BROADCAST_IDS ids each, before texts and ids are shuffled instead.
PASSES = 16


def shingles(text: bytes, k: int) -> np.ndarray:
    """The sorted distinct shingle hashes of the words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z."""
    return np.unique(shingle_hashes(word_hashes(text.lower().split()), k))


class Levels:
    """Size levels and segments of a threshold num/den. A pair's sizes lie in one level or two neighbours'."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.start, self.parts = [1], []
        self._grow(1)

    def _grow(self, size: int) -> None:
        num, den = self.num, self.den
        while self.start[-1] <= size or len(self.start) < 3:
            low = self.start[-1]
            self.start.append(low * den // num + 1)
            small = self.start[-1] - 1
            differ = (den - num) * (small + small * den // num) // (den + num)
            parts = differ + 1
            for _ in range(6):  # room for the segments that are left out
                empty = parts * math.exp(-0.8 * low / parts)
                parts = differ + 1 + min(differ + 2, max(1, math.ceil(empty + 2 * math.sqrt(empty) - 0.5)))
            self.parts.append((differ, parts))

    def keys(self, x: np.ndarray, rare: np.ndarray) -> np.ndarray:
        """The keys of a set's groups; ``rare`` marks its infrequent tokens."""
        if not len(x):
            return x
        self._grow(len(x) + 1)
        level = int(np.searchsorted(self.start, len(x), "right")) - 1
        out = []
        for at in (level, level - 1):
            if at < 0 or not self.parts[at][0]:
                continue  # no difference allowed: equal sets are found without groups
            differ, parts = self.parts[at]
            segment = (x % np.uint64(parts)).astype(np.int64)
            order = np.argsort(segment, kind="stable")
            sums = np.zeros(parts, np.uint64)
            there, first = np.unique(segment[order], return_index=True)
            sums[there] = np.add.reduceat(mixed(x[order] ^ np.uint64(0x5851F42D4C957F2D)), first)
            keep = np.zeros(parts, bool)
            keep[segment[rare]] = True
            if parts - keep.sum() >= parts - differ:
                keep[:] = True
            kept = np.flatnonzero(keep)
            out.append(mixed(mixed(sums[kept] + np.uint64(at)) + kept.astype(np.uint64)))
        return np.concatenate(out) if out else x[:0]


def _frequent(docs: DataFrame, k: int) -> np.ndarray:
    """Marks of the hash buckets whose shingles are frequent: counted over all rows, by partition, summed by bucket range."""
    width = 4096
    schema = pa.schema([("chunk", pa.int32()), ("salt", pa.int32()), ("counts", pa.binary())])

    def count(batches):
        total, seen = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for part in sliced(batch):
                x = [shingles(t, k) for t in utf8(part.column(0))]
                total += np.bincount((np.concatenate(x) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
                seen += 1
        if seen:
            n = BUCKETS // width
            salt = int(total[:64].sum()) % 16
            yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([salt] * n, pa.int32()), pa.array([r.tobytes() for r in total.reshape(n, width)], pa.binary())], schema=schema)

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, np.int64) for b in table.column("counts").to_pylist())
        return pa.table({"chunk": table.column("chunk")[:1], "salt": pa.array([0], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())}, schema=schema)

    sql = "chunk int, salt int, counts binary"
    parts = docs.select("text").mapInArrow(count, sql).groupBy("chunk", "salt").applyInArrow(add, sql)
    total = np.zeros(BUCKETS, np.int64)
    for r in parts.groupBy("chunk").applyInArrow(add, sql).collect():  # BUCKETS numbers, whatever the input
        total[r.chunk * width : (r.chunk + 1) * width] = np.frombuffer(r.counts, np.int64)
    return total


def _profiles(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, print): how many shingles, and a 128-bit print of the set; null for none."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [shingles(t, k) for t in utf8(batch.column(1))]
        prints = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in x]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, x)), pa.int64()), pa.array(prints, pa.binary())], ["doc_id", "n", "print"])

    return by_batch(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n bigint, print binary")


def _group_rows(docs: DataFrame, k: int, levels: Levels, frequent: np.ndarray) -> DataFrame:
    """(key, doc_id): the groups of each set; of copies in one partition, mostly the first only."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in (part for whole in batches for part in sliced(whole)):
            ids, keys = [], []
            for i, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                x = shingles(t, k)
                mark = xxhash.xxh3_128_digest(x.tobytes())
                if mark in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(mark)
                got = levels.keys(x, ~frequent[(x & np.uint64(BUCKETS - 1)).astype(np.int64)])
                keys.append(got)
                ids.append(np.full(len(got), i, np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids))], ["key", "doc_id"])

    return docs.mapInArrow(run, "key bigint, doc_id bigint")


def _chained(groups: DataFrame) -> DataFrame:
    """(a, b): each member of a group and the group's first one. Rows are sorted by key and streamed: no group is held."""
    spark = groups.sparkSession

    def run(batches):
        last_key, first = None, None
        for batch in batches:
            key, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            new[0] = last_key is None or key[0] != last_key
            at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            head = np.where(at >= 0, doc[np.maximum(at, 0)], 0 if first is None else first)
            last_key, first = key[-1], head[-1]
            other = np.flatnonzero(head != doc)
            pairs = np.unique(np.stack([doc[other], head[other]], 1), axis=0) if len(other) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = groups.repartition(n, "key").sortWithinPartitions("key", "doc_id")
    return parked(rows.mapInArrow(run, "a bigint, b bigint").distinct(), "chained")


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


class Matrix:
    """Groups of similar sets and, for each token, the groups whose union holds it."""

    def __init__(self, sets: list[np.ndarray], chosen: list[int], words: int):
        order = sorted(chosen, key=lambda i: (int(sets[i][0]) if len(sets[i]) else -1, len(sets[i])))
        self.members = [order[i : i + GROUP] for i in range(0, len(order), GROUP)]
        self.tokens = [np.concatenate([sets[i] for i in m]) for m in self.members]
        self.offsets = [np.concatenate([[0], np.cumsum([len(sets[i]) for i in m])[:-1]]) for m in self.members]
        self.sizes = [np.array([len(sets[i]) for i in m]) for m in self.members]
        self.low = np.array([s.min() for s in self.sizes])
        self.high = np.array([s.max() for s in self.sizes])
        union = [np.unique(t) for t in self.tokens]
        token = np.concatenate(union)
        group = np.repeat(np.arange(len(union)), [len(u) for u in union])
        order = np.argsort(token, kind="stable")
        self.group = group[order]
        self.begin = np.searchsorted(token[order], np.arange(words + 1))

    def overlaps(self, q: np.ndarray) -> np.ndarray:
        """How many tokens of ``q`` each group's union holds."""
        a, n = self.begin[q], self.begin[q + 1] - self.begin[q]
        at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.bincount(self.group[at], minlength=len(self.members))


def links(sets: list[np.ndarray], num: int, den: int, left: list[int], right: list[int]) -> list[tuple[int, int]]:
    """A forest over the pairs of ``left`` x ``right`` whose Jaccard similarity is num/den or more."""
    words = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]))
    local = [np.searchsorted(words, s) for s in sets]
    matrix, forest, out = Matrix(local, right, len(words)), Forest(len(sets)), []
    mark = np.zeros(len(words), bool)
    for q in sorted(left, key=lambda i: len(local[i])):
        n = len(local[q])
        least, most = -(-num * n // den), den * n // num
        smallest = np.maximum(matrix.low, least)
        need = -(-num * (n + smallest) // (den + num))
        able = (matrix.overlaps(local[q]) >= need) & (matrix.high >= least) & (matrix.low <= most)
        mark[local[q]] = True
        for g in np.flatnonzero(able).tolist():
            root = forest.root(q)
            fresh = [i for i, y in enumerate(matrix.members[g]) if forest.root(y) != root]
            if not fresh:
                continue
            shared = np.add.reduceat(mark[matrix.tokens[g]], matrix.offsets[g], dtype=np.int64)
            good = den * shared >= num * (n + matrix.sizes[g] - shared)
            for i in fresh:
                y = matrix.members[g][i]
                if good[i] and forest.root(y) != forest.root(q):
                    forest.up[forest.root(y)] = forest.root(q)
                    out.append((q, y))
        mark[local[q]] = False
    return out


def _shares(ids: DataFrame) -> int:
    """In how many parts of about BROADCAST_IDS rows ``ids`` are broadcast; 0 if they would be more than PASSES."""
    n = ids.count()
    return 0 if n > PASSES * BROADCAST_IDS else max(1, -(-n // max(1, BROADCAST_IDS)))


def _share(column: str, n: int, i: int) -> Column:
    return F.pmod(F.xxhash64(F.col(column).cast("bigint")), F.lit(n)) == i


def _verified(docs: DataFrame, members: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b): links among the members (doc_id, part, block, blocks). Members whose ids are too many for one broadcast go by
    parts in several passes, one after the other, so the texts stay where they lie."""
    n = _shares(members)
    if n <= 1:
        return _linked(docs.join(F.broadcast(members) if n else members, "doc_id"), k, num, den)
    passes = (_linked(docs.join(F.broadcast(members.where(_share("part", n, i))), "doc_id"), k, num, den) for i in range(n))
    return reduce(DataFrame.union, [parked(found, "linked") for found in passes])


def _linked(texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b): links among ``texts`` (doc_id, part, block, blocks, text), a task for each part or pair of its blocks."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [shingles(t, k).view(np.int64) for t in utf8(batch.column("text"))]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "part", "block", "blocks")), pa.array(x, pa.list_(pa.int64()))], ["doc_id", "part", "block", "blocks", "tokens"])

    sets = by_batch(texts.select("doc_id", "part", "block", "blocks", "text"), run, "doc_id bigint, part bigint, block bigint, blocks bigint, tokens array<bigint>")
    dealt = sets.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).select(
        "part", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "tokens"
    )

    def task(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        ids, block = table.column("doc_id").to_pylist(), table.column("block").to_pylist()
        tokens = table.column("tokens").combine_chunks()
        flat, at = tokens.values.to_numpy().view(np.uint64), tokens.offsets.to_numpy()
        found = [flat[a:b] for a, b in zip(at, at[1:], strict=False)]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left = [x for x, b in enumerate(block) if b == i]
        right = [x for x, b in enumerate(block) if b == j]
        got = links(found, num, den, left, right) if left and right else []
        return pa.table({"a": pa.array([ids[x] for x, _ in got], pa.int64()), "b": pa.array([ids[y] for _, y in got], pa.int64())})

    return dealt.groupBy("part", "i", "j").applyInArrow(task, "a bigint, b bigint")


def classes(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id.

    Documents link when the Jaccard similarity of their sets of k-word shingles is num/den or more (fewer words: the whole
    sequence is one shingle); component_id is the smallest doc_id that links reach. Null and empty texts have no shingle
    and link with nothing. Ids are integers. Rows that repeat a doc_id are one document, a result row each; rows without
    a doc_id link with nothing and have no component_id.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    every = parked(_profiles(docs, k), "profiles")
    nameless = every.where("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("bigint").alias("component_id"))
    docs, profiles = docs.where("doc_id is not null"), every.where("doc_id is not null")
    first = profiles.where("print is not null").groupBy("print").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    copied = salted_join(profiles.where("print is not null"), first, "print").where("doc_id <> rep").groupBy("doc_id").agg(F.min("rep").alias("rep"))
    known = parked(profiles.join(copied, "doc_id", "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")), "known")
    alias = known.where("rep <> doc_id").groupBy("doc_id").agg(F.min("rep").alias("rep"))

    total = _frequent(docs, k)
    frequent = total >= max(3 * float(np.median(total)), FREQUENT * profiles.count(), 8)
    chained = _chained(_group_rows(docs, k, Levels(num, den), frequent))
    low, high = alias.select(F.col("doc_id").alias("a"), F.col("rep").alias("ra")), alias.select(F.col("doc_id").alias("b"), F.col("rep").alias("rb"))
    edges = chained.join(low, "a", "left").join(high, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b")

    parts = parked(components(edges).join(known.where("rep = doc_id").groupBy("doc_id").agg(F.max("n").alias("n")), F.col("id") == F.col("doc_id")).select("doc_id", "n", F.col("component").alias("part")), "parts")
    sizes = parts.groupBy("part").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).alias("blocks"))
    members = parts.join(sizes, "part").select("doc_id", "part", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).alias("block"), F.col("blocks"))
    found = components(_verified(docs, parked(members, "members"), k, num, den))
    discard(chained)
    return known.join(found, known["rep"] == found["id"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id")).union(nameless)


def distinct(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs``, all columns, without all but the document of the smallest doc_id of each component. Rows without a doc_id all stay."""
    found = parked(classes(docs, k, num, den), "classes")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    n = _shares(gone)
    if n:
        parts = [docs.where(_share("doc_id", n, i)).join(F.broadcast(gone.where(_share("doc_id", n, i))), "doc_id", "left_anti") for i in range(n)] if n > 1 else [docs.join(F.broadcast(gone), "doc_id", "left_anti")]
        out = reduce(DataFrame.union, parts).select(*docs.columns)
    else:
        out = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = found.groupBy("doc_id").count().where("count > 1").limit(1).count()
    return out.where("doc_id is not null").dropDuplicates(["doc_id"]).union(out.where("doc_id is null")) if repeated else out
