"""SentencePiece encoding and decoding; giant texts go through a max-plus scan over chunks.

The model is of the BPE kind. A sequence of its pieces is the encoding of the text they spell if and only if every two
neighbours are: no merge that the encoder would have made first crosses their seam. So a text's encoding is a path in a
lattice whose nodes are pieces at places and whose edges join compatible neighbours; an edge weighs the piece's score and
what is not compatible weighs minus infinity. In the (max, +) semiring a chunk is a matrix from the nodes that cross its
left boundary to those that cross its right one; matrices combine associatively, in a tree, and each chunk is traced
back on its own once the nodes on its boundaries are known.

Between a character and a following blank no piece of the vocabulary can lie: such a place is a cut vertex of the
lattice. All paths pass it, a matrix over it has rank one, so inside a chunk only the stretches before the first and
after the last cut vertex need lattice steps and the library encodes the stretch between.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import by_batch, parked

#: Texts of more characters than GIANT are split into chunks of CHUNK.
GIANT, CHUNK = 65_536, 16_384
BLANK = "▁"


class Model:
    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        self.piece = [self.sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i))]
        self.ids = {self.piece[i]: i for i in plain}
        self.score = {self.piece[i]: self.sp.get_score(i) for i in plain}
        self.longest = max(map(len, self.ids))
        self.bytes = {int(self.piece[i][3:5], 16): i for i in range(n) if self.sp.is_byte(i)}
        self.made: dict[str, bool] = {}
        self.pair = lru_cache(maxsize=400_000)(self._pair)

    def merged(self, text: str) -> list[str]:
        """The pieces that merging by score, leftmost first, makes of a short text."""
        parts = list(text)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: (self.score.get(parts[i] + parts[i + 1], -np.inf), -i))
            if parts[best] + parts[best + 1] not in self.score:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _pair(self, a: str, b: str) -> bool:
        return self.merged(a + b) == [a, b]

    def whole(self, piece: str) -> bool:
        """Whether merging makes this very piece of its characters."""
        if piece not in self.made:
            self.made[piece] = self.merged(piece) == [piece]
        return self.made[piece]

    def to_ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            out += [self.ids[p]] if p in self.ids else [self.bytes[b] for b in p.encode()]
        return out

    def library(self, text: str) -> list[int]:
        """Ids of a stretch of normalised text that begins with a blank, or with none if it is empty."""
        return self.sp.encode(text[1:].replace(BLANK, " ")) if len(text) > 1 else self.to_ids(list(text))


_LOADED: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _LOADED:
        _LOADED[path] = Model(path)
    return _LOADED[path]


def normal(text: str) -> str:
    """The text as the encoder sees it: a blank put before, blanks marked."""
    return BLANK + text.replace(" ", BLANK) if text else ""


def _ends(m: Model, s: str, start: int) -> list[int]:
    """Ends of the pieces that start at ``start``: known pieces, and the single character in any case."""
    out = [start + 1]
    for e in range(start + 2, min(len(s), start + m.longest) + 1):
        if s[start:e] in m.ids and m.whole(s[start:e]):
            out.append(e)
    return out


Node = tuple[int, int]  # a piece: its start and end


def _crossing(m: Model, s: str, at: int) -> list[Node]:
    """Nodes that hold the character before ``at``; the one state (0, 0) at the start of the text."""
    if at == 0:
        return [(0, 0)]
    return [(a, e) for a in range(max(0, at - m.longest), at) for e in _ends(m, s, a) if e >= at]


class Stretch:
    """Lattice steps from nodes that cross ``low`` to nodes that cross ``high``: best weights and where they came from."""

    def __init__(self, m: Model, s: str, low: int, high: int, sources: list[Node]):
        self.sources, k = sources, len(sources)
        weight: dict[Node, np.ndarray] = {}
        came: dict[Node, list[Node | None]] = {}
        ending: dict[int, list[Node]] = {}
        for i, node in enumerate(sources):
            w = np.full(k, -np.inf)
            w[i] = 0.0
            weight[node], came[node] = w, [None] * k
            ending.setdefault(node[1], []).append(node)
        for p in range(low, high):
            for left in ending.get(p, ()):
                if left[1] >= high and left not in sources:
                    continue
                for e in _ends(m, s, p):
                    node, piece = (p, e), s[p:e]
                    if left[0] < left[1] and not m.pair(s[left[0] : left[1]], piece):
                        continue
                    w = weight[left] + m.score.get(piece, -100.0)
                    if node not in weight:
                        weight[node], came[node] = np.full(k, -np.inf), [None] * k
                        ending.setdefault(e, []).append(node)
                    better = w > weight[node]
                    for i in np.flatnonzero(better):
                        came[node][i] = left
                    weight[node] = np.where(better, w, weight[node])
        self.targets = [n for n in weight if n[1] >= high and (n[0] < high)]
        self.matrix = np.array([weight[n] for n in self.targets]).T.reshape(k, len(self.targets))
        self.came = came

    def trace(self, source: Node, target: Node) -> list[Node]:
        """Nodes of the best path after ``source``, up to ``target``."""
        i, out, node = self.sources.index(source), [], target
        while node != source:
            out.append(node)
            node = self.came[node][i]
        return out[::-1]


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two matrices in the (max, +) semiring."""
    return (a[:, :, None] + b[None, :, :]).max(1) if a.size and b.size else np.full((a.shape[0], b.shape[1]), -np.inf)


class Chunk:
    """One chunk: its matrix, and its own trace. ``cuts``: its first and last cut vertex, or none."""

    def __init__(self, m: Model, s: str, low: int, high: int):
        self.m, self.s, self.low, self.high = m, s, low, high
        cuts = [p for p in range(max(low, 1), high) if s[p] == BLANK and s[p - 1] != BLANK]
        self.cut = (cuts[0], cuts[-1]) if cuts else None
        self.sources = _crossing(m, s, low)
        if self.cut is None:
            self.one = Stretch(m, s, low, high, self.sources)
            self.targets, self.matrix = self.one.targets, self.one.matrix
            return
        a, b = self.cut
        self.head = Stretch(m, s, low, a, self.sources)
        self.tail = Stretch(m, s, b, high, [(b, b)])
        into = np.array([[self.head.matrix[i, j] if t[1] == a else -np.inf for j, t in enumerate(self.head.targets)] for i in range(len(self.sources))]).reshape(len(self.sources), -1)
        self.reach = into
        best = into.max(1) if into.shape[1] else np.full(len(self.sources), -np.inf)
        self.targets, self.matrix = self.tail.targets, best[:, None] + self.tail.matrix[0][None, :]

    def trace(self, source: Node, target: Node) -> list[int]:
        """Ids of the pieces after ``source`` up to ``target``."""
        text = lambda nodes: self.m.to_ids([self.s[a:e] for a, e in nodes])
        if self.cut is None:
            return text(self.one.trace(source, target))
        a, b = self.cut
        i = self.sources.index(source)
        head = [] if source[1] == a else self.head.trace(source, self.head.targets[int(self.reach[i].argmax())])
        return text(head) + self.m.library(self.s[a:b]) + text(self.tail.trace((b, b), target))


def _aligned(matrix: np.ndarray, targets: list[Node], sources: list[Node]) -> np.ndarray:
    at = {n: i for i, n in enumerate(targets)}
    none = np.full(matrix.shape[0], -np.inf)
    return np.array([matrix[:, at[n]] if n in at else none for n in sources]).reshape(len(sources), -1).T


def states(chunks: list[tuple[list[Node], list[Node], np.ndarray]], size: int) -> list[Node]:
    """The node on each boundary of the best path, from (sources, targets, matrix) of every chunk of a text of ``size`` characters."""
    matrices = [_aligned(a[2], a[1], b[0]) for a, b in zip(chunks, chunks[1:], strict=False)]
    _, targets, matrix = chunks[-1]
    ends = [i for i, n in enumerate(targets) if n[1] == size]
    matrices.append(matrix[:, ends])
    prefix = _scan(matrices)  # from the start of the text to each boundary
    # the right end fixes the last node, and each boundary's node is the best one that leads on to the next
    last = targets[ends[int(prefix[-1][0].argmax())]]
    tails = [matrices[-1].max(1)]
    for x in reversed(matrices[:-1]):
        tails.append((x + tails[-1][None, :]).max(1))
    tails.reverse()
    inner = [c[0][int((prefix[i][0] + tails[i + 1]).argmax())] for i, c in enumerate(chunks[1:])]
    return [(0, 0), *inner, last]


def encode_giant(text: str, m: Model, chunk: int = CHUNK) -> list[int]:
    """Ids of ``text`` by chunks, in one place: matrices, an associative scan over them, a trace of each chunk."""
    s = normal(text)
    if not s:
        return []
    bounds = [*range(0, len(s), chunk), len(s)]
    chunks = [Chunk(m, s, a, b) for a, b in zip(bounds, bounds[1:], strict=False)]
    edges = states([(c.sources, c.targets, c.matrix) for c in chunks], len(s))
    return [x for c, a, b in zip(chunks, edges, edges[1:], strict=False) for x in c.trace(a, b)]


def _scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """All prefix products, by halves: the product is associative, so each half may run anywhere."""
    if len(matrices) == 1:
        return matrices
    half = len(matrices) // 2
    left, right = _scan(matrices[:half]), _scan(matrices[half:])
    return left + [combine(left[-1], x) for x in right]


class Window:
    """A chunk of a giant text that lies in a row of its own: the characters about it, and where they start."""

    def __init__(self, m: Model, text: str, base: int, low: int, high: int):
        self.base = base
        self.chunk = Chunk(m, text, low - base, high - base)

    def out(self, nodes: list[Node]) -> list[Node]:
        """Places in the whole text; the start of the text is (0, 0) in both."""
        return [(a + self.base, e + self.base) for a, e in nodes]

    def trace(self, source: Node, target: Node) -> list[int]:
        into = lambda n: (n[0] - self.base, n[1] - self.base)
        return self.chunk.trace(into(source), into(target))


def _pairs(nodes: list[Node]) -> list[int]:
    return [x for n in nodes for x in n]


def _nodes(flat: list[int]) -> list[Node]:
    return list(zip(flat[::2], flat[1::2], strict=True))


def _giants(big: DataFrame, path: str, chunk: int) -> DataFrame:
    """(row, ids, wanted) of rows (row, text) of giant texts; ``wanted`` is the digest that the decoded text should have.

    Every chunk is a row: its matrix, and later its trace, is made wherever the row lies. A text's matrices, a few numbers
    a chunk, meet in one group and are combined there.
    """
    spark = big.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = "row bigint, i bigint, size bigint, base bigint, low bigint, high bigint, part string, wanted string"

    def split(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        reach = model(path).longest
        for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
            s, wanted = normal(text), hashlib.sha256(text.replace(BLANK, " ").encode()).hexdigest()
            n = -(-len(s) // chunk)
            for i in range(n):
                low, high = i * chunk, min(len(s), (i + 1) * chunk)
                base = max(0, low - reach)
                yield pa.RecordBatch.from_pylist([{"row": row, "i": i, "size": len(s), "base": base, "low": low, "high": high, "part": s[base : high + reach], "wanted": wanted}])

    windows = parked(by_batch(big, split, dealt).repartition(parts, "row", "i"), "chunks")

    def matrix(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for r in batch.to_pylist():
            w = Window(model(path), r["part"], r["base"], r["low"], r["high"])
            out.append({"row": r["row"], "i": r["i"], "size": r["size"], "sources": _pairs(w.out(w.chunk.sources)), "targets": _pairs(w.out(w.chunk.targets)), "weights": w.chunk.matrix.ravel().tolist()})
        return pa.RecordBatch.from_pylist(out, schema=pa.schema([("row", pa.int64()), ("i", pa.int64()), ("size", pa.int64()), ("sources", pa.list_(pa.int32())), ("targets", pa.list_(pa.int32())), ("weights", pa.list_(pa.float64()))]))

    def scan(table: pa.Table) -> pa.Table:
        rows = table.sort_by("i").to_pylist()
        chunks = [(_nodes(r["sources"]), _nodes(r["targets"]), np.array(r["weights"], float).reshape(len(r["sources"]) // 2, -1)) for r in rows]
        edges = states(chunks, rows[0]["size"])
        return pa.table({"row": [r["row"] for r in rows], "i": pa.array([r["i"] for r in rows], pa.int64()), "edges": pa.array([_pairs([a, b]) for a, b in zip(edges, edges[1:], strict=False)], pa.list_(pa.int32()))})

    matrices = by_batch(windows, matrix, "row bigint, i bigint, size bigint, sources array<int>, targets array<int>, weights array<double>", rows=8)
    edges = matrices.groupBy("row").applyInArrow(scan, "row bigint, i bigint, edges array<int>")

    def trace(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for r in batch.to_pylist():
            ids = Window(model(path), r["part"], r["base"], r["low"], r["high"]).trace(*_nodes(r["edges"]))
            out.append({"row": r["row"], "i": r["i"], "wanted": r["wanted"], "ids": ids})
        return pa.RecordBatch.from_pylist(out, schema=pa.schema([("row", pa.int64()), ("i", pa.int64()), ("wanted", pa.string()), ("ids", pa.list_(pa.int32()))]))

    traced = by_batch(windows.join(edges, ["row", "i"]), trace, "row bigint, i bigint, wanted string, ids array<int>", rows=8)
    whole = traced.groupBy("row").agg(F.first("wanted").alias("wanted"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "ids"))), lambda x: x["ids"])).alias("ids"))  # of one text
    return parked(whole, "giants")


RESULTS = "n_pieces bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean, ids array<int>"


def encoded(docs: DataFrame, path: str, keep_ids: bool = False, giant: int = GIANT, chunk: int = CHUNK, keep_columns: bool = False) -> DataFrame:
    """Per row: doc_id, n_pieces, ids_sha256 (of the ids as little-endian 32-bit numbers), decoded_sha256, round_trip.

    decoded_sha256 is of the text that the ids decode to; round_trip tells whether that is the text itself, its marked
    blanks (U+2581) as blanks. Null and empty texts have no pieces; repeated rows give a row each. With ``keep_ids`` the
    ids come along. Other columns are left out, or stay with ``keep_columns``, but for those named like a result.
    """
    names = ["n_pieces", "ids_sha256", "decoded_sha256", "round_trip"] + ["ids"] * keep_ids
    kept = [c for c in docs.columns if c not in {"n_pieces", "ids_sha256", "decoded_sha256", "round_trip", "ids"}] if keep_columns else ["doc_id"]
    fields = [docs.schema[c] for c in kept]
    out = StructType(fields + [f for f in StructType.fromDDL(RESULTS).fields if f.name in names])

    def results(ids: list[list[int]], wanted: list[str]) -> list[pa.Array]:
        back = [hashlib.sha256(b.encode()).hexdigest() for b in model(path).sp.decode(ids)]
        cols = [
            pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(np.array(x, "<i4").tobytes()).hexdigest() for x in ids], pa.string()),
            pa.array(back, pa.string()), pa.array([b == w for b, w in zip(back, wanted, strict=True)], pa.bool_()),
        ]
        return cols + [pa.array(ids, pa.list_(pa.int32()))] * keep_ids

    def short(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [x or "" for x in batch.column(len(kept)).to_pylist()]
        ids = model(path).sp.encode(texts, num_threads=1)
        return pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + results(ids, [hashlib.sha256(t.replace(BLANK, " ").encode()).hexdigest() for t in texts]), [*kept, *names])

    def long(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + results(batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist()), [*kept, *names])

    size = F.length(F.coalesce("text", F.lit("")))
    columns = [F.col(f"`{c}`") for c in kept]
    more = "_" * (1 + max(map(len, kept)))  # no column is called that
    few = by_batch(docs.where(size <= giant).select(*columns, F.col("text").alias(more)), short, out)
    big = docs.where(size > giant).select(F.monotonically_increasing_id().alias("row"), "text", F.struct(*columns).alias("kept"))
    big = parked(big, "giant-texts")
    if not big.limit(1).count():
        return few
    whole = big.select("row", "kept").join(_giants(big.select("row", "text"), path, chunk), "row")
    return few.union(by_batch(whole.select(*(F.col("kept")[c].alias(c) for c in kept), F.col("ids").alias(more), F.col("wanted").alias(more + "_")), long, out))
