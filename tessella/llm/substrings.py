"""Removal of repeated byte strings by a column-wise construction over many documents.

A string of LENGTH bytes repeats where an equal one starts earlier. Each such string holds an anchor: its GRAM-byte gram
of smallest hash, the leftmost of several. Equal strings have equal anchors at equal places, so only segments around equal
anchors can hold equal strings, and lined up by their anchor they hold them in the same columns.

The segments of a task are one collection. Their columns lie in a sequential file; from the last column to the first,
each round reads one column, that is one symbol of each document's segment, inserts it before the suffixes ordered so far
by a stable sort, and updates the common prefixes of neighbours. Where neighbours share LENGTH symbols, all but the
earliest of the run are repeated strings. What a round needs is a few numbers a segment; the columns stay on disk.

A construction over whole documents has as many rounds as the longest document has bytes, each through the whole
collection; anchors make that LENGTH + REACH rounds over the few segments whose surroundings differ.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_batch, discard, mixed, parked, salted_join, utf8

LENGTH, GRAM = 100, 48
#: A string starts at most so many bytes before its anchor; a segment is that, and LENGTH more.
REACH = LENGTH - GRAM
WIDTH = REACH + LENGTH
#: Bytes hashed at once; rows that are broadcast at most; segments of a collection; rows of a group that goes by windows instead.
PIECE, BROADCAST_ROWS, COLLECTION, HOT = 1 << 18, 400_000, 50_000, 50_000
#: Anchors that are combined before they are dealt, and rows of a batch that goes on.
COMBINED, SENT = 100_000, 16_384

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, np.uint64(base))
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


class Hashed:
    """Hashes of every stretch of a byte string, from sums of its bytes' numbers times powers of a base."""

    def __init__(self, raw: np.ndarray):
        up, self.down = _powers(max(PIECE + WIDTH, len(raw)) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=np.uint64)])

    def __call__(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


def _least(v: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each ``w`` neighbours."""
    size, out = 1, v
    while size * 2 <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(out) - (w - size)], out[w - size :]) if w > size else out


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, segment hash, anchor, first start, last start) of each anchor: strings that start between have it."""
    out = []
    for at in range(0, max(1, len(text) - LENGTH + 1), PIECE):
        part = text[at : at + PIECE + LENGTH - 1]
        if len(part) < LENGTH:
            break
        h = Hashed(np.frombuffer(part, np.uint8))
        grams = h(slice(0, len(part) - GRAM + 1), slice(GRAM, len(part) + 1))
        # 40 bits of the hash, then the place: the smallest is the leftmost of the smallest hash
        value = (grams & ~np.uint64((1 << 24) - 1)) | np.arange(len(grams), dtype=np.uint64)
        anchor = (_least(value, REACH + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(anchor, prepend=-1))
        last = np.append(first[1:], len(anchor)) - 1
        anchor = anchor[first]
        seg = mixed(h(first, last + LENGTH) ^ ((anchor - first) * (REACH + 1) + last - first).astype(np.uint64))
        out.append((grams[anchor], seg, anchor + at, first + at, last + at))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """(key, seg, doc_id, pack) and (doc_id, start, end), rows of either kind.

    pack holds the anchor, how far before it strings start first, and how many more start after. Of segments that are
    equal within a batch the earliest alone is dealt on by its key; strings of the others are repeated, whatever other
    batches hold, and go by their document as ranges of starts, neighbours joined.
    """

    def combined(rows: list[tuple], ids: list[np.ndarray]) -> pa.RecordBatch:
        key, seg, anchor, first, last = (np.concatenate(c) for c in zip(*rows, strict=True))
        doc = np.concatenate(ids)
        order = np.lexsort((first, doc, seg, key))
        again = np.zeros(len(key), bool)
        again[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (seg[order[1:]] == seg[order[:-1]])
        on = np.flatnonzero(~again)
        d, s, e = doc[again], first[again], last[again]
        by = np.lexsort((s, d))
        d, s, e = d[by], s[by], e[by]
        head = np.ones(len(d), bool)
        head[1:] = (d[1:] != d[:-1]) | (s[1:] != e[:-1] + 1)
        at = np.flatnonzero(head)
        end = e[np.append(at[1:], len(e)) - 1] + LENGTH if len(e) else e
        none = lambda n: pa.nulls(n, pa.int64())
        one = [pa.array(key[on].view(np.int64)), pa.array(seg[on].view(np.int64)), pa.array(doc[on]), pa.array((anchor[on] << 12) | ((anchor[on] - first[on]) << 6) | (last[on] - first[on])), none(len(on)), none(len(on))]
        two = [none(len(at)), none(len(at)), pa.array(d[at]), none(len(at)), pa.array(s[at]), pa.array(end)]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(one, two, strict=True)], ["key", "seg", "doc_id", "pack", "start", "end"])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, rows, held = [], [], 0
        texts = utf8(batch.column(1))
        for n, (i, t) in enumerate(zip(batch.column(0).to_pylist(), texts, strict=True)):
            got = anchors(t)
            rows.append(got)
            ids.append(np.full(len(got[0]), i, np.int64))
            held += len(got[0])
            if held > COMBINED or n == len(texts) - 1:
                out = combined(rows, ids)
                for at in range(0, out.num_rows, SENT):
                    yield out.slice(at, SENT)
                ids, rows, held = [], [], 0

    return by_batch(docs.select("doc_id", "text"), run, "key bigint, seg bigint, doc_id bigint, pack bigint, start bigint, end bigint")


def _sorted_out(rows: DataFrame) -> DataFrame:
    """From anchors sorted by key, seg and place: (doc_id, pack) of the anchors whose key has several segments, the first
    of each segment; (doc_id, start, end) of ranges that repeat. Rows are streamed; of a key no more than one is held.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        before = held = None  # last (key, seg); the first row of the last key while it has one segment only
        for batch in batches:
            through = batch.filter(pc.is_null(batch.column("key")))
            if through.num_rows:
                yield pa.RecordBatch.from_arrays([through.column(c) for c in ("doc_id", "pack", "start", "end")], ["doc_id", "pack", "start", "end"])
            batch = batch.filter(pc.is_valid(batch.column("key")))
            key, seg, doc, pack = (batch.column(i).to_numpy() for i in range(4))
            if not len(key):
                continue
            new_key = np.ones(len(key), bool)
            new_key[1:] = key[1:] != key[:-1]
            new_key[0] = before is None or key[0] != before[0]
            new_seg = new_key.copy()
            new_seg[1:] |= seg[1:] != seg[:-1]
            new_seg[0] |= before is None or seg[0] != before[1]
            run_of = np.cumsum(new_key)  # 0: still the last key of the batch before
            segs = np.bincount(run_of, new_seg, run_of[-1] + 1)
            if segs[0] and run_of[0] == 0:
                segs[0] = 2  # one stood in a batch before
            open_ = new_seg & (segs[run_of] > 1)
            opened = [(doc[open_], pack[open_])]
            if held is not None and run_of[0] == 0 and segs[0]:
                opened.append((np.array([held[0]]), np.array([held[1]])))
                held = None
            if run_of[-1] > 0:
                at = int(np.flatnonzero(new_key)[-1])
                held = (doc[at], pack[at]) if segs[-1] == 1 else None
            before = (key[-1], seg[-1])
            d, p = (np.concatenate(x).astype(np.int64) for x in zip(*opened, strict=True))
            again = pack[~new_seg]
            start = (again >> 12) - ((again >> 6) & 63)
            none = pa.nulls(len(d), pa.int64())
            columns = [(pa.array(d), pa.array(doc[~new_seg])), (pa.array(p), pa.nulls(len(again), pa.int64())), (none, pa.array(start)), (none, pa.array(start + (again & 63) + LENGTH))]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in columns], ["doc_id", "pack", "start", "end"])

    # ranges that repeat need no key; they are spread by their place, so no hot one meets in a task
    dealt = rows.repartition(n, F.coalesce("key", F.xxhash64("doc_id", "start"))).sortWithinPartitions("key", "seg", "doc_id", "pack")
    return parked(dealt.mapInArrow(run, "doc_id bigint, pack bigint, start bigint, end bigint"), "anchors")


def _cut(text: bytes, start: int, n: int) -> bytes:
    """``n`` bytes from ``start`` on, which may lie outside; b"" stands for what isn't there and is told by offsets."""
    return text[max(0, start) : max(0, start + n)]


def _segments(docs: DataFrame, opened: DataFrame) -> DataFrame:
    """(half, doc_id, anchor, side, low, data): each opened anchor's segment, dealt by its anchor and half its surroundings.

    A string reaches REACH bytes beyond its anchor's gram in all: half of that or more to the left (side 0) or more than
    half to the right (side 1). Strings that are equal agree on that half, so each side is grouped by it.
    """
    half = REACH // 2

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for doc, text, packs in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), batch.column("packs").to_pylist(), strict=True):
            for pack in packs:
                a, back, more = pack >> 12, (pack >> 6) & 63, pack & 63
                first, last = a - back, a - back + more
                gram, data, low = text[a : a + GRAM], _cut(text, a - REACH, WIDTH), max(0, REACH - a)
                if first <= a - half:
                    out.append((hashlib.blake2b(b"0" + text[a - half : a] + gram, digest_size=16).digest(), doc, a, 0, low, first, min(last, a - half), data))
                if last > a - half:
                    out.append((hashlib.blake2b(b"1" + gram + text[a + GRAM : a + GRAM + half], digest_size=16).digest(), doc, a, 1, low, max(first, a - half + 1), last, data))
        types = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["half", "doc_id", "anchor", "side", "low", "first", "last", "data"])

    mine = opened.groupBy("doc_id").agg(F.collect_list("pack").alias("packs"))  # of one document, so bounded by it
    few = opened.count() <= BROADCAST_ROWS
    texts = docs.select("doc_id", "text").join(F.broadcast(mine) if few else mine, "doc_id")
    rows = by_batch(texts.select("doc_id", "text", "packs"), run, "half binary, doc_id bigint, anchor bigint, side int, low int, first bigint, last bigint, data binary")
    return parked(rows, "segments")


def _ranges(lcp: np.ndarray) -> list[np.ndarray]:
    """Minima of 1, 2, 4, ... neighbours."""
    out = [lcp]
    while len(out[-1]) > 1 << (len(out) - 1):
        step = 1 << (len(out) - 1)
        out.append(np.minimum(out[-1][:-step], out[-1][step:]))
    return out


def repeated(group: np.ndarray, data: list[bytes], low: np.ndarray) -> np.ndarray:
    """marks[i, j]: the string of segment i from column j on stands in an earlier segment of its group too.

    Segments stand in the order of their places. The matrix of symbols lies in a file by columns; bytes outside a text
    equal nothing.
    """
    n = len(data)
    marks = np.zeros((n, REACH + 1), bool)
    symbols = np.full((n, WIDTH), 256, np.uint16)
    for i, (d, at) in enumerate(zip(data, low.tolist(), strict=True)):
        symbols[i, at : at + len(d)] = np.frombuffer(d, np.uint8)
    with tempfile.TemporaryFile() as columns:
        for c in range(WIDTH - 1, -1, -1):  # in the order of the rounds
            columns.write(np.ascontiguousarray(symbols[:, c]).tobytes())
        del symbols
        columns.seek(0)
        order = np.argsort(group, kind="stable")
        lcp = np.zeros(n, np.int16)  # of a segment's suffix and the one before it in order
        for c in range(WIDTH - 1, -1, -1):
            column = np.frombuffer(columns.read(2 * n), np.uint16)
            bwt = column[order]
            place = np.argsort(group[order].astype(np.int64) * 257 + bwt, kind="stable")
            minima = _ranges(lcp)
            a, b = place[:-1], place[1:]  # neighbours now, and where they stood
            symbol = bwt[place]
            same = (symbol[1:] == symbol[:-1]) & (symbol[1:] < 256) & (group[order[a]] == group[order[b]])
            at = np.flatnonzero(same)
            lo, hi = a[at] + 1, b[at] + 1  # the least common prefix on the way from the one to the other
            level = np.frexp((hi - lo).astype(np.float64))[1] - 1
            least = np.empty(len(at), np.int16)
            for k in np.unique(level).tolist():
                m = level == k
                least[m] = np.minimum(minima[k][lo[m]], minima[k][hi[m] - (1 << k)])
            order = order[place]
            lcp = np.zeros(n, np.int16)
            lcp[at + 1] = np.minimum(LENGTH, least + 1)
            if c <= REACH:
                new = lcp < LENGTH
                runs = np.flatnonzero(new)
                earliest = np.minimum.reduceat(order, runs)
                marks[order, c] = order != np.repeat(earliest, np.diff(np.append(runs, n)))
    return marks


def _resolved(segments: DataFrame) -> DataFrame:
    """(doc_id, start, end) of repeated strings among the opened segments."""
    sizes = segments.groupBy("half").agg(F.count("*").alias("n")).where("n > 1")
    several = segments.join(sizes, "half")
    spark = segments.sparkSession

    def collections(table: pa.Table):
        if not table.num_rows:
            return
        key = table.column("half").to_pylist()
        edges = [i for i in range(1, len(key)) if key[i] != key[i - 1]]
        begin = 0
        for end in [*edges, len(key)]:
            if end - begin >= COLLECTION or end == len(key):
                yield one(table.slice(begin, end - begin))
                begin = end

    def one(table: pa.Table) -> pa.RecordBatch:
        names = {h: i for i, h in enumerate(dict.fromkeys(table.column("half").to_pylist()))}
        group = np.array([names[h] for h in table.column("half").to_pylist()], np.int64)
        doc, anchor, first, last = (table.column(c).to_numpy() for c in ("doc_id", "anchor", "first", "last"))
        by = np.lexsort((anchor, doc))
        data = table.column("data").to_pylist()
        marks = repeated(group[by], [data[i] for i in by], table.column("low").to_numpy()[by])
        row, column = np.nonzero(marks)
        start = anchor[by][row] - REACH + column
        mine = (start >= first[by][row]) & (start <= last[by][row])
        d, s = doc[by][row][mine], start[mine]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1)
        at = np.flatnonzero(new)
        end = s[np.append(at[1:], len(s)) - 1] + LENGTH if len(s) else s
        return pa.RecordBatch.from_arrays([pa.array(d[at]), pa.array(s[at]), pa.array(end)], ["doc_id", "start", "end"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def stream(batches):
        """Whole groups, COLLECTION segments at a time; groups of a partition are never all held."""
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows >= COLLECTION:
                key = held.column("half").to_pylist()
                last = next((i for i in range(len(key) - 1, 0, -1) if key[i] != key[i - 1]), 0)
                if last:
                    yield from collections(held.slice(0, last).combine_chunks())
                    held = held.slice(last).combine_chunks()
        if held is not None:
            yield from collections(held.combine_chunks())

    columns = several.where(F.col("n") <= HOT).drop("n").repartition(n, "half").sortWithinPartitions("half").mapInArrow(stream, "doc_id bigint, start bigint, end bigint")

    # a string that very many places share half of: its strings one by one, the earliest of equal ones by an aggregate
    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        cols = [batch.column(c).to_pylist() for c in ("doc_id", "anchor", "low", "first", "last", "data")]
        for doc, a, low, first, last, data in zip(*cols, strict=True):
            for s in range(first, last + 1):
                at = s - (a - REACH) - low
                out.append((hashlib.blake2b(data[at : at + LENGTH], digest_size=16).digest(), doc, s))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.int64()))], ["string", "doc_id", "start"])

    each = by_batch(several.where(F.col("n") > HOT).drop("n"), windows, "string binary, doc_id bigint, start bigint")
    hot = parked(each, "hot")
    earliest = hot.groupBy("string").agg(F.min(F.struct("doc_id", "start")).alias("first"))
    late = hot.join(earliest, "string").where(F.struct("doc_id", "start") > F.col("first")).select("doc_id", "start", (F.col("start") + LENGTH).alias("end"))
    return columns.union(late)


def _runs(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _numbered(known: DataFrame) -> DataFrame:
    """(doc_id, same, key): the distinct (doc_id, text) in order, numbered: a count per range, then a number inside each."""
    ranged = known.select("doc_id", "same").distinct().repartitionByRange("doc_id", "same").withColumn("part", F.spark_partition_id())
    ranged = parked(ranged, "numbered")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))  # a row a partition
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "before")
    at = F.row_number().over(Window.partitionBy("part").orderBy("doc_id", "same"))
    return parked(ranged.withColumn("at", at).join(F.broadcast(before), "part").select("doc_id", "same", (F.col("at") + F.col("before")).cast("bigint").alias("key")), "keys")


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): byte ranges, in any order and overlapping, that strings of LENGTH bytes cover which start earlier too.

    Earlier: in a smaller doc_id, or before in the same document. Ids are integers; rows without one are left out. Rows
    that repeat a doc_id and its text are one document; where a doc_id has several texts each is a document, in the
    order of their digests, and the result has a column ``same``, the text's digest, beside the id. Documents without
    such a string have no row.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
    known = parked(docs.select("doc_id", F.octet_length("text").cast("bigint").alias("n"), _digest("text").alias("same")).where(f"n >= {LENGTH}"), "texts")
    repeated = known.count() != known.select("doc_id").distinct().count()
    keys = None
    if repeated:
        known = known.dropDuplicates(["doc_id", "same"])
        keys = _numbered(known)
        docs = docs.withColumn("same", _digest("text")).join(keys, ["doc_id", "same"]).select(F.col("key").alias("doc_id"), "text").dropDuplicates(["doc_id"])
        known = parked(known.join(keys, ["doc_id", "same"]).select(F.col("key").alias("doc_id"), "n", "same"), "texts")
    first = known.groupBy("same").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    copies = parked(salted_join(known, first, "same").where("doc_id > first").select("doc_id", "n").distinct(), "copies")
    gone = copies.select("doc_id")
    rest = docs.where(f"octet_length(text) >= {LENGTH}").join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, "doc_id", "left_anti")
    sorted_out = _sorted_out(_anchor_rows(rest))
    whole = sorted_out.where("pack is null").select("doc_id", "start", "end")
    segments = _segments(rest, sorted_out.where("pack is not null"))
    part = parked(_resolved(segments), "resolved")
    discard(segments)
    every = whole.union(part).union(copies.select("doc_id", F.lit(0).cast("bigint"), "n"))
    found = every.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # of one document, so bounded by it
    return found if keys is None else found.join(keys.withColumnRenamed("doc_id", "id"), F.col("doc_id") == F.col("key")).select(F.col("id").alias("doc_id"), "same", "spans")


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(text, 256))


def removed(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``keep_text`` the remaining bytes too.

    Null texts are empty. Rows without a doc_id keep all their bytes; repeated rows give equal rows; other columns are left out.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = parked(repeats(docs), "repeats")
    rows = docs.select("doc_id", "text", _digest("text").alias("same")) if "same" in found.columns else docs.select("doc_id", "text")
    rows = rows.join(found, found.columns[:-1], "left")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t, spans in zip(utf8(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
            runs = _runs([(s["start"], s["end"]) for s in spans or ()])
            kept = b"".join(t[a:b] for a, b in zip([0, *(e for _, e in runs)], [*(s for s, _ in runs), len(t)], strict=True))
            out.append((len(t), len(t) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 4 + keep_text]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in out], t) for i, t in enumerate(types))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + keep_text])

    return by_batch(rows.select("doc_id", "text", "spans"), run, f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep_text)
