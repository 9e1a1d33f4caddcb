"""Benchmark decontamination: a prefix-filtered set join of item windows against documents."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, by_batch, parked, shingle_hashes, utf8, word_hashes

#: Words of a window, and of the shingles that make up a window's set.
WINDOW, SHINGLE = 10, 3
#: Items, and bytes of their texts, that a pass over the documents takes along; more of either make more passes, so what is
#: broadcast stays bounded (about ten times these bytes).
ITEMS_A_PASS, BYTES_A_PASS = 20_000, 16 << 20


class Windows:
    """The distinct windows of some items, indexed by the rarest shingle of each.

    A window occurs in a document only where all its shingles do, so with shingles ordered by rarity a prefix of one is
    all that the containment threshold of 1 needs: documents are probed with the rarest shingle alone. A window is a place
    in its item's words, some 40 bytes in arrays; words of the same spelling are one object.
    """

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int, shingle: int):
        known: dict[bytes, bytes] = {}
        self.shingle = shingle
        self.items = [item for item, words in items if words]
        self.words = [[known.setdefault(w, w) for w in words] for _, words in items if words]
        self.grams = [shingle_hashes(word_hashes(w), shingle) for w in self.words]
        sizes = np.array([min(window, len(w)) for w in self.words], np.int64)
        counts = np.array([len(w) for w in self.words], np.int64) - sizes + 1
        owner = np.repeat(np.arange(len(self.words)), counts)
        start = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        whole = [shingle_hashes(word_hashes(w), int(z)) for w, z in zip(self.words, sizes)]
        order = np.lexsort((start, owner, np.concatenate([*whole, np.zeros(0, np.uint64)])))
        prints = np.concatenate([*whole, np.zeros(0, np.uint64)])[order]
        first = np.concatenate([[True], prints[1:] != prints[:-1]]) if len(prints) else np.zeros(0, bool)
        # equal prints are equal windows, unless two texts collide: then each text is a window
        number, at = np.cumsum(first) - 1, np.flatnonzero(first)
        extra = len(at)
        texts: dict[tuple, int] = {}
        for k in np.flatnonzero(~first).tolist():
            text, one = self._text(owner[order[k]], start[order[k]], sizes), int(at[number[k]])
            if text != self._text(owner[order[one]], start[order[one]], sizes):
                if text not in texts:
                    texts[text] = extra
                    extra += 1
                number[k] = texts[text]
        by = np.argsort(number, kind="stable")
        self._bounds = np.searchsorted(number[by], np.arange(extra + 1))
        self._owners = owner[order][by].astype(np.int32)
        one = order[by[self._bounds[:-1]]]
        self.item, self.start, self.size = owner[one].astype(np.int32), start[one].astype(np.int32), sizes[owner[one]].astype(np.int32)
        self.vocabulary = np.unique(np.concatenate([*self.grams, np.zeros(0, np.uint64)]))
        self.short = sorted({len(w) for w in self.words if len(w) < shingle})

    def _text(self, item: int, start: int, sizes: np.ndarray) -> tuple:
        return tuple(self.words[item][start : start + sizes[item]])

    def owners(self, window: int) -> list[object]:
        """The items that have a window."""
        return [self.items[i] for i in dict.fromkeys(self._owners[self._bounds[window] : self._bounds[window + 1]].tolist())]

    def rank(self, counts: np.ndarray) -> None:
        """Choose each window's rarest shingle, ties by hash; ``counts`` are those of the vocabulary over all documents."""
        place = np.empty(len(self.vocabulary), np.int64)
        place[np.lexsort((self.vocabulary, counts))] = np.arange(len(self.vocabulary))
        prefix, offset = np.zeros(len(self.item), np.uint64), np.zeros(len(self.item), np.int32)
        by = np.argsort(self.item, kind="stable")
        bounds = np.searchsorted(self.item[by], np.arange(len(self.words) + 1))
        for i, g in enumerate(self.grams):
            mine = by[bounds[i] : bounds[i + 1]]
            if len(mine):
                width = max(1, int(self.size[mine[0]]) - self.shingle + 1)
                rarest = np.lib.stride_tricks.sliding_window_view(place[np.searchsorted(self.vocabulary, g)], width).argmin(1)[self.start[mine]]
                prefix[mine], offset[mine] = g[self.start[mine] + rarest], rarest
        order = np.argsort(prefix, kind="stable")
        self.prefix, self._first = np.unique(prefix[order], return_index=True)
        self._first = np.append(self._first, len(order))
        self._window, self._offset = order.astype(np.int32), offset[order]

    def places(self, words: list[bytes], gram: np.uint64, at: int) -> Iterator[tuple[int, int, int]]:
        """(window, start, end) of the windows with a prefix that stand in ``words``, whose shingle ``gram`` is at ``at``."""
        k = int(np.searchsorted(self.prefix, gram))
        for j in range(self._first[k], self._first[k + 1]):
            w = int(self._window[j])
            start, size = at - int(self._offset[j]), int(self.size[w])
            # length and position bounds: the window must lie inside the text
            if 0 <= start and start + size <= len(words) and words[start : start + size] == self.words[self.item[w]][self.start[w] : self.start[w] + size]:
                yield w, start, start + size


def _grams(h: np.ndarray, k: int, short: list[int]) -> list[np.ndarray]:
    """Shingle hashes of a text, and the whole-sequence hashes of the lengths under ``k`` that some item has."""
    out = [shingle_hashes(h, k)] if len(h) >= k else []
    return out + [shingle_hashes(h, n) for n in short if len(h) >= n]


def _counts(docs: DataFrame, windows: Windows) -> np.ndarray:
    """How often each shingle of the windows occurs in all documents."""
    vocabulary, k, short = windows.vocabulary, windows.shingle, windows.short
    if not len(vocabulary):
        return np.zeros(0, np.int64)
    probe = Probe(vocabulary)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        total: Counter = Counter()
        for text in utf8(batch.column(0)):
            for g in _grams(word_hashes(ascii_words(text)), k, short):
                hit = probe(g)
                total.update(np.searchsorted(vocabulary, g[hit]).tolist())
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], ["at", "n"])

    rows = by_batch(docs.select("text"), run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(vocabulary), np.int64)
    for r in rows:
        out[r.at] = r.n
    return out


class Probe:
    """Positions of an array whose values are in a sorted set: a bitmap on 20 bits first, then a search."""

    def __init__(self, values: np.ndarray):
        self.values, self.bits = values, np.zeros(1 << 20, bool)
        self.bits[(values >> np.uint64(44)).astype(np.int64)] = True

    def __call__(self, x: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.bits[(x >> np.uint64(44)).astype(np.int64)])
        if not len(maybe):
            return maybe
        at = np.searchsorted(self.values, x[maybe])
        at[at == len(self.values)] = 0
        return maybe[self.values[at] == x[maybe]]


def occurrences(words: list[bytes], windows: Windows, probe: Probe) -> list[tuple[int, int, int]]:
    """(window, start, end) of each place where a window stands in ``words``."""
    out = []
    if not words or not len(windows.prefix):
        return out
    for g in _grams(word_hashes(words), windows.shingle, windows.short):
        for p in probe(g).tolist():
            out += windows.places(words, g[p], p)
    return sorted(set(out))


def _runs(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _passes(docs: DataFrame, bench: DataFrame, window: int, shingle: int, item_col: str, a_pass: int) -> tuple[int, Iterator[Windows]]:
    """How many passes, and the windows of each: one pass's items are held at a time."""
    n, size = bench.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-n // a_pass), -(-size // BYTES_A_PASS))
    rows = bench.select(F.col(item_col).alias("item"), "text").withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(parts)))

    def each() -> Iterator[Windows]:
        for part in range(parts):
            items = sorted(((r.item, ascii_words((r.text or "").encode())) for r in rows.where(F.col("part") == part).collect()), key=str)
            w = Windows(items, window, shingle)
            w.rank(_counts(docs, w))
            yield w

    return parts, each()


def contaminated(
    docs: DataFrame, bench: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, item_col: str = "item_id", a_pass: int = ITEMS_A_PASS
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans ("start:end" of word runs that are hit).

    Null texts have no words; an empty benchmark hits nothing; items with equal texts all count. Repeated rows give a
    row each. Other columns are left out, so their names can't clash.
    """
    docs = docs.select("doc_id", "text")
    parts, passes = _passes(docs, bench, window, shingle, item_col, a_pass)
    if parts == 1:
        merged = _pass(docs.withColumn("row", F.lit(0).cast("bigint")), next(passes))
    else:
        # every pass reads the same numbered rows; a pass is written before the next one's items are fetched
        rows = parked(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
        every = reduce(DataFrame.union, (parked(_pass(rows, w), "pass") for w in passes))
        # a row of a document from each pass: the lists of a document are bounded by its own length and the items in it
        merged = every.groupBy("row", "doc_id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"), F.flatten(F.collect_list("items")).alias("items"))

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = {n: batch.column(n).to_pylist() for n in ("starts", "ends", "items")}
        runs = [_runs(list(zip(a, b, strict=True))) for a, b in zip(cols["starts"], cols["ends"], strict=True)]
        items = [sorted(x) for x in cols["items"]]
        hit = [sum(b - a for a, b in r) for r in runs]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array([len(set(x)) for x in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(dict.fromkeys(x)).encode()).hexdigest() for x in items]), pa.array([x > 0 for x in hit], pa.bool_()),
                pa.array([",".join(f"{a}:{b}" for a, b in r) for r in runs]),
            ],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
        )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(merged, finish, f"doc_id {id_type}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans string")


def _pass(docs: DataFrame, windows: Windows) -> DataFrame:
    """(row, doc_id, n_words, starts, ends, items) of the windows of one pass."""
    probe = Probe(windows.prefix)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, starts, ends, items = [], [], [], []
        for text in utf8(batch.column("text")):
            words = ascii_words(text)
            at = occurrences(words, windows, probe)
            n.append(len(words))
            runs = _runs([(a, b) for _, a, b in at])
            starts.append([a for a, _ in runs])
            ends.append([b for _, b in runs])
            items.append(sorted({str(i) for w, _, _ in at for i in windows.owners(w)}))
        return pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
            ["row", "doc_id", "n_words", "starts", "ends", "items"],
        )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(docs.select("row", "doc_id", "text"), run, f"row bigint, doc_id {id_type}, n_words bigint, starts array<bigint>, ends array<bigint>, items array<string>")


def without_contaminated(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` in which no window of ``bench`` occurs, all columns kept."""
    parts, passes = _passes(docs, bench, options.get("window", WINDOW), options.get("shingle", SHINGLE), "item_id", options.get("a_pass", ITEMS_A_PASS))
    out = docs
    for at, windows in enumerate(passes):
        probe = Probe(windows.prefix)

        def run(batch: pa.RecordBatch, windows=windows, probe=probe) -> pa.RecordBatch:
            clean = [not occurrences(ascii_words(t), windows, probe) for t in utf8(batch.column("text"))]
            return batch.filter(pa.array(clean, pa.bool_()))

        out = by_batch(out, run, out.schema)
        if at < parts - 1:
            out = parked(out, "pass")
    return out
