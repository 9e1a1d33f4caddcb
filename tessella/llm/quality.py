"""Quality scores: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, utf8

#: Labelled rows that a fit takes at most: those with the smallest hashes of their id.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST, RIDGE = 60, 4, 64, 0.15, 12, 1.0

STATISTICS = (
    "log_bytes", "log_words", "log_lines", "bytes_a_word", "word_spread", "longest_word", "words_a_line", "upper", "digit", "punctuation", "symbol", "bang", "hash",
    "dollar", "percent", "ampersand", "star", "bar", "stop", "high", "blank", "distinct_words", "top_word", "repeated_lines", "top_line", "short_words", "long_words",
    "capital_words", "odd_ends", "byte_entropy", "word_entropy", "repeated_pairs",
)

_CLASS = np.zeros((256, 6))
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = (65 <= _b <= 90, 48 <= _b <= 57, _c in ".,;:'\"()-?", _c in "!#$%&*+/<=>@[\\]^_`{|}~", _b >= 128, _c in " \t\n\r\f\v")
_BLANK = _CLASS[:, 5].astype(np.int8)
_UPPER = _CLASS[:, 0]
_ODD_END = np.array([float(chr(b) in "#$%&*!|") for b in range(256)])


def _repeats(doc: np.ndarray, key: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: distinct keys, the largest count of one, the sum of c * log2(c) over counts. ``doc`` ascends."""
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    at = np.flatnonzero(new)
    c = np.diff(np.append(at, len(d)))
    owner = d[at]
    most = np.zeros(docs)
    np.maximum.at(most, owner, c)
    return np.bincount(owner, minlength=docs).astype(float), most, np.bincount(owner, c * np.log2(c), docs)


#: Bytes of the texts that go through a numpy call together, unless one text alone has more.
TOGETHER = 1 << 20


def statistics(texts: list[bytes]) -> np.ndarray:
    """The statistics of texts, a row each, all finite; zeros for an empty text."""
    parts, begin, held = [], 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > TOGETHER:
            parts.append(_together(texts[begin:i]))
            begin, held = i, 0
        held += len(t) + 1
    return np.concatenate([*parts, _together(texts[begin:])])


def _together(texts: list[bytes]) -> np.ndarray:
    docs = len(texts)
    out = np.zeros((docs, len(STATISTICS)), np.float64)
    size = np.fromiter(map(len, texts), np.int64, docs)
    if not size.sum():
        return out.astype(np.float32)
    buffer = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(buffer, np.uint8)
    of = np.repeat(np.arange(docs), size + 1)
    hist = np.bincount(of * 256 + raw, minlength=256 * docs).reshape(docs, 256).astype(np.float64)
    hist[:, 10] -= 1  # the line feeds between texts
    n = np.maximum(1, size)[:, None]
    share = hist / n
    with np.errstate(divide="ignore", invalid="ignore"):
        out[:, 29] = -np.where(share > 0, share * np.log2(share), 0).sum(1)
    classes = share @ _CLASS
    out[:, 7:11] = classes[:, :4]
    out[:, 11:18] = share[:, [33, 35, 36, 37, 38, 42, 124]]
    out[:, 18] = share[:, 46]
    out[:, 19:21] = classes[:, 4:]

    edge = np.diff(_BLANK[raw], prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    word_of, length = of[starts], ends - starts
    w = np.bincount(word_of, minlength=docs).astype(np.float64)
    some = np.maximum(1, w)
    each = lambda x: np.bincount(word_of, x, docs) / some
    mean = each(length)
    longest = np.zeros(docs)
    np.maximum.at(longest, word_of, length)
    words = buffer.split()  # as many as starts: both go by the same six blanks
    key = np.fromiter(map(hash, words), np.int64, len(words))
    distinct, top, clog = _repeats(word_of, key, docs)
    pair = (key[:-1] * np.int64(0x2545F4914F6CDD1D)) ^ (key[1:] + np.int64(0x1E3779B97F4A7C15))
    same = word_of[1:] == word_of[:-1]
    pairs = _repeats(word_of[1:][same], pair[same], docs)[0]

    feeds = np.flatnonzero(raw == 10)
    line_of, line_length = of[feeds], np.diff(feeds, prepend=-1) - 1
    line_key = np.fromiter(map(hash, buffer[:-1].split(b"\n")), np.int64, len(feeds))
    full = line_length > 0
    lines = np.bincount(line_of[full], minlength=docs).astype(np.float64)
    line_kinds, line_top, _ = _repeats(line_of[full], line_key[full], docs)

    out[:, 0], out[:, 1], out[:, 2] = np.log1p(size), np.log1p(w), np.log1p(lines)
    out[:, 3], out[:, 4], out[:, 5] = mean, np.sqrt(np.maximum(0, each(length * length) - mean * mean)), np.log1p(longest)
    out[:, 6] = w / np.maximum(1, lines)
    out[:, 21], out[:, 22] = distinct / some, top / some
    out[:, 23], out[:, 24] = (lines - line_kinds) / np.maximum(1, lines), line_top / np.maximum(1, lines)
    out[:, 25], out[:, 26] = each(length <= 3), each(length >= 12)
    out[:, 27], out[:, 28] = each(_UPPER[raw[starts]]), each(_ODD_END[raw[ends - 1]])
    out[:, 30] = np.where(w > 1, (np.log2(some) - clog / some) / np.maximum(1, np.log2(some)), 0)
    out[:, 31] = np.where(w > 1, 1 - pairs / np.maximum(1, w - 1), 0)
    out[size == 0] = 0
    return np.nan_to_num(out).astype(np.float32)


@dataclass
class Forest:
    """Trees flattened into arrays: node i of tree t goes to children 2i+1 and 2i+2; leaves point to themselves by depth."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Forest:
    """Fit trees to labels 0 and 1 on histograms of ``bins`` quantile bins; one label or no row gives a constant."""
    inner, last = 2**depth - 1, 2 ** (depth + 1) - 1
    prior = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(prior / (1 - prior)))
    if len(y) < 2 or y.min() == y.max():
        return Forest(np.zeros((0, last), np.int64), np.zeros((0, last)), np.zeros((0, last)), depth, base)
    n, k = x.shape
    edges = np.full((k, bins - 1), np.inf)
    code = np.empty((n, k), np.int64)
    for j in range(k):
        e = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32))
        edges[j, : len(e)] = e
        code[:, j] = np.searchsorted(e, x[:, j], side="left")
    margin = np.full(n, base)
    fs, ts, vs = [], [], []
    flat = code + np.arange(k) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold, value = np.zeros(last, np.int64), np.full(last, np.inf), np.zeros(last)
        node = np.zeros(n, np.int64)
        for d in range(depth):
            first, width = 2**d - 1, 2**d
            at = ((node - first)[:, None] * (k * bins) + flat).ravel()
            size = width * k * bins
            hist = [np.bincount(at, np.repeat(w, k), size).reshape(width, k, bins) for w in (g, h)] + [np.bincount(at, minlength=size).reshape(width, k, bins)]
            left = [a.cumsum(2)[:, :, :-1] for a in hist]
            total = [a.sum(2)[:, :1, None] for a in hist]
            right = [t - a for t, a in zip(total, left, strict=True)]
            gain = left[0] ** 2 / (left[1] + RIDGE) + right[0] ** 2 / (right[1] + RIDGE) - total[0] ** 2 / (total[1] + RIDGE)
            gain[(left[2] < LEAST) | (right[2] < LEAST) | ~np.isfinite(edges)[None]] = 0
            best = gain.reshape(width, -1).argmax(1)
            top = gain.reshape(width, -1)[np.arange(width), best]
            for i in np.flatnonzero(top > 1e-6):
                feature[first + i], threshold[first + i] = best[i] // (bins - 1), edges[best[i] // (bins - 1), best[i] % (bins - 1)]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        sg, sh = np.bincount(node, g, last), np.bincount(node, h, last)
        value[inner:] = (-rate * sg / (sh + RIDGE))[inner:]
        margin += value[node]
        fs.append(feature), ts.append(threshold), vs.append(value)
    return Forest(np.array(fs), np.array(ts), np.array(vs), depth, base)


def held_out(doc_id: object) -> bool:
    """Rows that no fit sees: crc32 of the id's text leaves 1 by 3."""
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Fit on ``sample`` labelled rows at most, none of them held out. Null labels are left out, of several the largest counts."""
    known = labels.where("quality is not null and doc_id is not null and pmod(crc32(cast(cast(doc_id as string) as binary)), 3) <> 1")
    chosen = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by `sample`

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [r.tobytes() for r in statistics(utf8(batch.column("text")))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(x, pa.binary())], ["doc_id", "quality", "x"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    table = by_batch(rows.select("doc_id", "quality", "text"), run, f"doc_id {id_type}, quality int, x binary").dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id")
    x = np.array([np.frombuffer(b, np.float32) for b in table.column("x").to_pylist()], np.float32).reshape(-1, len(STATISTICS))
    y = (np.array(table.column("quality").to_pylist(), np.float64).reshape(-1) > 0).astype(np.float64)
    return boost(x, y)


def _scores(model: Forest, texts: list[bytes]) -> np.ndarray:
    return model.score(statistics(texts))


def scores(docs: DataFrame, model: Forest) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; null texts score as empty ones. Other columns are left out."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = _scores(model, utf8(batch.column(1)))
        out = [held_out(i) for i in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.bool_()), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return by_batch(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Forest, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, all columns kept."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(_scores(model, utf8(batch.column("text"))) >= least, pa.bool_()))

    return by_batch(docs, run, docs.schema)
