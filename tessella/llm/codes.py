"""Vector code compression: product quantisation in whole numbers, so that every run gives the same codes.

A component x counts as floor(4096 * x). Vectors are cut into equal parts, each part position has a codebook, and a part's
code is its nearest entry. Nearest entries are screened with float32 matrix products, which come with an interval that
holds the exact value: entries whose interval overlaps the best one's are computed again in int64, and ties go to the lower
index. Rounds read the vectors in place; what a task gives back is sums and counts an entry, of fixed size, and codebooks
(parts x entries x components numbers) are the only thing that the driver holds.

Nulls and edges: a row whose vector is null, or holds a null, NaN or infinite component, is dropped. Of several rows of
one vec_id each is a row; the first entries are taken in the order of vec_id, then of the vector; null ids come last.
Fewer rows than entries give as many entries as rows. The dimension is that of the first kept row with components: other
lengths (empty vectors too) stay in the result with null code and error. A dimension that the parts don't divide, or a component
of 32768 or more in size, beyond which int64 can't hold a distance, is a ValueError. No rows give no rows. Further
columns of the input don't matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import salted_join
from .common import parked

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Largest size of a scaled component: with it, the squared distance of vectors of 64 Ki components fits in int64.
LIMIT = 32768 * SCALE
#: Rows that are screened at once, and labels whose sums are broadcast; more of them are joined by a shuffle.
BLOCK, FEW_LABELS = 8192, 100_000
U = 2.0**-24


def integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that are kept, their lengths, all their components as int64) of a column of vectors."""
    n = len(column)
    if pa.types.is_fixed_size_list(column.type):
        column = column.cast(pa.list_(column.type.value_type))
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    owner = np.repeat(np.arange(n), size)
    keep = pc.is_valid(column).to_numpy(zero_copy_only=False).copy()
    keep[owner[~np.isfinite(values)]] = False
    scaled = np.floor(values[keep[owner]] * SCALE)
    if len(scaled) and np.abs(scaled).max() >= LIMIT:
        raise ValueError("a component of 32768 or more in size can't be coded")
    return np.flatnonzero(keep), size[keep], scaled.astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, int]:
    """(index of each row's nearest entry, number of rows that the screening left open). Both arguments are int64.

    All entries share |x|^2, so |c|^2 - 2 x.c decides. A float32 product of d terms, of operands rounded to float32, differs
    from x.c by no more than (d + 2) u' |x| |c|, u' a little over 2^-24, in any order of summation; double that is used,
    and further 2^-50 of the terms covers the float64 arithmetic around it.
    """
    d = x.shape[1]
    square = (book * book).sum(1).astype(np.float64)
    norm = np.sqrt((x * x).sum(1).astype(np.float64))
    product = (x.astype(np.float32) @ book.T.astype(np.float32)).astype(np.float64)
    score = square - 2 * product
    slack = 4 * (d + 4) * U * np.outer(norm, np.sqrt(square)) + 2.0**-50 * (square + 2 * np.abs(product)) + 1e-9
    near = score - slack <= (score + slack).min(1, keepdims=True)
    best = near.argmax(1)
    open_rows = np.flatnonzero(near.sum(1) > 1)
    if len(open_rows):
        row, entry = np.nonzero(near[open_rows])
        exact = np.full((len(open_rows), len(book)), np.iinfo(np.int64).max)
        gap = x[open_rows[row]] - book[entry]
        exact[row, entry] = (gap * gap).sum(1)
        best[open_rows] = exact.argmin(1)
    return best, len(open_rows)


def _blocks(batches, dim: int, columns: int):
    """(values of other columns, (n, dim) int64, whether a row has that dimension) of kept rows, BLOCK at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            rows, size, flat = integers(part.column(columns))
            fits = (size == dim) & (dim > 0)
            yield [part.column(i).take(pa.array(rows)) for i in range(columns)], flat[np.repeat(fits, size)].reshape(int(fits.sum()), dim), fits


def first_entries(vectors: DataFrame, entries: int = ENTRIES) -> list[list[int]]:
    """Scaled vectors of the smallest kept ids, all of the first one's dimension."""
    clean = vectors.where("embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf')) AND size(embedding) > 0")
    order = F.col("vec_id").asc_nulls_last(), F.col("embedding").asc()
    one = clean.select("vec_id", "embedding").orderBy(*order).first()
    if one is None:
        return []
    rows = clean.where(F.size("embedding") == len(one["embedding"])).select("vec_id", "embedding").orderBy(*order).limit(entries).collect()
    return integers(pa.array([r["embedding"] for r in rows], pa.list_(pa.float64())))[2].reshape(len(rows), -1).tolist()


def _moved(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: every entry is the floor of its parts' mean, and unused ones stay."""
    parts, k, width = books.shape

    def sums(batches):
        total, count = np.zeros(books.shape, np.int64), np.zeros((parts, k), np.int64)
        for _, x, _ in _blocks(batches, parts * width, 0):
            for p in range(parts):
                cut = np.ascontiguousarray(x[:, p * width : (p + 1) * width])
                best, _ = nearest(cut, books[p])
                count[p] += np.bincount(best, minlength=k)
                for j in np.unique(best):
                    total[p, j] += cut[best == j].sum(0)
        entry = np.repeat(np.arange(parts * k), width + 1)
        at = np.tile(np.arange(width + 1), parts * k)
        value = np.concatenate([total.reshape(parts * k, width), count.reshape(-1, 1)], 1).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(entry, pa.int32()), pa.array(at, pa.int32()), pa.array(value, pa.int64())], ["entry", "at", "value"])

    found = vectors.select("embedding").mapInArrow(sums, "entry int, at int, value long").groupBy("entry", "at").agg(F.sum("value").alias("value")).collect()
    table = np.zeros((parts * k, width + 1), np.int64)
    for r in found:  # parts x entries x (components + 1) numbers
        table[r["entry"], r["at"]] = r["value"]
    count = table[:, -1:]
    moved = np.where(count > 0, table[:, :-1] // np.maximum(count, 1), books.reshape(parts * k, width))
    return moved.reshape(books.shape)


def codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """(parts, entries, components of a part) whole numbers, after ``rounds`` passes over all vectors."""
    start = np.array(first_entries(vectors, entries), np.int64)
    if not start.size:
        return np.zeros((parts, 0, 0), np.int64)
    if start.shape[1] % parts:
        raise ValueError(f"vectors of {start.shape[1]} components can't be cut into {parts} equal parts")
    books = np.ascontiguousarray(start.reshape(len(start), parts, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        books = _moved(vectors, books)
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every kept vector. Codes are two hex digits a part."""
    parts, k, width = books.shape

    def run(batches):
        for (ids, labels), x, fits in _blocks(batches, parts * width, 2):
            code = np.zeros((len(x), parts), np.uint8)
            error = np.zeros(len(x), np.int64)
            for p in range(parts):
                cut = np.ascontiguousarray(x[:, p * width : (p + 1) * width])
                if k and len(cut):
                    best, _ = nearest(cut, books[p])
                    gap = cut - books[p][best]
                    code[:, p], error = best, error + (gap * gap).sum(1)
            texts = np.full(len(fits), None, object)
            texts[fits] = [row.tobytes().hex() for row in code]
            errors = np.zeros(len(fits), np.int64)
            errors[fits] = error
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(texts, pa.string()), pa.array(errors, pa.int64(), mask=~fits)], ["vec_id", "label", "code", "error"])

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding")
    return rows.mapInArrow(run, "vec_id long, label long, code string, error long")


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept vector."""
    books = codebooks(vectors, parts, entries, rounds)
    rows = parked(coded(vectors, books).withColumn("key", F.coalesce(F.col("label").cast("string"), F.lit(""))), "codes")
    sums = rows.groupBy("key").agg(F.sum("error").alias("label_error"))
    if sums.limit(FEW_LABELS + 1).count() <= FEW_LABELS:
        joined = rows.join(F.broadcast(sums), "key")
    else:
        joined = salted_join(rows.withColumn("deal", F.col("vec_id")), sums, "key", "deal")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
