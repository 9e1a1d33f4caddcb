"""Shared pieces of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components as components
from ..storage import discard as discard
from ..storage import parked as parked

#: Rows and bytes that a function gets at once. Spark ends an Arrow batch at 64 MB, and a batch is cut again in the Python
#: worker, so its memory is bounded by bytes, whatever the texts' lengths; the session's settings are left alone.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20

#: Bytes that count as separators for the words of the licence and benchmark operators are turned to blanks, A-Z to a-z.
_WORD_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salted_join(rows: DataFrame, first: DataFrame, key: str, by: str = "doc_id", salts: int = 16, how: str = "inner") -> DataFrame:
    """Join of ``rows`` with ``first``, one row a key, where a key may hold a third of ``rows``: each key's rows are dealt to ``salts`` tasks by ``by``."""
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    return dealt.join(first.select("*", salt), [key, "_salt"], how).drop("_salt")


def sliced(batch: pa.RecordBatch, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Views of a batch of ``rows`` rows and ``size`` bytes of strings at most; a row of more bytes stands alone."""
    n = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            n += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    total, at = np.concatenate([[0], np.cumsum(n)]), 0
    while at < batch.num_rows:
        end = int(np.searchsorted(total, total[at] + size, "right")) - 1
        end = max(at + 1, min(end, at + rows, batch.num_rows))
        yield batch.slice(at, end - at)
        at = end


def by_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """``fn`` on the rows of ``df``, ``rows`` rows and BATCH_BYTES bytes at a time at most."""

    def run(batches):
        for batch in batches:
            for part in sliced(batch, rows):
                out = fn(part)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
        pa.default_memory_pool().release_unused()  # a worker waits for its next task without it

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def ascii_words(text: bytes) -> list[bytes]:
    """Words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.translate(_WORD_TABLE).split()


class _Hashes(dict):
    """64-bit hashes of words, remembered while there are few."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < 200_000:
            self[word] = value
        return value


_HASHES = _Hashes()
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; of the whole sequence where it is shorter; none for no words."""
    if not len(h):
        return h
    k = min(k, len(h))
    n = len(h) - k + 1
    out = np.full(n, np.uint64(k), np.uint64)
    for i in range(k):
        out = mixed(out * _ODD[i % len(_ODD)] + h[i : n + i])
    return out
