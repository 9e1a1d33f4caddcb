"""Token counts of byte-level BPE texts; huge texts go through overlapping chunks that are spliced at proven boundaries."""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_batch

#: Characters of a chunk, and of the overlap that is tried first.
CHUNK, OVERLAP = 32_768, 256

_LOADED: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a file, once a process."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def _boundaries(text: str, spans: list[tuple[int, int]], base: int, low: int, high: int) -> dict[int, int]:
    """Offsets p in [low, high) where white space follows another character, and how many tokens start before each.

    No pre-token of the vocabulary's pattern holds white space after any other character and the pattern looks back at
    nothing, so a pre-token starts at p whatever stands around: neither side's tokens depend on the other side.
    """
    out, n = {}, 0
    for p in range(max(low, 1), high):
        if text[p].isspace() and not text[p - 1].isspace():
            while n < len(spans) and spans[n][0] + base < p:
                n += 1
            if n == 0 or spans[n - 1][1] + base <= p:
                out[p] = n
    return out


def count_tokens(text: str, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text``, counted in chunks of ``chunk`` characters where it is longer.

    Neighbouring chunks overlap. Both encodings must agree on a boundary in the overlap and on the tokens from there to
    the overlap's last common boundary; if they don't, the overlap is doubled, in the end up to the rest of the text.
    """
    tok = tokenizer(path)
    if len(text) <= chunk + overlap:
        return len(tok.encode(text, add_special_tokens=False).ids)
    total, start, size = 0, 0, chunk
    left = tok.encode(text[: size + overlap], add_special_tokens=False)
    left_end, done = min(len(text), size + overlap), 0  # tokens of left before `done` are counted already
    while left_end < len(text):
        wide = left_end - (start + size)
        while True:
            begin = left_end - wide
            here = _boundaries(text, left.offsets, start, begin + 1, left_end)
            right_end = min(len(text), begin + chunk + wide)
            right = tok.encode(text[begin:right_end], add_special_tokens=False)
            there = _boundaries(text, right.offsets, begin, begin + 1, left_end)
            common = [p for p in here if p in there]
            if common:
                p, q = common[0], common[-1]
                if left.ids[here[p] : here[q]] == right.ids[there[p] : there[q]]:
                    total += here[p] - done
                    start, size, left, left_end, done = begin, right_end - begin - wide, right, right_end, there[p]
                    break
            # no common boundary: take more text on both sides
            left_end = min(len(text), left_end + 2 * wide)
            left = tok.encode(text[start:left_end], add_special_tokens=False)
            wide *= 2
            if left_end == len(text):
                break
        if left_end == len(text):
            break
    return total + len(left.ids) - done


#: Token counts of units, remembered while there are few.
_UNITS: dict[str, int] = {}
MOST_UNITS = 600_000


def units(text: str) -> list[str]:
    """``text`` cut at every blank that follows another character than white space: proven boundaries, see _boundaries."""
    if not text:
        return []
    first, *rest = text.split(" ")
    out, held = [first] if first else [], "" if first and not first[-1].isspace() else None
    blank = "" if first else None  # blanks seen since the last unit
    for piece in rest:
        blank = " " if blank is None else blank + " "
        if not piece:
            continue
        if held is None and out:
            out[-1] += blank + piece
        else:
            out.append(blank + piece)
        held = None if piece[-1].isspace() else ""
        blank = None
    if blank:
        if held is None and out:
            out[-1] += blank
        else:
            out.append(blank)
    return out


#: More proven boundaries inside a unit: punctuation after a letter (but for the pattern's apostrophe and the special strings' <, |), a line feed after what isn't white space.
_CUT = re.compile(r"(?<=[A-Za-zÀ-ÖØ-öø-ÿ])(?=[!-&(-/:;=-@\[-`{}~])|(?<=\S)(?=\n)")


def batch_counts(texts: list[str], path: str) -> list[int]:
    """Tokens of each text: of its units, most of which recur and are encoded once a process."""
    split = [units(t) for t in texts]
    if len(_UNITS) > MOST_UNITS:
        _UNITS.clear()
    cut = {u: _CUT.split(u) for u in {u for x in split for u in x if u not in _UNITS}}
    fresh = list({p for x in cut.values() for p in x if p not in _UNITS})
    for i in range(0, len(fresh), 1024):
        part = fresh[i : i + 1024]
        _UNITS.update(zip(part, map(len, tokenizer(path).encode_batch_fast(part, add_special_tokens=False)), strict=True))
    _UNITS.update((u, sum(map(_UNITS.__getitem__, x))) for u, x in cut.items())
    return [sum(map(_UNITS.__getitem__, x)) for x in split]


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row. Null and empty texts have 0 tokens; repeated rows are counted each.

    Special strings inside texts become special tokens, as the library does by default. Other columns are left out.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [x or "" for x in batch.column(1).to_pylist()]
        short = [i for i, t in enumerate(texts) if len(t) <= CHUNK + OVERLAP]
        n = [0] * len(texts)
        for i, found in zip(short, batch_counts([texts[i] for i in short], path), strict=True):
            n[i] = found
        for i in set(range(len(texts))) - set(short):
            n[i] = count_tokens(texts[i], path)
        sizes = [len(x.encode()) for x in texts]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        )

    id_type = docs.schema[id_col].dataType.simpleString()
    return by_batch(docs.select(id_col, text_col), run, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean")
