"""Licence scans: an exact set-similarity join of text blocks with licence texts.

A template goes with blocks of its own size. Tokens of all templates are ordered by their frequency in the corpus; a block
that holds the share ``threshold`` of a template's tokens holds one of the template's first ones in that order (prefix),
has tokens enough (length), and enough of them after the shared one (position). Only such blocks are compared in full.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, by_batch, utf8, word_hashes
from .decontam import Probe
from .licence_texts import TEMPLATES

# Phrases and the label of each.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Words from one block to the next are a power of two from STEP on; a block is two of them, so a passage as long as its
#: template, that is as many words or fewer, lies wholly in some block.
STEP = 32
THRESHOLD = 0.85


class Templates:
    """Token sets of the templates; ``order`` sorts them by the frequency of tokens in all documents, rare ones first."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        words = [word_hashes(ascii_words(text.encode())) for _, text in templates]
        self.sets = [(label, np.unique(w)) for (label, _), w in zip(templates, words, strict=True)]
        self.step = [max(STEP, 1 << (len(w) - 1).bit_length()) for w in words]
        self.need = [int(np.ceil(threshold * len(s) - 1e-9)) for _, s in self.sets]
        self.vocabulary = np.unique(np.concatenate([s for _, s in self.sets]))

    def order(self, counts: np.ndarray) -> None:
        rank = np.empty(len(counts), np.int64)
        rank[np.lexsort((self.vocabulary, counts))] = np.arange(len(counts))
        self.rank = rank  # of each token of the vocabulary
        self.ranked = [np.sort(rank[np.searchsorted(self.vocabulary, s)]) for _, s in self.sets]
        #: by block size: the templates and places of each prefix token, and marks of these tokens
        self.prefix: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for t, s in enumerate(self.ranked):
            mine = self.prefix.setdefault(self.step[t], {})
            for i in range(len(s) - self.need[t] + 1):
                mine.setdefault(int(s[i]), []).append((t, i))
        self.marked = {step: np.isin(np.arange(len(counts)), list(mine)) for step, mine in self.prefix.items()}

    def matches(self, block: np.ndarray, step: int) -> list[tuple[int, float]]:
        """(template, containment) of those that meet the threshold; ``block`` has the sorted ranks of its distinct tokens."""
        seen, out, prefix = set(), [], self.prefix[step]
        for j in np.flatnonzero(self.marked[step][block]).tolist():
            for t, i in prefix[int(block[j])]:
                if t in seen:
                    continue
                seen.add(t)  # the first shared prefix token: no token before i and j is shared
                s, need = self.ranked[t], self.need[t]
                if len(block) < need or 1 + min(len(s) - i - 1, len(block) - j - 1) < need:
                    continue
                shared = len(np.intersect1d(s, block, assume_unique=True))
                if shared >= need:
                    out.append((t, shared / len(s)))
        return out

    def blocks(self, places: np.ndarray, ranks: np.ndarray, n: int) -> Iterator[tuple[int, int, int, float]]:
        """(template, start, end, containment) of all blocks of a text of ``n`` words; its vocabulary words have ``ranks`` and stand at ``places``."""
        for step, marked in self.marked.items():
            least = min(self.need[t] for t, s in enumerate(self.step) if s == step)
            at = np.unique(places[marked[ranks]] // step)
            for k in np.unique(np.concatenate([at - 1, at])).tolist():
                start, end = k * step, min(n, (k + 2) * step)
                if start < 0 or start and start + step >= n:
                    continue  # the block before holds all of it
                low, high = np.searchsorted(places, [start, end])
                if high - low >= least:
                    yield from ((t, start, end, share) for t, share in self.matches(np.unique(ranks[low:high]), step))


def _frequencies(docs: DataFrame, templates: Templates) -> np.ndarray:
    """How many pieces of STEP words of all documents hold each token of the vocabulary."""
    vocabulary, probe = templates.vocabulary, Probe(templates.vocabulary)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        total: Counter = Counter()
        for text in utf8(batch.column(0)):
            h = word_hashes(ascii_words(text))
            hit = probe(h)
            at = np.searchsorted(vocabulary, h[hit])
            total.update((np.unique((hit // STEP) * len(vocabulary) + at) % len(vocabulary)).tolist())
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], ["at", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    for r in by_batch(docs.select("text"), run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r.at] = r.n
    return out


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks ("label:start:end").

    score is 1 where a phrase stands, else the largest containment of a template in a block, else 0. Null and empty
    texts have no words and no labels; repeated rows give a row each, an empty table none; other columns are left out.
    """
    found = Templates(templates, threshold)
    found.order(_frequencies(docs, found))
    probe = Probe(found.vocabulary)
    spelled = [(word_hashes(ascii_words(p.encode())), ascii_words(p.encode()), label) for p, label in phrases.items()]

    def one(text: bytes) -> tuple:
        words = ascii_words(text)
        h = word_hashes(words)
        starts, base, labels, blocks, score = [], set(), set(), [], 0.0
        for ph, pw, label in spelled:
            n = len(h) - len(ph) + 1
            if n <= 0:
                continue
            at = np.flatnonzero(h[:n] == ph[0])
            for i in range(1, len(ph)):
                at = at[h[at + i] == ph[i]] if len(at) else at
            at = [int(p) for p in at if words[p : p + len(pw)] == pw]
            if at:
                starts += at
                base.add(label)
                blocks += [f"{label}:{p}:{p + len(pw)}" for p in at]
        hit = probe(h)
        if len(hit):
            ranks = found.rank[np.searchsorted(found.vocabulary, h[hit])]
            for t, a, b, share in found.blocks(hit, ranks, len(words)):
                labels.add(found.sets[t][0])
                blocks.append(f"{found.sets[t][0]}:{a}:{b}")
                score = max(score, share)
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if base else score, ",".join(dict.fromkeys(blocks))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [one(t) for t in utf8(batch.column(1))]
        types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.string()]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], ["doc_id", *names])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return by_batch(
        docs.select("doc_id", "text"),
        run,
        f"doc_id {id_type}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, blocks string",
    )
