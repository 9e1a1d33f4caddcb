"""Which texts hold which passages, without comparing every text with every passage (JON08)."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .lexical import few

#: Passages that are broadcast at most.
BROADCAST_PASSAGES = 100_000
#: Characters of passages that one automaton looks for in all texts; texts that are searched at once.
WHOLE, SEARCHED = 2_000_000, 256


def _words(x: Column) -> Column:
    """The words of ``x``: runs of what is no ASCII blank, sign or digit."""
    return F.filter(F.split(x, r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != "")


def holding(docs: DataFrame, passages: DataFrame, whole: int = WHOLE) -> DataFrame:
    """(qid, doc_id): the documents (doc_id, text) whose text holds the passage of (qid, passage), exactly.

    Passages of up to ``whole`` characters together are one automaton, which passes over every text where it lies. Of more, a passage's key is its longest inner word, one that other signs enclose: a text that holds the passage has that very
    word. Texts are joined by their distinct words with the keys, and only those that meet are searched. Passages without
    an inner word, a few signs long, are looked for in all texts as one automaton. Empty passages stand in every text and are left out.
    """
    size = passages.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("passage")), F.lit(0)).alias("chars")).first()
    if size.n <= BROADCAST_PASSAGES and size.chars <= whole:
        return _short(docs, passages.select("qid", "passage").where("passage <> ''"))
    inner = F.filter(F.transform(F.split("passage", r"[\x00-\x40\x5B-\x60\x7B-\x7F]", -1), lambda w, i: F.struct(F.length(w).alias("n"), w.alias("w"), i.alias("i"))), lambda s: s["w"] != "")
    last = F.size(F.split("passage", r"[\x00-\x40\x5B-\x60\x7B-\x7F]", -1)) - 1
    inside = F.filter(inner, lambda s: (s["i"] > 0) & (s["i"] < last))
    keyed = passages.where("passage <> ''").withColumn("key", F.array_max(inside)["w"])
    with_key, without = keyed.where("key is not null"), keyed.where("key is null")
    words = docs.select("doc_id", F.explode(F.array_distinct(_words(F.col("text")))).alias("key"))
    pairs = words.join(few(with_key.select("qid", "key"), BROADCAST_PASSAGES), "key").select("doc_id", "qid")
    checked = docs.join(pairs, "doc_id").join(few(passages, BROADCAST_PASSAGES), "qid").where(F.contains("text", F.col("passage"))).select("qid", "doc_id")
    short = without.select("qid", "passage")
    return checked.union(_short(docs, short))


def _short(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """The same by one automaton of all passages, BROADCAST_PASSAGES a pass, over each text once."""
    n = max(1, -(-passages.count() // BROADCAST_PASSAGES))
    found = None
    kinds = [to_arrow_type(f.dataType) for f in (passages.schema["qid"], docs.schema["doc_id"])]
    schema = StructType([passages.schema["qid"], docs.schema["doc_id"]])
    for k in range(n):
        rows = passages.where(F.pmod(F.xxhash64("qid", "passage"), F.lit(n)) == k).collect()  # about BROADCAST_PASSAGES
        asked: dict[str, list] = {}
        for r in rows:
            asked.setdefault(r.passage, []).append(r.qid)

        def run(batches, asked=asked):
            automaton = ahocorasick.Automaton()
            for p in asked:
                automaton.add_word(p, p)
            automaton.make_automaton()
            for batch in (part.slice(at, SEARCHED) for part in batches for at in range(0, part.num_rows, SEARCHED)):
                qids, ids = [], []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for p in {p for _, p in automaton.iter(text or "")} if asked else ():
                        qids += asked[p]
                        ids += [doc_id] * len(asked[p])
                yield pa.RecordBatch.from_arrays([pa.array(qids, kinds[0]), pa.array(ids, kinds[1])], ["qid", "doc_id"])

        one = docs.select("doc_id", "text").mapInArrow(run, schema)
        found = one if found is None else found.union(one)
    return found
