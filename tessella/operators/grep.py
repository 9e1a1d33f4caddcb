"""Literal search over lines, for all questions at once (LEX13-LEX15).

All terms are one Aho-Corasick automaton, BLOCK of them a pass, so a line is read once however many terms there are, and no
terms meet no lines.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distinct terms of a pass; a term is a stated word of a question.
BLOCK = 100_000
#: Places that a term's lines are thinned in.
SALTS = 16

HITS = "doc_id long, line int, term string"


def matches(docs: DataFrame, terms: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, line, term): the lines of ``docs`` (doc_id, text) that hold a term, whatever the case; each once."""
    distinct = terms.select(F.lower("term").alias("term")).where("term <> ''").distinct()
    n = max(1, -(-distinct.count() // block))
    lines = docs.select("doc_id", F.lower("text").alias("text"))
    found = None
    for k in range(n):
        words = [r.term for r in distinct.where(F.pmod(F.xxhash64("term"), F.lit(n)) == k).orderBy("term").collect()]  # about BLOCK

        def run(batches, words=words):
            automaton = ahocorasick.Automaton()
            for w in words:
                automaton.add_word(w, w)
            automaton.make_automaton()
            for batch in batches:
                ids, ats, hits = [], [], []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for at, line in enumerate((text or "").split("\n") if words else ()):
                        for w in {w for _, w in automaton.iter(line)}:
                            ids.append(doc_id)
                            ats.append(at)
                            hits.append(w)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ats, pa.int32()), pa.array(hits, pa.string())], ["doc_id", "line", "term"])

        one = lines.mapInArrow(run, HITS)
        found = one if found is None else found.union(one)
    return found


def search(docs: DataFrame, wanted: DataFrame, per_term: int = 250, block: int = BLOCK) -> DataFrame:
    """(qid, doc_id, score): literal matches of the questions' terms (qid, term), line by line (LEX13).

    A document scores 1 / (60 + its place among a term's documents) once a term, and 0.003 times the share of the
    question's terms on each matching line. Lines count in the order (doc_id, line), ``per_term`` of them at most.
    """
    terms = wanted.withColumn("term", F.lower("term")).withColumn("n_terms", F.count("*").over(Window.partitionBy("qid")))
    # a line past its term's first ``per_term`` counts for no question; a common term's lines are thinned in SALTS places first
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("doc_id", "line"))
    thinned = matches(docs, wanted, block).withColumn("deal", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).withColumn("at", first("term", "deal")).where(F.col("at") <= per_term)
    taken = thinned.withColumn("at", first("term")).where(F.col("at") <= per_term)
    hits = taken.join(terms, "term")
    firsts = hits.groupBy("qid", "term", "doc_id").agg(F.min("at").alias("at"))
    files = firsts.withColumn("place", F.row_number().over(Window.partitionBy("qid", "term").orderBy("at")))
    by_file = files.groupBy("qid", "doc_id").agg(F.sum(1.0 / (F.lit(60.0) + F.col("place"))).alias("s"))
    cover = hits.groupBy("qid", "doc_id", "line", "n_terms").agg(F.count("*").alias("k"))
    by_line = cover.groupBy("qid", "doc_id").agg(F.sum(F.lit(0.003) * F.col("k") * F.col("k") / F.col("n_terms")).alias("l"))
    return by_file.join(by_line, ["qid", "doc_id"]).select("qid", "doc_id", F.round(F.col("s") + F.col("l"), 9).alias("score"))


def _prefixes(path: Column) -> Column:
    """The folders of a path, "" for the top, with what follows."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("root"), F.array_join(F.slice(parts, i + 1, F.size(parts)), "/").alias("rest"), i.alias("depth")))


def documents_at(paths: DataFrame, roots: DataFrame, pages: DataFrame, root: str = "") -> DataFrame:
    """(path, root, rest, doc_id) of every path: the deepest content root above it and the page that lies there (LEX14).

    ``roots`` (root) are looked up by an equality for each folder of a path; ``pages`` (source_path, doc_id). Absolute paths
    count below ``root``; what lies elsewhere, or is no page, has no doc_id.
    """
    clean = F.regexp_replace(F.when(F.col("path").startswith("/"), F.when(F.col("path").startswith(f"{root}/"), F.substring(F.col("path"), len(root) + 2, 1 << 30))).otherwise(F.col("path")), r"^(\./)+", "")
    each = paths.select("path").distinct().withColumn("clean", clean).select("path", F.explode_outer(_prefixes(F.col("clean"))).alias("p")).select("path", "p.root", "p.rest", "p.depth")
    known = each.join(roots.select("root").distinct(), "root")
    best = known.groupBy("path").agg(F.max_by(F.struct("root", "rest"), "depth").alias("b")).select("path", "b.root", "b.rest")
    found = best.join(pages.select(F.col("source_path").alias("rest"), "doc_id"), "rest", "left")
    return paths.select("path").distinct().join(found, "path", "left").select("path", "root", "rest", "doc_id")


MATCH = "struct<type string, data struct<path struct<text string>, lines struct<text string>, line_number bigint>>"


def parsed(output: DataFrame, by: str, limit: int) -> DataFrame:
    """(by, place, path, line_number, line): the first ``limit`` matches of each search's output (by, n, line), JSON a line (LEX15). Broken lines and other events are passed over."""
    event = F.from_json("line", MATCH)
    rows = output.select(by, "n", event.alias("e")).where("e.type = 'match' AND e.data.path.text IS NOT NULL AND e.data.lines.text IS NOT NULL")
    place = F.row_number().over(Window.partitionBy(by).orderBy("n"))
    out = rows.withColumn("place", place).where(F.col("place") <= limit)
    return out.select(by, "place", F.col("e.data.path.text").alias("path"), F.coalesce("e.data.line_number", F.lit(0)).alias("line_number"), F.regexp_replace("e.data.lines.text", r"[\r\n]+\z", "").alias("line"))
