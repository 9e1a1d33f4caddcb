"""Sources and sinks, round trips through the shared folder over whole tables (SRC01-SRC16)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import jsonl
from ..storage import delete, parked, shared_dir
from .registry import query, table
from .retrieval import CHUNKS, chunks


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/tessella-{name}-{uuid.uuid4().hex}"


@query("src01_jsonl_scan", "SELECT doc_id, lang, source, sha256(text) AS digest FROM documents")
def src01(spark, d):
    """All documents as compressed JSON Lines, read again under their schema."""
    docs, path = table(spark, d, "documents"), _folder(spark, "jsonl")
    jsonl.write(docs, path, "gzip")
    return jsonl.read(spark, path, docs.schema).select("doc_id", "lang", "source", F.sha2("text", 256).alias("digest"))


@query("src02_jsonl_sink", "SELECT doc_id, CAST(length(replace(replace(replace(text, chr(133), 'xxxxxx'), chr(8232), 'xxxxxx'), chr(8233), 'xxxxxx')) AS BIGINT) AS n FROM documents")
def src02(spark, d):
    """Lines of the sink: one an object, whatever line separators a text holds. Their text fields are as long as the texts, escapes counted."""
    docs, path = table(spark, d, "documents"), _folder(spark, "lines")
    jsonl.write(docs.select("doc_id", "text"), path)
    lines = spark.read.text(path)
    seen = F.replace(F.replace(F.replace(F.col("text"), F.lit("\u0085"), F.lit("xxxxxx")), F.lit("\u2028"), F.lit("xxxxxx")), F.lit("\u2029"), F.lit("xxxxxx"))
    rows = lines.where(~F.col("value").rlike("[\u0085\u2028\u2029]")).select(F.from_json("value", "doc_id bigint, text string").alias("r")).select("r.*")
    return rows.select("doc_id", F.length(seen).cast("bigint").alias("n"))


@query(
    "src07_gzip_identity",
    """WITH f AS (SELECT count(*) AS n_lines, sha256(count(*) || ':' || coalesce(sum(('0x' || substr(sha256(doc_id || chr(0) || coalesce(lang, '') || chr(0) || coalesce(source, '') || chr(0) || coalesce(text, '') || chr(0) || coalesce(CAST(n_chars AS VARCHAR), '')), 1, 15))::BIGINT), 0)) AS fingerprint FROM documents)
    SELECT side, n_lines, fingerprint, CAST(0 AS BIGINT) AS differing FROM f, (VALUES ('one'), ('two')) AS v(side)""",
)
def src07(spark, d):
    """Two compressed exports, dealt over files differently: what each holds when it is read again, and how many lines differ by their digests."""
    from .checks import fingerprint

    docs, one, two = table(spark, d, "documents"), _folder(spark, "gz"), _folder(spark, "gz")
    jsonl.write(docs, one, "gzip")
    jsonl.write(docs.repartition(3), two, "gzip")
    digests = lambda p: spark.read.option("lineSep", "\n").text(p).groupBy(F.sha2("value", 256).alias("h")).count()
    both = digests(one).withColumnRenamed("count", "x").join(digests(two).withColumnRenamed("count", "y"), "h", "full")
    differing = both.agg(F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("differing"))
    read = lambda side, p: fingerprint(jsonl.read(spark, p, docs.schema), "doc_id", "lang", "source", "text", "n_chars").select(F.lit(side).alias("side"), F.col("n").alias("n_lines"), "fingerprint")
    out = parked(read("one", one).union(read("two", two)).crossJoin(differing), "identity")  # one row each
    delete(spark, one)
    delete(spark, two)
    return out


@query("src08_session_log", "SELECT role AS type, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars, max(ord) AS longest FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS ord FROM conversations) WHERE turn % 7 <> 3 OR role <> 'user' GROUP BY role")
def src08(spark, d):
    """Conversations as compressed session logs, some lines of them cut off, read with tolerance."""
    rows, path = table(spark, d, "conversations"), _folder(spark, "log")
    event = jsonl.line("type", "data")
    rows = rows.withColumn("size", F.count("*").over(_window("conv_id"))).select("turn", "role", F.col("role").alias("type"), F.to_json(F.struct("text", "size")).alias("data"))
    broken = (F.col("turn") % 7 == 3) & (F.col("role") == "user")
    rows.select(F.when(broken, F.concat(F.lit("  "), F.substring(event, 1, 20))).otherwise(event).alias("value")).write.option("compression", "gzip").text(path)
    log = jsonl.session_log(spark, path).select("type", F.from_json("data", "text string, size bigint").alias("r"))
    return log.groupBy("type").agg(F.count("*").alias("n"), F.sum(F.length("r.text")).cast("bigint").alias("n_chars"), F.max("r.size").alias("longest"))


def _window(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key)


@query("src16_unit_export", f"WITH {CHUNKS} SELECT chunk_id, doc_id, sha256(text) AS digest FROM ch")
def src16(spark, d):
    """The retrieval units that a graph store takes, exported and read again."""
    path = _folder(spark, "units")
    jsonl.write(chunks(spark, d).select("chunk_id", "doc_id", "route", "text"), path, "gzip")
    return jsonl.read(spark, path, "chunk_id string, doc_id bigint, text string").select("chunk_id", "doc_id", F.sha2("text", 256).alias("digest"))


@query(
    "src13_inventory",
    r"""WITH p AS (SELECT CASE doc_id % 6 WHEN 0 THEN lang || '/' || source || '.md' WHEN 1 THEN lang || '/img/' || source || '.PNG' WHEN 2 THEN lang || '/sidebar.json' WHEN 3 THEN lang || '/' || source || '.yml' WHEN 4 THEN source || '.py' ELSE 'LICENSE' END AS path FROM documents)
    SELECT role, count(*) AS n, count(DISTINCT path) AS paths FROM (SELECT path, CASE WHEN lower(path) LIKE '%sidebar.json' THEN 'navigation' WHEN lower(path) LIKE '%.md' THEN 'documentation' WHEN lower(path) LIKE '%.png' THEN 'asset' WHEN lower(path) LIKE '%.yml' THEN 'data' WHEN lower(path) LIKE '%.py' THEN 'code' ELSE 'support' END AS role FROM p) GROUP BY role""",
)
def src13(spark, d):
    """Files by their role; paths are computed from documents, and tests take the inventory of a real tree."""
    c = lambda *x: F.concat(*(F.lit(v) if v.startswith(("/", ".", "i")) or v == "LICENSE" else F.col(v) for v in x))
    shapes = [c("lang", "/", "source", ".md"), c("lang", "/", "img/", "source", ".PNG"), c("lang", "/sidebar.json"), c("lang", "/", "source", ".yml"), c("source", ".py"), F.lit("LICENSE")]
    paths = table(spark, d, "documents").select(F.element_at(F.array(*shapes), (F.col("doc_id") % 6 + 1).cast("int")).alias("path"))
    return paths.groupBy(jsonl.role(F.col("path")).alias("role")).agg(F.count("*").alias("n"), F.countDistinct("path").alias("paths"))
