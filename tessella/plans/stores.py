"""Queries over what is stored: a cache of vectors, packages, a service log, trees of files, images, search output."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import grep, images, trees, vector
from ..operators.cache import ContentCache
from ..sources import packages
from ..storage import delete, parked, shared_dir
from ..streaming import requests
from .checks import PRIVATE
from .gates import REFS, _refs
from .registry import query, table
from .retrieval import CHUNKS, chunks


@query(
    "src09_incremental_cache",
    f"""WITH {CHUNKS}, a AS (SELECT DISTINCT sha256(text) AS h FROM ch), b AS (SELECT DISTINCT sha256(text || CASE WHEN doc_id % 10 = 3 THEN ' changed ' || doc_id ELSE '' END) AS h FROM ch)
    SELECT 1 AS run, (SELECT count(*) FROM ch) AS units, (SELECT count(*) FROM a) AS encoded UNION ALL SELECT 2, (SELECT count(*) FROM ch), (SELECT count(*) FROM b WHERE h NOT IN (SELECT h FROM a)) UNION ALL SELECT 3, (SELECT count(*) FROM ch), 0""",
)
def src09(spark, d):
    """Chunks encoded, then those of a corpus in which one page in ten changed, then the same again: what each run had to encode."""
    units = chunks(spark, d).select("chunk_ord", "doc_id", "text")
    changed = units.withColumn("text", F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit(" changed "), F.col("doc_id").cast("string"))).otherwise(F.col("text")))
    cache = ContentCache(spark, vector.HashedTokens(), f"{shared_dir(spark)}/tessella-cache-{uuid.uuid4().hex}")
    out = []
    for run, rows in enumerate((units, changed, changed), 1):
        n = cache.vectors(rows, "chunk_ord").count()
        out.append((run, n, cache.encoded))
    cache.clear()
    return spark.createDataFrame(out, "run int, units bigint, encoded bigint")


@query(
    "src12_package",
    """WITH e AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) SELECT 'corpus' AS part, lang || '::' || doc_id AS id, lang AS project, sha256(coalesce(text, '')) AS digest FROM documents
    UNION ALL SELECT 'questions', d.lang || '::' || d.doc_id, d.lang, sha256(coalesce(CAST(quality AS VARCHAR), '')) FROM documents d JOIN e ON e.doc_id = d.doc_id UNION ALL SELECT 'damaged', '', '', CAST(0 AS VARCHAR)""",
)
def src12p(spark, d):
    """Documents and their eligible questions combined into one package, written over an older one, verified against its manifest and read back."""
    folder = f"{shared_dir(spark)}/tessella-package-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").select(F.concat_ws("::", "lang", F.col("doc_id").cast("string")).alias("id"), F.col("lang").alias("project"), "doc_id", "text")
    eligible = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    asked = packages.combined(eligible.select("doc_id"), docs.join(eligible, "doc_id"), ["doc_id"]).select("id", "project", "quality")
    packages.write(spark, folder, {"corpus": (docs.limit(1), ["id"]), "questions": (asked.limit(1), ["id"])})  # the old package
    packages.write(spark, folder, {"corpus": (docs, ["id"]), "questions": (asked, ["id"])})
    now = packages.current(spark, folder)
    corpus = packages.read(spark, now, "corpus").select(F.lit("corpus").alias("part"), "id", "project", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    questions = packages.read(spark, now, "questions").select(F.lit("questions"), "id", "project", F.sha2(F.coalesce(F.col("quality").cast("string"), F.lit("")), 256))
    broken = packages.damaged(spark, now).agg(F.count("*").cast("string").alias("n")).select(F.lit("damaged"), F.lit(""), F.lit(""), "n")
    out = parked(corpus.union(questions).union(broken), "package")
    delete(spark, folder)
    return out


@query("trc07_service_log", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'search' WHEN 'assistant' THEN 'fetch' ELSE 'expand' END AS endpoint, substr(sha256(conv_id || chr(0) || turn || chr(0) || coalesce(text, '')), 1, 20) AS request_id, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars FROM conversations")
def trc07(spark, d):
    """Conversation turns appended to a service log as a stream, which is stopped by an error after its first write and started again."""
    folder = f"{shared_dir(spark)}/tessella-log-{uuid.uuid4().hex}"
    stopped = []

    def fail(number):
        if not stopped:
            stopped.append(number)
            raise InterruptedError("stopped after a write that nothing acknowledged")

    for _ in range(2):
        try:
            requests.appended(requests.turns(spark, f"{d}/conversations.parquet"), f"{folder}/log", f"{folder}/checkpoint", after=fail)
        except Exception as error:
            if "stopped after a write" not in str(error):
                raise
    out = parked(requests.logged(spark, f"{folder}/log"), "log")
    delete(spark, folder)
    return out


# --- trees of files: a page is a file in a folder of its language, in one of its host

TREE = r"""f AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || '/' || page_id % 4 || CASE WHEN page_id % 9 = 0 THEN '.tmp' ELSE '' END || '/' || page_id || '.md' AS path, coalesce(html, '') AS content FROM pages WHERE page_id % 9 <> 0),
s AS (SELECT CAST(unnest(range(0, 4)) AS BIGINT) AS k),
l3 AS (SELECT path, 'file' AS kind, 3 AS level, sha256(content) AS digest, 1 AS files, CAST(octet_length(encode(content)) AS BIGINT) AS bytes FROM f)"""
LEVEL = """{0} AS (SELECT path, 'folder' AS kind, {2} AS level, sha256(count(*) || ':' || CAST(sum(('0x' || substr(h, 1, 15))::BIGINT::HUGEINT) AS VARCHAR) || ':' || CAST(sum(('0x' || substr(h, 16, 15))::BIGINT::HUGEINT) AS VARCHAR) || ':' || CAST(sum(('0x' || substr(h, 31, 15))::BIGINT::HUGEINT) AS VARCHAR) || ':' || CAST(sum(('0x' || substr(h, 46, 15))::BIGINT::HUGEINT) AS VARCHAR)) AS digest, CAST(sum(files) AS BIGINT) AS files, CAST(sum(bytes) AS BIGINT) AS bytes
  FROM (SELECT regexp_replace(path, '/?[^/]*$', '') AS path, sha256(kind || chr(0) || regexp_extract(path, '([^/]*)$', 1) || chr(0) || digest) AS h, files, bytes FROM {1}) GROUP BY path)"""


def tree_files(spark, d):
    i = F.col("page_id")
    path = F.concat(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), F.lit("/"), (i % 4).cast("string"), F.when(i % 9 == 0, ".tmp").otherwise(""), F.lit("/"), i.cast("string"), F.lit(".md"))
    return table(spark, d, "pages").select(path.alias("path"), F.coalesce("html", F.lit("")).alias("content"))


@query("hlp16_tree_digests", f"WITH {TREE}, {LEVEL.format('l2', 'l3', 2)}, {LEVEL.format('l1', 'l2', 1)}, {LEVEL.format('l0', 'l1', 0)} SELECT * FROM l3 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l0")
def hlp16(spark, d):
    """Digests of every file and folder of a tree, temporary folders left out."""
    return trees.digests(tree_files(spark, d))


@query(
    "prv01_changed_paths",
    f"""WITH {TREE}, c AS (SELECT path FROM f WHERE length(content) % 50 = 7) SELECT path, 'file' AS kind, 'changed' AS change FROM c UNION ALL SELECT DISTINCT regexp_replace(path, '/[^/]*$', ''), 'folder', 'changed' FROM c
    UNION ALL SELECT DISTINCT split_part(path, '/', 1), 'folder', 'changed' FROM c UNION ALL SELECT DISTINCT '', 'folder', 'changed' FROM c""",
)
def prv01c(spark, d):
    """What differs between two trees: the changed files, and the folders above them."""
    files = tree_files(spark, d)
    later = files.withColumn("content", F.when(F.length("content") % 50 == 7, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return trees.changed(trees.digests(files), trees.digests(later))


@query(
    "src15_collisions",
    """WITH p AS (SELECT DISTINCT CASE doc_id % 8 WHEN 0 THEN upper(lang) ELSE lang END || '/' || source || CASE WHEN doc_id % 11 = 0 THEN '/../' || doc_id WHEN doc_id % 13 = 0 THEN '' ELSE '/' || doc_id % 40 || '.md' END AS path FROM documents)
    SELECT path, 'unsafe' AS problem FROM p WHERE contains(path, '/../') UNION ALL SELECT path, 'case' FROM p WHERE lower(path) IN (SELECT lower(path) FROM p GROUP BY lower(path) HAVING count(*) > 1)
    UNION ALL SELECT path, 'folder' FROM p WHERE EXISTS (SELECT 1 FROM p q WHERE starts_with(q.path, p.path || '/'))""",
)
def src15c(spark, d):
    """Paths that can't lie in one workspace."""
    i = F.col("doc_id")
    path = F.concat(F.when(i % 8 == 0, F.upper("lang")).otherwise(F.col("lang")), F.lit("/"), "source", F.when(i % 11 == 0, F.concat(F.lit("/../"), i.cast("string"))).when(i % 13 == 0, "").otherwise(F.concat(F.lit("/"), (i % 40).cast("string"), F.lit(".md"))))
    return trees.collisions(table(spark, d, "documents").select(path.alias("path")))


# --- images

@query(
    "img02_status",
    rf"""WITH {REFS}, f AS (SELECT role, owner, position, url, CASE WHEN role = 'document' AND owner % 2 = 0 THEN 'a linked page about ' || owner ELSE alt END AS alt, (owner + position) % 11 AS k, regexp_matches(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '{PRIVATE}') AS unsafe FROM refs),
    g AS (SELECT *, CASE WHEN unsafe THEN 'unsafe_image_url' ELSE (CASE k WHEN 3 THEN 'http_error' WHEN 4 THEN 'too_many_redirects' WHEN 5 THEN 'network_error' WHEN 6 THEN 'unsupported_or_non_image' WHEN 7 THEN 'animated_gif_unsupported' WHEN 8 THEN 'image_too_large' WHEN 9 THEN 'http_error' END) END AS error_code FROM f)
    SELECT 'img-' || substr(sha256(role || chr(0) || owner || chr(0) || position || chr(0) || url), 1, 24) AS image_id, CASE WHEN error_code IS NULL THEN 'resolved' WHEN fb THEN 'text_fallback' ELSE 'failed' END AS status, error_code, CASE WHEN fb THEN alt END AS fallback_text,
      CASE WHEN unsafe THEN 0 ELSE (CASE k WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 4 THEN 6 WHEN 9 THEN 2 WHEN 10 THEN 4 ELSE 1 END) END AS attempts, CASE WHEN unsafe THEN 0 ELSE (CASE k WHEN 1 THEN 1 WHEN 4 THEN 6 WHEN 10 THEN 2 ELSE 0 END) END AS redirects,
      CASE WHEN NOT unsafe THEN (CASE k WHEN 1 THEN url || '/r1' WHEN 4 THEN url || '/r6' WHEN 10 THEN url || '/r3' END) END AS location FROM (SELECT *, role = 'document' AND coalesce(error_code, '') = 'http_error' AND length(alt) >= 20 AS fb FROM g)""",
)
def img02(spark, d):
    """What became of each image, attempt by attempt: redirects, refreshed addresses, errors, fallbacks to descriptions."""
    from ..functions.text import stable_id

    alt = F.when((F.col("role") == "document") & (F.col("owner") % 2 == 0), F.concat(F.lit("a linked page about "), F.col("owner").cast("string"))).otherwise(F.col("alt"))
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#:]*)", 1))
    image = stable_id("img", F.col("role"), F.col("owner").cast("string"), F.col("position").cast("string"), F.col("url"))
    rows = _refs(spark, d).select("role", "url", image.alias("image_id"), alt.alias("alt"), host.rlike(PRIVATE).alias("unsafe"), ((F.col("owner") + F.col("position")) % 11).cast("int").alias("k"))
    a = lambda outcome, kind="image/png", size=100, animated=False: F.struct(F.lit(outcome).alias("outcome"), F.lit(kind).alias("type"), F.lit(size).alias("size"), F.lit(animated).alias("animated"))
    ok, moved, error = a("ok"), a("redirect"), a("http_error")
    scripts = [[ok], [moved, ok], [error, ok], [error], [moved] * 6, [a("network_error")], [a("ok", "text/html")], [a("ok", "image/gif", 10, True)], [a("ok", size=30 << 20)], [error, error], [moved, error, moved, ok, error]]
    script = F.element_at(F.array(*(F.array(*s) for s in scripts)), F.col("k") + 1)
    tried = rows.select("image_id", "url", F.col("k").isin(2, 9, 10).alias("refreshable"), F.posexplode(script).alias("attempt", "s"))
    tried = tried.select("image_id", "refreshable", "attempt", "s.outcome", F.concat("url", F.lit("/r"), (F.col("attempt") + 1).cast("string")).alias("location"), "s.type", "s.size", "s.animated")
    return images.resolved(rows.select("image_id", "role", "alt", "unsafe"), tried)


# --- search output

@query(
    "lex14_documents_at",
    """WITH p AS (SELECT DISTINCT doc_id, CASE doc_id % 5 WHEN 0 THEN '/srv/repo/' WHEN 1 THEN './' WHEN 2 THEN '/elsewhere/' ELSE '' END AS head, lang, source FROM documents),
    q AS (SELECT *, head || CASE WHEN lang IN ('en', 'fr') THEN lang || '/' || source || '/' ELSE lang || '/' END || 'page/' || doc_id || '.md' AS path FROM p)
    SELECT path, CASE WHEN head <> '/elsewhere/' THEN CASE lang WHEN 'en' THEN 'en/' || source WHEN 'fr' THEN 'fr' WHEN 'de' THEN 'de' END END AS root,
      CASE WHEN head <> '/elsewhere/' THEN CASE lang WHEN 'en' THEN 'page/' || doc_id || '.md' WHEN 'fr' THEN source || '/page/' || doc_id || '.md' WHEN 'de' THEN 'page/' || doc_id || '.md' END END AS rest,
      CASE WHEN head <> '/elsewhere/' AND lang IN ('en', 'de') THEN doc_id END AS doc_id FROM q""",
)
def lex14(spark, d):
    """Pages at the paths that a search names: roots of different depths, absolute paths, paths elsewhere."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    i = F.col("doc_id")
    head = F.element_at(F.array(*map(F.lit, ("/srv/repo/", "./", "/elsewhere/", "", ""))), (i % 5 + 1).cast("int"))
    folder = F.when(F.col("lang").isin("en", "fr"), F.concat_ws("/", "lang", "source")).otherwise(F.col("lang"))
    paths = docs.select(F.concat(head, folder, F.lit("/page/"), i.cast("string"), F.lit(".md")).alias("path"))
    roots = docs.where("lang = 'en'").select(F.concat_ws("/", "lang", "source").alias("root")).union(docs.where("lang IN ('en', 'fr', 'de')").select("lang"))
    pages = docs.select(F.concat(F.lit("page/"), i.cast("string"), F.lit(".md")).alias("source_path"), "doc_id")
    return grep.documents_at(paths, roots, pages, "/srv/repo")


@query(
    "lex15_search_output",
    """WITH l AS (SELECT doc_id, generate_subscripts(b, 1) - 1 AS n, unnest(b) AS body FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS b FROM documents)), m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS place FROM l WHERE n % 4 <> 3)
    SELECT doc_id, CAST(place AS INT) AS place, 'pages/' || doc_id || '.md' AS path, CAST(n + 1 AS BIGINT) AS line_number, regexp_replace(body, '[\\r\\n]+$', '') AS line FROM m WHERE place <= 20""",
)
def lex15(spark, d):
    """A search tool's output, JSON a line, for every document: the first twenty matches; broken lines and other events between them."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("n", "body"))
    data = F.struct(F.struct(F.concat(F.lit("pages/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("text")).alias("path"), F.struct(F.concat("body", F.lit("\r\n")).alias("text")).alias("lines"), (F.col("n") + 1).alias("line_number"))
    event = F.to_json(F.struct(F.lit("match").alias("type"), data.alias("data")))
    broken = F.when(F.col("n") % 8 == 3, F.lit('{"type":"match","data":')).otherwise(F.lit('{"type":"begin","data":{"path":{"text":"x"}}}'))
    return grep.parsed(lines.select("doc_id", "n", F.when(F.col("n") % 4 == 3, broken).otherwise(event).alias("line")), "doc_id", 20)
