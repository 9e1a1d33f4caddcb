"""Further text, retrieval and trace queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls
from ..operators import fusion, stats
from .registry import query, table
from .shapes import same
from .texts import made, made_sql, scalar

scalar(
    "txt03_url_slug", ["Some%20Heading <b>x</b>", "A {b} C", "--x--"],
    lambda x: F.regexp_replace(F.regexp_replace(T.fold(F.regexp_replace(urls.unquoted(x), r"<[^>]+>|\{[^}]*\}", " ")), r"[^\w]+", "-"), r"^-+|-+$", ""),
    r"regexp_replace(regexp_replace(replace(lower(regexp_replace(url_decode(x), '<[^>]+>|\{[^}]*\}', ' ', 'g')), 'ß', 'ss'), '[^\w]+', '-', 'g'), '^-+|-+$', '', 'g')",
    ["Some%20Heading <b>§lang§</b>", "A {§source§} §id§", "--§lang§--", "§text§"], digest=True,
)
scalar("txt11_frontmatter", ["---\ntitle: T\nversions: v1\n---\nbody", "no front", "---\nbroken"], lambda x: F.concat_ws("|", F.regexp_extract(x, r"(?s)^---\n.*?(?:^|\n)title: *([^\n]*)", 1), F.regexp_replace(x, r"(?s)^---\n.*?\n---\n", "")), r"concat_ws('|', regexp_extract(x, '(?s)^---\n.*?(?:^|\n)title: *([^\n]*)', 1), regexp_replace(x, '(?s)^---\n.*?\n---\n', ''))", ["---\ntitle: §lang§ T\nversions: v§id§\n---\n§text§", "§text§", "---\nbroken §id§"], digest=True)
scalar("txt13_redirects", ["redirect_from:\n  - /a/b\n  - /c\nother: x", "none"], lambda x: F.array_join(F.regexp_extract_all(x, F.lit(r"\n  - (/[^\n]+)"), F.lit(1)), ","), r"array_to_string(regexp_extract_all(x, '\n  - (/[^\n]+)', 1), ',')", ["redirect_from:\n  - /a/§lang§\n  - /c/§id§\nother: x\n§text§", "§text§"])
scalar("txt35_prose_links", ["see [label](http://x) and http://y.z ok", "`[code](u)`"], lambda x: F.regexp_replace(F.regexp_replace(x, r"\[([^\]]+)\]\([^)]*\)", "$1"), r"(^|\s)(https?://\S+)", "$1`$2`"), r"regexp_replace(regexp_replace(x, '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '(^|\s)(https?://\S+)', '\1`\2`', 'g')", ["see [label §lang§](http://x/§id§) and http://y.z ok\n§text§", "`[code](u)` §id§"], digest=True)
scalar("txt45_enriched_query", ["how to log in", "see screenshot of login error"], lambda x: F.when(F.contains(F.lower(x), F.lit("login error")), x).otherwise(F.concat(x, F.lit("\nlogin error"))), "CASE WHEN contains(lower(x), 'login error') THEN x ELSE x || chr(10) || 'login error' END", ["how to log in §lang§", "see screenshot of login error §id§", "§text§"], digest=True)
scalar("hlp20_tool_paths", ["./docs//a.md", "/root/docs/b.md:12", "c.md"], lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^\./", ""), "/+", "/"), r":\d+$", ""), r"regexp_replace(regexp_replace(regexp_replace(x, '^\./', ''), '/+', '/', 'g'), ':\d+$', '')", ["./docs//§lang§/§id§.md", "/root/docs/§source§.md:12", "§id§.md"])
scalar("txt34_search_terms", ["find \"exact phrase\" in `my_func` please", "plain longer words"], lambda x: F.array_join(F.slice(F.concat(F.regexp_extract_all(x, F.lit(r"[\"`]([^\"`]+)[\"`]"), F.lit(1)), F.regexp_extract_all(F.regexp_replace(x, r"[\"`][^\"`]+[\"`]", ""), F.lit(r"[a-z_]{5,}"), F.lit(0))), 1, 3), "|"), r"""array_to_string(list_slice(list_concat(regexp_extract_all(x, '["`]([^"`]+)["`]', 1), regexp_extract_all(regexp_replace(x, '["`][^"`]+["`]', '', 'g'), '[a-z_]{5,}')), 1, 3), '|')""", ["find \"exact §lang§\" in `my_func` please", "§text§"])

LINKS = ["a [one §id§](x/§lang§.md#s) b [two](/y)\n§text§", "![img §source§](p§id§.png) [three](z)\n§text§ ![](q.gif)", "§text§"]


@query("txt23_markdown_links", rf"SELECT id, anchor, target FROM (SELECT id, unnest(regexp_extract_all(x, '\[([^\]]+)\]\(([^)\s]+)\)', 1)) AS anchor, unnest(regexp_extract_all(x, '\[([^\]]+)\]\(([^)\s]+)\)', 2)) AS target FROM (SELECT doc_id AS id, {made_sql('documents', LINKS)} AS x FROM documents))")
def txt23(spark, d):
    p = r"\[([^\]]+)\]\(([^)\s]+)\)"
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), made("documents", LINKS).alias("x"))
    both = F.arrays_zip(F.regexp_extract_all("x", F.lit(p), F.lit(1)).alias("anchor"), F.regexp_extract_all("x", F.lit(p), F.lit(2)).alias("target"))
    return rows.select("id", F.explode(both).alias("l")).select("id", "l.anchor", "l.target")


@query("txt26_images", rf"SELECT id, unnest(regexp_extract_all(x, '!\[[^\]]*\]\(([^)\s]+)\)', 1)) AS url FROM (SELECT doc_id AS id, {made_sql('documents', LINKS)} AS x FROM documents)")
def txt26(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), made("documents", LINKS).alias("x"))
    return rows.select("id", F.explode(F.regexp_extract_all("x", F.lit(r"!\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1))).alias("url"))


@query("txt29_json_ld", "SELECT page_id, 'T ' || page_id AS question, '<div>See <a href=\"https://o.example/' || page_id || '\">that</a><br><IMG SRC=//cdn.example/' || page_id || '.gif></div>' AS answer FROM pages WHERE page_id % 4 <> 3")
def txt29(spark, d):
    """The question and answer of each page with structured data, however deep they stand, as HTML."""
    from ..operators import qa
    from .docs import question_files

    return qa.questions(question_files(spark, d), "page_id", "html", "url").select("page_id", F.col("name").alias("question"), "answer")


@query("txt33_shingles", r"SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(len(list_distinct(list_transform(range(1, greatest(1, len(w) - 1)), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]))) AS BIGINT) AS n_shingles FROM (SELECT doc_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{M}\p{N}_]+') AS w FROM documents)")
def txt33(spark, d):
    rows = table(spark, d, "documents").select("doc_id", stats.lexical_tokens(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").cast("bigint").alias("n_tokens"), F.size(stats.lexical_shingles(F.col("w"))).cast("bigint").alias("n_shingles"))


@query("fus01_rrf", "WITH a AS (SELECT o_custkey AS qid, o_orderkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders), b AS (SELECT o_custkey AS qid, o_orderkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank FROM orders) SELECT qid, doc_id, round(sum(1::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY qid, doc_id")
def fus01(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("doc_id"), "o_totalprice", "o_orderdate")
    one = o.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("o_totalprice"), "doc_id")))
    two = o.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("o_orderdate", "doc_id")))
    return fusion.rrf(one, two).select("qid", "doc_id", F.round("score", 9).alias("score"))


same("hlp06_last_wins", "SELECT p_brand AS evidence_id, min(p_partkey) AS first_position, max(p_partkey) AS last_row FROM part GROUP BY p_brand", "part")
