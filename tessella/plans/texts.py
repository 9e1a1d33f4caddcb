"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from .registry import query, sql_query, table


#: Columns of the tables that texts are made of: a text of a document or a page, as Spark and as the SQL says it.
FIELDS = {
    "documents": {"id": "CAST(doc_id AS STRING)", "lang": "lang", "source": "source", "text": "coalesce(text, '')"},
    "pages": {"id": "CAST(page_id AS STRING)", "url": "url", "path": "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)", "html": "coalesce(html, '')"},
}
#: Text functions and the short texts that tests hold them on: name, texts, the function, its SQL.
SCALARS: list[tuple] = []


def made(source: str, templates: list[str]):
    """A text for every row of a table, one template after the other. Fields stand between paragraph signs."""
    key = {"documents": "doc_id", "pages": "page_id"}[source]
    columns = [F.concat(*(F.expr(FIELDS[source][p]) if n % 2 else F.lit(p) for n, p in enumerate(t.split("§")))) for t in templates]
    return F.element_at(F.array(*columns), (F.col(key) % len(templates) + 1).cast("int"))


def scalar(name: str, texts: list[str], column, duck_expr: str, templates: list[str], source: str = "documents", digest: bool = False) -> None:
    """A query of one text function over a text made of every row of a table; whole results, or their digests."""
    key = {"documents": "doc_id", "pages": "page_id"}[source]
    SCALARS.append((name, texts, column, duck_expr))

    @query(name, f"SELECT id, {f'sha256({duck_expr})' if digest else duck_expr} AS y FROM (SELECT {key} AS id, {made_sql(source, templates)} AS x FROM {source})")
    def run(spark, d):
        y = column(F.col("x"))
        return table(spark, d, source).select(F.col(key).alias("id"), made(source, templates).alias("x")).select("id", (F.sha2(y, 256) if digest else y).alias("y"))


def made_sql(source: str, templates: list[str]) -> str:
    """The same as SQL."""
    key, cases = {"documents": "doc_id", "pages": "page_id"}[source], []
    for k, template in enumerate(templates):
        sql = [FIELDS[source][p].replace("STRING", "VARCHAR") if n % 2 else "E'" + p.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t") + "'" for n, p in enumerate(template.split("§"))]
        cases.append(f"WHEN {k} THEN {' || '.join(sql)}")
    return f"CASE {key} % {len(templates)} {' '.join(cases)} END"


#: A word by ASCII letters, digits and underscores, as in the SQL.
WORD = r"(?<![A-Za-z0-9_])%s(?![A-Za-z0-9_])"

URLS = ["https://Docs.Example.com:8443//a//B/?q=1#frag", "http://www.example.org", "HTTP://EX.ORG/en/guide/Page.md", "https://example.net/x%20y/z?p=%41", "not a url"]
HEADINGS = ["Getting *Started* with `code`", "{% data x %} The <b>Big</b> API_reference", "  Already-hyphenated -- twice  ", "What's new?", "1. Install & run", ""]
PATHS = ["/en/latest/Guide/Index", "guide//Setup/", "/docs/v2.1/api#auth", "/fr/API/", "/enterprise-server@3.9/admin"]

scalar(
    "txt02_heading_slug", HEADINGS, T.heading_slug,
    r"regexp_replace(regexp_replace(trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(x, '\{%.*?%\}', '', 'g'), '<[^>]+>', '', 'g'), '[`*_~]', '', 'g')), '[^\w\s-]', '', 'g')), '[\s-]+', '-', 'g'), '^-+|-+$', '', 'g')",
    ["Getting *§lang§* with `code` §id§", "{% data §source§ %} The <b>Big</b> API_§id§", "  Already-§source§ -- twice  ", "What's new in §lang§?", "§text§"], digest=True,
)
scalar(
    "txt05_path", PATHS,
    lambda x: T.fold(F.regexp_replace(F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(x, "[#?].*$", ""), "^/+|/+$", "")), "/+", "/")),
    r"replace(lower(regexp_replace('/' || regexp_replace(regexp_replace(x, '[#?].*$', ''), '^/+|/+$', '', 'g'), '/+', '/', 'g')), 'ß', 'ss')",
    ["/en/latest§path§", "guide/§path§/", "§path§#auth", "§url§"], source="pages",
)
scalar(
    "txt06_route", PATHS,
    lambda x: F.regexp_replace(F.regexp_replace(T.fold(F.regexp_replace(F.regexp_replace(x, "[#?].*$", ""), "^/+|/+$", "")), r"^(?:en|fr|de|es)(?:/|$)", ""), r"^(?:latest|v?\d+(?:\.\d+)*|[a-z-]+@[\w.]+)(?:/|$)", ""),
    r"regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(x, '[#?].*$', ''), '^/+|/+$', '', 'g')), '^(?:en|fr|de|es)(?:/|$)', ''), '^(?:latest|v?\d+(?:\.\d+)*|[a-z-]+@[\w.]+)(?:/|$)', '')",
    ["/en/latest§path§", "/docs/v2.1§path§", "§path§?x=1", "/v3.0/§path§/", "/enterprise-server@3.9§path§"], source="pages",
)
scalar(
    "txt07_canonical_url", URLS[:4], T.canonical_url,
    r"lower(regexp_extract(x, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(x, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) || CASE WHEN regexp_extract(x, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_replace(regexp_extract(x, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+', '/', 'g') END",
    ["§url§", "HTTPS://Docs.Example.com:8443/§path§?q=1#frag", "http://www.example.org", "HTTP://EX.ORG//a/§path§"], source="pages",
)
scalar("txt09_identifier", ["  Foo Bar\tBaz ", "Straße  X", "a\nb"], lambda x: F.regexp_replace(T.fold(x), r"(?U)\s+", ""), r"regexp_replace(replace(lower(x), 'ß', 'ss'), '[\s\x{0B}\x{85}\p{Z}]+', '', 'g')", ["  Foo §lang§\tBaz §id§ ", "Straße  §source§ X", "§text§"], digest=True)
scalar(
    "txt10_document_id", ["proj::guide\\setup.md#top", "guide//index.md", "a/b/index", "X.md?raw=1", "proj::a"],
    lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.replace(x, F.lit("\\"), F.lit("/")), r"^[^:/]+::", ""), r"[#?].*$", ""), "/+", "/"), r"\.md$", ""), r"/index$", ""),
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(x, '\', '/'), '^[^:/]+::', ''), '[#?].*$', ''), '/+', '/', 'g'), '\.md$', ''), '/index$', '')",
    ["proj::guide\\§source§\\§id§.md#top", "guide//§lang§/index.md", "§lang§/§source§/index", "X§id§.md?raw=1", "§source§::§id§"],
)
scalar(
    "txt16_mdx_render", ["import A from 'a'\nexport const title = 'x'\n# Hi\n{/* gone */}\n\n\n\nText", "plain"],
    lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"(?m)^import [^\n]*\n?", ""), r"(?m)^export const (?:title|description) = [^\n]*\n?", ""), r"(?s)\{/\*.*?\*/\}", ""), r"\n{3,}", "\n\n"),
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '(?m)^import [^\n]*\n?', '', 'g'), '(?m)^export const (?:title|description) = [^\n]*\n?', '', 'g'), '(?s)\{/\*.*?\*/\}', '', 'g'), '\n{3,}', E'\n\n', 'g')",
    ["import A from 'a'\nexport const title = '§lang§'\n# Hi §id§\n{/* gone */}\n\n\n\n§text§", "§text§\n{/* one\ntwo */}\n"], digest=True,
)
scalar(
    "txt17_title", ["---\ntitle: Front\n---\n# H", "export const title = \"Const\"\n# H", "intro\n# Heading one\n# Two", "nothing"],
    lambda x: F.coalesce(*(F.nullif(F.trim(F.regexp_extract(x, p, 1)), F.lit("")) for p in (r"(?s)^---\n.*?(?-s)title: *([^\n]+)", r"export const title = [\"']([^\"']+)", r"(?m)^# +(.+)$")), F.lit("stem")),
    r"""coalesce(nullif(trim(regexp_extract(x, '(?s)^---\n.*?title: *([^\n]+)', 1)), ''), nullif(trim(regexp_extract(x, 'export const title = ["'']([^"'']+)', 1)), ''), nullif(trim(regexp_extract(x, '(?m)^# +(.+)$', 1)), ''), 'stem')""",
    ["---\ntitle: Front §id§\n---\n# H\n§text§", "export const title = \"Const §lang§\"\n# H", "intro\n# Heading §source§\n# Two\n§text§", "§text§"],
)
scalar("txt18_path_route", ["docs/en/guide/setup.md", "pages/index.mdx", "api/README.md"], lambda x: F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(F.lower(x), r"\.mdx?$", ""), r"(?:^|/)(?:index|readme)$", "")), r"'/' || regexp_replace(regexp_replace(lower(x), '\.mdx?$', ''), '(?:^|/)(?:index|readme)$', '')", ["docs/§lang§/guide/§id§.md", "pages/§source§/index.mdx", "api/§lang§/README.md", "§source§/§id§.MDX"])
scalar("txt22_line_number", ["a\nb\nc x", "x", "\n\nx"], lambda x: F.size(F.split(F.substring_index(x, "x", 1), "\n", -1)).cast("bigint"), "CAST(len(string_split(string_split(x, 'x')[1], chr(10))) AS BIGINT)", ["§text§"])
scalar(
    "txt24_link_targets", ["[a](b.md) <a href=\"c.html\"> import X from './d'", "[x](http://y z) to='/e'", "none"],
    lambda x: F.array_join(F.concat(F.regexp_extract_all(x, F.lit(r"\]\(([^)\s]+)"), F.lit(1)), F.regexp_extract_all(x, F.lit(r"(?:href|src|to)=[\"']([^\"']+)"), F.lit(1)), F.regexp_extract_all(x, F.lit(r"import [^\n]*? from [\"']([^\"']+)"), F.lit(1))), "|"),
    r"""array_to_string(list_concat(list_concat(regexp_extract_all(x, '\]\(([^)\s]+)', 1), regexp_extract_all(x, '(?:href|src|to)=["'']([^"'']+)', 1)), regexp_extract_all(x, 'import [^\n]*? from ["'']([^"'']+)', 1)), '|')""",
    ["[a](§lang§.md) <a href=\"c§id§.html\"> import X from './d'\n§text§", "[x](http://y z) to='/e§id§'", "§text§"],
)
scalar(
    "txt31_intent", ["How do I install it", "error when building", "why is this slow", "Feature request"],
    lambda x: F.when(F.lower(x).rlike("error|fail|crash"), "troubleshooting").when(F.lower(x).contains("how "), "how_to").when(F.lower(x).contains("why"), "explanation").otherwise("other"),
    "CASE WHEN regexp_matches(lower(x), 'error|fail|crash') THEN 'troubleshooting' WHEN contains(lower(x), 'how ') THEN 'how_to' WHEN contains(lower(x), 'why') THEN 'explanation' ELSE 'other' END",
    ["How do I install §lang§", "error when building §source§", "why is §id§ slow", "Feature request", "§text§"],
)
scalar(
    "txt30_intent_rules", ["How do I install it", "error when building", "migrate to v2", "api reference for x", "permission denied secret", "hello"],
    lambda x: F.when(F.lower(x).rlike(WORD % r"(error|fail\w*|broken|denied)"), "troubleshoot").when(F.lower(x).rlike(WORD % r"(migrat\w*|upgrade)"), "migrate").when(F.lower(x).rlike(WORD % r"(how|install|set ?up)"), "configure").when(F.lower(x).rlike(WORD % r"(api|reference)"), "reference").when(F.lower(x).rlike(WORD % r"(why|what)"), "concept").otherwise("general"),
    r"CASE WHEN regexp_matches(lower(x), '\b(error|fail\w*|broken|denied)\b') THEN 'troubleshoot' WHEN regexp_matches(lower(x), '\b(migrat\w*|upgrade)\b') THEN 'migrate' WHEN regexp_matches(lower(x), '\b(how|install|set ?up)\b') THEN 'configure' WHEN regexp_matches(lower(x), '\b(api|reference)\b') THEN 'reference' WHEN regexp_matches(lower(x), '\b(why|what)\b') THEN 'concept' ELSE 'general' END",
    ["How do I install §lang§", "error when building §source§", "migrate to v§id§", "api reference for x", "permission denied secret", "hello", "§text§"],
)
scalar("txt38_uri", ["a b/c", "x::y", "é"], lambda x: F.concat(F.lit("docs://"), F.replace(F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))), "'docs://' || url_encode(x)", ["§lang§ b/§id§", "§source§::y*~", "§text§"], digest=True)
scalar("txt39_bounded", ["3.5", "2.5", "-4", "999", "x"], lambda x: F.greatest(F.lit(1), F.least(F.lit(50), F.coalesce(F.bround(x.try_cast("double")).cast("int"), F.lit(10)))).cast("bigint"), "CAST(greatest(1, least(50, coalesce(round_even(TRY_CAST(x AS DOUBLE), 0), 10))) AS BIGINT)", ["§id§.5", "-§id§", "x§id§", "§id§"])
scalar("txt41_redaction", ["bolt://user:pw@host:1/db", "--api-key=abc x", "https://h/p"], lambda x: F.regexp_replace(F.regexp_replace(x, r"://[^/@\s]+@", "://***@"), r"(--(?:api-key|token|password)=)\S+", "$1***"), r"regexp_replace(regexp_replace(x, '://[^/@\s]+@', '://***@', 'g'), '(--(?:api-key|token|password)=)\S+', '\1***', 'g')", ["bolt://user:§lang§@host:1/db §id§", "--api-key=§source§ x §text§", "https://h/p §text§"], digest=True)
scalar("txt46_numbers", ["see /discussions/123 and /discussions/7", "none", "/discussions/99?page=2"], lambda x: F.array_join(F.array_distinct(F.regexp_extract_all(x, F.lit(r"/discussions/(\d+)"), F.lit(1))), ","), r"array_to_string(list_filter(regexp_extract_all(x, '/discussions/(\d+)', 1), lambda v, i: list_position(regexp_extract_all(x, '/discussions/(\d+)', 1), v) = i), ',')", ["see /discussions/§id§ and /discussions/7 and /discussions/§id§", "§text§", "/discussions/99?page=§id§"])
scalar(
    "txt42_image_filter", ["https://img.shields.io/badge/x.svg", "https://a.b/c.png?tok=1", "data:image/png;base64,xx", "https://a.b/avatar/u.png"],
    lambda x: F.when(x.rlike(r"^data:|shields\.io|/badge/|/avatar"), "drop").otherwise(F.regexp_replace(x, r"\?.*$", "")), r"CASE WHEN regexp_matches(x, '^data:|shields\.io|/badge/|/avatar') THEN 'drop' ELSE regexp_replace(x, '\?.*$', '') END",
    ["https://img.shields.io/badge/§id§.svg", "§url§?tok=1", "data:image/png;base64,§id§", "https://a.b/avatar/§id§.png"], source="pages",
)
scalar(
    "txt28_code_entities", ["use `--dry-run` and --force with MY_VAR plus `obj.call()`", "plain words", "`a b`, `x_y` --x"],
    lambda x: F.array_join(F.array_sort(F.array_distinct(F.concat(F.regexp_extract_all(F.lower(x), F.lit(r"(?:^|[^\w-])(--[a-z][a-z0-9-]+)"), F.lit(1)), F.transform(F.regexp_extract_all(x, F.lit(WORD % "([A-Z][A-Z0-9]*_[A-Z0-9_]+)"), F.lit(1)), F.lower), F.transform(F.filter(F.regexp_extract_all(x, F.lit(r"`([^`\n]{1,100})`"), F.lit(1)), lambda c: c.rlike(r"[_().-]")), F.lower)))), "|"),
    r"array_to_string(list_sort(list_distinct(list_concat(list_concat(regexp_extract_all(lower(x), '(?:^|[^\w-])(--[a-z][a-z0-9-]+)', 1), list_transform(regexp_extract_all(x, '\b([A-Z][A-Z0-9]*_[A-Z0-9_]+)\b', 1), lambda c: lower(c))), list_transform(list_filter(regexp_extract_all(x, '`([^`\n]{1,100})`', 1), lambda c: regexp_matches(c, '[_().-]')), lambda c: lower(c))))), '|')",
    ["use `--dry-run` and --force with §lang§ MY_VAR plus `obj.call()`\n§text§", "§text§", "`a b`, `x_§id§` --x"], digest=True,
)
scalar(
    "txt36_evidence_sentence", ["Alpha only. Alpha and beta here. Beta.", "Just beta. None", "nothing at all"],
    lambda x: F.substring(F.coalesce(F.get(F.filter(F.split(x, r"(?<=[.!?])\s+"), lambda s: F.lower(s).contains("alpha") & F.lower(s).contains("beta")), F.lit(0)), F.get(F.filter(F.split(x, r"(?<=[.!?])\s+"), lambda s: F.lower(s).contains("alpha") | F.lower(s).contains("beta")), F.lit(0)), x), 1, 800),
    r"substr(coalesce(list_filter(string_split(regexp_replace(x, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: contains(lower(s), 'alpha') AND contains(lower(s), 'beta'))[1], list_filter(string_split(regexp_replace(x, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: contains(lower(s), 'alpha') OR contains(lower(s), 'beta'))[1], x), 1, 800)",
    ["Alpha only. Alpha and beta here. Beta. §text§", "Just beta. §text§", "§text§"], digest=True,
)


PAGE_TEXT = r"""trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)</?(?:p|div|section|article|li|ul|ol|br|h[1-6]|pre|tr|table|blockquote)\b[^>]*>', E'\n', 'g'), '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g'),
 '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), 'https?://\S+', '', 'g'), '[ \t]+', ' ', 'g'), '\s*\n\s*', E'\n', 'g'))"""


@query("txt01_html_text", f"SELECT page_id, sha256({PAGE_TEXT}) AS digest, CAST(length({PAGE_TEXT}) AS BIGINT) AS n_chars FROM pages")
def txt01(spark, d):
    x = T.html_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.sha2(x, 256).alias("digest"), F.length(x).cast("bigint").alias("n_chars"))


@query("txt25_page_links", r"""SELECT page_id, CAST(pos AS BIGINT) AS pos, links[pos + 1] AS href FROM (SELECT page_id, links, unnest(range(len(links))) AS pos FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS links FROM pages))""")
def txt25(spark, d):
    links = F.regexp_extract_all("html", F.lit(r'<a [^>]*href="([^"]*)"'), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.posexplode(links).alias("pos", "href")).withColumn("pos", F.col("pos").cast("bigint"))


@query("txt04_docs_path", r"""SELECT page_id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '^/(?:en|fr|de|es)(/|$)', '/'), '^/v?\d+(?:\.\d+)+(/|$)', '/')) AS path, regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages""")
def txt04(spark, d):
    p = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1), "/+", "/")
    p = F.lower(F.regexp_replace(F.regexp_replace(p, r"^/(?:en|fr|de|es)(/|$)", "/"), r"^/v?\d+(?:\.\d+)+(/|$)", "/"))
    return table(spark, d, "pages").select("page_id", p.alias("path"), F.regexp_extract("url", "#(.*)$", 1).alias("fragment"))


@query("txt27_distinct_links", r"""SELECT page_id, CAST(len(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS BIGINT) AS n FROM pages""")
def txt27(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).cast("bigint").alias("n"))


SECTIONS = ["# Title §id§\nintro\n## A\n§text§\n### A1\ndeep\n## B\n§source§\n# Last\nend", "## First\n§text§\n#### Deep\n### Less\n# Top", "§text§", "# One\n§text§\n## Two\n## Three\n### Four\n§lang§"]


def _headings(spark, d):
    """(id, line, n, body, level) of every line of texts with headings put into them; level is null where a line is no heading."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.split(made("documents", SECTIONS), "\n", -1).alias("b"))
    lines = rows.select("id", F.size("b").alias("n"), F.posexplode("b").alias("line", "body"))
    level = F.length(F.regexp_extract("body", r"^(#{1,6}) ", 1))
    return lines.withColumn("level", F.when(level > 0, level))


LINES = f"""l AS (SELECT id, len(b) AS n, CAST(generate_subscripts(b, 1) - 1 AS INT) AS line, unnest(b) AS body FROM (SELECT doc_id AS id, string_split({made_sql("documents", SECTIONS)}, chr(10)) AS b FROM documents)),
h AS (SELECT *, nullif(length(regexp_extract(body, '^(#{{1,6}}) ', 1)), 0) AS level FROM l)"""


@query("txt19_flat_sections", f"WITH {LINES} SELECT id, line AS start_line, body AS heading, CAST(coalesce(lead(line) OVER (PARTITION BY id ORDER BY line), n) AS INT) AS end_line FROM h WHERE level >= 1")
def txt19(spark, d):
    """Sections that end at the next heading of any level."""
    following = F.lead("line").over(Window.partitionBy("id").orderBy("line"))
    return _headings(spark, d).where("level >= 1").select("id", F.col("line").alias("start_line"), F.col("body").alias("heading"), F.coalesce(following, "n").alias("end_line"))


@query("txt20_nested_sections", f"WITH {LINES} SELECT a.id, a.line AS start_line, a.body AS heading, CAST(coalesce(min(b.line), any_value(a.n)) AS INT) AS end_line FROM h a LEFT JOIN h b ON a.id = b.id AND b.line > a.line AND b.level <= a.level WHERE a.level IS NOT NULL GROUP BY a.id, a.line, a.body")
def txt20(spark, d):
    """Sections that end at the next heading of their level or above: for each level the nearest such heading that follows, in one window."""
    ahead = Window.partitionBy("id").orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    nearest = [F.min(F.when(F.col("level") <= k, F.col("line"))).over(ahead) for k in range(1, 7)]
    rows = _headings(spark, d).where("level IS NOT NULL").select("id", "line", "body", "n", F.element_at(F.array(*nearest), F.col("level")).alias("end"))
    return rows.select("id", F.col("line").alias("start_line"), F.col("body").alias("heading"), F.coalesce("end", "n").alias("end_line"))


@query("win06_active_heading", f"WITH {LINES} SELECT id, line, last_value(CASE WHEN level IS NOT NULL THEN body END IGNORE NULLS) OVER (PARTITION BY id ORDER BY line) AS heading FROM h")
def win06(spark, d):
    """The heading in force at each line (TXT21, JON10, WIN06)."""
    w = Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return _headings(spark, d).select("id", "line", F.last(F.when(F.col("level").isNotNull(), F.col("body")), ignorenulls=True).over(w).alias("heading"))


@query("txt32_terms", r"""SELECT item_id, array_to_string(list_filter(list_transform(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9._-]*'), lambda t: trim(t, '.-')), lambda t: length(t) > 1 AND t NOT IN ('the', 'and', 'of')), ' ') AS terms FROM benchmark""")
def txt32(spark, d):
    t = F.transform(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9][a-z0-9._-]*"), F.lit(0)), lambda t: F.regexp_replace(t, r"^[.-]+|[.-]+$", ""))
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.filter(t, lambda x: (F.length(x) > 1) & ~x.isin("the", "and", "of")), " ").alias("terms"))


@query("idn01_stable_ids", "SELECT doc_id, 'doc-' || substr(sha256(lang || chr(0) || source || chr(0) || CAST(doc_id AS VARCHAR)), 1, 24) AS id FROM documents")
def idn01(spark, d):
    return table(spark, d, "documents").select("doc_id", T.stable_id("doc", F.col("lang"), F.col("source"), F.col("doc_id").cast("string")).alias("id"))


sql_query(
    "txt40_evidence_budget",
    """SELECT item_id, pos, before, CASE WHEN before = 0 THEN least(n, 400) ELSE n END AS taken FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) AS pos, CAST(length(text) AS BIGINT) AS n,
    coalesce(sum(length(text)) OVER (ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM benchmark) WHERE before + n <= 2000 OR before = 0""",
    """SELECT item_id, pos, CAST(before AS BIGINT) AS before, CASE WHEN before = 0 THEN least(n, 400) ELSE n END AS taken FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) AS pos, CAST(length(text) AS BIGINT) AS n,
    coalesce(sum(length(text)) OVER (ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM benchmark) WHERE before + n <= 2000 OR before = 0""",
    "benchmark",
)
