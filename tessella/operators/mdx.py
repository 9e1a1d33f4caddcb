"""Pages of Markdown and MDX repositories: routes, one page a route, links between them (GRF02, GRF03, TXT18).

Pages are rows (source_path, body). Every link of a body is looked for where its target can be: on one of the site's hosts,
at an absolute path, or beside the page. A link counts if a page has the route, and isn't the page itself; of links that
share target, anchor text and section the last one's context counts, at the place of the first.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls, yaml
from .components import salted_join

# What counts as a link or a heading, and how many characters about a link are its context.
MARKDOWN_LINK = re.compile(r"\[([^\]]*)\]\(([^)\s]+)(?:\s+[^)]*)?\)")
ATTRIBUTE_LINK = re.compile(r"(?:href|to)=[\"']([^\"']+)[\"']")
HEADING = re.compile(r"^#{2,6}[ \t]+(\S.*?)\s*$", re.M)
BEFORE, AFTER = 160, 240
DROPPED = re.compile(r"[`*_{}<>]")

LINKS = "source string, at int, anchor string, raw string, section string, context string"


def route(source_path: Column, declared: Column, kind: str, prefix: str = "/docs/") -> Column:
    """The address of a page: "flat" sites use the file's name, "declared" ones the front matter's url if there is one, others the path."""
    bare = F.regexp_replace(source_path, r"\.[^./]*$", "")
    if kind == "flat":
        value = F.regexp_extract(bare, "([^/]*)$", 1)
    elif kind == "declared":
        value = F.when(F.length(F.trim(declared)) > 0, F.regexp_replace(F.trim(declared), "^/+", "")).otherwise(F.regexp_replace(bare, "/index$", ""))
    else:
        value = F.regexp_replace(bare, "/(index|overview)$", "")
    return urls.canonical_path(F.concat(F.lit(prefix), value))


def _front(batches):
    for batch in batches:
        parts = [yaml.split(x or "") for x in batch.column(batch.num_columns - 1).to_pylist()]
        columns = [pa.array([p[k] for p in parts], pa.string()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], "metadata", "body"])


def with_front_matter(pages: DataFrame, text: str = "text") -> DataFrame:
    """``pages`` without ``text``, with ``metadata``, the front matter as VARIANT, and ``body`` (TXT12). Invalid front matter is an empty map."""
    others = [f for f in pages.schema.fields if f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "metadata string, body string"])
    read = pages.select(*(f.name for f in others), text).mapInArrow(_front, schema)
    return read.select(*(f.name for f in others), F.parse_json("metadata").alias("metadata"), "body")


def one_page_a_route(pages: DataFrame) -> DataFrame:
    """Of pages that share a ``route``: one without a version in its path before others, then the shortest path, then the first (GRF03)."""
    versioned = F.concat(F.lit("/"), F.col("source_path")).rlike(r"/(?:v\d+|legacy)/")
    others = [c for c in pages.columns if c != "route"]
    best = F.min_by(F.struct(*others), F.struct(versioned, F.length("source_path"), F.col("source_path")))
    return pages.groupBy("route").agg(best.alias("page")).select("route", *(F.col(f"page.{c}").alias(c) for c in others))


def clean(text: str) -> str:
    return " ".join(DROPPED.sub("", text).split())


def _links(batches):
    for batch in batches:
        out = [[] for _ in range(6)]
        for source, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            body = body or ""
            heads = [(m.start(), clean(m.group(1))) for m in HEADING.finditer(body)]
            found = sorted([(m.start(), m.group(1), m.group(2)) for m in MARKDOWN_LINK.finditer(body)] + [(m.start(), "", m.group(1)) for m in ATTRIBUTE_LINK.finditer(body)])
            k, section = 0, ""
            for at, anchor, raw in found:  # both are in order: one pass
                while k < len(heads) and heads[k][0] <= at:
                    section, k = heads[k][1], k + 1
                for column, value in zip(out, (source, at, clean(anchor), raw, section, " ".join(body[max(0, at - BEFORE) : at + AFTER].split()))):
                    column.append(value)
        kinds = pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], [f.split()[0] for f in LINKS.split(", ")])


def links(pages: DataFrame) -> DataFrame:
    """(source, at, anchor, raw, section, context) of every link of the pages (route, body), with the heading it stands under."""
    return pages.select(F.col("route").alias("source"), "body").mapInArrow(_links, LINKS)


def candidate(raw: Column, source: Column, hosts: list[str], prefix: str | None = None) -> Column:
    """The route that a link may mean, null if it leads elsewhere. With ``prefix``, routes outside of it are looked for in it."""
    decoded = F.replace(F.replace(raw, F.lit("&amp;"), F.lit("&")), F.lit("&#x2F;"), F.lit("/"))
    web = urls.scheme(decoded).isin("http", "https")
    beside = urls.joined(F.concat(F.lit("https://site.invalid"), source), decoded)
    found = (
        F.when(web, F.when(urls.host(decoded).isin(*(h.lower() for h in hosts)), urls.canonical_path(decoded)))
        .when(raw.startswith("#") | raw.startswith("mailto:") | raw.startswith("javascript:"), None)
        .when(raw.startswith("/"), urls.canonical_path(decoded))
        .otherwise(urls.canonical_path(beside))
    )
    if prefix is None:
        return found
    return F.when(found.startswith(prefix), found).otherwise(F.concat(F.lit(prefix.rstrip("/")), found))


def edges(pages: DataFrame, hosts: list[str], prefix: str | None = None) -> DataFrame:
    """(source, target, anchor, section, context, target_anchor, place): distinct links between pages (route, body)."""
    asked = links(pages).withColumn("target", candidate(F.col("raw"), F.col("source"), hosts, prefix)).where("target IS NOT NULL AND target <> source")
    found = salted_join(asked, pages.select(F.col("route").alias("target")).distinct(), "target", "source")  # a start page is linked from everywhere
    last = F.max_by(F.struct("context", F.lower(urls.unquoted(urls.fragment(F.col("raw")))).alias("target_anchor")), "at")
    once = found.groupBy("source", "target", "anchor", "section").agg(F.min("at").alias("first"), last.alias("last"))
    place = F.row_number().over(Window.partitionBy("source").orderBy("first"))
    return once.select("source", "target", "anchor", "section", "last.context", "last.target_anchor", place.alias("place"))
