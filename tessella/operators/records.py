"""Pages and their chunks as records of a graph: sections, text and image units, assets, occurrences, NEAR and NEXT edges (GRF04).

A page's headings, line ends, chunks and images are lists in the order of their offsets; one walk over each page merges
them. What joins pages (projects, assets) is an aggregate over all of them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What counts as a heading or an image, the beginnings of a chunk that are looked for, and an unfound chunk's size.
HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*$", re.M)
MARKDOWN_IMAGE = re.compile(r"!\[([^\]]*)\]\(([^)\s]+)(?:\s+[\"']([^\"']*)[\"'])?\)")
ELEMENT_IMAGE = re.compile(r"<(?:img|image)\b([^>]*?)\bsrc=[\"']([^\"']+)[\"']([^>]*)>", re.I)
ATTRIBUTE = {n: re.compile(rf"\b{n}=[\"']([^\"']*)[\"']", re.I) for n in ("alt", "title")}
PROBES = (None, 500, 200, 80)
CHUNK = 1400

UNITS = "doc_id long, project string, unit_id string, kind string, place int, offset int, line int, section_id string, section string, level int, ordinal int, following string, near string, asset_id string, url string, alt string, image_title string, syntax string"


def stable_id(prefix: str, *parts: str) -> str:
    return f"{prefix}-{sha256(chr(0).join(parts).encode()).hexdigest()[:24]}"


def images(text: str) -> list[tuple[int, str, str, str, str]]:
    """(offset, url, alternative text, title, syntax) of a page's images, by offset, then by url."""
    out = [(m.start(), m.group(2).strip(), m.group(1).strip(), (m.group(3) or "").strip(), "markdown") for m in MARKDOWN_IMAGE.finditer(text)]
    for m in ELEMENT_IMAGE.finditer(text):
        beside = f"{m.group(1)} {m.group(3)}"
        alt, title = (ATTRIBUTE[n].search(beside) for n in ("alt", "title"))
        out.append((m.start(), m.group(2).strip(), alt.group(1).strip() if alt else "", title.group(1).strip() if title else "", "element"))
    return sorted(out, key=lambda x: x[:2])


def found_at(text: str, chunk: str, fallback: int) -> int:
    """Where a chunk's body (what follows its two lines of title and id) stands in its page."""
    body = chunk.split("\n", 2)[-1].strip()
    for probe in PROBES if body else ():
        if (at := text.find(body[:probe])) >= 0:
            return at
    return fallback


def page_units(doc_id: int, project: str, title: str, text: str, chunks: list[str]) -> list[tuple]:
    """The units of one page in their order, as rows of UNITS."""
    heads = [(m.start(), m.end(), m.group(2).strip(), len(m.group(1))) for m in HEADING.finditer(text)]
    ends = [h[1] for h in heads]  # a heading is in force where it ends
    breaks = [i for i, c in enumerate(text) if c == "\n"]
    line = lambda at: bisect_right(breaks, at - 1) + 1
    section_id = lambda name, level: stable_id("section", str(doc_id), str(level), name.casefold())
    units = []
    for k, chunk in enumerate(chunks):
        at = found_at(text, chunk, k * CHUNK)
        m = HEADING.search(chunk)
        name, level = (m.group(2).strip(), len(m.group(1))) if m else (title, 1)
        units.append([at, 0, f"{doc_id}::c{k:04d}", "text_chunk", k, name, level, None, "", "", "", "", ""])
    joined, first, known = "\0".join(chunks), [0], {}
    for chunk in chunks:
        first.append(first[-1] + len(chunk) + 1)

    def holder(words: str) -> int:
        """The first chunk that holds some words; a chunk too many if none does."""
        if words not in known:
            at = joined.find(words) if words else -1
            known[words] = bisect_right(first, at) - 1 if at >= 0 else len(chunks)
        return known[words]

    for k, (at, url, alt, image_title, syntax) in enumerate(images(text)):
        h = bisect_right(ends, at + 1) - 1
        name, level = heads[h][2:] if h >= 0 else (title, 1)
        near = min(holder(url), holder(alt))
        near = f"{doc_id}::c{0 if near == len(chunks) else near:04d}" if chunks else None
        units.append([at, 1, stable_id("image-occurrence", str(doc_id), str(k), url), "image_occurrence", len(chunks) + k, name, level, near, stable_id("image-asset", project, url), url, alt, image_title, syntax])
    units.sort(key=lambda u: u[:3])
    out = []
    for n, (at, _, unit, kind, place, name, level, near, asset, url, alt, image_title, syntax) in enumerate(units):
        following = units[n + 1][2] if n + 1 < len(units) else None
        out.append((doc_id, project, unit, kind, place, at, line(at), section_id(name, level), name, level, n, following, near, asset or None, url, alt, image_title, syntax))
    return out


def units(pages: DataFrame) -> DataFrame:
    """Rows of UNITS of the pages (doc_id, project, title, text, chunks: array of texts)."""
    names = [c.split()[0] for c in UNITS.split(", ")]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                rows = page_units(row["doc_id"], row["project"], row["title"], row["text"] or "", row["chunks"] or [])
                kinds = [pa.int64() if n == "doc_id" else pa.int32() if n in ("place", "offset", "line", "level", "ordinal") else pa.string() for n in names]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return pages.select("doc_id", "project", "title", "text", "chunks").mapInArrow(run, UNITS)


def records(pages: DataFrame, made: DataFrame) -> dict[str, DataFrame]:
    """Tables of a graph from pages and their :func:`units`. A section is told by its first unit in the order chunks, then images;
    an asset belongs to its project and is told by its first page."""
    first = Window.partitionBy("section_id").orderBy("place")
    sections = made.withColumn("n", F.row_number().over(first)).where("n = 1").select("section_id", "doc_id", F.col("section").alias("title"), "level", F.col("place").alias("ordinal"))
    pictures = made.where("kind = 'image_occurrence'")
    return {
        "projects": pages.select(F.col("project").alias("project_id")).distinct(),
        "documents": pages.select("doc_id", F.col("project").alias("project_id"), "title"),
        "sections": sections,
        "units": made.select("unit_id", "doc_id", F.col("project").alias("project_id"), "section_id", F.col("kind").alias("unit_type"), "ordinal", F.col("line").alias("source_line"), "asset_id"),
        "next_edges": made.where("following IS NOT NULL").select(F.col("unit_id").alias("source"), F.col("following").alias("target")),
        "image_assets": pictures.groupBy("asset_id").agg(F.min("project").alias("project_id"), F.min("url").alias("source_url"), F.min("doc_id").alias("first_doc_id")),
        "image_occurrences": pictures.select(F.col("unit_id").alias("occurrence_id"), "asset_id", "doc_id", F.col("alt").alias("alt_text"), "image_title", F.col("url").alias("source_url"), F.col("syntax").alias("source_syntax")),
        "near_edges": pictures.where("near IS NOT NULL").select(F.col("unit_id").alias("occurrence_id"), F.col("near").alias("unit_id")),
    }


def slices(title: Column, doc_id: Column, text: Column, size: int = CHUNK) -> Column:
    """Chunks of a fixed size under two lines of title and id."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(text) / size).cast("int") - 1))
    return F.transform(starts, lambda i: F.concat_ws("\n", title, doc_id.cast("string"), F.substring(text, i * size + 1, F.lit(size))))
