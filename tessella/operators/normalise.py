"""Resolution of historical links, routing pages and sections (MET07, NRM01-NRM05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that every documentation route may have and that say nothing about its topic.
ROUTE_WORDS = ("docs", "guide", "guides", "overview", "concepts", "components", "reference", "using", "customizing")


def terms(x: Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct lower-case terms of two or more characters, without dots and hyphens at their ends (TXT32)."""
    found = F.transform(F.regexp_extract_all(F.lower(x), F.lit(r"[a-z0-9][a-z0-9._-]*"), F.lit(0)), lambda t: F.regexp_replace(t, r"^[.-]+|[.-]+$", ""))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*stop) if stop else F.length(t) > 1))


def _share(a: Column, b: Column) -> Column:
    """The share of ``a``'s terms that ``b`` has."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(a))


def recovered(records: DataFrame, pages: DataFrame) -> DataFrame:
    """(record, doc_id, method, score, margin, coverage_before, coverage) of links whose topic moved to another page (NRM03).

    ``records``: (record, project, target, anchor, route_terms); ``pages``: (doc_id, project, anchors, terms). Candidates are
    pages of the project that share a term with the anchor, by an inverted index. They score 1000 for the very anchor, 100 times the
    share of the anchor's terms, 10 times that of the route's. The best counts if no other comes within 8 (or it has the
    anchor) and if it covers the topic better than the page that the link names, without leaving the route's scope.
    """
    asked = records.withColumn("asked", terms(F.regexp_replace("anchor", "-", " "))).where(F.size("asked") > 0)
    now = pages.select(F.col("doc_id").alias("target"), F.col("anchors").alias("now_anchors"), F.col("terms").alias("now_terms"))
    asked = asked.join(now, "target").where(~F.array_contains("now_anchors", F.col("anchor")))
    asked = asked.withColumn("before", _share(F.col("asked"), F.col("now_terms"))).withColumn("route_before", _share(F.col("route_terms"), F.col("now_terms"))).drop("now_terms", "now_anchors")
    index = pages.select("project", "doc_id", F.explode("terms").alias("term"))
    found = asked.select("record", "project", "target", F.explode("asked").alias("term")).join(index, ["project", "term"]).where("doc_id <> target").select("record", "doc_id").distinct()
    both = found.join(pages.select("doc_id", "anchors", "terms"), "doc_id").join(asked, "record")
    exact = F.array_contains("anchors", F.col("anchor"))
    scored = both.select("record", "doc_id", "before", "route_before", F.size("route_terms").alias("n_route"), exact.alias("exact"), _share(F.col("asked"), F.col("terms")).alias("coverage"), _share(F.col("route_terms"), F.col("terms")).alias("route"))
    scored = scored.withColumn("score", F.round(1000.0 * F.col("exact").cast("int") + 100.0 * F.col("coverage") + 10.0 * F.col("route"), 9))
    order = Window.partitionBy("record").orderBy(F.desc("score"), F.desc("coverage"), F.desc("exact"), F.desc("doc_id"))
    best = scored.withColumn("next", F.lead("score").over(order)).withColumn("at", F.row_number().over(order)).where("at = 1")
    margin = F.col("score") - F.col("next")
    better = F.col("coverage") >= F.col("before") + 0.20
    scope = (F.col("n_route") == 0) | (F.col("route") >= F.col("route_before"))
    clear = F.col("exact") | F.col("next").isNull() | (margin >= 8.0)
    good = clear & scope & ((F.col("exact") & ((F.col("before") < 0.75) | better)) | ((F.col("coverage") >= 0.75) & better))
    method = F.when(F.col("exact"), "exact_anchor").otherwise("topic")
    return best.where(good).select("record", "doc_id", method.alias("method"), F.round("score", 6).alias("score"), F.round(margin, 6).alias("margin"), F.round("before", 6).alias("coverage_before"), F.round("coverage", 6).alias("coverage"))


def routed(asked: DataFrame, pages: DataFrame, most: int = 3) -> DataFrame:
    """(qid, prefix, doc_id, score, matched, rank) of the pages that stand in for an empty routing page (NRM04).

    ``asked``: (qid, project, prefix, terms); ``pages``: (doc_id, project, route, title_terms, route_terms, terms). Pages below
    the prefix that share a term with the question score each shared term's inverse frequency in the project, three times
    more if it is in the title, half as much again in the route, and a little for being near. A page is joined by the
    directories above it, so prefixes meet pages on equality.
    """
    sizes = pages.groupBy("project").agg(F.count("*").alias("size"))
    postings = pages.select("project", "doc_id", F.explode("terms").alias("term"))
    wanted = asked.select("qid", "project", "prefix", F.explode("terms").alias("term"))
    hits = postings.join(wanted.select("project", "term").distinct(), ["project", "term"])
    df = hits.groupBy("project", "term").agg(F.count("*").alias("df"))
    parts = F.split("route", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/")))
    below = pages.where(F.size(parts) > 1).select("doc_id", "project", "title_terms", "route_terms", "route", F.explode(above).alias("prefix"))
    below = below.join(asked.select("project", "prefix").distinct(), ["project", "prefix"])
    pairs = below.join(hits, ["project", "doc_id"]).join(wanted, ["project", "prefix", "term"]).join(df, ["project", "term"]).join(sizes, "project")
    idf = F.log1p(F.col("size") / F.greatest(F.lit(1), F.col("df")))
    part = idf * (1.0 + F.when(F.array_contains("title_terms", F.col("term")), 3.0).otherwise(0.0) + F.when(F.array_contains("route_terms", F.col("term")), 1.5).otherwise(0.0))
    depth = F.size(F.split(F.substring("route", F.length("prefix") + 1, F.length("route")), "/"))
    out = pairs.groupBy("qid", "prefix", "doc_id").agg(F.round(F.sum(part) + 0.25 / F.first(depth), 9).alias("score"), F.count("*").alias("matched"))
    rank = F.row_number().over(Window.partitionBy("qid", "prefix").orderBy(F.desc("score"), F.desc("matched"), "doc_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= most)


def _section_score(fragment: Column, fragment_terms: Column) -> Column:
    heading, body, query = F.col("heading_terms"), F.col("body_terms"), F.col("query_terms")
    shared = lambda a, b: F.size(F.array_intersect(a, b))
    of = lambda c: F.greatest(F.lit(1), F.size(c))
    by_fragment = 80.0 * shared(fragment_terms, heading) / of(fragment_terms) + 30.0 * shared(fragment_terms, body) / of(fragment_terms) + 25.0 * shared(fragment_terms, heading) / of(heading)
    by_query = 12.0 * shared(query, heading) / of(heading) + 8.0 * shared(query, body) / of(query)
    near = 1.0 / (1.0 + F.col("start") / 10_000.0)
    exact = (fragment != "") & (F.col("anchor") == fragment)
    return F.when(exact, 10_000.0).otherwise(F.round(F.when(F.size(fragment_terms) > 0, by_fragment).otherwise(0.0) + F.when(F.size(query) > 0, by_query).otherwise(0.0) + near, 9))


def sections_ranked(sections: DataFrame, most: int = 4, budget: int = 18_000) -> tuple[DataFrame, DataFrame]:
    """(mappings, evidence) of link fragments among the sections of their pages (NRM05).

    ``sections``: (key, start, heading, anchor, body, fragment, query), a page's sections with the fragment and the question
    that ask for it. A mapping tells the best section, the margin to the next, and whether it is ambiguous: not the very
    anchor, and under 34 points or within 4. Evidence is that section and the question's best ones, ``most`` in all, by
    score and place under ``budget`` characters: the last one is cut.
    """
    rows = sections.withColumn("heading_terms", terms(F.col("heading"))).withColumn("body_terms", terms(F.substring("body", 1, 8000))).withColumn("query_terms", terms(F.col("query")))
    rows = rows.withColumn("fragment_terms", terms(F.regexp_replace("fragment", "-", " ")))
    rows = rows.withColumn("score", _section_score(F.col("fragment"), F.col("fragment_terms"))).withColumn("plain", _section_score(F.lit(""), F.array().cast("array<string>")))
    order = Window.partitionBy("key").orderBy(F.desc("score"), "start")
    first = rows.withColumn("next", F.lead("score").over(order)).withColumn("at", F.row_number().over(order))
    best = first.where("at = 1")
    margin, exact = F.col("score") - F.col("next"), (F.col("fragment") != "") & (F.col("anchor") == F.col("fragment"))
    ambiguous = (F.col("fragment") != "") & ~exact & ((F.col("score") < 34.0) | F.coalesce(margin < 4.0, F.lit(False)))
    method = F.when(exact, "exact_anchor").when(F.col("fragment") != "", "ranked_heading").otherwise("question_guided")
    mappings = best.select("key", F.col("start").alias("section"), method.alias("method"), F.round("score", 6).alias("score"), F.round(margin, 6).alias("margin"), ambiguous.alias("ambiguous"))
    others = first.where("at > 1").withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("plain"), "start"))).where(F.col("n") < most)
    chosen = best.select("key", "start", "score", F.length("body").alias("size")).union(others.select("key", "start", "plain", F.length("body")))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("key").orderBy(F.desc("score"), "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = chosen.withColumn("before", before).where((F.col("size") > 0) & (F.col("before") < budget))
    return mappings, taken.select("key", F.col("start").alias("section"), F.round("score", 6).alias("score"), F.least("size", budget - F.col("before")).cast("bigint").alias("taken"))


def document_id(x: Column) -> Column:
    """The plain form of a document id: slashes one way, no fragment or query, no ending (TXT10)."""
    x = F.regexp_replace(F.replace(x, F.lit("\\"), F.lit("/")), r"[#?].*$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "/+", "/"), r"\.mdx?$", ""), r"/index$", "")


def _variants(raw: Column) -> list[Column]:
    bare = F.regexp_replace(raw, r"^content/", "")
    return [raw, bare, F.concat(F.lit("content/"), bare), document_id(raw), F.regexp_replace(document_id(raw), r"^/+", "")]


def resolved(sources: DataFrame, pages: DataFrame, hosts: dict[str, str]) -> DataFrame:
    """(key, doc_id or null) of cited sources: ids, paths or URLs (MET07).

    ``sources``: (key, source); ``pages``: (doc_id, project, source_doc_id, source_path, route). What looks like an id is
    looked up as one first. Else scheme, host, query, fragment, locale and version go, and the first of several spellings
    that names one page only decides; the host, or a leading project, adds spellings inside that project.
    """
    key = lambda x: F.lower(F.trim(x))
    names = [document_id(F.col("doc_id")), F.regexp_replace(document_id(F.col("doc_id")), "^/+", ""), *_variants(F.col("source_doc_id")), *_variants(F.col("source_path")), document_id(F.col("route"))]
    names += [F.concat(F.col("project"), F.lit("::"), document_id(F.col(c))) for c in ("source_doc_id", "source_path")]
    alias = pages.select("doc_id", F.explode(F.array_distinct(F.transform(F.array(*names), key))).alias("alias")).where("alias <> ''")
    alias = alias.groupBy("alias").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("other")).where("doc_id = other").select("alias", "doc_id")

    raw = F.trim("source")
    url = raw.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://")
    host = F.lower(F.regexp_extract(raw, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1))
    hint = F.coalesce(*(F.when(url & (host == h), F.lit(p)) for h, p in hosts.items()), F.lit(""))
    path = F.when(url, F.regexp_replace(raw, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", "")).otherwise(raw)
    path = F.regexp_replace(F.replace(F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path), F.lit("\\"), F.lit("/")), "[#?].*$", "")
    rows = sources.where(raw != "").select("key", raw.alias("raw"), hint.alias("hint"), F.filter(F.split(path, "/"), lambda p: p != "").alias("parts"))
    head = F.lower(F.coalesce(F.get("parts", F.lit(0)), F.lit("")))
    rows = rows.withColumn("named", head.isin(*hosts.values())).withColumn("hint", F.when(F.col("named"), head).otherwise(F.col("hint")))
    drop = lambda when: F.when(when, F.slice("parts", 2, F.greatest(F.lit(0), F.size("parts") - 1))).otherwise(F.col("parts"))
    rows = rows.withColumn("parts", drop(F.col("named"))).withColumn("parts", drop(head == "en")).withColumn("parts", drop(head.rlike(r"^(?:latest|v?\d+(?:\.\d+)*|[a-z-]+@[\w.]+)$")))
    rows = rows.withColumn("path", F.array_join("parts", "/"))
    spelled = _variants(F.col("path"))
    inside = [F.when(F.col("hint") != "", F.concat(F.col("hint"), F.lit("::"), document_id(s))) for s in spelled]
    tries = rows.select("key", F.posexplode(F.transform(F.array(*spelled, *inside), key)).alias("at", "alias")).where("alias is not null")
    by_alias = tries.join(alias, "alias").groupBy("key").agg(F.min_by("doc_id", "at").alias("by_alias"))
    ids = pages.select(key(document_id(F.col("doc_id"))).alias("id"), F.col("doc_id").alias("by_id"))
    by_id = rows.where(F.contains("raw", F.lit("::"))).select("key", key(document_id(F.col("raw"))).alias("id")).join(ids, "id").groupBy("key").agg(F.min("by_id").alias("by_id"))
    return sources.select("key").join(by_id, "key", "left").join(by_alias, "key", "left").select("key", F.coalesce("by_id", "by_alias").alias("doc_id"))
