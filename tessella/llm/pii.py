"""Personal data: patterns find protected entities, corpus co-occurrence finds the terms that give them away.

DataFrame functions only. After Sanchez and Batet's information-theoretic sanitisation: a term t in a document of an entity e
discloses it by PMI(e; t) = log(p(e, t) / (p(e) p(t))), at most IC(e) = -log p(e), reached where t never occurs without
e. Terms whose share PMI / IC is at least ``theta`` are generalised, those that reach ``remove`` are removed.
Probabilities are over all documents, wherever entity and term stand in them; a term needs ``support`` different contexts
with the entity, so the copies of one passage prove nothing. Every place of such a term in the entity's documents goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parked

KINDS = ("email", "ip", "card", "phone")

# The patterns of the four kinds. \G and the look-behind let a match start where a run of its characters
# starts or the last match ended: there, and only there, the plain pattern's leftmost match can start. With possessive
# repeats no run is read twice, so texts of one long run take linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a match of the kind to be there at all.
HINTS = {"ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}

#: Words of three letters or less are no terms.
LETTER = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]"
TERM = LETTER + "{4,}"
RADIUS, SUPPORT, THETA, REMOVE = 80, 3, 0.8, 0.999
#: Parts that an entity's rows are dealt in; the commonest terms that are dropped by broadcast; words added up at once; words
#: on each side that make a term's context.
SALTS, COMMON, CHUNK, NEIGHBOURS = 16, 1000, 128, 4


def _appended(state: Column, item: Column) -> list[Column]:
    """Fields ``out`` and ``done`` of a fold's state with ``item`` added: full lists of CHUNK are put by, so no step copies a long one."""
    out = F.concat(state["out"], F.array(item))
    full = F.size(out) >= CHUNK
    return [F.when(full, F.slice(out, 1, 0)).otherwise(out).alias("out"), F.when(full, F.concat(state["done"], F.array(out))).otherwise(state["done"]).alias("done")]


def _lists(kind: str) -> list[Column]:
    return [F.array().cast(f"array<{kind}>").alias("out"), F.array().cast(f"array<array<{kind}>>").alias("done")]


def _all(state: Column) -> Column:
    return F.concat(F.flatten(state["done"]), state["out"])


def _starts(text: Column, pattern: str, hits: Column) -> Column:
    """Code-point offsets of the matches: the pieces between matches and the matches before each add up to them."""
    sizes = F.transform(F.split(text, pattern, -1), F.length)
    zero = F.struct(F.lit(0).alias("at"), *_lists("int"))
    step = lambda a, x: F.when(x["h"].isNull(), a).otherwise(
        F.struct((a["at"] + x["n"] + F.length(x["h"])).alias("at"), *_appended(a, a["at"] + x["n"]))
    )
    return F.aggregate(F.arrays_zip(sizes.alias("n"), hits.alias("h")), zero, step, _all)


def _luhn(value: Column) -> Column:
    digits = F.regexp_replace(value, r"[\x20-]", "")
    n = F.length(digits)
    digit = lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int")
    add = lambda s, i: s + F.when(i % 2 == 1, digit(i)).when(digit(i) > 4, 2 * digit(i) - 9).otherwise(2 * digit(i))
    return F.when(n.between(16, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(False)


def _good(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == "card":
        return _luhn(value)
    return F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)


SPAN = "struct<kind:string,start:int,end:int,value:string>"


def _spans(kind: str, text: Column) -> Column:
    pattern = PATTERNS[kind]
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    made = F.zip_with(
        _starts(text, pattern, hits), hits, lambda s, h: F.struct(F.lit(kind).alias("kind"), s.alias("start"), (s + F.length(h)).alias("end"), h.alias("value"))
    )
    there = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(HINTS[kind])
    return F.when(there, F.filter(made, lambda x: _good(kind, x["value"]))).otherwise(F.array()).cast(f"array<{SPAN}>")


def detected(docs: DataFrame) -> DataFrame:
    """``docs`` (null text: empty) with ``spans``: kind, start, end, value of the base patterns, by kind as listed, then start."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn("spans", F.concat(*(_spans(k, text) for k in KINDS)))


def _windows(found: DataFrame) -> DataFrame:
    """(row, s, base, part): each span and the part of the text, from offset ``base`` on, that holds RADIUS code points on both its sides.

    CHUNK spans that stand next to each other share a part, so a text isn't carried along for each of its spans. Words that
    reach over a part's edges are whole.
    """
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))
    some = found.where(F.size("spans") > 0).select("row", "text", F.explode(F.array(ordered)).alias("all"))
    chunks = F.transform(F.sequence(F.lit(0), F.size("all") - 1, F.lit(CHUNK)), lambda i: F.slice("all", i + 1, CHUNK))
    low, high = F.greatest(F.lit(0), F.get("c", F.lit(0))["start"] - RADIUS), F.array_max(F.transform("c", lambda s: s["end"])) + RADIUS
    part = some.select("row", "text", F.explode(chunks).alias("c")).select("row", "text", "c", low.alias("low"), high.alias("high"))
    cut = lambda at: F.substring("text", at, F.lit(2)).rlike(f"^{LETTER}{{2}}")  # noqa: E731  (a word goes on over the edge)
    before = F.when((F.col("low") > 0) & cut(F.col("low")), F.regexp_extract(F.substring("text", F.lit(1), F.col("low")), f"(?<!{LETTER}){LETTER}++$", 0)).otherwise("")
    after = F.when(cut(F.col("high")), F.regexp_extract(F.substring("text", F.col("high") + 1, F.length("text")), f"^{LETTER}++", 0)).otherwise("")
    part = part.select("row", "c", "low", before.alias("before"), F.substring("text", F.col("low") + 1, F.col("high") - F.col("low")).alias("mid"), after.alias("after"))
    return part.select("row", F.explode("c").alias("s"), (F.col("low") - F.length("before")).alias("base"), F.concat("before", "mid", "after").alias("part"))


def _sides() -> tuple[Column, Column, Column, Column]:
    """Of a window: where its span's left side starts and its right side ends in ``part``, and both sides, RADIUS code points at most."""
    low, high = F.greatest(F.lit(0), F.col("s.start") - RADIUS) - F.col("base"), F.col("s.end") + RADIUS - F.col("base")
    return low, high, F.substring("part", low + 1, F.col("s.start") - F.col("base") - low), F.substring("part", F.col("s.end") - F.col("base") + 1, F.lit(RADIUS))


def _entities(windows: DataFrame) -> DataFrame:
    """(row, kind, value, around): the entities of each row once; ``around`` stands for the text about the first place."""
    _, _, left, right = _sides()
    first = F.struct(F.col("s.start").alias("at"), F.xxhash64(left, right).alias("around")).alias("first")
    return windows.select("row", "s.kind", "s.value", first).groupBy("row", "kind", "value").agg(F.min("first")["around"].alias("around"))


def _near(windows: DataFrame) -> DataFrame:
    """(kind, value, term, context) of the whole words that stand within RADIUS code points of a span or reach in there; a context is one side."""
    low, high, left, right = _sides()
    cut = lambda at: F.substring("part", at, F.lit(2)).rlike(f"^{LETTER}{{2}}")
    before = F.when((low > 0) & cut(low), F.regexp_extract(F.substring("part", F.lit(1), low), f"(?<!{LETTER}){LETTER}++$", 0)).otherwise("")
    after = F.when(cut(high), F.regexp_extract(F.substring("part", high + 1, F.length("part")), f"^{LETTER}++", 0)).otherwise("")
    sides = windows.select("s.kind", "s.value", F.explode(F.array(
        F.struct(F.xxhash64(left).alias("context"), F.concat(before, left).alias("side")),
        F.struct(F.xxhash64(right).alias("context"), F.concat(right, after).alias("side")),
    )).alias("c"))
    return sides.select("kind", "value", "c.context", F.explode(_terms(F.col("c.side"))).alias("term")).distinct()


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _together(docs: DataFrame, found: DataFrame, support: int, theta: float) -> tuple[DataFrame, DataFrame]:
    """Rows in which an entity and a term stand, anywhere, and the pairs (kind, value, term, share, near) that reach ``theta``.

    What is left out before the join can't reach it: with n_both <= n_entity, the share is at most
    log(n_docs / n_term) / log(n_docs / n_entity), and pairs of under ``support`` rows need as many sides near the entity.
    """
    windows = _windows(found)
    entities = parked(_entities(windows), "entities")
    near = parked(_near(windows).groupBy("kind", "value", "term").agg(F.count("*").alias("near")).where(F.col("near") >= support), "near")
    total = docs.agg(F.count("*").alias("n_docs"))
    frequency = parked(docs.select(F.explode(_terms(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term")), "terms")

    counts = entities.groupBy("kind", "value").agg(F.count("*").alias("n_entity")).join(near.select("kind", "value", F.lit(True).alias("few")).distinct(), ["kind", "value"], "left")
    most = F.col("n_docs") * F.pow(F.col("n_entity") / F.col("n_docs"), F.lit(theta)) * (1 + 1e-9)
    able = counts.crossJoin(F.broadcast(total)).where((F.col("n_entity") < F.col("n_docs")) & ((F.col("n_entity") >= support) | F.col("few")))  # one row
    able = parked(able.select("kind", "value", "n_entity", "n_docs", F.coalesce("few", F.lit(False)).alias("few"), most.alias("most")), "able")
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    held = entities.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(able.select("*", salt), ["kind", "value", "salt"]).drop("salt")
    held = parked(held, "held")

    limit = able.agg(F.coalesce(F.max("most"), F.lit(0.0)).alias("limit"))
    common = frequency.orderBy(F.desc("n_term")).limit(COMMON).crossJoin(F.broadcast(limit)).where("n_term > limit").select("term")
    rare = frequency.crossJoin(F.broadcast(limit)).where("n_term <= limit").drop("limit")
    words = found.join(held.select("row").distinct(), "row", "left_semi").select("row", F.explode(_terms(F.col("text"))).alias("term"))
    words = words.join(F.broadcast(common), "term", "left_anti").join(rare, "term")  # at most COMMON rows
    rows = words.join(held, "row").where((F.col("n_term") <= F.col("most")) & (F.col("few") | (F.col("n_term") >= support)))
    rows = parked(rows.select("row", "kind", "value", "around", "term", "n_entity", "n_term", "n_docs"), "together")

    both = rows.groupBy("kind", "value", "term").agg(F.count("*").alias("n_both"), *(F.min(c).alias(c) for c in ("n_entity", "n_term", "n_docs")))
    pmi = F.log(F.col("n_both") * F.col("n_docs") / (F.col("n_entity") * F.col("n_term")))
    share = pmi / F.log(F.col("n_docs") / F.col("n_entity"))
    scored = both.withColumn("share", share).where(F.col("share") >= theta).join(near, ["kind", "value", "term"], "left")
    scored = scored.where((F.col("n_both") >= support) | F.col("near").isNotNull())
    return rows, parked(scored.select("kind", "value", "term", "share", "near"), "scored")


def _places(texts: DataFrame) -> DataFrame:
    """(row, term, start, end, context) of every word of the texts; ``context`` stands for the words about it and what is between them.

    Offsets add up within CHUNK words, and then from chunk to chunk, so a long text's arrays aren't copied for each word.
    """
    words = F.regexp_extract_all("text", F.lit(TERM), F.lit(0))
    once = lambda c: F.explode(F.array(c))  # noqa: E731  (evaluated here, not anew wherever it is read)
    both = texts.select("row", once(F.zip_with(F.split("text", TERM, -1), words, lambda g, w: F.struct(g.alias("g"), w.alias("w")))).alias("all"))
    told = both.select("row", once(F.transform("all", lambda x, i: F.struct(
        F.length(x["g"]).alias("n"), F.length(x["w"]).alias("m"), F.lower(x["w"]).alias("w"),
        F.xxhash64(F.slice("all", F.greatest(F.lit(1), i + 1 - NEIGHBOURS), NEIGHBOURS + 1 + F.least(i, F.lit(NEIGHBOURS)))).alias("context"),
    ))).alias("all"))
    chunked = told.select("row", once(F.transform(F.sequence(F.lit(0), (F.size("all") - 1).cast("int"), F.lit(CHUNK)), lambda i: F.slice("all", i + 1, CHUNK))).alias("chunks"))
    total = lambda a, x: a + x["n"] + F.coalesce(x["m"], F.lit(0))
    sized = chunked.select("row", "chunks", once(F.transform("chunks", lambda c: F.aggregate(c, F.lit(0), total))).alias("sizes"))
    one = sized.select("row", "sizes", F.posexplode("chunks").alias("i", "c"))
    one = one.select("row", "c", F.aggregate(F.slice("sizes", 1, F.col("i")), F.lit(0), lambda a, n: a + n).alias("base"))
    zero = F.struct(F.col("base").alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda a, x: F.struct((a["at"] + x["n"] + F.coalesce(x["m"], F.lit(0))).alias("at"), F.concat(a["out"], F.array(a["at"] + x["n"])).alias("out"))
    one = one.select("row", "c", once(F.aggregate("c", zero, step)["out"]).alias("starts"))
    out = one.select("row", F.explode(F.arrays_zip("c", "starts")).alias("x"))
    return out.select("row", F.col("x.c.w").alias("term"), F.col("x.starts").alias("start"), (F.col("x.starts") + F.col("x.c.m")).alias("end"), F.col("x.c.context").alias("context")).where("term is not null")


def _term_spans(docs: DataFrame, found: DataFrame, support: int, theta: float, remove: float) -> DataFrame:
    """(row, terms): every place of a term that discloses an entity, in the rows that hold the entity.

    A pair's context in a row is the text about the entity's first place and about the term's; a pair that ``support``
    sides near the entity bear out needs no more.
    """
    rows, scored = _together(docs, found, support, theta)
    hits = parked(rows.select("row", "kind", "value", "around", "term").join(scored, ["kind", "value", "term"]), "hits")
    wanted = hits.select("row", "term").distinct()
    texts = found.select("row", "text").join(hits.select("row").distinct(), "row", "left_semi")
    places = parked(_places(texts).join(wanted, ["row", "term"], "left_semi"), "places")
    first = places.groupBy("row", "term").agg(F.min_by("context", "start").alias("context"))
    borne = hits.join(first, ["row", "term"]).groupBy("kind", "value", "term").agg(F.countDistinct(F.xxhash64("around", "context")).alias("contexts"), F.max("near").alias("near"))
    borne = borne.where((F.col("contexts") >= support) | (F.col("near") >= support)).select("kind", "value", "term")
    kind = F.when(F.col("share") >= remove, F.lit("removed")).otherwise(F.lit("term"))
    kinds = hits.join(borne, ["kind", "value", "term"]).groupBy("row", "term").agg(F.max(kind).alias("kind"))
    return places.join(kinds, ["row", "term"]).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("terms"))  # of one text, so bounded by it


def _joined(spans: Column, kind: str = "kind") -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x[kind], x["start"], x["end"])), ",")


SPANNED = "struct<start:int,end:int,kind:string>"


def _free(spans: Column, terms: Column) -> Column:
    """The terms that overlap no span, by two passes over all of them in order: spans that start before, then those after."""
    one = lambda c, kind: F.transform(c, lambda x: F.struct(x["start"].alias("start"), kind.alias("term"), x["end"].alias("end"), x["kind"].alias("kind")))
    order = F.array_sort(F.concat(one(spans, F.lit(0)), one(terms, F.lit(1))))
    kind = "struct<start:int,term:int,end:int,kind:string>"
    passed = lambda array, edge, far, hit: F.aggregate(array, F.struct(F.lit(edge).alias("edge"), *_lists(kind)), lambda a, x: F.when(
        x["term"] == 0, F.struct(far(a["edge"], x).alias("edge"), *_appended(a, x))
    ).when(hit(a["edge"], x), a).otherwise(F.struct(a["edge"].alias("edge"), *_appended(a, x))), _all)
    order = passed(order, -1, lambda e, x: F.greatest(e, x["end"]), lambda e, x: e > x["start"])
    order = passed(F.reverse(order), 2**31 - 1, lambda e, x: F.least(e, x["start"]), lambda e, x: e < x["end"])
    left = F.filter(F.reverse(order), lambda x: x["term"] == 1)
    return F.transform(left, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))


def scanned(docs: DataFrame, support: int = SUPPORT, theta: float = THETA, remove: float = REMOVE) -> DataFrame:
    """Every column of ``docs`` but those named spans, terms and row, with ``spans`` (base) and ``terms`` (start, end, kind: "term" or "removed").

    Terms that overlap a base span are left to it. Null and empty texts have none; repeated rows are rows of their own.
    """
    docs = docs.drop("spans", "terms", "row")
    found = parked(detected(docs).withColumn("row", F.monotonically_increasing_id()), "pii")
    terms = parked(_term_spans(docs, found.withColumn("text", F.coalesce("text", F.lit(""))), support, theta, remove), "term-spans")
    out = found.join(terms, "row", "left").drop("row")
    none = F.array().cast(f"array<{SPANNED}>")
    return out.withColumn("terms", F.when(F.size("terms") > 0, _free(F.col("spans"), F.col("terms"))).otherwise(none))


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans ("kind:start:end" of base spans, then terms), n_terms."""
    out = scanned(docs.select("doc_id", "text"), **options)
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    base = _joined(F.col("spans"))
    terms = F.transform("terms", lambda t: F.struct(F.lit("term").alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    every = F.concat(F.transform("spans", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))), terms)
    return out.select("doc_id", *(count(k) for k in KINDS), F.sha2(base, 256).alias("base_sha256"), _joined(every).alias("spans"), F.size("terms").cast("bigint").alias("n_terms"))


def _disjoint(spans: Column) -> Column:
    """Spans by start, those that overlap made one; the first one's kind stays."""
    none = F.lit(None).cast(SPANNED)
    zero = F.struct(none.alias("last"), *_lists(SPANNED))
    wider = lambda a, x: F.struct(a["start"].alias("start"), F.greatest(a["end"], x["end"]).alias("end"), a["kind"].alias("kind"))
    kept = lambda a: [a["out"].alias("out"), a["done"].alias("done")]
    step = lambda a, x: F.when(a["last"].isNull(), F.struct(x.alias("last"), *kept(a))).when(
        x["start"] < a["last"]["end"], F.struct(wider(a["last"], x).alias("last"), *kept(a))
    ).otherwise(F.struct(x.alias("last"), *_appended(a, a["last"])))
    return F.aggregate(F.array_sort(spans), zero, step, lambda a: F.when(a["last"].isNull(), _all(a)).otherwise(F.concat(_all(a), F.array(a["last"]))))


def _said(kind: Column) -> Column:
    return F.when(kind == "removed", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(kind), F.lit("]")))


def _replaced(text: str, cut: str) -> Column:
    """``text`` with the disjoint spans ``cut`` replaced. CHUNK spans at a time take their part of the text, so a long one isn't read anew for each."""
    end = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(cut, i - 1)["end"])
    part = lambda i: F.struct(
        end(i).alias("base"), F.slice(cut, i + 1, CHUNK).alias("c"),
        F.substring(text, end(i) + 1, F.get(cut, F.least(i + CHUNK, F.size(cut)) - 1)["end"] - end(i)).alias("part"),
    )
    parts = F.transform(F.sequence(F.lit(0), F.size(cut) - 1, F.lit(CHUNK)), part)

    def told(r: Column) -> Column:
        before = lambda j: F.when(j == 0, r["base"]).otherwise(F.get(r["c"], j - 1)["end"])
        return F.array_join(F.transform(r["c"], lambda x, j: F.concat(F.substring(r["part"], before(j) - r["base"] + 1, x["start"] - before(j)), _said(x["kind"]))), "")

    tail = F.substring(text, F.element_at(cut, -1)["end"] + 1, F.length(text))
    return F.when(F.size(cut) == 0, F.col(text)).otherwise(F.concat(F.array_join(F.transform(parts, told), ""), tail))


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with base spans replaced by "[KIND]", terms generalised to "[TERM]" or removed; all columns kept, null texts stay null.

    The other columns travel as one, so their names clash with none of the operator's own.
    """
    others = [c for c in docs.columns if c != "text"]
    out = scanned(docs.select("text", F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in others)).alias("others")), **options)
    plain = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    out = out.withColumn("cut", _disjoint(F.concat(plain("spans"), plain("terms"))))
    out = out.select("others", _replaced("text", "cut").alias("text"))
    return out.select(*("text" if c == "text" else F.col("others")[c].alias(c) for c in docs.columns))
