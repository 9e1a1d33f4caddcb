"""Text functions as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default stop words; every function that uses them takes another list.
STOP_WORDS = (
    "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few "
    "for from further had has have having he her here hers him his how if in into is it its itself just me more most my no nor not now of off on once only or other our out "
    "over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which "
    "while who whom why will with would you your"
).split()

#: Letters that are not ASCII become one word character outside the token alphabet, so word boundaries agree everywhere.
MASK = r"[^\x00-\x7F\p{P}\p{S}\p{Z}\p{C}\p{M}]"
TOKEN = r"\b[a-z0-9][a-z0-9_.:/-]+\b"


def fold(x: Column) -> Column:
    """Case folding: lower case with sharp s as ss."""
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")


def tokens(text: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """Lower-cased tokens of two or more characters, stop words left out (LEX01)."""
    masked = F.regexp_replace(F.lower(text), MASK, "Z")
    found = F.regexp_extract_all(masked, F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*stop_words)) if stop_words else found


def with_bigrams(words: Column) -> Column:
    """Words and pairs of neighbours; stop words are gone by then, so a pair may span one."""
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b)))
    return F.concat(words, F.coalesce(pairs, F.array().cast("array<string>")))


def terms(text: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    return with_bigrams(tokens(text, stop_words))


def paragraph_chunks(text: Column, size: int = 1400, overlap: int = 180) -> Column:
    """Greedy packing of blank-line paragraphs into chunks of ``size``, each with the end of the one before (CHK01)."""
    paragraphs = F.filter(F.transform(F.split(text, "\n\n", -1), strip), lambda p: p != "")
    slices = lambda p: F.transform(F.sequence(F.lit(0), ((F.length(p) - 1) / size).cast("int")), lambda i: F.substring(p, i * size + 1, F.lit(size)))
    pieces = F.flatten(F.transform(paragraphs, slices))
    zero = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, piece: Column) -> Column:
        cur = a["cur"]
        full = (cur != "") & (F.length(cur) + F.length(piece) + 2 > size)
        tail = strip(F.right(cur, F.lit(overlap)))
        joined = lambda x: F.when(x != "", F.concat(x, F.lit("\n\n"), piece)).otherwise(piece)
        return F.when(full, F.struct(joined(tail).alias("cur"), F.concat(a["out"], F.array(strip(cur))).alias("out"))).otherwise(
            F.struct(joined(cur).alias("cur"), a["out"].alias("out"))
        )

    return F.aggregate(pieces, zero, step, lambda a: F.when(strip(a["cur"]) != "", F.concat(a["out"], F.array(strip(a["cur"])))).otherwise(a["out"]))


#: What Unicode calls white space.
WHITE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def packed(text: str, size: int = 1400, overlap: int = 180) -> list[str]:
    """The chunks of :func:`paragraph_chunks` for one text in a worker, in time proportional to it."""
    chunks, current = [], ""
    for paragraph in text.split("\n\n"):
        paragraph = paragraph.strip(WHITE)
        for at in range(0, len(paragraph), size):
            piece = paragraph[at : at + size]
            if current and len(current) + len(piece) + 2 > size:
                chunks.append(current.strip(WHITE))
                current = current[-overlap:].strip(WHITE)
            current = f"{current}\n\n{piece}" if current else piece
    if current.strip(WHITE):
        chunks.append(current.strip(WHITE))
    return chunks


def heading_slug(x: Column) -> Column:
    """Template tags, HTML tags and marks go; lower case; words joined by hyphens (TXT02)."""
    x = F.regexp_replace(x, r"\{%.*?%\}", "")
    x = F.regexp_replace(x, r"<[^>]+>", "")
    x = F.lower(F.regexp_replace(x, r"[`*_~]", ""))
    x = F.regexp_replace(x, r"[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(strip(x), r"[\s-]+", "-"), r"^-+|-+$", "")


def html_text(html: Column) -> Column:
    """Visible text: a line feed at block tags, entities decoded, URLs dropped, blanks and blank lines squeezed (TXT01)."""
    x = F.regexp_replace(html, r"(?i)</?(?:p|div|section|article|li|ul|ol|br|h[1-6]|pre|tr|table|blockquote)\b[^>]*>", "\n")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", "")
    x = F.regexp_replace(x, r"<[^>]*>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    x = F.regexp_replace(x, r"https?://\S+", "")
    x = F.regexp_replace(x, r"[ \t]+", " ")
    return F.trim(F.regexp_replace(x, r"\s*\n\s*", "\n"))


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, slashes collapsed, no query and no fragment (TXT07)."""
    part = lambda p: F.try_parse_url(url, F.lit(p))
    path = F.regexp_replace(F.coalesce(part("PATH"), F.lit("")), "/+", "/")
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    return F.concat(F.lower(part("PROTOCOL")), F.lit("://"), host, F.when(path == "", "/").otherwise(path))


def stable_id(prefix: str, *parts: Column) -> Column:
    """``prefix`` and 24 hex digits of the SHA-256 of the parts, joined by NUL."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 24))
