"""References between pages as Column expressions: joining with a base, dot segments, canonical paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that percent-decoding yields, as text: %XX of a path is decoded as UTF-8, what isn't a code stays.
_ESCAPE = "%(?![0-9A-Fa-f]{2})"


def unquoted(x: Column) -> Column:
    """Percent-decoding; a plus stays a plus, and a percent sign that no code follows stays as it is."""
    whole = F.regexp_replace(F.regexp_replace(x, _ESCAPE, "%25"), r"\+", "%2B")
    return F.when(x.contains("%"), F.url_decode(whole)).otherwise(x)


def scheme(x: Column) -> Column:
    return F.lower(F.regexp_extract(x, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def authority(x: Column) -> Column:
    return F.regexp_extract(x, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def host(x: Column) -> Column:
    return F.lower(F.regexp_extract(authority(x), r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1))


def path(x: Column) -> Column:
    return F.regexp_extract(x, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def fragment(x: Column) -> Column:
    return F.regexp_extract(x, "#(.*)$", 1)


def without_dots(x: Column) -> Column:
    """A path without its "." and ".." segments; what climbs above the root stays at the root."""
    parts = F.split(x, "/", -1)

    def step(a: Column, s: Column) -> Column:
        back = F.when(F.size(a) > 1, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a)
        return F.when(s == ".", a).when(s == "..", back).otherwise(F.array_append(a, s))

    folded = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.slice(parts, 1, 1), step)
    folder = F.element_at(parts, -1).isin(".", "..")
    return F.when(F.regexp_like(x, F.lit(r"(^|/)\.\.?(/|$)")), F.array_join(F.when(folder, F.array_append(folded, F.lit(""))).otherwise(folded), "/")).otherwise(x)


def joined(base: Column, target: Column) -> Column:
    """``target`` as seen from the page at ``base``, both as text; a target with a scheme of its own stays as it is."""
    target = F.btrim(target)
    root = F.concat(scheme(base), F.lit("://"), authority(base))
    asked = F.regexp_extract(target, r"^[^?#]*(.*)$", 1)
    mine, own = path(base), path(target)
    folder = F.regexp_replace(mine, "[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(target.startswith("//"), F.concat(scheme(base), F.lit(":"), target))
        .when(target == "", F.regexp_extract(base, "^[^#]*", 0))
        .when(target.startswith("#"), F.concat(F.regexp_extract(base, "^[^#]*", 0), target))
        .when(target.startswith("?"), F.concat(root, mine, target))
        .when(target.startswith("/"), F.concat(root, without_dots(own), asked))
        .otherwise(F.concat(root, without_dots(F.concat(folder, own)), asked))
    )


def canonical_path(x: Column) -> Column:
    """The path of a reference as an address of a page: decoded, one slash at the front, none at the end, in lower case."""
    once = F.regexp_replace(F.concat(F.lit("/"), unquoted(path(x))), "/+", "/")
    bare = F.lower(F.regexp_replace(once, "/+$", ""))
    return F.when(bare == "", "/").otherwise(bare)
