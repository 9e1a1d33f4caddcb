"""Digests of a tree of files, level by level, so that one changed file names its path (HLP16, PRV01).

A folder's digest sums up those of what it holds: the entries' SHA-256, taken as four numbers of 60 bits, are added, which
needs no order and is combined before a shuffle, so a folder of any size is an aggregate, not a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import parked

#: Names that an inventory leaves out, as patterns of a whole path segment.
IGNORED = (r"\.git", r"\.DS_Store", "__pycache__", "node_modules", r".*\.tmp", r".*~")


def kept(path: Column, ignored: tuple[str, ...] = IGNORED) -> Column:
    return ~path.rlike(f"(^|/)({'|'.join(ignored)})(/|$)")


def _sum_digest(entry: Column) -> Column:
    """The digest of a group of entries."""
    h = F.sha2(entry, 256)
    part = lambda k: F.sum(F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return F.sha2(F.concat_ws(":", F.count("*").cast("string"), *(part(k) for k in range(4))), 256)


def digests(files: DataFrame, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """(path, kind, level, digest, files, bytes) of every file (path, content) and folder; the root is the path ""."""
    leaf = files.where(kept(F.col("path"), ignored)).select(
        "path", F.lit("file").alias("kind"), F.size(F.split("path", "/")).alias("level"), F.sha2("content", 256).alias("digest"), F.lit(1).cast("bigint").alias("files"), F.octet_length("content").cast("bigint").alias("bytes")
    )
    leaf = parked(leaf, "leaves")
    deepest = leaf.agg(F.max("level")).first()[0] or 0
    out, above = leaf, None
    for level in range(deepest, 0, -1):
        rows = leaf.where(F.col("level") == level)
        rows = rows if above is None else rows.union(above)
        parent = F.regexp_replace("path", "/?[^/]*$", "")
        entry = F.concat_ws("\0", "kind", F.regexp_extract("path", "([^/]*)$", 1), "digest")
        above = rows.groupBy(parent.alias("path")).agg(_sum_digest(entry).alias("digest"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))
        above = parked(above.select("path", F.lit("folder").alias("kind"), F.lit(level - 1).alias("level"), "digest", "files", "bytes"), "folders")
        out = out.union(above)
    return out


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, kind, change) of what differs between two trees: added, removed, changed. A folder whose digest holds says that nothing in it differs."""
    both = before.select("path", "kind", F.col("digest").alias("a")).join(after.select("path", "kind", F.col("digest").alias("b")), ["path", "kind"], "full")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select("path", "kind", change.alias("change")).where("change IS NOT NULL")


def collisions(files: DataFrame) -> DataFrame:
    """(path, problem) of paths that can't lie in one workspace (SRC15): unsafe ones, such as differ in case only, files where a folder is."""
    segments = F.split("path", "/")
    unsafe = F.col("path").startswith("/") | F.exists(segments, lambda s: s.isin("", ".", "..")) | F.col("path").rlike(r"[\x00\\]|^[A-Za-z]:")
    rows = files.select("path").distinct()
    inner = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(segments) - 1)), lambda i: F.array_join(F.slice(segments, F.lit(1), i), "/"))
    folders = rows.where(F.size(segments) > 1).select(F.explode(inner).alias("path")).distinct()
    case = rows.groupBy(F.lower("path").alias("low")).agg(F.count("*").alias("n")).where("n > 1").select("low")
    return (
        rows.where(unsafe).select("path", F.lit("unsafe").alias("problem"))
        .union(rows.withColumn("low", F.lower("path")).join(case, "low", "left_semi").select("path", F.lit("case")))
        .union(rows.join(folders, "path", "left_semi").select("path", F.lit("folder")))
    )
