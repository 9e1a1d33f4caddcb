"""JSON Lines, session logs, Markdown trees, file inventories and exports (SRC01, SRC02, SRC05, SRC07, SRC08, SRC13, SRC16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Rows of JSON Lines under an explicit schema: one pass, no inference. Blank lines give no row."""
    return spark.read.schema(schema).option("lineSep", "\n").json(path)


def line(*columns: str) -> Column:
    """One object of the columns, nulls kept; the Unicode line separators are escaped, so every reader sees one line an object."""
    out = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    for char, escape in (("\u0085", "\\u0085"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        out = F.replace(out, F.lit(char), F.lit(escape))
    return out


def write(df: DataFrame, path: str, compression: str | None = None) -> None:
    writer = df.select(line(*df.columns).alias("value")).write
    (writer.option("compression", compression) if compression else writer).text(path)


def session_log(spark: SparkSession, path: str, codec: str | None = None) -> DataFrame:
    """(file, ord, type, data): the events of session logs in their order (SRC08).

    Lines that are no JSON object are passed over, blank ones too; a compressed log is read through its codec (by its
    ending: .gz, .zst, .bz2). ``ord`` counts the events of a file that are kept.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    event = F.from_json("value", "type string, data string", {"mode": "PERMISSIVE"})
    good = lines.where(F.trim("value").startswith("{")).where(F.try_parse_json("value").isNotNull()).select("file", "at", event.alias("e")).where("e.type is not null")
    return good.select("file", F.row_number().over(Window.partitionBy("file").orderBy("at")).alias("ord"), "e.type", "e.data")


def markdown_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of all Markdown files under ``root``; parts that begin with an underscore are left out."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,mdx}").text(root)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.where(~F.col("path").rlike("/_"))


def role(path: Column) -> Column:
    """What a file of a documentation tree is: documentation, asset, navigation, data, code, or support."""
    low = F.lower(path)
    return (
        F.when(low.rlike(r"(?:^|/)(?:nav|sidebars?|toc|mkdocs|summary)[^/]*\.(?:ya?ml|json|js|md)$"), "navigation").when(low.rlike(r"\.mdx?$|\.rst$"), "documentation")
        .when(low.rlike(r"\.(?:png|jpe?g|gif|svg|webp|ico|mp4|pdf)$"), "asset").when(low.rlike(r"\.(?:json|ya?ml|csv|toml)$"), "data").when(low.rlike(r"\.(?:py|js|ts|tsx|jsx|go|rs|java|sh)$"), "code").otherwise("support")
    )


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes, sha256, role) of the files under ``root`` (SRC13); names that begin with an underscore or a dot are hidden files to Spark."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), role(F.col("path")).alias("role"))
