"""Packages of tables that change as one (SRC12): versions, a manifest with the digest of every file, one atomic step.

A writer puts its files into a version folder of its own and the manifest after them. What makes the version the package
is the replacement of one small file, CURRENT. A writer that dies before leaves the old package as it was; a reader that
began with the old version reads on in it until it is pruned.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import delete, exists, listed, read_text, write_text

MANIFEST = "table string, file string, bytes long, sha256 string"


def digests(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """(table, file, bytes, sha256) of a table's files as they lie there, read where they lie."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(f"{folder}/{table}")
    name = F.regexp_extract("path", "([^/]+)$", 1)
    return files.select(F.lit(table).alias("table"), name.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write(spark: SparkSession, folder: str, tables: dict[str, tuple[DataFrame, list[str]]], file_rows: int = 100_000) -> str:
    """Write tables, each sorted by its columns as JSON Lines, and make them the package. Files hold ``file_rows`` rows at most."""
    version = f"v-{uuid.uuid4().hex}"
    here = f"{folder}/{version}"
    for name, (df, order) in tables.items():
        df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", file_rows).option("ignoreNullFields", False).option("compression", "gzip").json(f"{here}/{name}")
        schema = spark.createDataFrame([(df.schema.json(),)], "value string")
        schema.coalesce(1).write.text(f"{here}/_schema/{name}")
    made = [digests(spark, here, name) for name in tables]
    whole = made[0]
    for m in made[1:]:
        whole = whole.union(m)
    whole.coalesce(1).write.json(f"{here}/_manifest")  # a row a file
    publish(spark, folder, version)
    return version


def publish(spark: SparkSession, folder: str, version: str) -> None:
    write_text(spark, f"{folder}/CURRENT", version)


def current(spark: SparkSession, folder: str) -> str:
    version = read_text(spark, f"{folder}/CURRENT")
    if not version:
        raise FileNotFoundError(f"{folder} holds no package")
    return f"{folder}/{version.strip()}"


def manifest(spark: SparkSession, version: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{version}/_manifest")


def read(spark: SparkSession, version: str, table: str) -> DataFrame:
    schema = StructType.fromJson(json.loads(spark.read.text(f"{version}/_schema/{table}").first()[0]))
    return spark.read.schema(schema).json(f"{version}/{table}")


def damaged(spark: SparkSession, version: str) -> DataFrame:
    """(table, file, problem) of files that aren't as the manifest says."""
    said = manifest(spark, version)
    names = [n for n in listed(spark, version) if not n.startswith("_")]
    there = None
    for name in names:
        one = digests(spark, version, name)
        there = one if there is None else there.union(one)
    there = there if there is not None else said.limit(0)
    both = said.join(there.select("table", "file", F.col("bytes").alias("b"), F.col("sha256").alias("s")), ["table", "file"], "full")
    problem = F.when(F.col("s").isNull(), "missing").when(F.col("sha256").isNull(), "extra").when((F.col("s") != F.col("sha256")) | (F.col("b") != F.col("bytes")), "changed")
    return both.select("table", "file", problem.alias("problem")).where("problem IS NOT NULL")


def prune(spark: SparkSession, folder: str) -> None:
    """Delete all versions but the current one, and what dead writers left."""
    keep = current(spark, folder).rsplit("/", 1)[1]
    for name in listed(spark, folder):
        if name != keep and name.startswith("v-") and exists(spark, f"{folder}/{name}"):
            delete(spark, f"{folder}/{name}")


def combined(eligible: DataFrame, source: DataFrame, on: list[str]) -> DataFrame:
    """``source`` rows of the eligible keys. An eligible key that stands twice, or that the source lacks, is an error where it is met."""
    keys = eligible.groupBy(*on).agg(F.count("*").alias("_n"))
    both = keys.join(source.withColumn("_there", F.lit(True)), on, "left")
    said = F.concat_ws(", ", *(F.col(c).cast("string") for c in on))
    wrong = F.when(F.col("_n") > 1, F.concat(F.lit("eligible twice: "), said)).when(F.col("_there").isNull(), F.concat(F.lit("not in the source: "), said))
    return both.where(F.when(wrong.isNotNull(), F.raise_error(wrong).cast("boolean")).otherwise(True)).drop("_n", "_there")
