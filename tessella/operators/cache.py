"""Vectors by content: what has been encoded before, by any session, isn't encoded again (SRC09).

A unit's address is the SHA-256 of the model's name and the text. The cache of a model is a folder of batches in the shared
folder; a batch is written beside it and renamed into it when it is whole, so a reader sees whole batches alone, and a run
that dies leaves nothing that counts. Two runs at once may encode the same text: one of the two rows is taken.
"""

from __future__ import annotations

import uuid
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import delete, exists, listed, parked, rename, shared_dir
from .vector import EmbeddingProvider

SCHEMA = "digest string, embedding array<double>"


def address(name: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(name), F.lit("\0"), F.coalesce(text, F.lit(""))), 256)


class ContentCache:
    """The vectors of ``provider``'s model. ``encoded`` is how many texts the last call had to encode."""

    def __init__(self, spark: SparkSession, provider: EmbeddingProvider, folder: str | None = None):
        self.spark, self.provider, self.encoded = spark, provider, 0
        self.folder = folder or f"{shared_dir(spark)}/tessella-vectors-{sha256(provider.name.encode()).hexdigest()[:16]}"

    def stored(self) -> DataFrame:
        """(digest, embedding) as it was written."""
        batches = [f"{self.folder}/{n}" for n in listed(self.spark, self.folder) if n.startswith("batch-")]
        return self.spark.read.schema(SCHEMA).parquet(*batches) if batches else self.spark.createDataFrame([], SCHEMA)

    def known(self) -> DataFrame:
        """The same, a row a digest."""
        return self.stored().groupBy("digest").agg(F.first("embedding").alias("embedding"))

    def vectors(self, units: DataFrame, key: str, text: str = "text") -> DataFrame:
        """``units``, whose keys differ, with ``embedding`` in place of the text. Only texts that the cache lacks are encoded, each once.

        What is compared are digests. Where a text is missing, the first twenty bits of its digest are (2 ** 20 rows at most,
        which are broadcast), so of the texts that are known nearly none leaves its place.
        """
        addressed = units.withColumn("digest", address(self.provider.name, F.col(text)))
        wanted = parked(addressed.select(key, "digest"), "addressed")
        missing = wanted.groupBy("digest").agg(F.min(key).alias(key)).join(self.stored().select("digest"), "digest", "left_anti")
        missing = parked(missing, "missing")
        near = missing.select(F.substring("digest", 1, 5).alias("prefix")).distinct()
        maybe = addressed.withColumn("prefix", F.substring("digest", 1, 5)).join(F.broadcast(near), "prefix", "left_semi")
        texts = maybe.join(missing, [key, "digest"], "left_semi").select("digest", F.coalesce(text, F.lit("")).alias("text"))
        staged = f"{self.folder}/staged-{uuid.uuid4().hex}"
        self.provider.encode(texts, "digest").select("digest", "embedding").write.parquet(staged)
        self.encoded = self.spark.read.schema(SCHEMA).parquet(staged).count()
        if self.encoded:
            rename(self.spark, staged, f"{self.folder}/batch-{uuid.uuid4().hex}")
        else:
            delete(self.spark, staged)
        return wanted.join(units.drop(text), key).join(self.known(), "digest").drop("digest") if len(units.columns) > 2 else wanted.join(self.known(), "digest").drop("digest")

    def clear(self) -> None:
        if exists(self.spark, self.folder):
            delete(self.spark, self.folder)
