"""The log of a service's requests as a stream: every request once, whatever is stopped and started again (TRC07).

A micro-batch is written to a folder of its own number, over what an earlier try of it left; the checkpoint says which
number comes next. So a batch that was written but not yet acknowledged when the stream died is written again in place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def turns(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    """A stream over a Parquet table, whether it is one file or a folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_at_once)
    if fs.getFileStatus(where).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", where.getName()).parquet(str(where.getParent()))


def requests(rows: DataFrame) -> DataFrame:
    """Log entries of conversation turns: a user's turn is a search, an answer to it is fetched, others expand."""
    kind = F.when(F.col("role") == "user", "search").when(F.col("role") == "assistant", "fetch").otherwise("expand")
    entry = F.substring(F.sha2(F.concat_ws("\0", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.coalesce("text", F.lit(""))), 256), 1, 20)
    return rows.select("conv_id", "turn", kind.alias("endpoint"), entry.alias("request_id"), F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_chars"))


def appended(rows: DataFrame, log: str, checkpoint: str, before: Callable[[int], None] = lambda n: None, after: Callable[[int], None] = lambda n: None) -> None:
    """Append what the stream ``rows`` holds by now to ``log``. ``before`` and ``after`` are called about each batch's write."""

    def write(batch: DataFrame, number: int) -> None:
        before(number)
        requests(batch).write.mode("overwrite").parquet(f"{log}/batch={number}")
        after(number)

    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def logged(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.parquet(log).drop("batch")
