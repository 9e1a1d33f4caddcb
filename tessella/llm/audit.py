"""Filter interaction audit: what each of five filters removes in every order of the five, replayed for every document.

Every document becomes one row of flags: which of the filters A to E it fails, and what ``labels`` says of it. The rows
meet all 120 orders, which are broadcast (their number is fixed), the five steps of each order are exploded, the first
step that a document fails is compared with each, and conditional sums count documents by part, order and step. Partial
sums are made before the shuffle, so what travels is 600 rows a part and task, whatever the number of documents.

Nulls and edges: a null text is the empty text and a null source the empty string, one part with sources that are empty.
The identity of texts is their SHA-256. A null doc_id is no smaller and no larger than another, so such a row neither
fails E nor makes others fail it. Repeated rows count each; rows of one doc_id aren't copies of one another. A label
counts if any row of the document's labels has it. No documents give no rows. Further columns are not looked at.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import salted_join
from .common import parked

FILTERS = "ABCDE"


def failures(text: Column) -> Column:
    """Bits 0 to 3: filters A to D that a text fails. Words are split once."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))

    def bits(w: Column) -> Column:
        few = F.when(F.size(w) < 50, 1).otherwise(0)
        repeated = F.when(100 * F.size(F.array_distinct(w)) < 65 * F.size(w), 2).otherwise(0)
        loud = F.when(100 * capitals > 5 * F.length(text), 4).otherwise(0)
        marked = F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)
        return few + repeated + loud + marked

    return F.transform(F.array(words), bits)[0]


def flags(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic) of every row of ``documents``: bit i of ``fails`` is filter ``FILTERS[i]``.

    Texts are read once; what is left of one is its bits and its digest. Copies are found by one aggregate over the
    digests, and only digests that several ids share are joined back, dealt over tasks by id.
    """
    text = F.coalesce("text", F.lit(""))
    rows = parked(documents.select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("part"), failures(text).alias("fails"), F.unhex(F.sha2(text, 256)).alias("digest")), "flags")
    first = rows.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    keyed = rows.withColumn("deal", F.coalesce("id", F.lit(0)))
    copies = salted_join(keyed, first, "digest", "deal").where("first < id").groupBy("id", "digest").agg(F.lit(16).alias("copy"))
    label = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    out = rows.join(copies, ["id", "digest"], "left").join(label, "id", "left")
    return out.select("part", (F.col("fails") + F.coalesce("copy", F.lit(0))).alias("fails"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def orders(spark) -> DataFrame:
    """The 120 orders of the filters, each with the bits of its steps."""
    rows = [("".join(p), [1 << FILTERS.index(x) for x in p]) for p in permutations(FILTERS)]
    return spark.createDataFrame(rows, "filter_order string, bits array<int>")


def replay(rows: DataFrame) -> DataFrame:
    """What happens to the rows of :func:`flags` at every step of every order, by part."""
    first = F.expr("coalesce(array_position(transform(bits, b -> (fails & b) <> 0), true), 0)")
    crossed = rows.crossJoin(F.broadcast(orders(rows.sparkSession))).withColumn("first", F.when(F.col("fails") == 0, 6).otherwise(first).cast("int"))
    steps = crossed.select("part", "filter_order", "fails", "good", "toxic", "first", F.posexplode("bits").alias("at", "bit")).withColumn("step", F.col("at") + 1)
    count = lambda of: F.sum(F.when(of, 1).otherwise(0)).cast("long")
    here, fails = F.col("first") == F.col("step"), F.col("fails").bitwiseAND(F.col("bit")) != 0
    counted = steps.groupBy("part", "filter_order", "step").agg(
        count(F.col("first") > F.col("step")).alias("kept"), count(here).alias("removed"), count(fails & (F.col("first") < F.col("step"))).alias("redundant"),
        count(F.col("fails") == F.col("bit")).alias("unique_fails"), count(here & (F.col("good") == 1)).alias("good_lost"), count(here & (F.col("toxic") == 1)).alias("toxic_lost"),
    )
    named = counted.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    return named.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")).cast("long")).drop("filter")


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    columns = "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    return replay(flags(documents, labels)).select(*columns)
