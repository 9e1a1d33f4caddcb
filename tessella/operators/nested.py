"""Nested values, templates, and citations that are nearly right (TXT14, TXT15, HLP19, MET12)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..storage import parked

# How a template names a reusable text and a variable.
REUSABLE, VARIABLE = r"\{%\s*data reusables\.([\w.-]+)\s*%\}", r"\{%\s*data variables\.([\w.-]+)\s*%\}"


def _walked(rows: DataFrame, key: str, value: str, schema: str, walk: Callable[[object], Iterator[tuple]]) -> DataFrame:
    """``walk`` over the JSON of each row; what isn't JSON has nothing to walk."""
    names = [x.split()[0] for x in schema.split(", ")]
    key_type = rows.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in names]
            ids = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = walk(json.loads(text)) if text else ()
                except json.JSONDecodeError:
                    found = ()
                for row in found:
                    ids.append(i)
                    for column, v in zip(out, row, strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema[0].type), *(pa.array(c, pa.string()) for c in out)], [key, *names])

    return rows.select(key, value).mapInArrow(run, f"{key} {key_type}, {schema}")


def flattened(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, path, value): the scalars of nested maps under their dotted paths; lists and nulls are left out (TXT15)."""

    def walk(node: object) -> Iterator[tuple]:
        todo = [("", node)]
        while todo:
            path, x = todo.pop()
            if isinstance(x, dict):
                todo += [(f"{path}.{k}" if path else k, v) for k, v in x.items()]
            elif path and isinstance(x, (str, int, float)):
                yield path, str(x)

    return _walked(rows, key, value, "path string, value string", walk)


def gathered(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, text): the texts of nested content, whatever holds them, a line each, in order (HLP19)."""

    def walk(node: object) -> Iterator[tuple]:
        todo, out = [node], []
        while todo:
            x = todo.pop()
            if isinstance(x, dict):
                if x.get("type") == "text" and isinstance(x.get("text"), str):
                    out.append(x["text"])
                todo += [v for v in reversed(list(x.values())) if isinstance(v, (dict, list))]
            elif isinstance(x, list):
                todo += reversed(x)
        yield ("\n".join(out),)

    return _walked(rows, key, value, "text string", walk)


def _pieces(text: Column, pattern: str) -> Column:
    """(at, text, name) of what stands between the names that a pattern finds, and of the names, in order."""
    names = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    between = F.transform(F.split(text, pattern, -1), lambda x, i: F.struct((2 * i).alias("at"), x.alias("text"), F.lit(None).cast("string").alias("name")))
    return F.concat(between, F.transform(names, lambda x, i: F.struct((2 * i + 1).alias("at"), F.lit(None).cast("string").alias("text"), x.alias("name"))))


def rendered(pages: DataFrame, reusables: DataFrame, variables: DataFrame, rounds: int = 50) -> DataFrame:
    """(key, text) of templates (key, text) with reusables (name, text) put in, theirs too, and variables (name, value) (TXT14).

    A name that is unknown or already on its own path stands for itself, dots as blanks; an unknown variable for its last
    part, underscores as blanks; other tags are blanks. A round puts in the reusables that the round before named, so
    a page's text is made of rows, and its depth, not its size, makes rounds. Deeper than ``rounds`` is an error.
    """
    kept = []
    todo = pages.select("key", F.array().cast("array<int>").alias("order"), F.array().cast("array<string>").alias("seen"), F.explode(_pieces(F.col("text"), REUSABLE)).alias("p"))
    for _ in range(rounds):
        now = parked(todo.select("key", F.concat("order", F.array("p.at")).alias("order"), "seen", F.col("p.text").alias("text"), F.col("p.name").alias("name")), "template")
        kept.append(now.where("name is null").select("key", "order", "text"))
        named = now.where("name is not null").drop("text").join(reusables.select("name", F.col("text").alias("inner")), "name", "left")
        known = F.col("inner").isNotNull() & ~F.array_contains("seen", F.col("name"))
        kept.append(named.where(~known).select("key", "order", F.replace("name", F.lit("."), F.lit(" ")).alias("text")))
        todo = named.where(known).select("key", "order", F.concat("seen", F.array("name")).alias("seen"), F.explode(_pieces(F.col("inner"), REUSABLE)).alias("p"))
        if not now.where("name is not null").limit(1).count():
            break
    else:
        raise ValueError("templates are nested too deeply")
    whole = lambda rows: rows.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", "text"))), lambda x: x["text"]), "").alias("text"))  # noqa: E731  of one page
    text = whole(reduce(DataFrame.union, kept))
    parts = text.select("key", F.explode(_pieces(F.col("text"), VARIABLE)).alias("p")).select("key", F.array("p.at").alias("order"), F.col("p.text").alias("plain"), F.col("p.name").alias("name"))
    parts = parts.join(variables.select("name", "value"), "name", "left")
    said = F.coalesce("plain", "value", F.replace(F.element_at(F.split("name", r"\."), -1), F.lit("_"), F.lit(" ")))
    return whole(parts.select("key", "order", said.alias("text"))).select("key", F.regexp_replace("text", r"\{%.*?%\}", " ").alias("text"))


def _ratios(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``ratio``: how alike ``a`` and ``b`` are, by matching blocks."""
    schema = StructType([*pairs.schema.fields, StructField("ratio", DoubleType())])

    def run(batches):
        from difflib import SequenceMatcher

        for batch in batches:
            both = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ratios = [SequenceMatcher(None, a.casefold(), b.casefold()).ratio() for a, b in both]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ratios, pa.float64())], schema.names)

    return pairs.mapInArrow(run, schema)


def _clear(pairs: DataFrame, least: float, margin: float) -> DataFrame:
    """(cited, valid): the most alike one, if it is alike enough and no other comes near; ties go by the greater id."""
    order = Window.partitionBy("cited").orderBy(F.desc("ratio"), F.desc("valid"))
    best = pairs.withColumn("next", F.coalesce(F.lead("ratio").over(order), F.lit(0.0))).withColumn("at", F.row_number().over(order)).where("at = 1")
    return best.where((F.col("ratio") >= least) & (F.col("ratio") - F.col("next") >= margin)).select("cited", "valid")


def repaired(cited: DataFrame, valid: DataFrame) -> DataFrame:
    """(cited, valid, method) of cited section ids that are near copies of valid ones, of the same ``scope`` (MET12).

    An id is "document#anchor". One with the very anchor and a document much like the cited one is taken if no other
    comes near, else one of the very document with an anchor much like it. Both are equi-joins: only those pairs are compared.
    """
    split = lambda df, name: df.where(F.contains("id", F.lit("#"))).select("scope", F.col("id").alias(name), F.regexp_extract("id", "^(.*)#[^#]*$", 1).alias("doc"), F.regexp_extract("id", "#([^#]*)$", 1).alias("anchor")).distinct()
    wrong = split(cited.join(valid, ["scope", "id"], "left_anti"), "cited")
    good = split(valid, "valid")
    doc = wrong.join(good.withColumnRenamed("doc", "other"), ["scope", "anchor"]).select(F.struct("scope", "cited").alias("cited"), "valid", F.col("doc").alias("a"), F.col("other").alias("b"))
    one = parked(_clear(_ratios(doc), 0.88, 0.06), "repaired")
    rest = wrong.join(one.select("cited.*"), ["scope", "cited"], "left_anti")
    anchor = rest.join(good.withColumnRenamed("anchor", "other"), ["scope", "doc"]).select(F.struct("scope", "cited").alias("cited"), "valid", F.col("anchor").alias("a"), F.col("other").alias("b"))
    two = _clear(_ratios(anchor), 0.86, 0.12)
    named = lambda df, method: df.select("cited.scope", "cited.cited", "valid", F.lit(method).alias("method"))
    return named(one, "anchor_near_document").union(named(two, "document_near_anchor"))
