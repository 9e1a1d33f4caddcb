"""Ids of a project's own in a corpus of many: rewritten wherever they stand (SRC10, SRC11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def namespaced(rows: DataFrame, project: str, key: str, arrays: list[str] = (), maps: list[str] = ()) -> DataFrame:
    """``rows`` with ``question_id``, and with the project before every id in ``arrays`` and before every key of ``maps``; entries keep their order."""
    named = lambda x: F.concat(F.col(project), F.lit("::"), x.cast("string"))

    def keyed(m: str) -> Column:
        return F.transform_keys(m, lambda k, v: named(k))

    out = rows.withColumn("question_id", named(F.col(key)))
    for c in arrays:
        out = out.withColumn(c, F.transform(c, named))
    for c in maps:
        out = out.withColumn(c, keyed(c))
    return out
