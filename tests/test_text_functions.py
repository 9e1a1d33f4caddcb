"""Text functions on short texts by hand: each function against its SQL over inline rows; queries run them over whole tables."""

import duckdb
import pytest
from pyspark.sql import functions as F
from tessella.plans import catalog  # noqa: F401  it registers them
from tessella.plans.texts import SCALARS


@pytest.mark.parametrize("name, texts, column, sql", SCALARS, ids=[s[0] for s in SCALARS])
def test_short_texts(spark, name, texts, column, sql):
    rows = [*texts, *([] if name == "txt07_canonical_url" else ["", "\n", "x" * 50])]  # it is about URLs alone
    got = [r.y for r in spark.createDataFrame(list(enumerate(rows)), "id int, x string").select("id", column(F.col("x")).alias("y")).orderBy("id").collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE f (id INT, x VARCHAR)")
    con.executemany("INSERT INTO f VALUES (?, ?)", list(enumerate(rows)))
    assert got == [r[0] for r in con.execute(f"SELECT {sql} AS y FROM f ORDER BY id").fetchall()]
