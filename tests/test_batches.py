import random

import pytest
from tessella.operators import batches


def plain(rows, budget):
    out, project, used, batch = [], None, 0, 0
    for p, k, n in sorted(rows):
        if p != project:
            project, used, batch = p, 0, 0
        if used and used + n > budget:
            batch, used = batch + 1, 0
        used += n
        out.append((p, k, batch))
    return out


@pytest.mark.parametrize("block_rows", [10, 37, 10_000])
def test_greedy_batches_over_blocks(spark, block_rows):
    """A project of half of all rows, small ones, units over the budget, blocks that one batch covers."""
    r = random.Random(4)
    size = lambda: r.choice([51, 51, 60, 300, 900, 1999, 2000, 2001, 9000])
    rows = [("big", k, 55 if 60 < k < 110 else size()) for k in range(260)] + [(f"p{k % 9}", k, size()) for k in range(1000, 1150)] + [("one", 1, 5000), ("two", 1, 1999), ("two", 2, 51)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "project string, unit bigint, n int").repartition(5)
    got = sorted(map(tuple, batches.greedy(df, "unit", "n", 2000, block_rows).collect()))
    assert got == plain(rows, 2000)


def test_small_budgets_and_no_rows(spark):
    none = spark.createDataFrame([], "project string, unit bigint, n int")
    assert batches.greedy(none, "unit", "n", 2000).collect() == []
    with pytest.raises(ValueError, match="budget"):
        batches.greedy(none, "unit", "n", 1999)
