"""Greedy batches under a budget, for projects of any size (CHK04).

A batch takes its project's units in order until the next one would pass the budget; a unit over the budget stands alone.
So a unit is followed, if a batch starts with it, by one certain start, and the starts are what a walk from the project's
first unit meets. Units lie in ranges of (project, order), blocks of about ``block_rows``; a project may span many.
Prefix sums of the blocks' totals place every unit; its next start is a range search in its own block or, at the end, in
the head of the next one. A block is then a table from the few units that a walk may enter it by to where the walk leaves
it, and pointer doubling over these tables finds the entries that walks do take, in a logarithm of the blocks' number.
No project is folded in one place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import discard, parked

BLOCK_ROWS, LEAST = 200_000, 2000
PLACED = "project string, block int, pos long, low long, n long, next long"


def _following(budget: int):
    """Each unit's next start in its own block; null beyond it."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        pos, low, n = (rows.column(c).to_numpy() for c in ("pos", "low", "n"))
        at = np.searchsorted(low + n, low + budget, "right")
        found = at < len(pos)
        following = np.where(found, np.maximum(pos[np.minimum(at, len(pos) - 1)], pos + 1), 0)
        return pa.table([*(rows.column(c) for c in ("project", "block", "pos", "low", "n")), pa.array(following, pa.int64(), mask=~found | (following > pos[-1]))], [c.split()[0] for c in PLACED.split(", ")])

    return run


def _left(rows: pa.Table) -> pa.Table:
    """Where a walk that enters a block by one of its first units leaves it."""
    rows = rows.sort_by("pos")
    pos = rows.column("pos").to_numpy()
    after = [x.as_py() for x in rows.column("next")]
    leave = [None] * len(pos)
    for i in range(len(pos) - 1, -1, -1):
        leave[i] = leave[after[i] - pos[0]] if after[i] is not None and after[i] <= pos[-1] else after[i]
    head = np.flatnonzero(rows.column("head").to_numpy(zero_copy_only=False))
    return pa.table([rows.column("project").take(pa.array(head)), pa.array(pos[head]), pa.array([leave[i] for i in head], pa.int64())], ["project", "entry", "leave"])


def _started(rows: pa.Table) -> pa.Table:
    """The starts of a block, walked from its entries."""
    rows = rows.sort_by("pos")
    pos, after, entry = rows.column("pos").to_numpy(), [x.as_py() for x in rows.column("next")], rows.column("entry").to_numpy(zero_copy_only=False)
    start = np.zeros(len(pos), bool)
    i = int(np.argmax(entry)) if entry.any() else None
    while i is not None:
        start[i] = True
        i = int(after[i] - pos[0]) if after[i] is not None and after[i] <= pos[-1] else None
    return pa.table([rows.column("project"), rows.column("block"), rows.column("pos"), pa.array(start)], ["project", "block", "pos", "start"])


def greedy(units: DataFrame, key: str, size: str, budget: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(project, key, batch) of every unit (project, key, size): batches are numbered from 0 in each project's order of ``key``."""
    if budget < LEAST:
        raise ValueError(f"a budget must be {LEAST} at least")
    rows = units.select(F.coalesce("project", F.lit("")).alias("project"), F.col(key).alias("key"), F.col(size).cast("long").alias("n"))
    parts = max(1, -(-rows.count() // block_rows))
    dealt = parked(rows.repartitionByRange(parts, "project", "key").withColumn("block", F.spark_partition_id()), "units")
    before = Window.partitionBy("project").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    totals = dealt.groupBy("project", "block").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    offsets = parked(totals.select("project", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("low0"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("pos0"), F.lead("block").over(Window.partitionBy("project").orderBy("block")).alias("then")), "offsets")
    within = Window.partitionBy("project", "block").orderBy("key")
    placed = dealt.join(offsets, ["project", "block"]).select(
        "project", "block", "key", "n", (F.col("pos0") + F.row_number().over(within) - 1).alias("pos"), (F.col("low0") + F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("low"),
    )
    placed = parked(placed, "placed")
    discard(dealt)
    own = parked(placed.select("project", "block", "pos", "low", "n").groupBy("project", "block").applyInArrow(_following(budget), PLACED), "following")

    # the last units of a block look into the heads of the next ones
    edges = offsets.select("project", "block", "low0", "then")
    head = own.join(edges, ["project", "block"]).where(F.col("low") <= F.col("low0") + budget).select("project", F.col("block").alias("then"), F.col("pos").alias("entry"), (F.col("low") + F.col("n")).alias("high"))
    asked = own.where("next IS NULL").join(edges, ["project", "block"]).where("then IS NOT NULL").select("project", "pos", (F.col("low") + budget).alias("reach"), "then")
    resolved, looked = None, parked(asked, "asked")
    while looked.limit(1).count():
        met = looked.join(head, ["project", "then"]).groupBy("project", "pos", "reach", "then").agg(F.min(F.when(F.col("high") > F.col("reach"), F.col("entry"))).alias("entry"))
        met = parked(met, "met")
        here = met.where("entry IS NOT NULL").select("project", "pos", F.greatest("entry", F.col("pos") + 1).alias("entry"))
        resolved = here if resolved is None else resolved.union(here)
        on = met.where("entry IS NULL").join(edges.select("project", F.col("block").alias("then"), F.col("then").alias("after")), ["project", "then"]).where("after IS NOT NULL")
        further = parked(on.select("project", "pos", "reach", F.col("after").alias("then")), "asked")
        discard(looked)
        looked = further
    if resolved is not None:
        whole = parked(own.join(resolved, ["project", "pos"], "left").select("project", "block", "pos", "low", "n", F.coalesce("next", "entry").alias("next")), "following")
        discard(own)
        own = whole

    # blocks as tables from entries to where a walk leaves, then doubling
    marked = own.join(edges, ["project", "block"]).withColumn("head", F.col("low") <= F.col("low0") + budget)
    jumps = parked(marked.select("project", "block", "pos", "next", "head").groupBy("project", "block").applyInArrow(_left, "project string, entry long, leave long").where("leave IS NOT NULL"), "jumps")
    taken = parked(own.where("pos = 0").select("project", F.col("pos").alias("entry")), "taken")
    n = taken.count()
    while True:
        more = taken.join(jumps, ["project", "entry"]).select("project", F.col("leave").alias("entry"))
        wider = parked(taken.union(more).distinct(), "taken")
        m = wider.count()
        discard(taken)
        taken = wider
        if m == n:
            break
        n = m
        further = jumps.select("project", F.col("entry").alias("leave"), F.col("leave").alias("far"))
        twice = parked(jumps.join(further, ["project", "leave"]).select("project", "entry", F.col("far").alias("leave")), "jumps")
        discard(jumps)
        jumps = twice
    entered = own.join(taken.select("project", F.col("entry").alias("pos"), F.lit(True).alias("entry")), ["project", "pos"], "left").select("project", "block", "pos", "next", F.coalesce("entry", F.lit(False)).alias("entry"))
    discard(jumps)
    started = parked(entered.groupBy("project", "block").applyInArrow(_started, "project string, block int, pos long, start boolean"), "started")
    discard(own)
    discard(taken)
    counts = started.groupBy("project", "block").agg(F.count(F.when(F.col("start"), 1)).alias("starts"))
    earlier = counts.select("project", "block", F.coalesce(F.sum("starts").over(before), F.lit(0)).alias("earlier"))
    running = F.count(F.when(F.col("start"), 1)).over(Window.partitionBy("project", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    numbered = started.join(earlier, ["project", "block"]).select("project", "pos", (F.col("earlier") + running - 1).alias("batch"))
    return placed.join(numbered, ["project", "pos"]).select("project", F.col("key").alias(key), "batch")


def batch_ids(batched: DataFrame, key: str, text: Column) -> DataFrame:
    """(project, batch, batch_id, n_units) of units with their batch: 24 hex digits of project and texts in order. A batch is bounded by its budget."""
    unit = F.struct(F.col(key), F.concat(F.lit('<evidence_unit id="'), F.col(key).cast("string"), F.lit('">\n'), text, F.lit("\n</evidence_unit>")).alias("body"))
    payload = F.array_join(F.transform(F.array_sort(F.collect_list(unit)), lambda u: u["body"]), "\n\n")
    return batched.groupBy("project", "batch").agg(F.substring(F.sha2(F.concat_ws("\0", F.first("project"), payload), 256), 1, 24).alias("batch_id"), F.count("*").alias("n_units"))
