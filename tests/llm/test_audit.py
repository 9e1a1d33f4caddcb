import re
from collections import Counter
from itertools import permutations

from tessella.llm import audit

COLUMNS = "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"


def plain(rows, labels):
    """Every order replayed for every document, straight from the definitions."""
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}
    least = {}
    for d, text, _ in rows:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    found, parts = Counter(), set()
    for d, text, source in rows:
        text, part = text or "", source or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            x for x, f in zip("ABCDE", (
                len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text)), d is not None and least[text] < d,
            )) if f
        }
        parts.add(part)
        for order in permutations("ABCDE"):
            gone = False
            for k, x in enumerate(order):
                at = part, "".join(order), k + 1
                if x in fails:
                    found[at, "redundant" if gone else "removed"] += 1
                    if not gone:
                        found[at, "good_lost"] += d in good
                        found[at, "toxic_lost"] += d in toxic
                        found[part, x] += 1
                    gone = True
                found[at, "kept"] += not gone
                found[at, "unique_fails"] += fails == {x}
    out = []
    for part in parts:
        for order in map("".join, permutations("ABCDE")):
            for k in range(1, 6):
                out.append((part, order, k, *(found[(part, order, k), c] for c in COLUMNS[3:9]), found[part, order[k - 1]]))
    return sorted(out)


def test_audit(spark, rows):
    r = [(i, t, (None, "", "src1", "src2")[i % 4]) for i, t in rows]
    r += [(None, "a b", "src1"), (None, None, "src1"), r[20], r[20], (7, "another text of one id " * 30, "src2"), (1000, "x # Y " * 40, None), (1001, "x # Y " * 40, "src1"), (1002, "WORDS " * 60, "src1"), (1003, " ".join("ab" * 9), "src2")]
    r += [(2000 + i, f"copy of many {'w ' * 50}", "src1") for i in range(60)]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 90, 2)] + [(0, 1, 0), (0, None, 1), (None, 1, 1), (2003, 1, 1)]
    labels = [(d, q, None if t is None else int(t)) for d, q, t in labels]
    docs = spark.createDataFrame([(*x, 1, 2, "x") for x in r], "doc_id bigint, text string, source string, step int, part int, fails string").repartition(6)
    got = audit.audit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert got.columns == list(COLUMNS)
    assert sorted(tuple(x) for x in got.collect()) == plain(r, labels)


def test_empty(spark, empty):
    assert audit.audit(empty, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).collect() == []


def test_orders_are_combined_before_the_shuffle(spark, docs):
    plan = audit.replay(audit.flags(docs, spark.createDataFrame([(1, 1, 1)], "doc_id bigint, quality int, toxic int")))._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin BuildRight" in plan and "partial_sum" in plan
