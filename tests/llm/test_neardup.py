from collections import Counter, defaultdict

import numpy as np

from tessella.llm import neardup
from tessella.llm.common import components


def brute(rows, k, num, den):
    sets = {i: neardup.shingles((t or "").encode(), k) for i, t in rows}
    holders, up = defaultdict(list), {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in sorted(sets.items()):
        shared = Counter(j for h in x.tolist() for j in holders[h])
        for h in x.tolist():
            holders[h].append(i)
        for j, s in shared.items():
            if den * s >= num * (len(x) + len(sets[j]) - s):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_components_against_all_pairs(docs, rows, empty):
    for k, num, den in ((3, 90, 100), (5, 80, 100), (1, 50, 100)):
        got = neardup.classes(docs, k, num, den).collect()
        want = brute(rows, k, num, den)
        assert len(got) == len(rows) + 1
        assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got)
    assert neardup.classes(empty, 3, 90, 100).count() == 0


def test_distinct_keeps_one_of_each_component(docs, rows):
    kept = neardup.distinct(docs)
    want = {c for _, c in brute(rows, 5, 80, 100).values()}
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_rows_without_an_id_stay_beside_a_repeated_id(spark):
    rows = [(None, "one text of its own"), (None, "quite another text here"), (1, "a text said twice"), (1, "a text said twice")]
    kept = neardup.distinct(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "one text of its own"), (0, "quite another text here"), (1, "a text said twice")]


def test_pairs_at_the_threshold_share_a_group():
    r = np.random.default_rng(5)
    for num, den in ((80, 100), (90, 100)):
        levels = neardup.Levels(num, den)
        for _ in range(600):
            n = int(r.integers(2, 300))
            x = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
            y = np.unique(np.concatenate([x[r.random(len(x)) < r.uniform(0.75, 1)], r.integers(0, 1 << 63, int(r.integers(0, 1 + n // 8)), dtype=np.uint64)]))
            s = len(np.intersect1d(x, y))
            if not s or den * s < num * (len(x) + len(y) - s) or np.array_equal(x, y):
                continue
            for share in (0.0, 0.3, 1.0):  # of frequent tokens
                rare = lambda z: (z % np.uint64(1000)) >= np.uint64(1000 * share)  # noqa: E731, B023
                assert np.intersect1d(levels.keys(x, rare(x)), levels.keys(y, rare(y))).size


def test_links_reach_what_all_pairs_reach():
    r = np.random.default_rng(9)
    sets = [np.unique(r.integers(0, 40, int(r.integers(1, 30))).astype(np.uint64)) for _ in range(120)]
    everyone = list(range(len(sets)))
    want, got = neardup.Forest(len(sets)), neardup.Forest(len(sets))
    for a in everyone:
        for b in everyone[a + 1 :]:
            s = len(np.intersect1d(sets[a], sets[b]))
            if 10 * s >= 6 * (len(sets[a]) + len(sets[b]) - s):
                want.up[want.root(b)] = want.root(a)
    halves = [everyone[:60], everyone[60:]]
    for left, right in ((halves[0], halves[0]), (halves[0], halves[1]), (halves[1], halves[1])):
        for a, b in neardup.links(sets, 6, 10, left, right):
            got.up[got.root(b)] = got.root(a)
    same = lambda f: [[f.root(a) == f.root(b) for a in everyone] for b in everyone]
    assert same(want) == same(got)


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 90), (90, 95), (7, 7), (200, 100)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, **{i: 90 for i in (90, 95, 100, 200)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_chains_of_any_length_close(spark):
    n = 400  # a path: its smallest id has to travel through all of it
    edges = [((i * 7919) % n, (i * 7919 + 1) % n) for i in range(n) if (i * 7919 + 1) % n]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == dict.fromkeys(range(n), 0)


def test_rows_without_an_id_have_a_row(spark):
    rows = [(None, "a b c d"), (3, "a b c d"), (4, "a b c d"), (None, None)]
    got = neardup.classes(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 90, 100).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted([(None, 2, None), (3, 2, 3), (4, 2, 3), (None, 0, None)], key=str)


def test_ids_that_are_shuffled(docs, rows, monkeypatch):
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 0)
    monkeypatch.setattr(neardup, "BLOCK_TOKENS", 300)  # parts of many blocks
    want = brute(rows, 5, 80, 100)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in neardup.classes(docs, 5, 80, 100).collect())
    assert neardup.distinct(docs).count() == len({c for _, c in want.values()})


def test_ids_go_in_passes(docs, rows, monkeypatch):
    """More ids than one broadcast holds: several passes, and no join that shuffles the texts."""
    want = brute(rows, 5, 80, 100)
    monkeypatch.setattr(neardup, "BLOCK_TOKENS", 300)
    joined, plain = [], neardup._linked

    def seen(texts, *rest):
        joined.append(texts._jdf.queryExecution().executedPlan().toString())
        return plain(texts, *rest)

    monkeypatch.setattr(neardup, "_linked", seen)
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 25)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in neardup.classes(docs, 5, 80, 100).collect())
    kept = neardup.distinct(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})
    assert len(joined) >= 4 and all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in joined)
