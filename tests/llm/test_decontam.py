import hashlib
import re

import pytest

from tessella.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.fixture(scope="module")
def bench(spark, rows):
    long = rows[30][1].split()
    items = [(1, " ".join(long[3:20])), (2, " ".join(long[3:20])), (3, "A, b"), (4, ""), (5, None), (6, "a"), (7, "not anywhere at all in any of these texts for sure yes"), (8, rows[-4][1][-400:]), (10, "shared3 shared4 shared5 shared6 shared7 shared8 shared9 shared10 shared11 shared12 shared13"), (11, "x")]
    return spark.createDataFrame(items, "item_id bigint, text string")


def brute(rows, items):
    """Every window of every item, looked up among all runs of as many words."""
    windows = {}
    for item, text in items:
        v = words(text)
        for s in range(max(1, len(v) - 9) if v else 0):
            windows.setdefault(tuple(v[s : s + 10]), set()).add(str(item))
    sizes = {len(x) for x in windows}
    out = {}
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[p : p + n])):
                    hit |= set(range(p, p + n))
                    found |= owners
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def test_against_a_plain_search(docs, rows, bench, empty):
    want = brute(rows, [(r.item_id, r.text) for r in bench.collect()])
    for a_pass in (1000, 3):  # all items at once, then in several passes
        got = {r.doc_id: r for r in decontam.contaminated(docs, bench, a_pass=a_pass).collect()}
        for i, _ in rows:
            r = got[i]
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want[i], i
        clean = decontam.without_contaminated(docs, bench, a_pass=a_pass)
        assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, r in got.items() if not r.contaminated}
    assert decontam.contaminated(empty, bench).count() == 0
    none = bench.limit(0)
    assert decontam.contaminated(docs, none).where("contaminated").count() == 0


def test_memory_of_a_pass():
    """Windows are places in their items' words: 2,500 items of 200 words, an eighth of what 20,000 would take in one pass."""
    import random
    import tracemalloc

    import numpy as np

    r = random.Random(1)
    vocabulary = [f"word{i}".encode() for i in range(20_000)]
    items = [(i, [r.choice(vocabulary) for _ in range(200)]) for i in range(2500)]
    tracemalloc.start()
    w = decontam.Windows(items, 10, 3)
    w.rank(np.ones(len(w.vocabulary), np.int64))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 60 << 20 and len(w.item) == 2500 * 191
    probe = decontam.Probe(w.prefix)
    assert decontam.occurrences(items[7][1][5:20], w, probe) and not decontam.occurrences(items[7][1][5:14], w, probe)


def test_passes_by_bytes(docs, rows, bench, monkeypatch):
    want = sorted(map(tuple, decontam.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontam, "BYTES_A_PASS", 200)
    assert sorted(map(tuple, decontam.contaminated(docs, bench).collect())) == want


def test_windows_whose_prints_collide(monkeypatch):
    import numpy as np

    monkeypatch.setattr(decontam, "shingle_hashes", lambda h, k: np.full(max(0, len(h) - min(k, len(h)) + 1), 7, np.uint64))
    w = decontam.Windows([(1, [b"a", b"b", b"c"]), (2, [b"x", b"y", b"z"]), (3, [b"a", b"b", b"c"])], 3, 3)
    w.rank(np.ones(1, np.int64))
    assert sorted(w.owners(k) for k in range(len(w.item))) == [[1, 3], [2]]
    assert decontam.occurrences([b"q", b"x", b"y", b"z"], w, decontam.Probe(w.prefix))[0][1:] == (1, 4)
