import hashlib
import random

import numpy as np

from tessella.llm import substrings


def brute(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        flags = bytearray(len(raw))
        for p in range(len(raw) - 99):
            s = raw[p : p + 100]
            if s in seen:
                flags[p : p + 100] = b"\1" * 100
            else:
                seen.add(s)
        kept = bytes(b for b, f in zip(raw, flags, strict=True) if not f)
        out[i] = (len(raw), sum(flags), sum(f and (p == 0 or not flags[p - 1]) for p, f in enumerate(flags)), hashlib.sha256(kept).hexdigest())
    return out


def check(df, rows):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.removed(df).collect()}
    assert got == brute(rows)


def test_against_all_strings(docs, rows, empty):
    short = [(i, t) for i, t in rows if len(t or "") < 20_000]
    check(docs.where("length(text) < 20000 or text is null"), short)
    assert substrings.removed(docs).count() == len(rows) + 1
    assert substrings.removed(empty).count() == 0


def test_few_symbols_runs_and_shared_halves(spark):
    r = random.Random(2)
    line = "".join(r.choice("abcdefgh ") for _ in range(160))
    rows = [(i, "".join(r.choice("ab") for _ in range(r.randint(90, 700)))) for i in range(20)]
    rows += [(100 + i, "a" * (95 + i)) for i in range(12)] + [(200, "ab" * 400), (201, "b" + "ab" * 300), (202, "é" * 120)]
    for i in range(60):  # a common passage, cut at both ends, in different surroundings
        a, b = r.randint(0, 60), r.randint(100, 160)
        rows.append((300 + i, "".join(r.choice("xyz") for _ in range(30)) + line[a:b] + "".join(r.choice("uvw") for _ in range(30))))
    check(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), rows)


def test_groups_that_go_by_windows(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 3)
    test_few_symbols_runs_and_shared_halves(spark)


def test_anchors_cover_every_string_once(monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 300)
    r = random.Random(4)
    for _ in range(30):
        text = bytes(r.choice(b"abc") for _ in range(r.randint(0, 1500)))
        _, _, anchor, first, last = substrings.anchors(text)
        starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)]) if len(first) else np.zeros(0, int)
        assert starts.tolist() == list(range(max(0, len(text) - 99)))
        assert ((anchor >= first) & (anchor <= first + 52) & (last <= anchor)).all()


def test_ids_with_several_texts(spark):
    r = random.Random(8)
    line = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared = line(150)
    texts = [(1, line(130)), (5, line(40) + shared), (5, shared + line(40)), (5, shared + line(40)), (6, "short"), (6, line(200)), (7, shared)]
    texts[3] = texts[2]  # a repeated row
    out = {}
    for key, (i, t) in enumerate(sorted(set(texts), key=lambda x: (x[0], hashlib.sha256(x[1].encode()).digest()))):
        out[(i, t)] = key
    want = brute([(k, t) for (_, t), k in out.items()])
    got = substrings.removed(spark.createDataFrame(texts + [(None, shared)], "doc_id bigint, text string").repartition(3), keep_text=True).collect()
    assert len(got) == len(texts) + 1
    told = sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got if x.doc_id is not None)
    assert told == sorted((i, *want[out[(i, t)]]) for i, t in texts)
    assert [x.n_removed for x in got if x.doc_id is None] == [0]


def test_long_texts(spark):
    r = random.Random(9)
    base = "".join(r.choice("abcdefghijkl ") for _ in range(30_000))
    rows = [(1, base), (2, "x" * 25_000), (3, base[5_000:29_000] + "tail" * 50), (4, base[:20_500][::-1])]
    check(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2), rows)
