import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from tessella.llm import codes

SCHEMA = "vec_id bigint, embedding array<float>, label int, code int, key string"


def plain(rows, parts=8, entries=16, rounds=6):
    """Whole-number product quantisation, vector by vector."""
    kept = [(v, [math.floor(4096 * np.float32(x).item()) for x in e], lab) for v, e, lab in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    dim = next(len(e) for _, e, _ in kept if e)
    fit = [r for r in kept if len(r[1]) == dim]
    w = dim // parts
    books = [[e[p * w : p * w + w] for _, e, _ in fit[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for _, e, _ in fit:
                x = e[p * w : p * w + w]
                held[near(x, books[p])[1]].append(x)
            for j, xs in held.items():
                books[p][j] = [sum(c) // len(xs) for c in zip(*xs)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out, sums = [], defaultdict(int)
    for v, e, lab in kept:
        best = [near(e[p * w : p * w + w], books[p]) for p in range(parts)] if len(e) == dim else None
        error = sum(d for d, _ in best) if best else None
        sums[lab] += error or 0
        out.append((v, "".join(f"{j:02x}" for _, j in best) if best else None, error, lab))
    return sorted(((v, c, e, sums[lab], digest) for v, c, e, lab in out), key=str)


def vectors(n=300, dim=16, seed=1):
    r = random.Random(seed)
    centres = [[r.uniform(-1, 1) for _ in range(dim)] for _ in range(6)]
    rows = [(i, [float(np.float32(c + r.gauss(0, 0.2))) for c in r.choice(centres)], r.choice([None, 0, 1, 1, 1])) for i in range(n)]
    rows += [(n + i, list(rows[3][1]), 1) for i in range(80)]  # copies
    rows += [(n + 100 + i, [float(r.randint(-2, 2)) for _ in range(dim)], 2) for i in range(60)]  # ties
    return rows


def got(df):
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("few", [100_000, 0])
def test_codes(spark, monkeypatch, few):
    monkeypatch.setattr(codes, "FEW_LABELS", few)
    rows = vectors()
    odd = [(900, None, 1), (901, [None] + [0.5] * 15, 1), (902, [math.nan] + [0.5] * 15, 1), (903, [math.inf] + [0.5] * 15, 1), (904, [], 1), (905, [0.5], None), (None, [0.25] * 16, None), (3, [9.0] * 16, 1), rows[3], (-1, None, 1), (907, [-30000.0, 30000.0] * 8, 7)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], SCHEMA).repartition(5)
    assert got(codes.compressed(df)) == plain(rows + odd)


def test_fewer_rows_than_entries_and_none(spark):
    rows = vectors()[:5]
    assert got(codes.compressed(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA))) == plain(rows)
    assert codes.compressed(spark.createDataFrame([], SCHEMA)).collect() == []
    assert codes.compressed(spark.createDataFrame([(1, None, 1, 1, "x"), (2, [None], 1, 1, "x")], SCHEMA)).collect() == []
    assert [tuple(r)[:3] for r in codes.compressed(spark.createDataFrame([(1, [], 1, 1, "x")], SCHEMA)).collect()] == [(1, None, None)]


def test_what_cannot_be_coded_is_said(spark):
    with pytest.raises(ValueError, match="equal parts"):
        codes.compressed(spark.createDataFrame([(1, [0.5] * 9, 1, 1, "x")], SCHEMA))
    with pytest.raises(Exception, match="can't be coded"):
        codes.compressed(spark.createDataFrame([(1, [1e30] * 8, 1, 1, "x")], SCHEMA))


def test_intervals_hold_the_nearest_entry():
    """Large values, where float32 products are off by far more than the gaps between entries."""
    r = np.random.default_rng(2)
    opened = 0
    for scale in (3, 1000, 10**6, codes.LIMIT - 1):
        for d in (1, 2, 8, 64):
            book = r.integers(-scale, scale + 1, (16, d))
            book[5] = book[2]
            book[7] = book[3] + r.integers(-1, 2, d)
            x = np.concatenate([r.integers(-scale, scale + 1, (300, d)), book[r.integers(0, 16, 300)] + r.integers(-2, 3, (300, d))])
            best, n = codes.nearest(x, book)
            exact = ((x[:, None].astype(object) - book[None].astype(object)) ** 2).sum(2)
            assert (best == np.array([min(range(16), key=lambda j: (row[j], j)) for row in exact])).all()
            opened += n
    assert 0 < opened < 9600
