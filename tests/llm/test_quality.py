import numpy as np

from tessella.llm import quality
from tessella.llm.common import table

SF = "/root/testdata/sf0.01"


def test_statistics_are_finite_and_of_each_text_alone(rows):
    texts = [(t or "").encode() for _, t in rows]
    all_ = quality.statistics(texts)
    assert all_.shape == (len(texts), len(quality.STATISTICS)) and np.isfinite(all_).all()
    for i in range(0, len(texts), 7):
        assert np.allclose(quality.statistics([texts[i]])[0], all_[i], atol=1e-5)
    assert quality.statistics([]).shape[0] == 0


def test_one_label_gives_a_constant():
    model = quality.boost(np.zeros((5, 3), np.float32), np.ones(5))
    assert (model.score(np.zeros((2, 3), np.float32)) > 0.9).all()
    assert quality.boost(np.zeros((0, 3), np.float32), np.zeros(0)).score(np.zeros((1, 3), np.float32))[0] == 0.5


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    scored = quality.scores(docs, quality.fit(docs, labels))
    rows = scored.where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 100 and np.mean([r.predicted == r.quality for r in rows]) > 0.97
    assert scored.count() == docs.count()


def test_odd_rows(spark, docs, rows, empty):
    labels = spark.createDataFrame([(14, 1), (14, 0), (16, None), (30, 1), (8, 0), (99999, 1)], "doc_id bigint, quality int")
    out = quality.scores(docs, quality.fit(docs, labels)).collect()
    assert len(out) == len(rows) + 1 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert all(r.held_out == (__import__("zlib").crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    model = quality.fit(empty, labels)
    assert quality.scores(empty, model).count() == 0
    assert quality.accepted(docs, model).columns == docs.columns


def test_trees_against_row_by_row_walks():
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 5)).astype(np.float32)
    x[:, 2] = np.round(x[:, 2])  # ties
    y = (x[:, 0] + (x[:, 2] > 0) + r.normal(scale=0.3, size=400) > 0.5).astype(float)
    model = quality.boost(x, y, trees=8, depth=3, bins=16)
    for row, score in zip(x, model.score(x), strict=True):
        margin = model.base
        for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
            node = 0
            for _ in range(model.depth):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            margin += v[node]
        assert np.isclose(score, 1 / (1 + np.exp(-margin)))


def test_the_first_split_against_all_splits():
    r = np.random.default_rng(4)
    x = r.integers(0, 12, size=(300, 4)).astype(np.float32)
    y = ((x[:, 1] > 6) ^ (r.random(300) < 0.1)).astype(float)
    model = quality.boost(x, y, trees=1, depth=1, bins=64)
    g, h = y.mean() - y, np.full(300, max(y.mean() * (1 - y.mean()), 1e-6))
    weight = lambda m: g[m].sum() ** 2 / (h[m].sum() + quality.RIDGE)
    every = np.ones(300, bool)
    gains = {(j, t): weight(x[:, j] <= t) + weight(x[:, j] > t) - weight(every) for j in range(4) for t in range(12) if min((x[:, j] <= t).sum(), (x[:, j] > t).sum()) >= quality.LEAST}
    best = max(gains.values())
    assert np.isclose(gains[int(model.feature[0, 0]), float(model.threshold[0, 0])], best)
    left = x[:, model.feature[0, 0]] <= model.threshold[0, 0]
    for leaf, m in ((1, left), (2, ~left)):
        assert np.isclose(model.value[0, leaf], -quality.RATE * g[m].sum() / (h[m].sum() + quality.RIDGE))
