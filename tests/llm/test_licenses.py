import re

import numpy as np

from tessella.llm import licenses
from tessella.llm.common import word_hashes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    None, "", "Released under the MIT License.", "under the mit license, UNDER THE MIT LICENSE", "Apache License, Version 2.0 and CC BY-NC 4.0", "under the mit", "ünder the mit license",
    "This work is licensed under the GNU General Public License, version 3.", "x " * 500 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files" + " y" * 300,
    "gnu general public", "the " * 4000,
]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_phrases_against_a_plain_scan(spark, docs, rows, empty):
    cases = list(enumerate(TEXTS)) + [(100 + i, t) for i, t in rows]
    df = spark.createDataFrame(cases, "doc_id bigint, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for i, t in cases:
        words = WORD.findall(lower(t))
        hits = [(p, label) for phrase, label in licenses.PHRASES.items() for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(hits))
        assert (r.first_word, r.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in hits})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert got[7].labels == "gpl-3" and got[8].labels == "mit" and got[8].base_labels == ""
    assert licenses.scan(empty).count() == 0


def variants():
    """Licence texts whole, cut, with words changed, inside others, one after the other."""
    import random

    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    out = []
    for _, text in licenses.TEMPLATES:
        w = text.split()
        for share in (0, 0.05, 0.12, 0.2, 0.4):
            changed = [word() if r.random() < share else x for x in w]
            out.append(" ".join([word() for _ in range(r.randint(0, 150))] + changed + [word() for _ in range(r.randint(0, 80))]))
        out.append(" ".join(w[: len(w) * 4 // 5]))
    return out + [" ".join(text for _, text in licenses.TEMPLATES), " ".join(text for _, text in reversed(licenses.TEMPLATES))]


def test_labels_against_every_block(spark):
    texts = variants()
    templates = [(label, set(WORD.findall(lower(t))), len(WORD.findall(lower(t)))) for label, t in licenses.TEMPLATES]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    found = 0
    for r in licenses.scan(df).collect():
        w = WORD.findall(lower(texts[r.doc_id]))
        blocks, score, labels = set(), 0.0, set()
        for label, have, size in templates:
            step = 32
            while step < size:
                step *= 2
            for a in range(0, max(1, len(w) - step), step):
                share = len(have & set(w[a : a + 2 * step])) / len(have)
                if share >= licenses.THRESHOLD - 1e-12:
                    labels.add(label)
                    blocks.add(f"{label}:{a}:{min(len(w), a + 2 * step)}")
                    score = max(score, share)
        base = set(filter(None, r.base_labels.split(",")))
        method = {b for b in r.blocks.split(",") if b} - {b for b in r.blocks.split(",") if b and b.split(":")[0] in base}
        assert method == {b for b in blocks if b.split(":")[0] not in base}
        assert r.labels == ",".join(sorted(labels | base)) and r.score == (1.0 if base else score)
        found += bool(labels)
    assert found > len(texts) // 2


def test_whole_texts_are_found_wherever_they_lie(spark):
    rows = [(k, "x " * pad + text + " y" * 50) for k, (text, pad) in enumerate((t, p) for _, t in licenses.TEMPLATES for p in (0, 17, 201))]
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(licenses.TEMPLATES[k // 3][0] in v for k, v in got.items())


def test_words_hash_apart():
    assert len(np.unique(word_hashes([b"a", b"b", b"ab", b"ba"]))) == 4
