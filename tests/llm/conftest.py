import random

import pytest

SHARED = " ".join(f"shared{i}" for i in range(40))


def documents():
    """Texts with every odd case: null, empty, blanks, a very long one, ties, repeated rows, near copies, shared passages."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    out = [None, "", " ", "\n\n", "a", "a b", "A B", "é😀ñ", "x" * 3000, "ab" * 2000, "<|endoftext|> a", "same words here again", "same words here again"]
    for _ in range(40):
        out.append(" ".join(word() for _ in range(r.randint(5, 200))))
    base = [word() for _ in range(120)]
    for _ in range(25):
        copy = list(base)
        for _ in range(r.randint(0, 8)):
            copy[r.randrange(len(copy))] = word()
        out.append(" ".join(copy))
    for _ in range(8):
        out.append(" ".join(word() for _ in range(20)) + " " + SHARED + " " + " ".join(word() for _ in range(20)))
    out.append(" ".join(word() for _ in range(12_000)))
    out += [out[20], out[20], out[60]]
    return list(enumerate(out))


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With columns whose names operators use themselves, and a repeated row."""
    data = [(i, t, "en", "src0", len(t or ""), 1, "x", 2.0) for i, t in [*rows, rows[15]]]
    return spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint, row int, spans string, score double").repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
