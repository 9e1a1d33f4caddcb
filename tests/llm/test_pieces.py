from tessella.llm import pieces
from tessella.llm.queries import tokenizer_file

PATH = tokenizer_file("piece_bpe_32k.model")


def test_the_scan_gives_the_library_s_ids(rows):
    m = pieces.model(PATH)
    odd = ["a", "ab", "  a  b  ", "x" * 300, "é😀ñ梦 " * 30, "\n\n  \n", "▁▁ a▁b", "the the " * 40, "aaaaaaaabbbbbbb" * 15, " " * 70]
    for chunk in (16, 50, 400):
        for t in odd + [t[:1200] for _, t in rows[::4] if t]:
            assert pieces.encode_giant(t, m, chunk) == m.sp.encode(t)


def test_matrices_combine_in_any_order():
    import numpy as np

    r = np.random.default_rng(0)
    a, b, c = r.normal(size=(3, 4)), r.normal(size=(4, 2)), r.normal(size=(2, 5))
    assert np.allclose(pieces.combine(pieces.combine(a, b), c), pieces.combine(a, pieces.combine(b, c)))
    assert np.allclose(pieces._scan([a, b, c])[-1], pieces.combine(pieces.combine(a, b), c))


def test_query(docs, rows, empty):
    m = pieces.model(PATH)
    got = {r.doc_id: r for r in pieces.encoded(docs, PATH, keep_ids=True, giant=2000, chunk=500).collect()}
    for i, t in rows:
        assert got[i].ids == m.sp.encode(t or "") and got[i].n_pieces == len(got[i].ids) and got[i].round_trip
    assert pieces.encoded(empty, PATH).count() == 0


def test_columns_stay(docs, rows):
    clashing = docs.withColumn("_text", docs["doc_id"]).withColumn("n_pieces", docs["row"]).withColumn("kept", docs["row"])
    out = pieces.encoded(clashing, PATH, keep_columns=True, giant=2000, chunk=500)
    assert out.columns == [c for c in clashing.columns if c != "n_pieces"] + ["n_pieces", "ids_sha256", "decoded_sha256", "round_trip"]
    texts = dict(rows)
    got = out.collect()
    assert len(got) == len(rows) + 1 and all(r.text == texts[r.doc_id] and r["_text"] == r.doc_id and r.round_trip for r in got)


def test_a_text_of_many_chunks(spark):
    m = pieces.model(PATH)
    words = "the quick brown föx jumps over lazy dogs 梦 again".split()
    text = " ".join(words[i * i % len(words)] for i in range(200_000)) + "a" * 3000 + "  " * 2000
    df = spark.createDataFrame([(1, text), (None, text[::-1]), (3, None)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in pieces.encoded(df, PATH, keep_ids=True).collect()}
    assert got[1].ids == m.sp.encode(text) and got[None].ids == m.sp.encode(text[::-1]) and got[3].n_pieces == 0
    assert all(r.round_trip for r in got.values())
