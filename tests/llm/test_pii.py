import hashlib
import random
import re

from pyspark.sql import functions as F

from tessella.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def good(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(int(c) * 2, 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return 8 <= len(d) <= 15 if kind == "phone" else True


def base(t):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, t or "") if good(k, m.group())]


def cases():
    r = random.Random(5)
    parts = ["a", "b.", "@", "c", ".", "1", "23", "+", " ", "-", "(", ")", "4111111111111111", "255", "é😀", "_", "%", "\n", "10.0.0.1", "x@y.z"]
    out = ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(800)]
    return out + ["", None, "a" * 9000, "1" * 9000, "a." * 4000 + "@", "@" * 900, "+1" + " " * 3000, "1." * 2000, "x@y" + ".a" * 2000, "4111 1111 1111 1111 " * 100]


def cut(t, spans):
    merged = []
    for k, a, e in sorted(spans, key=lambda x: (x[1], x[2], x[0])):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([a, e, k])
    out, p = "", 0
    for a, e, k in merged:
        out, p = out + t[p:a] + f"[{k.upper()}]", e
    return out + t[p:]


def test_base_spans_and_texts(spark):
    texts = cases()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r for r in pii.report(df).collect()}
    clean = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    for i, t in enumerate(texts):
        b = base(t)
        joined = ",".join(f"{k}:{a}:{e}" for k, a, e in b)
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.spans.startswith(joined), t
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in b) for k in PLAIN]
        if not r.n_terms:
            assert clean[i] == (None if t is None else cut(t, b))


def test_terms_that_give_an_entity_away(spark):
    plain = [(i, f"common words are everywhere number{i % 7} here") for i in range(300)]
    told = [(1000 + i, f"report{i} by the starfish of bob@ex.org common words nearby{i}") for i in range(5)]
    df = spark.createDataFrame(plain + told, "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.report(df).collect()}
    for i, t in told:
        at = t.index("starfish")
        assert f"term:{at}:{at + 8}" in got[i].spans and "common" not in [t[int(s.split(":")[1]) : int(s.split(":")[2])] for s in got[i].spans.split(",")]
    assert not any(got[i].n_terms or got[i].spans for i, _ in plain)
    text = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert "starfish" not in text[1000] and "[EMAIL]" in text[1000] and text[3] == plain[3][1]


def test_odd_rows(docs, rows, empty):
    assert pii.report(docs).count() == len(rows) + 1
    clashing = docs.withColumn("others", F.lit("o")).withColumn("cut", F.col("doc_id")).withColumn("terms", F.lit(3)).withColumn("kind.of", F.lit("k"))
    out = pii.sanitised(clashing)
    assert out.columns == clashing.columns
    same = lambda df: sorted(tuple(r[c] for c in clashing.columns if c != "text") for r in df.collect())
    assert same(out) == same(clashing)
    assert pii.report(empty).count() == 0 and pii.sanitised(empty).count() == 0


def test_terms_far_from_the_entity(spark):
    fill = " ".join(["common words are everywhere here"] * 12)
    plain = [(i, f"common words are everywhere number{i % 7} here") for i in range(300)]
    told = [(1000 + i, f"starfish{i} é😀 {fill} report{i} by bob@ex.org {fill} nearby{i} Starfish. {'common words ' * 300}STARFISH") for i in range(5)]
    copies = [(2000 + i, f"{fill} jellyfish {fill} written by amy@ex.org {fill}") for i in range(5)]
    df = spark.createDataFrame(plain + told + copies, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r for r in pii.report(df).collect()}
    text = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    for i, t in told:
        at = [m.start() for m in re.finditer("starfish", t, re.I)]
        assert len(at) == 3 and all(f"term:{a}:{a + 8}" in got[i].spans.split(",") for a in at)
        assert "starfish" not in text[i].lower() and "common words are everywhere here" in text[i]
    assert all(got[i].n_terms == 0 and "jellyfish" in text[i] for i, _ in copies)  # one passage


def test_words_over_the_edge_of_the_window_are_whole(spark):
    rows = [(i, "plain text of another kind") for i in range(50)] + [(100, "".join(f" Xylophone{'-' * 74}{'.' * k} bob@ex.org{'_' * 77}Marimbas " for k in range(3)))]
    found = pii.detected(spark.createDataFrame(rows, "doc_id bigint, text string")).withColumn("row", F.monotonically_increasing_id())
    terms = {r.term for r in pii._near(pii._windows(found)).collect()}
    assert {"xylophone", "marimbas"} <= terms and terms <= {"xylophone", "marimbas"}


def test_places(spark):
    texts = cases() + ["é😀ñ word " * 700, "longword" * 50 + " x " + "some words. " * 500]
    df = spark.createDataFrame([(i, t or "") for i, t in enumerate(texts)], "row bigint, text string")
    got = sorted((r.row, r.start, r.end, r.term) for r in pii._places(df).collect())
    assert got == sorted((i, m.start(), m.end(), m.group().lower()) for i, t in enumerate(texts) for m in re.finditer(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]{4,}", t or ""))


def test_shares_count_documents_not_places(spark):
    # an entity in 10 documents, a word in 10, both in 3: the share is far under the threshold though each document has many places
    both = [(i, "zebrafish bob@ex.org zebrafish " * 5 + f"alpha{i}") for i in range(3)]
    one = [(10 + i, f"bob@ex.org writes beta{i} bob@ex.org") for i in range(7)]
    two = [(20 + i, f"zebrafish swims gamma{i} zebrafish") for i in range(7)]
    rest = [(100 + i, f"plain text of row{i}") for i in range(100)]
    df = spark.createDataFrame(both + one + two + rest, "doc_id bigint, text string")
    assert all("zebrafish" in r.text for r in pii.sanitised(df).collect() if r.doc_id in (0, 1, 2))


def test_many_matches_in_long_texts(spark):
    text = "".join(f"name{i}@example.org +1 555 010 {i:04d} 10.0.{i % 256}.7 " for i in range(4_000))
    df = spark.createDataFrame([(1, text), (2, "é😀 " * 100_000 + "a@b.c")], "doc_id bigint, text string").repartition(2)
    got = {r.doc_id: r for r in pii.report(df).collect()}
    clean = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert [got[1][f"n_{k}"] for k in PLAIN] == [sum(x[0] == k for x in base(text)) for k in PLAIN]
    assert clean[1] == cut(text, base(text)) and clean[2] == "é😀 " * 100_000 + "[EMAIL]"


def test_terms_beside_spans(spark):
    r = random.Random(3)
    for _ in range(20):
        spans = sorted((a, a + r.randint(1, 30), "email") for a in r.sample(range(600), r.randint(0, 60)))
        terms = sorted((a, a + r.randint(1, 9), "term") for a in r.sample(range(600), 40))
        df = spark.createDataFrame([(spans, terms)], f"spans array<{pii.SPANNED}>, terms array<{pii.SPANNED}>")
        got = [tuple(x) for x in df.select(pii._free(F.col("spans"), F.col("terms")).alias("x")).first().x]
        assert got == [t for t in terms if not any(s[0] < t[1] and t[0] < s[1] for s in spans)]
