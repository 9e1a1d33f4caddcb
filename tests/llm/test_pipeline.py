import corpus_pipeline
from tessella.llm import decontam, neardup, pieces, pii, quality
from tessella.llm.common import table
from tessella.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.001"


def test_stages_compose_and_keep_the_columns(spark):
    docs = table(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "pieces"]
    columns, before = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    model = quality.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    assert quality.accepted(docs, model).count() > 0
    classes = neardup.classes(docs).collect()
    assert len({r.component_id for r in classes}) >= len(classes) - 1  # sanitising may make texts alike
    assert decontam.contaminated(docs, table(spark, SF, "benchmark")).where("contaminated").count() == 0
    assert pii.report(docs).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    m = pieces.model(tokenizer_file("piece_bpe_32k.model"))
    text = {r.doc_id: r.text for r in docs.collect()}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == set(text) and all(r.round_trip and r.ids == m.sp.encode(text[r.doc_id]) for r in out)


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, SF, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_and_decontamination_against_plain_versions(spark):
    """What each stage keeps of its own input: components of plain Jaccard links, and windows looked up one by one."""
    import re

    docs = corpus_pipeline.quality(spark, table(spark, SF, "documents"), SF)
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = {i: shingles(t) for i, t in rows.items()}, {i: i for i in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(rows)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = {i for i in ids if find(i) == i}
    distinct = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert {r.doc_id for r in distinct.collect()} == kept and len(kept) < len(ids)

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    windows = set()
    for r in table(spark, SF, "benchmark").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    clean = {i for i in kept if not any(tuple(w[p : p + n]) in windows for w in [words(rows[i])] for n in sizes for p in range(len(w) - n + 1))}
    assert {r.doc_id for r in corpus_pipeline.decontamination(spark, distinct, SF).collect()} == clean and len(clean) < len(kept)
