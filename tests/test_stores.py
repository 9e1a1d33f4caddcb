import uuid
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from tessella.operators import grep, images, trees, vector
from tessella.operators.cache import ContentCache
from tessella.sources import packages
from tessella.storage import listed, shared_dir
from tessella.streaming import requests


@pytest.fixture
def folder(spark):
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


class Counting(vector.HashedTokens):
    """Fails on request, after it has been asked to encode."""

    fail = False

    def encode(self, units, key, text="text"):
        out = super().encode(units, key, text)
        return out.withColumn("embedding", F.when(F.raise_error(F.lit("model is away")).isNull(), F.col("embedding"))) if self.fail else out


def test_cache_by_content_across_sessions(spark, folder):
    units = [(i, f"text number {i % 7} of some words") for i in range(20)] + [(50, None), (51, "")]
    df = spark.createDataFrame(units, "unit bigint, text string")
    model = Counting(8)
    first = ContentCache(spark, model, folder)
    want = {r.unit: r.embedding for r in model.encode(df.fillna("", ["text"]), "unit").collect()}
    assert {r.unit: r.embedding for r in first.vectors(df, "unit").collect()} == want and first.encoded == 8
    later = ContentCache(spark, Counting(8), folder)  # another session knows what the first one wrote
    changed = df.withColumn("text", F.when(F.col("unit") == 3, "changed words").otherwise(F.col("text")))
    assert later.vectors(changed, "unit").count() == 22 and later.encoded == 1
    assert later.vectors(changed, "unit").count() == 22 and later.encoded == 0
    model.fail = True
    with pytest.raises(Exception, match="model is away"):
        first.vectors(df.withColumn("text", F.lit("new")), "unit")
    model.fail = False
    assert first.known().count() == 9  # what the dead run staged does not count
    first.clear()
    assert first.known().count() == 0


def test_a_killed_write_leaves_the_old_package(spark, folder, monkeypatch):
    rows = lambda n: spark.range(n).select(F.col("id"), F.concat(F.lit("t"), "id").alias("text"), F.lit(None).cast("string").alias("empty"))
    with pytest.raises(FileNotFoundError):
        packages.current(spark, folder)
    packages.write(spark, folder, {"a": (rows(5), ["id"]), "b": (rows(3), ["id"])})
    old = packages.current(spark, folder)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(packages, "publish", killed)
        with pytest.raises(KeyboardInterrupt):
            packages.write(spark, folder, {"a": (rows(50), ["id"])})
    assert packages.current(spark, folder) == old
    assert packages.read(spark, old, "a").collect() == rows(5).collect() and packages.damaged(spark, old).count() == 0
    reader = packages.read(spark, old, "b")
    packages.write(spark, folder, {"a": (rows(9), ["id"])}, file_rows=2)
    assert reader.count() == 3  # a reader of the old version reads on
    new = packages.current(spark, folder)
    assert packages.read(spark, new, "a").count() == 9 and packages.manifest(spark, new).count() >= 5
    packages.prune(spark, folder)
    assert [n for n in listed(spark, folder) if n.startswith("v-")] == [new.rsplit("/", 1)[1]]
    local = new.removeprefix("file://")
    import glob
    import os

    files = sorted(glob.glob(f"{local}/a/part-*"))
    with open(files[0], "ab") as f:
        f.write(b"x")
    os.remove(files[1])
    for crc in glob.glob(f"{local}/a/.*.crc"):
        os.remove(crc)
    assert sorted(r.problem for r in packages.damaged(spark, new).collect()) == ["changed", "missing"]


def test_combined_rejects(spark):
    source = spark.createDataFrame([("p", 1, "x"), ("p", 2, "y")], "project string, id bigint, text string")
    keys = lambda *k: spark.createDataFrame([("p", i) for i in k], "project string, id bigint")
    assert packages.combined(keys(2), source, ["project", "id"]).collect()[0].text == "y"
    for bad, said in (((1, 1), "eligible twice: p, 1"), ((3,), "not in the source: p, 3")):
        with pytest.raises(Exception, match=said):
            packages.combined(keys(*bad), source, ["project", "id"]).collect()


@pytest.mark.parametrize("where", ["before", "after"])
def test_log_restarts(spark, folder, where):
    rows = spark.range(200).select((F.col("id") % 40).alias("conv_id"), (F.col("id") / 40).cast("bigint").alias("turn"), F.element_at(F.array(*map(F.lit, ("user", "assistant", "tool"))), (F.col("id") % 3 + 1).cast("int")).alias("role"), F.when(F.col("id") % 9 > 0, F.concat(F.lit("text "), "id")).alias("text"))
    rows.repartition(5).write.parquet(f"{folder}/in")
    tries = []

    def fail(number):
        if number in (1, 3) and number not in tries:
            tries.append(number)
            raise InterruptedError("stopped here")

    for _ in range(3):
        try:
            requests.appended(requests.turns(spark, f"{folder}/in"), f"{folder}/log", f"{folder}/checkpoint", **{where: fail})
        except Exception as e:
            assert "stopped here" in str(e)
    assert tries == [1, 3]
    assert sorted(requests.logged(spark, f"{folder}/log").collect()) == sorted(requests.requests(rows).collect())
    rows.limit(7).withColumn("turn", F.lit(99).cast("bigint")).write.mode("append").parquet(f"{folder}/in")
    requests.appended(requests.turns(spark, f"{folder}/in"), f"{folder}/log", f"{folder}/checkpoint")
    assert requests.logged(spark, f"{folder}/log").count() == 207


def test_tree_digests_name_what_changed(spark):
    files = [("a/b/c.md", "1"), ("a/b/d.md", "2"), ("a/e.md", "3"), ("f.md", ""), ("a/node_modules/x.js", "z"), ("g/h.tmp", "z"), (".git/x", "z")]
    df = lambda rows: spark.createDataFrame(rows, "path string, content string")
    one = trees.digests(df(files))
    assert {r.path: (r.kind, r.level, r.files) for r in one.collect()} == {"a/b/c.md": ("file", 3, 1), "a/b/d.md": ("file", 3, 1), "a/e.md": ("file", 2, 1), "f.md": ("file", 1, 1), "a/b": ("folder", 2, 2), "a": ("folder", 1, 3), "": ("folder", 0, 4)}
    assert trees.changed(one, trees.digests(df(files[::-1]))).count() == 0
    moved = [("a/b/c.md", "2"), ("a/b/d.md", "1"), *files[2:4], ("a/new", "n")]  # contents swapped
    assert {(r.path, r.change) for r in trees.changed(one, trees.digests(df(moved))).collect()} == {("a/b/c.md", "changed"), ("a/b/d.md", "changed"), ("a/b", "changed"), ("a", "changed"), ("", "changed"), ("a/new", "added")}
    assert trees.digests(df([])).count() == 0


def test_image_states(spark):
    scripts = {
        "ok": (False, [("ok", "image/png", 1)], "resolved", None), "moved": (False, [("redirect", None, 0)] * 5 + [("ok", "image/gif", 9)], "resolved", None), "loop": (True, [("redirect", None, 0)] * 9, "failed", "too_many_redirects"),
        "again": (True, [("http_error", None, 0), ("redirect", None, 0), ("ok", "image/png", 1)], "resolved", None), "twice": (True, [("http_error", None, 0), ("http_error", None, 0)], "failed", "http_error"), "once": (False, [("http_error", None, 0), ("ok", "image/png", 1)], "failed", "http_error"),
        "net": (True, [("network_error", None, 0)], "failed", "network_error"), "late": (True, [("http_error", None, 0), ("network_error", None, 0)], "failed", "network_error"), "text": (False, [("ok", "text/html", 5)], "failed", "unsupported_or_non_image"), "none": (False, [("ok", "image/png", 0)], "failed", "unsupported_or_non_image"),
        "big": (False, [("ok", "image/png", images.MAX_BYTES + 1)], "failed", "image_too_large"), "open": (False, [("redirect", None, 0)], "redirected", None), "fresh": (True, [("http_error", None, 0)], "refreshing", None),
    }
    rows = [(name, fresh, k, o, f"u{k}", t, s, False) for name, (fresh, tries, _, _) in scripts.items() for k, (o, t, s) in enumerate(tries)]
    rows += [("many", True, k, "redirect" if k < 2 else "ok", "u", "image/png", 1, False) for k in range(3000)]  # long after the end
    rows.append(("gif", False, 0, "ok", "u", "image/gif", 3, True))
    df = spark.createDataFrame(rows, "image_id string, refreshable boolean, attempt int, outcome string, location string, type string, size bigint, animated boolean").repartition(6)
    got = {r.image_id: r for r in images.states(df).collect()}
    for name, (_, _, state, error) in scripts.items():
        assert (got[name].state, got[name].error) == (state, error), name
    assert got["many"].attempts == 3 and got["gif"].error == "animated_gif_unsupported" and got["loop"].attempts == 6 and got["moved"].redirects == 5
    say = "a description of what is to be seen"
    pictures = [("once", "document", say, False), ("twice", "question", say, False), ("late", "document", say, False), ("ok", "document", say, True), ("open", "document", "", False), ("unseen", "answer", "", False), ("fresh", "document", "photo", False)]
    out = {r.image_id: (r.status, r.error_code) for r in images.resolved(spark.createDataFrame(pictures, "image_id string, role string, alt string, unsafe boolean"), df).collect()}
    assert out == {"once": ("text_fallback", "http_error"), "twice": ("failed", "http_error"), "late": ("failed", "network_error"), "ok": ("failed", "unsafe_image_url"), "open": ("failed", "unfinished"), "unseen": ("failed", "never_tried"), "fresh": ("failed", "unfinished")}


def test_grep_against_loops(spark):
    docs = [(1, "Alpha beta\nbeta ALPHA alpha\n\ngamma"), (2, "alphabet\nx"), (3, None), (4, ""), (5, "beta\n" * 300)]
    wanted = [(1, "alpha"), (1, "Beta"), (2, "beta"), (2, "phab"), (3, "none"), (4, "")]
    df, w = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(wanted, "qid bigint, term string")
    lines = [(d, n, x.lower()) for d, t in docs for n, x in enumerate((t or "").split("\n"))]
    found = defaultdict(list)
    for _, t in wanted:
        found[t.lower()] = [(d, n) for d, n, x in lines if t and t.lower() in x]
    for block in (1, 100):
        assert {(r.doc_id, r.line, r.term) for r in grep.matches(df, w, block).collect()} == {(d, n, t) for t, hits in found.items() for d, n in hits}
    want = defaultdict(float)
    for q in {q for q, _ in wanted}:
        mine = [t.lower() for p, t in wanted if p == q]
        cover = defaultdict(int)
        for t in mine:
            hits = found[t][:250]
            for place, d in enumerate(dict.fromkeys(d for d, _ in hits), 1):
                want[q, d] += 1 / (60 + place)
            for h in hits:
                cover[h] += 1
        for (d, _), k in cover.items():
            want[q, d] += 0.003 * k * k / len(mine)
    assert {(r.qid, r.doc_id): r.score for r in grep.search(df, w).collect()} == {k: pytest.approx(v, abs=1e-8) for k, v in want.items()}
    plan = grep.search(df, w)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
