import random

from tessella.llm import warc


def test_loser_tree_merges_any_runs():
    r = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(r.randint(0, 50) for _ in range(r.randint(0, 20))) for _ in range(k)]
        assert list(warc.LoserTree([iter(x) for x in runs], lambda v: v)) == sorted(v for x in runs for v in x)


def test_url_keys():
    assert warc.url_key("http://WWW.Example.com:80/A/b?z=1&a=2#f") == "com,example)/a/b?a=2&z=1"
    assert warc.url_key(None) == ")/" and warc.url_key("http://[bad") == "http://[bad"


def test_records_survive_the_archive(spark):
    html = ["<p>a</p>", "", None, "<p>a</p>", "é😀" * 100, "\r\n\r\nx", "long " * 40_000, "<p>a</p>", ""]
    rows = [(i * 3 + 1, f"http://h{i % 2}.example.com/p{i}", h, i) for i, h in enumerate(html)] + [(50, None, "only", 0)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, segment int").repartition(3)
    for least in (0, 4):
        got = warc.histories(warc.captures(warc.archive(pages, least))).collect()
        first = {}
        for i, _, h, _ in sorted(rows):
            first.setdefault(h or "", i)
        assert len(got) == len(rows)
        for r in got:
            raw = (next(h for i, _, h, _ in rows if i == r.page_id) or "")
            again = first[raw] != r.page_id and len(raw.encode()) >= least
            assert (r.payload_bytes, r.payload_digest) == (len(raw.encode()), warc.digest(raw.encode()))
            assert (r.record_type, r.refers_to) == (("revisit", first[raw]) if again else ("response", None))
        keys = [(r.url_key, r.captured_at, r.page_id) for r in got]
        assert keys == sorted(keys)
    none = warc.histories(warc.captures(warc.archive(pages.limit(0))))
    assert none.count() == 0


def expected(rows):
    """(page_id, record_type, refers_to, digest) by a plain pass over (page_id, html)."""
    first = {}
    for i, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, h in rows:
        to = first.get(h or "")
        again = to is not None and to != i
        out.append((i, "revisit" if again else "response", to if again else None, warc.digest((h or "").encode())))
    return sorted(out, key=str)


def test_repeated_and_missing_page_ids(spark, monkeypatch):
    rows = [(5, "one"), (5, "its own"), (1, "one"), (1, "one"), (None, "one"), (None, "alone"), (None, "twice"), (None, "twice"), (7, ""), (8, None), (8, "more"), (9, "more")]
    pages = spark.createDataFrame([(i, f"http://e.org/{k}", h, k) for k, (i, h) in enumerate(rows)], "page_id bigint, url string, html string, place int").repartition(4)
    for most in (400_000, 0):  # payloads broadcast, then shuffled
        monkeypatch.setattr(warc, "BROADCAST_ROWS", most)
        got = warc.histories(warc.captures(warc.archive(pages))).collect()
        assert sorted(((r.page_id, r.record_type, r.refers_to, r.payload_digest) for r in got), key=str) == expected(rows)


def test_ranges_merge_many_runs(spark):
    rows = [(i, f"http://e.org/{i % 3}", f"t{i}") for i in range(2000)]
    index = warc.captures(warc.archive(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(9)))
    got = warc.histories(index, range_rows=100).collect()
    keys = [(r.url_key, r.captured_at, r.page_id) for r in got]
    assert keys == sorted(keys) and len(keys) == 2000
