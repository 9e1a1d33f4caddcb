"""DuckDB SQL for the queries of this subpackage that SQL can express."""

LOWER = "translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all(" + LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
BASE32 = "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(h, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31 AS BIGINT), 1)), '')"

SQL: dict[str, str] = {
    "op4_ngram_join": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(""" + LOWER.format(x="text") + r""", '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS sh FROM w),
    f AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
    e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM f a JOIN f b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
    r(root, node) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.root, e.b FROM r JOIN e ON r.node = e.a)
    SELECT s.doc_id, CAST(any_value(len(sh)) AS BIGINT) AS n_shingles, min(node) AS component_id FROM s JOIN r ON r.root = s.doc_id GROUP BY s.doc_id""",
    "op6_decontaminate": f"""WITH d AS (SELECT doc_id, {WORDS.format(x="text")} AS w FROM documents), b AS (SELECT item_id, {WORDS.format(x="text")} AS w FROM benchmark),
    win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
    dwin AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
    hit AS (SELECT doc_id, p, dwin.n AS n, item_id FROM dwin JOIN win ON dwin.n = win.n AND dwin.win = win.win),
    pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN items ON d.doc_id = items.doc_id""",
    "op7_repeats": """WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(length(hex(encode(coalesce(text, '')))) // 2 AS BIGINT) AS n FROM documents),
    win AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM t WHERE n >= 100)),
    late AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM win) WHERE k > 1),
    gap AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM late),
    num AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM gap),
    runs AS (SELECT doc_id, k, min(p) AS a, max(p) + 100 AS b FROM num GROUP BY doc_id, k),
    keep AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM runs UNION ALL SELECT r.doc_id, max(b), any_value(n) FROM runs r JOIN t ON r.doc_id = t.doc_id GROUP BY r.doc_id),
    kept AS (SELECT k.doc_id, string_agg(substr(h, CAST(2 * x + 1 AS BIGINT), CAST(2 * (y - x) AS BIGINT)), '' ORDER BY x, y) AS h, CAST(sum(y - x) AS BIGINT) AS m FROM keep k JOIN t ON k.doc_id = t.doc_id GROUP BY k.doc_id),
    spans AS (SELECT doc_id, count(*) AS n_spans FROM runs GROUP BY doc_id)
    SELECT t.doc_id, t.n AS n_bytes, CAST(t.n - coalesce(m, t.n) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, t.h))) AS kept_sha256 FROM t LEFT JOIN kept ON t.doc_id = kept.doc_id LEFT JOIN spans ON t.doc_id = spans.doc_id""",
    "op8_warc": f"""WITH p AS (SELECT page_id, url, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
    u AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www[0-9]*\\.', '') AS host, lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)) AS path, lower(regexp_extract(url, '\\?([^#]*)', 1)) AS q FROM pages)
    SELECT p.page_id, payload_bytes, {BASE32} AS payload_digest, CASE WHEN p.page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN p.page_id <> first THEN first END AS refers_to,
    array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(q, '&')), '&') END AS url_key,
    strftime(TIMESTAMP '2020-01-01' + to_seconds(p.page_id), '%Y-%m-%dT%H:%M:%SZ') AS captured_at FROM p JOIN u ON p.page_id = u.page_id""",
}

SQL["op12_filter_audit"] = r"""WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    f AS (SELECT doc_id, part, len(w) < 50 AS "A", 100 * len(list_distinct(w)) < 65 * len(w) AS "B", 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 5 * length(x) AS "C", regexp_matches(x, '[#$%&*|]') AS "D", doc_id > min(doc_id) OVER (PARTITION BY x) AS "E" FROM t),
    l AS (SELECT doc_id, max(quality) AS q, max(toxic) AS tx FROM labels GROUP BY doc_id),
    g AS (SELECT part, CASE WHEN "A" THEN 'A' ELSE '' END || CASE WHEN "B" THEN 'B' ELSE '' END || CASE WHEN "C" THEN 'C' ELSE '' END || CASE WHEN "D" THEN 'D' ELSE '' END || CASE WHEN "E" THEN 'E' ELSE '' END AS failed, coalesce(q = 1, false) AS good, coalesce(tx = 1, false) AS toxic FROM f LEFT JOIN l ON f.doc_id = l.doc_id),
    c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    o AS (SELECT a.x || b.x || c3.x || d.x || e.x AS filter_order FROM c a, c b, c c3, c d, c e WHERE len(list_distinct([a.x, b.x, c3.x, d.x, e.x])) = 5),
    s AS (SELECT part, filter_order, k AS step, substr(filter_order, k, 1) AS filter, failed, good, toxic, contains(failed, substr(filter_order, k, 1)) AS fails, regexp_matches(failed, '[' || substr(filter_order, 1, k - 1) || '_]') AS gone FROM g, o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS k)),
    n AS (SELECT part, filter_order, step, filter, count(*) FILTER (NOT gone AND NOT fails) AS kept, count(*) FILTER (fails AND NOT gone) AS removed, count(*) FILTER (fails AND gone) AS redundant, count(*) FILTER (failed = filter) AS unique_fails, count(*) FILTER (fails AND NOT gone AND good) AS good_lost, count(*) FILTER (fails AND NOT gone AND toxic) AS toxic_lost FROM s GROUP BY ALL)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM n"""  # fmt: skip


def _codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Rounds of assignment in whole numbers, written out one after the other."""
    ctes = [
        "v AS MATERIALIZED (SELECT vec_id, label, embedding AS e, len(embedding) // %d AS width FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)" % parts,
        "x AS MATERIALIZED (SELECT vec_id, (i - 1) // width AS part, (i - 1) % width AS pos, CAST(floor(4096 * CAST(e[i] AS DOUBLE)) AS BIGINT) AS val FROM (SELECT vec_id, e, width, unnest(range(1, len(e) + 1)) AS i FROM v))",
        f"b0 AS MATERIALIZED (SELECT part, r AS entry, pos, val FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS r FROM v ORDER BY vec_id LIMIT {entries}) USING (vec_id))",
    ]
    assign = "SELECT vec_id, part, min_by(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT vec_id, x.part AS part, entry, CAST(sum((x.val - b.val) * (x.val - b.val)) AS BIGINT) AS d FROM x JOIN b{0} b ON x.part = b.part AND x.pos = b.pos GROUP BY ALL) GROUP BY vec_id, part"
    for k in range(rounds):
        ctes.append(f"a{k} AS MATERIALIZED ({assign.format(k)})")
        ctes.append(f"m{k} AS MATERIALIZED (SELECT part, entry, pos, CAST(sum(val) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{k} USING (vec_id, part) GROUP BY ALL)")
        ctes.append(f"b{k + 1} AS MATERIALIZED (SELECT part, entry, pos, CASE WHEN n IS NULL THEN val ELSE (s - ((s % n) + n) % n) // n END AS val FROM b{k} LEFT JOIN m{k} USING (part, entry, pos))")
    ctes.append(f"z AS MATERIALIZED ({assign.format(rounds)})")
    ctes.append("c AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM z GROUP BY vec_id)")
    digest = f"(SELECT sha256(string_agg(CAST(val AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b{rounds})"
    return f"WITH {', '.join(ctes)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, {digest} AS codebooks_sha256 FROM c JOIN v USING (vec_id)"


SQL["op13_vector_codes"] = _codes()

#: For the pages at hand, whose article is one element of headings and paragraphs.
SQL["op11_main_text"] = r"""WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's') AS x FROM pages),
    b AS (SELECT page_id, url, list_transform(regexp_split_to_array(x, '</?(h1|p)>'), lambda t: replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]*>', CASE WHEN t LIKE '%<br>%' THEN ' ' ELSE '' END, 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#x27;', ''''), '&#39;', '''')) AS l FROM a),
    c AS (SELECT page_id, url, list_filter(list_transform(l, lambda t: trim(regexp_replace(regexp_replace(t, '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda t: t <> '') AS l FROM b)
    SELECT page_id, url, array_to_string(l, chr(10)) AS text, CAST(length(array_to_string(l, chr(10))) AS BIGINT) AS n_chars FROM c"""  # fmt: skip
