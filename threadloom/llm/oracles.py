"""SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations


def _usable(name: str, kind: str, value: str) -> str:
    return f"""(SELECT k, id, v FROM (SELECT {kind} AS k, thread_id AS id, updated_at, {value} AS raw, dimensions, TRY_CAST(TRY_CAST({value} AS JSON) AS DOUBLE[]) AS v FROM {name} WHERE model = 'trellis-embed-l')
        WHERE k IS NOT NULL AND id IS NOT NULL AND len(v) = dimensions AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
        QUALIFY row_number() OVER (PARTITION BY k, id ORDER BY updated_at DESC NULLS LAST, raw DESC) = 1)"""


_TV = _usable("thread_vectors", "'thread_vectors'", "vector_json")
_P2 = f"""
WITH v AS (SELECT * FROM {_TV} UNION ALL SELECT * FROM {_usable("document_embeddings", "source_kind", "embedding_json")}),
s AS (SELECT a.k, a.id AS x, b.id AS y, list_cosine_similarity(a.v, b.v) AS c FROM v a JOIN v b ON a.k = b.k AND a.id <> b.id AND len(a.v) = len(b.v)),
near AS (SELECT * FROM s WHERE c >= 0.82 QUALIFY row_number() OVER (PARTITION BY k, x ORDER BY c DESC, y) <= 6)
"""
_P2_FOUND = """
SELECT DISTINCT k AS vector_set, least(x, y) AS left_thread_id, greatest(x, y) AS right_thread_id FROM near
"""
_P6 = f"""
WITH v AS (SELECT id, v FROM {_TV}),
s AS (SELECT a.id AS x, b.id AS y, list_cosine_similarity(a.v, b.v) AS c FROM v a JOIN v b ON a.id <> b.id AND len(a.v) = len(b.v)),
hood AS (SELECT x, list_sort(list_append(list(y), x)) AS n, avg(c) AS m FROM s WHERE c >= 0.80 GROUP BY x),
same AS (SELECT n, count(*) AS size, arg_max(x, {{'m': round(m, 9), 'i': -x}}) AS r FROM hood GROUP BY n)
SELECT r AS representative_thread_id, unnest(n) AS thread_id FROM same WHERE size = len(n) AND size >= 4
"""
_LE, _W = r"(?:\x{E000}\x{E001}|\r|\n)", r"[ \t\r\n\x{E000}\x{E001}]+"


def _fits(parts: str) -> str:
    return f"list_max(list_transform({parts}, lambda x: length(regexp_replace(x, '^{_W}|{_W}$', '', 'g')))) <= 6000"


_P3_ITEMS = """
WITH item AS (SELECT 'threads' AS item_table, id AS item_id, body AS t FROM threads WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, body DESC NULLS LAST) = 1
    UNION ALL SELECT 'documents', doc_id, raw_text FROM documents WHERE doc_id IS NOT NULL)
"""
_P3 = rf"""{_P3_ITEMS},
big AS (SELECT item_table, item_id, replace(t, chr(13) || chr(10), chr(57344) || chr(57345)) AS s FROM item WHERE length(t) > 6000)
SELECT item_table, item_id, CASE
    WHEN {_fits(f"regexp_split_to_array(s, '{_LE}(?:[ \t]*{_LE})+')")} THEN 'paragraph'
    WHEN {_fits(f"regexp_split_to_array(s, '{_LE}')")} THEN 'line'
    WHEN {_fits(f"regexp_split_to_array(regexp_replace(s, '([.!?]){_W}', '\1' || chr(10), 'g'), '{_LE}')")} THEN 'sentence'
    WHEN {_fits(f"regexp_split_to_array(s, '{_W}')")} THEN 'word' ELSE 'none' END AS boundary FROM big
"""
_P4 = """
WITH RECURSIVE e AS (SELECT left_thread_id AS a, right_thread_id AS b FROM similarity_edges WHERE score >= 0.78 AND score <= 1 AND left_thread_id <> right_thread_id),
bw AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(id, r) AS (SELECT a, a FROM bw UNION SELECT bw.b, reach.r FROM reach JOIN bw ON bw.a = reach.id),
found AS (SELECT min(r) AS group_thread_id, id AS thread_id FROM reach GROUP BY id)
"""
_P5_PAIRS = r"""
WITH RECURSIVE item AS (SELECT 'threads' AS record_table, id, coalesce(title, '') || chr(10) || coalesce(body, '') AS t FROM (SELECT * FROM threads WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, title DESC NULLS LAST, body DESC NULLS LAST) = 1)
    UNION ALL SELECT 'documents', doc_id, dedupe_text FROM documents WHERE doc_id IS NOT NULL),
w AS (SELECT record_table, id, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS w FROM item),
g AS (SELECT DISTINCT record_table, id, hash(w[i] || chr(0) || w[i + 1] || chr(0) || w[i + 2]) AS g FROM (SELECT record_table, id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
n AS (SELECT record_table, id, count(*) AS n FROM g GROUP BY 1, 2 HAVING count(*) >= 20),
big AS (SELECT g.* FROM g JOIN n USING (record_table, id)),
both_ AS (SELECT a.record_table, a.id AS x, b.id AS y, count(*) AS c FROM big a JOIN big b ON a.record_table = b.record_table AND a.g = b.g AND a.id < b.id GROUP BY 1, 2, 3),
pr AS (SELECT both_.record_table, x AS left_id, y AS right_id FROM both_ JOIN n p ON p.record_table = both_.record_table AND p.id = x JOIN n q ON q.record_table = both_.record_table AND q.id = y WHERE c >= 0.6 * (p.n + q.n - c))
"""
_P5_GROUPS = """,
nb AS (SELECT record_table, left_id AS a, right_id AS b FROM pr UNION ALL SELECT record_table, right_id, left_id FROM pr),
kd AS (SELECT w.record_table, w.id, md5(array_to_string(w.w, ' ')) AS k FROM w JOIN n USING (record_table, id)),
cp AS (SELECT record_table, id, k, count(*) OVER (PARTITION BY record_table, k) AS n_copies FROM kd),
ln AS (SELECT nb.record_table, a AS id, count(DISTINCT y.k) FILTER (WHERE y.k <> x.k) AS n_links FROM nb JOIN kd x ON x.record_table = nb.record_table AND x.id = a JOIN kd y ON y.record_table = nb.record_table AND y.id = b GROUP BY 1, 2),
reach(t, id, r) AS (SELECT record_table, a, a FROM nb UNION SELECT reach.t, nb.b, reach.r FROM reach JOIN nb ON nb.record_table = reach.t AND nb.a = reach.id)
SELECT cp.record_table, cp.id AS record_id, g.r AS group_record_id, ln.n_links, cp.n_copies FROM cp JOIN ln USING (record_table, id) JOIN (SELECT t, id, min(r) AS r FROM reach GROUP BY 1, 2) g ON g.t = cp.record_table AND g.id = cp.id
"""
_P9 = """
WITH d AS (SELECT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 150),
g AS (SELECT doc_id, i, md5(substr(text, i, 150)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 148)) AS i FROM d)),
common AS (SELECT h FROM g GROUP BY h HAVING min(doc_id) <> max(doc_id)),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM g WHERE h IN (SELECT h FROM common))
SELECT doc_id, CAST(sum(least(150, i - coalesce(p, -1000))) AS BIGINT) AS shared_chars FROM hit GROUP BY 1
"""
ORACLES = {
    "p2_found": _P2 + _P2_FOUND,
    "p2_recall": _P2 + "SELECT k AS vector_set, count(*) AS exact_pairs, true AS reached FROM near WHERE x % 50 = 0 GROUP BY 1",
    "p3_found": _P3,
    "p3_cover": _P3_ITEMS + "SELECT item_table, item_id, length(t) AS covered, true AS within, true AS lapped FROM item WHERE length(t) > 6000",
    "p4_found": _P4 + "SELECT * FROM found",
    "p4_group_sizes": _P4 + "SELECT size, count(*) AS n_groups FROM (SELECT group_thread_id, count(*) AS size FROM found GROUP BY 1) GROUP BY 1",
    "p5_found": _P5_PAIRS + "SELECT * FROM pr",
    "p5_groups": _P5_PAIRS + _P5_GROUPS,
    "p6_found": _P6,
    "p9_found": _P9,
}
