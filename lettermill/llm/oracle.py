"""SQL for DuckDB with the same rows, for the queries that SQL can express over whole tables.

Near-duplicates (p7) are found with a stated probability, so they have none; a test holds them against all pairs.
"""

from __future__ import annotations

_GRAMS = """r AS (SELECT DISTINCT id, split, list_filter(tokens, lambda t: t IS NOT NULL) AS t FROM mail_corpus WHERE id IS NOT NULL),
k AS (SELECT id, split, list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || chr(31) || t[i + 1] || chr(31) || t[i + 2])) AS g FROM r WHERE len(t) >= 20 AND {splits}),
s AS (SELECT row_number() OVER () AS n, id, split, g, len(g) AS c FROM k),
x AS (SELECT n, unnest(g) AS w FROM s),
p AS (SELECT a.n AS a, b.n AS b, count(*) AS shared FROM x a JOIN x b ON a.w = b.w AND a.n < b.n GROUP BY ALL)"""
_PAIRS = "SELECT DISTINCT least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b FROM p JOIN s a ON p.a = a.n JOIN s b ON p.b = b.n WHERE a.id <> b.id AND {ok} AND shared >= {least} * (a.c + b.c - shared)"
_WORDS = "list_transform(regexp_extract_all({text}, '[\\pL\\pN]+'), lambda w: lower(w))"


def _islands(hits: str, width: int, name: str) -> str:
    """Stretches of runs of so many symbols that overlap or touch, from rows (id, k) of where runs start."""
    return f"""SELECT id AS {name}, min(k)::INT AS "start", (max(k) + {width})::INT AS "end" FROM (SELECT id, k, sum(f) OVER (PARTITION BY id ORDER BY k) AS n FROM
(SELECT id, k, CASE WHEN k > lag(k) OVER (PARTITION BY id ORDER BY k) + {width} THEN 1 ELSE 0 END AS f FROM ({hits}))) GROUP BY id, n"""


_CHAR_RUNS = """rn AS (SELECT doc_id, unnest(range(length(text) - 199)) AS k, unnest(list_transform(range(1, length(text) - 198), lambda k: hash(substr(text, k, 200)))) AS h FROM documents WHERE length(text) >= 200 AND doc_id IS NOT NULL),
sh AS (SELECT h FROM rn GROUP BY h HAVING min(doc_id) <> max(doc_id)), hit AS (SELECT DISTINCT doc_id AS id, k FROM rn JOIN sh USING (h))"""


def queries() -> dict[str, str]:
    spans = f"WITH {_CHAR_RUNS}, sp AS ({_islands('SELECT id, k FROM hit', 200, 'doc_id')})"
    return {
        "p2_counts": f"""WITH {_GRAMS.format(splits="split IN ('train', 'validation')")}, pr AS (SELECT DISTINCT a.id AS ia, a.split AS sa, b.id AS ib, b.split AS sb FROM p JOIN s a ON p.a = a.n JOIN s b ON p.b = b.n WHERE a.split <> b.split AND shared >= 0.7 * (a.c + b.c - shared)),
l AS (SELECT id, split, count(DISTINCT o) AS links FROM (SELECT ia AS id, sa AS split, ib AS o FROM pr UNION ALL SELECT ib, sb, ia FROM pr) GROUP BY id, split),
rc AS (SELECT DISTINCT id, split, source FROM mail_corpus WHERE id IS NOT NULL AND split IN ('train', 'validation') AND len(list_filter(tokens, lambda t: t IS NOT NULL)) >= 20)
SELECT rc.split, rc.source, count(DISTINCT rc.id) AS records, count(DISTINCT CASE WHEN links > 0 THEN rc.id END) AS overlapping, sum(coalesce(links, 0))::BIGINT AS links FROM rc LEFT JOIN l ON rc.id = l.id AND rc.split = l.split GROUP BY rc.split, rc.source""",
        "p2_spans": f"""WITH r AS (SELECT DISTINCT id, split, list_filter(tokens, lambda t: t IS NOT NULL) AS t FROM mail_corpus WHERE id IS NOT NULL AND split IN ('train', 'validation')),
g AS (SELECT id, split, unnest(range(len(t) - 7)) AS k, unnest(list_transform(range(1, len(t) - 6), lambda i: array_to_string(t[i:i + 7], chr(31)))) AS w FROM r WHERE len(t) >= 20),
v AS (SELECT DISTINCT w FROM g WHERE split = 'validation') {_islands("SELECT DISTINCT g.id, g.k FROM g JOIN v ON g.w = v.w WHERE g.split = 'train'", 8, 'id')}""",
        "p10_spans": f"{spans} SELECT * FROM sp",
        "p10_share": f"""{spans} SELECT sp.doc_id, count(*) AS spans, sum("end" - "start")::BIGINT AS shared_chars, any_value(c) AS chars, sum("end" - "start") / any_value(c) AS share
FROM sp JOIN (SELECT doc_id, max(length(text)) AS c FROM documents GROUP BY doc_id) z ON sp.doc_id = z.doc_id GROUP BY sp.doc_id""",
        "p2_found": f"WITH {_GRAMS.format(splits="split IN ('train', 'validation')")} {_PAIRS.format(ok='a.split <> b.split', least=0.7)}",
        "p9_found": f"""WITH i AS (SELECT item_id, {_WORDS.format(text='text')} AS w FROM heldout_items WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS s FROM i WHERE len(w) >= 12),
d AS (SELECT doc_id, {_WORDS.format(text='text')} AS w FROM documents WHERE text IS NOT NULL),
dw AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS s FROM d WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (s)""",
        "p10_found": """WITH s AS (SELECT doc_id, unnest(list_transform(range(1, length(text) - 198), lambda k: hash(substr(text, k, 200)))) AS h FROM documents WHERE length(text) >= 200),
m AS (SELECT h FROM s GROUP BY h HAVING min(doc_id) <> max(doc_id)) SELECT DISTINCT doc_id FROM s JOIN m USING (h)""",
    }
