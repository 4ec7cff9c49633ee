"""SQL for DuckDB that must give the same rows as the queries of the same names."""

from __future__ import annotations

from html.entities import name2codepoint

from ..functions import html as h
from ..functions import scores
from ..functions import text as t
from ..operators.compare import IGNORED
from ..sources.mime import CHARSETS, DOCX_TYPE


def _q(value: str) -> str:
    """A string literal; every character beyond printable ASCII is given by its number."""
    out, plain = [], ""
    for c in value:
        if " " <= c <= "~":
            plain += "''" if c == "'" else c
        else:
            out += [f"'{plain}'", f"chr({ord(c)})"] if plain else [f"chr({ord(c)})"]
            plain = ""
    return "(" + " || ".join([*out, f"'{plain}'"] if plain or not out else out) + ")" if out else f"'{plain}'"


def _sub(expr: str, pattern: str, to: str) -> str:
    return f"regexp_replace({expr}, {_q(pattern)}, {_q(to)}, 'g')"


def redact(e: str) -> str:
    return _sub(_sub(_sub(e, t.URL, "httpurl"), t.EMAIL, "emailaddress"), t.DOMAIN, "domainname")


def _rebuilt(e: str, pattern: str, piece: str) -> str:
    """Pieces between matches, each followed by the replacement of the first group, called n."""
    names = f"list_transform(regexp_extract_all({e}, {_q(pattern)}, 1), lambda n: {piece})"
    return f"CASE WHEN {e} IS NULL THEN NULL ELSE array_to_string(list_transform(list_zip(string_split_regex({e}, {_q(pattern)}), {names}), lambda z: z[1] || coalesce(z[2], '')), '') END"


def entities(e: str) -> str:
    keys = ", ".join(f"'{k}'" for k in name2codepoint)
    values = ", ".join(f"chr({v})" for v in name2codepoint.values())
    return _rebuilt(e, t.ENTITY, f"coalesce(map_extract_value(MAP([{keys}], [{values}]), n), '?')")


def fold(e: str) -> str:
    table = t.fold_table()
    single = {k: v for k, v in table.items() if len(v) == 1}
    for k, v in table.items():
        if len(v) > 1 and ord(k) < 0x2200:
            e = f"replace({e}, chr({ord(k)}), {_q(v)})"
    e = f"translate({e}, {'||'.join(f'chr({ord(k)})' for k in single if ord(k) < 0x10000)}, {_q(''.join(v for k, v in single.items() if ord(k) < 0x10000))})"
    return f"regexp_replace({e}, '[^\\x00-\\x7F]', '', 'g')"


def lex(e: str) -> str:
    for pattern, to in t.LEXER:
        e = _sub(e, pattern, to.replace("$", "\\"))
    return f"list_filter(string_split({e}, ' '), lambda x: x <> '')"


def squeeze(e: str) -> str:
    return f"trim({_sub(e, '[' + t.SPACES + chr(34) + ']+', ' ')})"


def own(e: str) -> str:
    return _sub(e, t.REPLY, "")


_TOKENS = f"""entity AS (SELECT doc_id, lang, {entities(redact('text'))} AS e FROM documents WHERE text IS NOT NULL),
folded AS (SELECT doc_id, lang, {fold('e')} AS f FROM entity),
toks AS (SELECT doc_id, lang, {lex('lower(f)')} AS tokens FROM folded)"""

_LINES = "ln AS (SELECT DISTINCT line_no, score, tokens FROM score_log WHERE score IS NOT NULL AND tokens IS NOT NULL)"
_SCORED = f"{_LINES}, sc AS (SELECT line_no, score + (line_no % 7) * 0.125::DOUBLE + 0.1::DOUBLE AS s, len(tokens) AS known FROM ln)"
_BUCKET = "CASE WHEN known < 10 THEN 'toosmall' WHEN s < 2 THEN 'ham' WHEN s < 10 THEN 'maybeham' WHEN s < 20 THEN '20ham' WHEN s > 98 THEN 'spam' WHEN s > 90 THEN 'maybespam' WHEN s > 80 THEN '80spam' ELSE 'dunno' END"
_BATCH = "CASE WHEN known < 10 THEN 'toosmall' WHEN s <= 10 THEN 'ham-' || trunc(s)::INT WHEN s < 20 THEN 'ham-maybe' WHEN s >= 90 THEN 'spam-' || trunc(s)::INT WHEN s > 80 THEN 'spam-maybe' ELSE 'dunno' END"
_CHANGED = f"""{_LINES}, nw AS (SELECT *, ((coalesce(list_sum(list_transform(tokens, lambda x: coalesce(length(x), 0))), 0)::BIGINT * 37 + len(tokens) * 11) % 101)::INT AS new FROM ln),
ch AS (SELECT *, score - new AS diff, CASE WHEN score <= 20 AND new >= 80 THEN '+' WHEN new <= 20 AND score >= 80 THEN '-' WHEN score < 2 AND new >= 2 THEN '?'
WHEN new < 2 AND score >= 2 THEN '!' WHEN score >= 98 AND new < 98 THEN '?' WHEN new >= 98 AND score < 98 THEN '!' ELSE ' ' END AS change FROM nw)"""
_IS_HTML = "(lower(trim(split_part(coalesce(ctype, ''), ';', 1))) IN ('text/html', 'text/xml') OR " + " OR ".join(f"contains(lower(coalesce(text, '')), '{m}')" for m in h.MARKS) + ")"
_HTML = f"""hd AS (SELECT doc_id, CASE WHEN strpos(lower(text), '<body') > 1 THEN substr(text, strpos(lower(text), '<body')) ELSE text END AS text FROM documents WHERE {_IS_HTML}),
src AS (SELECT doc_id, regexp_replace({_sub('text', h.COMMENT, ' HTMLcomment ')}, {_q(h.OPEN_COMMENT)}, '') AS c FROM hd WHERE text IS NOT NULL),
ch AS (SELECT doc_id, unnest(string_split(c, '<')) AS chunk, generate_subscripts(string_split(c, '<'), 1) AS pos FROM src),
tg AS (SELECT *, CASE WHEN contains(chunk, '>') THEN substr(chunk, 1, strpos(chunk, '>') - 1) END AS tag FROM ch),
nm AS (SELECT *, lower(regexp_extract(tag, '^\\s*(\\S+)', 1)) AS name, CASE WHEN tag IS NULL THEN chunk ELSE substr(chunk, length(tag) + 2) END AS rest FROM tg),
dp AS (SELECT *, sum(CASE name WHEN 'style' THEN 1 WHEN '/style' THEN -1 ELSE 0 END) OVER w AS st, sum(CASE name WHEN 'script' THEN 1 WHEN '/script' THEN -1 ELSE 0 END) OVER w AS sp
FROM nm WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
pc AS (SELECT doc_id, pos, CASE WHEN tag IS NULL THEN rest WHEN st <= 0 AND sp <= 0 THEN
(CASE WHEN name IN ('p','span','div') AND regexp_matches(lower(tag) || ';', {_q(h.WHITE)}) THEN chr(10) || 'HTMLhiddenWHITE:' ELSE '' END) ||
(CASE WHEN name IN ('p','span','div') AND regexp_matches(lower(tag) || ';', {_q(h.TINY)}) THEN chr(10) || 'HTMLhiddenFONTSIZE:' ELSE '' END) ||
(CASE WHEN name IN ('p','br','td','div','li') THEN chr(10) ELSE '' END) || rest ELSE '' END AS piece FROM dp),
txt AS (SELECT d.doc_id, x.text FROM hd d LEFT JOIN (SELECT doc_id, string_agg(piece, '' ORDER BY pos) AS text FROM pc GROUP BY doc_id) x ON d.doc_id = x.doc_id)"""
_NUMBER = "CASE WHEN lower(n[2]) = 'x' THEN TRY_CAST('0x' || regexp_replace(n[3:], '^0+(.)', '\\1') AS BIGINT) ELSE TRY_CAST(regexp_replace(n[2:], '^0+(.)', '\\1') AS BIGINT) END"
_HEADS = "hs AS (SELECT DISTINCT msg_no, seq, name, coalesce(value, '') AS value FROM header_block WHERE name IS NOT NULL)"
_MAIL = f"""{_HEADS}, ps AS (SELECT DISTINCT msg_no, part_no, coalesce(payload, ''::BLOB) AS payload FROM mime_parts WHERE msg_no IS NOT NULL),
ev AS (SELECT msg_no FROM hs UNION SELECT msg_no FROM ps)"""


def _count(word: str) -> str:
    return f"sum((length(t) - length(replace(t, '{word}', ''))) // {len(word)})::BIGINT AS {word}"


def queries() -> dict[str, str]:
    known = f"""WITH {_TOKENS}, ex AS (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM toks),
kn AS (SELECT doc_id, pos, ex.token, v.id FROM ex JOIN vocab v ON ex.token = v.token),
ag AS (SELECT doc_id, array_agg(token ORDER BY pos) AS ts, array_agg(id ORDER BY pos) AS ids FROM kn GROUP BY doc_id)"""
    names = ", ".join(f"'{k}': '{v}'" for k, v in CHARSETS.items())
    return {
        "redact_text": f"SELECT doc_id, {redact('text')} AS redacted FROM documents",
        "redaction_counts_by_lang": f"SELECT lang, {_count('httpurl')}, {_count('emailaddress')}, {_count('domainname')} FROM (SELECT lang, {redact('text')} AS t FROM documents) WHERE t IS NOT NULL GROUP BY lang",
        "entity_decode": f"SELECT doc_id, {entities('text')} AS decoded FROM documents",
        "fold_accents": f"SELECT doc_id, {fold('text')} AS folded FROM documents",
        "tokenize_docs": f"WITH {_TOKENS} SELECT doc_id, array_to_string(tokens, ' ') AS tokens, len(tokens)::INT AS n FROM toks",
        "token_totals_by_lang": f"WITH {_TOKENS} SELECT lang, count(*) AS docs, sum(len(tokens))::BIGINT AS tokens FROM toks GROUP BY lang",
        "html_text": f"WITH {_HTML} SELECT doc_id, text FROM txt",
        "html_flag_counts": f"WITH {_HTML} SELECT sum(CASE WHEN contains(text, 'HTMLcomment') THEN 1 ELSE 0 END)::BIGINT AS comments, sum(CASE WHEN contains(text, 'HTMLhiddenWHITE:') THEN 1 ELSE 0 END)::BIGINT AS white, sum(CASE WHEN contains(text, 'HTMLhiddenFONTSIZE:') THEN 1 ELSE 0 END)::BIGINT AS tiny FROM txt",
        "squeeze_and_gate": f"SELECT * FROM (SELECT doc_id, {squeeze('text')} AS squeezed FROM documents) WHERE length(squeezed) > 10 AND NOT contains(squeezed, '{t.BOILERPLATE}')",
        "reply_truncate": f"SELECT doc_id, {own('text')} AS own FROM documents",
        "corpus_words": f"WITH o AS (SELECT doc_id, {own('text')} AS own FROM documents), w AS (SELECT doc_id, list_filter(string_split({squeeze('own')}, ' '), lambda x: x <> '') AS ws FROM o WHERE length(own) > 100) SELECT * FROM (SELECT doc_id, len(list_filter(ws, lambda x: length(x) >= 3 AND ord(x) >= 65))::INT AS counted, len(ws)::INT AS words FROM w) WHERE counted >= 20 AND words >= 30",
        "vocab_counts": f"WITH {_TOKENS} SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM toks) GROUP BY token HAVING count(*) >= 2",
        "vocab_topk": f"WITH {_TOKENS} SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM toks) GROUP BY token HAVING count(*) >= 2 ORDER BY n DESC, token LIMIT 100",
        "vocab_coverage": "WITH x AS (SELECT unnest(tokens) AS token FROM mail_corpus) SELECT count(*) AS total, count(v.token) AS known FROM x LEFT JOIN vocab v ON x.token = v.token",
        "encode_sequence": f"{known} SELECT t.doc_id, coalesce(array_to_string(ts, ' '), '') AS known, array_to_string(list_concat(coalesce(ids, []), list_transform(range(100), lambda i: 0))[1:100], ' ') AS ids FROM toks t LEFT JOIN ag ON t.doc_id = ag.doc_id",
        "minimum_evidence": f"{known} SELECT doc_id, len(ts)::INT AS known FROM ag WHERE len(ts) >= {scores.LEAST_KNOWN}",
        "best_part": "SELECT msg_no, part_no, size FROM (SELECT *, row_number() OVER (PARTITION BY msg_no ORDER BY size DESC, part_no) AS r FROM (SELECT DISTINCT msg_no, part_no, octet_length(payload)::INT AS size FROM mime_parts WHERE lower(ctype) LIKE 'text/%') WHERE size > 0) WHERE r = 1",
        "exact_dedup": "SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text",
        "near_dedup_relational": f"""WITH {_TOKENS}, el AS (SELECT doc_id, tokens FROM toks WHERE len(tokens) >= 20),
sh AS (SELECT doc_id, unnest(list_transform(range(1, len(tokens) - 5), lambda i: array_to_string(tokens[i:i + 6], ' '))) AS s FROM el),
fs AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS first FROM sh), sn AS (SELECT doc_id, sum(CASE WHEN first < doc_id THEN 1 ELSE 0 END)::BIGINT AS seen FROM fs GROUP BY doc_id)
SELECT el.doc_id, coalesce(seen, 0) AS seen, coalesce(seen, 0) <= (len(tokens) - 10) * 4 / 5.0 AS kept FROM el LEFT JOIN sn ON el.doc_id = sn.doc_id""",
        "label_union_onehot": "SELECT id, split, label, CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS spam, CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS ham, len(tokens)::INT AS n FROM (SELECT id, tokens, CASE WHEN src_file IN ('mail.neg', 'mail.negT') THEN 0 ELSE 1 END AS label, CASE WHEN src_file IN ('mail.neg', 'mail.pos') THEN 'train' ELSE 'validation' END AS split FROM (SELECT DISTINCT id, tokens, src_file FROM mail_corpus))",
        "split_counts": "SELECT split, label, count(*) AS n FROM (SELECT DISTINCT id, label, split FROM mail_corpus) GROUP BY split, label",
        "verdict_online": f"WITH {_SCORED} SELECT line_no, CASE WHEN known < 10 THEN 'toosmall' ELSE {_BUCKET} || ' ' || trunc(s)::INT || '%' END AS verdict FROM sc",
        "verdict_batch": f"WITH {_SCORED} SELECT line_no, {_BATCH} AS verdict FROM sc",
        "verdict_points": f"WITH {_SCORED} SELECT line_no, bucket, CASE bucket {' '.join(f"WHEN '{k}' THEN {v}" for k, v in scores.POINTS.items())} END AS points FROM (SELECT line_no, {_BUCKET} AS bucket FROM sc)",
        "routed_counts": f"WITH {_SCORED} SELECT verdict, count(*) AS n FROM (SELECT {_BATCH} AS verdict FROM sc) GROUP BY verdict",
        "percent_of_outputs": "SELECT line_no, CASE WHEN p BETWEEN 0 AND 100 THEN p ELSE 50.0 END::DOUBLE AS pct FROM (SELECT line_no, CASE WHEN score + (line_no % 5) * 20 = 0 THEN NULL ELSE score::DOUBLE * 100 / (score::DOUBLE + (line_no % 5)::DOUBLE * 20) END AS p FROM (SELECT DISTINCT line_no, score FROM score_log WHERE score IS NOT NULL))",
        "score_compare": f"WITH {_CHANGED} SELECT line_no, score, new, diff, change FROM ch",
        "score_counters": f"WITH {_CHANGED} SELECT count(*) AS total, count(*) FILTER (diff <> 0) AS changed, count(*) FILTER (change = '+') AS to_spam, count(*) FILTER (change = '-') AS to_ham FROM ch",
        "score_running_error": f"WITH {_CHANGED}, r AS (SELECT line_no, count(*) OVER w AS total, count(*) FILTER (diff <> 0) OVER w AS changed, count(*) FILTER (change IN ('+', '-')) OVER w AS crossed FROM ch WINDOW w AS (ORDER BY line_no ROWS UNBOUNDED PRECEDING)) SELECT *, (100 * changed // total)::INT AS changed_pct, (100 * crossed // total)::INT AS crossed_pct FROM r",
        "large_changes": f"WITH {_CHANGED} SELECT line_no, score, new, substr(array_to_string(tokens, ' '), 1, 120) AS text FROM ch WHERE abs(diff) > 20",
        "score_log_round_trip": f"WITH {_LINES} SELECT line_no, lpad(score::VARCHAR, 3, ' ') || '%:' || array_to_string(tokens, ' ') AS line, score, len(string_split(array_to_string(tokens, ' '), ' '))::INT AS n FROM ln WHERE len(tokens) > 0",
        "directive_lines": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL),
en AS (SELECT doc_id, pos, line, {entities(redact('line'))} AS e FROM l), fo AS (SELECT doc_id, pos, line, {fold('e')} AS f FROM en)
SELECT doc_id, pos::INT AS pos, CASE WHEN starts_with(line, ':') THEN trim(line) ELSE array_to_string({lex('lower(f)')}, ' ') END AS out FROM fo""",
        "mbox_split": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
e AS (SELECT *, CASE WHEN starts_with(line, 'From ') THEN 'F' WHEN trim(regexp_replace(line, '\\s', '', 'g')) = '' THEN 'B' END AS ev FROM l),
b AS (SELECT *, CASE WHEN ev = 'F' AND coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'B') = 'B' THEN 1 ELSE 0 END AS beg FROM e)
SELECT doc_id, (sum(beg) + 1 - max(CASE WHEN pos = 1 THEN beg ELSE 0 END))::BIGINT AS messages, count(*) AS lines FROM b GROUP BY doc_id""",
        "charset_repair": f"SELECT msg_no, part_no, CASE WHEN c IS NULL THEN 'utf-8' WHEN c = '' THEN 'iso8859-2' WHEN starts_with(c, 'utf8') THEN 'utf-8' ELSE coalesce(map_extract_value(MAP {{{names}}}, c), c) END AS charset FROM (SELECT DISTINCT msg_no, part_no, charset, lower(trim(charset)) AS c FROM mime_parts)",
        "attachment_kinds": f"SELECT * FROM (SELECT msg_no, part_no, CASE WHEN c = 'application/pdf' OR f LIKE '%.pdf' THEN 'pdf' WHEN c = 'application/rtf' OR f LIKE '%.rtf' THEN 'rtf' WHEN c = '{DOCX_TYPE}' OR f LIKE '%.docx' THEN 'docx' WHEN c = 'application/ms-tnef' OR f = 'winmail.dat' THEN 'tnef' END AS kind FROM (SELECT DISTINCT msg_no, part_no, lower(trim(split_part(ctype, ';', 1))) AS c, lower(coalesce(fname, 'none')) AS f FROM mime_parts)) WHERE kind IS NOT NULL",
        "header_names": "SELECT hdr, count(*) AS n, sum(CASE WHEN hdr IN ('from', 'to', 'cc', 'bcc', 'reply-to') THEN 1 ELSE 0 END)::BIGINT AS with_addresses FROM (SELECT DISTINCT msg_no, seq, lower(trim(name)) AS hdr FROM header_block WHERE name IS NOT NULL) GROUP BY hdr",
        "shuffled_ids": "SELECT id, row_number() OVER (ORDER BY md5(id::VARCHAR || '/7'), id) AS position FROM (SELECT DISTINCT id FROM mail_corpus WHERE split = 'train' AND id IS NOT NULL)",
        "numeric_entities": f"SELECT doc_id, CASE WHEN len(list_filter(regexp_extract_all(text, {_q(t.NUMERIC)}, 1), lambda n: coalesce(({_NUMBER}) > 1114111, true))) > 0 THEN NULL ELSE {_rebuilt('text', t.NUMERIC, f"CASE WHEN ({_NUMBER}) < 128 THEN '&' || n || ';' ELSE chr(({_NUMBER})::INT) END")} END AS decoded FROM documents",
        "mail_assembly": f"""WITH {_MAIL}, hd AS (SELECT msg_no, string_agg(hex(encode(name || ': ' || value)) || '0A', '' ORDER BY seq) AS x, max(CASE WHEN name = 'X-Grey-ng' AND value LIKE 'REJECT%' THEN 1 ELSE 0 END) AS g FROM hs GROUP BY msg_no),
bd AS (SELECT msg_no, string_agg(hex(payload), '' ORDER BY part_no) AS x FROM ps GROUP BY msg_no)
SELECT 'c' || ev.msg_no AS conn_id, (length(coalesce(hd.x, '')) + 2 + length(coalesce(bd.x, ''))) // 2 AS bytes, length(coalesce(bd.x, '')) // 2 AS size, md5(coalesce(hd.x, '') || '0A' || coalesce(bd.x, '')) AS md5, coalesce(g, 0) = 1 AS grey
FROM ev LEFT JOIN hd ON ev.msg_no = hd.msg_no LEFT JOIN bd ON ev.msg_no = bd.msg_no""",
        "milter_activity": f"WITH {_MAIL} SELECT (SELECT count(*) FROM ev) AS connections, (SELECT count(*) FROM ev) AS messages, (SELECT sum(octet_length(payload)) FROM ps)::BIGINT AS body_bytes",
        "milter_replies": f"WITH {_MAIL} SELECT * FROM (VALUES ('M', (SELECT count(*) FROM ev), 'Continue'), ('L', (SELECT count(*) FROM hs), 'Continue'), ('N', (SELECT count(*) FROM ev), 'Continue'), ('B', (SELECT count(*) FROM ps), 'Continue'), ('E', (SELECT count(*) FROM ev), 'Continue')) v(cmd, n, reply)",
        "milter_parsed": f"WITH {_MAIL} SELECT 'c' || msg_no AS conn_id, seq + 1 AS seq, 'Header' AS name, name AS first, value AS second FROM hs UNION ALL SELECT 'c' || msg_no, 0, 'MailFrom', 'a@b.example', NULL FROM ev",
        "milter_header_log": f"WITH {_HEADS} SELECT 'c' || msg_no AS conn_id, seq + 1 AS seq, name AS header, value FROM hs WHERE name IN ('X-Grey-ng', 'From')",
        "milter_negotiation": """WITH l AS (SELECT DISTINCT line_no FROM score_log), n AS (SELECT line_no, 2 AS version, (line_no & 63) & 17 AS actions, (line_no & 127) & 75 AS protocol, line_no & 63 AS can,
['AddHeader', 'ChangeBody', 'AddRecipient', 'DeleteRecipient', 'ChangeHeader', 'Quarantine', 'Accept'][line_no % 7 + 1] AS action FROM l)
SELECT line_no, version, actions, protocol, action, CASE action WHEN 'Accept' THEN true ELSE (can & CASE action WHEN 'AddHeader' THEN 1 WHEN 'ChangeBody' THEN 2 WHEN 'AddRecipient' THEN 4 WHEN 'DeleteRecipient' THEN 8 WHEN 'ChangeHeader' THEN 16 ELSE 32 END) > 0 END AS ok FROM n""",
        "milter_actions": f"WITH {_SCORED}, v AS (SELECT line_no, CASE WHEN known < 10 THEN 'toosmall' ELSE {_BUCKET} || ' ' || trunc(s)::INT || '%' END AS verdict FROM sc) SELECT line_no, 0 AS pos, 'AddHeader' AS action, 'X-Mail-Verdict' AS header, verdict AS value FROM v UNION ALL SELECT line_no, 1, 'Accept', NULL, NULL FROM v UNION ALL SELECT line_no, 2, 'Continue', NULL, NULL FROM v",
        "canonical_addresses": f"WITH {_HEADS} SELECT msg_no, seq, CASE WHEN a = '<>' THEN a ELSE regexp_replace(a, '^<+|>+$', '', 'g') END AS addr FROM (SELECT msg_no, seq, regexp_extract(value, '(<[^<>]*>)', 1) AS a FROM hs WHERE lower(trim(name)) = 'from')",
        "header_scan": f"WITH {_HEADS} SELECT msg_no, name, regexp_replace(value, '^[ \\t]+|[ \\t]+$', '', 'g') AS value, count(*) AS n FROM hs WHERE NOT regexp_matches(name, '[\\s:]') AND trim(name) <> '' AND regexp_full_match(value, '[^\\r\\n]*\\S[^\\r\\n]*') GROUP BY ALL",
        "parts_walk": "SELECT msg_no, (row_number() OVER (PARTITION BY msg_no ORDER BY part_no) - 1)::INT AS part_no, lower(trim(split_part(ctype, ';', 1))) AS ctype, md5(hex(coalesce(payload, ''::BLOB))) AS md5 FROM (SELECT DISTINCT msg_no, part_no, ctype, payload FROM mime_parts WHERE msg_no IS NOT NULL)",
        "rtf_text": "SELECT doc_id, text FROM documents WHERE text IS NOT NULL",
        "docx_text": "SELECT doc_id, chr(9) || replace(replace(replace(text, '<', ' '), '>', ' '), chr(10), chr(9)) AS text FROM documents WHERE text IS NOT NULL",
        "score_regression": f"WITH {_CHANGED.replace('nw AS (SELECT *,', 'cp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY array_to_string(tokens, chr(32)) ORDER BY line_no) AS r FROM ln WHERE NOT contains(array_to_string(tokens, chr(32)), ' + _q(IGNORED) + ')) WHERE r = 1), nw AS (SELECT *,').replace('AS new FROM ln)', 'AS new FROM cp)')} SELECT count(*) AS total, count(*) FILTER (diff <> 0) AS changed, count(*) FILTER (change = '+') AS to_spam, count(*) FILTER (change = '-') AS to_ham FROM ch",
        "result_dump": f"WITH {_LINES} SELECT line_no, printf('%3d %%  [%d/%d]   %8.5f / %8.5f  %s', score, line_no % 100, 100, score / 100.0::DOUBLE, (line_no % 2)::DOUBLE, array_to_string(tokens, ' ')) AS line FROM ln",
    }
