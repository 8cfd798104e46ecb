"""The same results as SQL, for the queries that SQL can express."""

from __future__ import annotations

LLM_ORACLE: dict[str, str] = {}

BLANKS_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LLM_ORACLE["op4_line_dedup"] = f"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (
    SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM docs),
keyed AS (
    SELECT doc_id, pos, line, {LOWER_SQL.format(f"trim(line, {BLANKS_SQL})")} AS key FROM lines),
firsts AS (
    SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
    GROUP BY key HAVING min(doc_id) < max(doc_id)),
marked AS (
    SELECT k.doc_id, k.pos, k.line, f.first IS NOT NULL AND k.doc_id <> f.first AS gone
    FROM keyed k LEFT JOIN firsts f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

LLM_ORACLE["op8_ngram_jaccard_join"] = f"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all({LOWER_SQL.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]) END AS s
    FROM words),
classes AS (
    SELECT list_sort(s) AS k, min(doc_id) AS rep, len(any_value(s)) AS n FROM sets WHERE len(s) > 0 GROUP BY k),
grams AS (SELECT rep, n, unnest(k) AS g FROM classes),
common AS (
    SELECT x.rep AS a, y.rep AS b, x.n AS n, y.n AS m, count(*) AS c
    FROM grams x JOIN grams y ON x.g = y.g AND x.rep <> y.rep GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * c >= 85 * (n + m - c)),
reached AS (
    SELECT rep, rep AS other FROM classes UNION
    SELECT r.rep, l.b FROM reached r JOIN links l ON r.other = l.a),
least AS (SELECT rep, min(other) AS component_id FROM reached GROUP BY rep)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(t.component_id, s.doc_id) AS component_id
FROM sets s LEFT JOIN classes c ON c.k = list_sort(s.s) AND len(s.s) > 0 LEFT JOIN least t USING (rep)
"""

# The distinct terms of a text as 60-bit numbers, and a fingerprint of its sorted choice.
TERMS_SQL = f"""[('0x' || substr(md5(w), 1, 15))::BIGINT FOR w IN list_distinct(
    regexp_extract_all({LOWER_SQL}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))]"""
PRINT_SQL = """substr(md5(array_to_string({0}, ',')), 1, 16) || array_to_string([
    CASE WHEN len(s) = 0 THEN '----' ELSE substr(md5(array_to_string(s, ',')), 1, 4) END
    FOR s IN [list_filter({0}, lambda t: (t >> (k // 4 * 3)) % 1024 < (64 >> (k % 4 * 2))) FOR k IN range(64)]], '')"""
CHOICE_SQL = """list_sort(CASE WHEN len(list_intersect({0}, known)) > 0 THEN list_intersect({0}, known) ELSE {0} END)"""
LIKE_SQL = """(SELECT CASE WHEN count(*) FILTER (x <> '----' OR y <> '----') = 0 THEN ({0} = {1})::INT::DOUBLE
    ELSE count(*) FILTER (x = y AND x <> '----') / (count(*) FILTER (x <> '----' OR y <> '----'))::DOUBLE END
    FROM (SELECT substr({0}, 17 + 4 * k, 4) AS x, substr({1}, 17 + 4 * k, 4) AS y FROM (SELECT unnest(range(64)) AS k)))"""

LLM_ORACLE["op11_imatch_fingerprints"] = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, text, {TERMS_SQL.format("text")} AS terms FROM docs),
counts AS (SELECT term, count(*) AS df FROM (SELECT unnest(terms) AS term FROM words) GROUP BY term),
lexicon AS (
    SELECT term FROM counts, (SELECT count(*) AS n FROM docs) WHERE df >= 2 AND df * 1024 >= n AND df * 8 <= n
    ORDER BY df DESC, term LIMIT 8192),
known AS (SELECT list(term) AS known FROM lexicon),
linked AS (
    SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text,
        coalesce(lead(terms) OVER w, first_value(terms) OVER w) AS next_terms FROM words WINDOW w AS (ORDER BY doc_id DESC)),
edited AS (
    SELECT *, substr(text, 1, length(text) - length(text) // 2) || substr(next_text, 1, length(text) // 2) AS edited FROM linked),
chosen AS (
    SELECT doc_id, length(text) AS n_chars, edited, {CHOICE_SQL.format("terms")} AS a, {CHOICE_SQL.format("next_terms")} AS b,
        {CHOICE_SQL.format("edited_terms")} AS c
    FROM (SELECT *, {TERMS_SQL.format("edited")} AS edited_terms FROM edited), known),
prints AS (
    SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, {PRINT_SQL.format("a")} AS fingerprint,
        {PRINT_SQL.format("c")} AS edited_fingerprint, {PRINT_SQL.format("b")} AS next_fingerprint FROM chosen)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    {LIKE_SQL.format("fingerprint", "edited_fingerprint")} AS near_edited,
    {LIKE_SQL.format("fingerprint", "next_fingerprint")} AS near_next
FROM prints
"""

LLM_ORACLE["op12_source_divergence"] = f"""
WITH docs AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all({LOWER_SQL.format("coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
    FROM documents),
words AS (SELECT r, lang, source, unnest(w) AS term FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS n_docs FROM words GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS total FROM counts GROUP BY lang, term HAVING sum(n_docs) >= 3),
groups AS (SELECT DISTINCT lang, source FROM docs),
grid AS (
    SELECT g.lang, g.source, k.term, k.total::HUGEINT AS total, coalesce(c.n, 0)::HUGEINT AS n
    FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
sized AS (
    SELECT *, count(*) OVER w AS v, sum(n) OVER w AS n_group, sum(total) OVER w AS n_lang FROM grid
    WINDOW w AS (PARTITION BY lang, source)),
shares AS (
    SELECT lang, source, term, n, 1 + (1000000000 * (n + 1)) // (n_group::HUGEINT + v) AS p,
        1 + (1000000000 * (total + 1)) // (n_lang::HUGEINT + v) AS q FROM sized),
sums AS (
    SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
    FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
valued AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM (
    SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM valued)
WHERE part = 'pair' OR rank <= 200
"""

# CRC-32 of a string of ASCII digits, bit by bit.
CRC_SQL = """xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], [ord(c)::BIGINT FOR c IN string_split({}, '')]),
    lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [k::BIGINT FOR k IN range(8)]),
        lambda x, k: xor(x >> 1, 3988292384::BIGINT * (x & 1)))))"""

LLM_ORACLE["op13_prefix_trie"] = f"""
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
        PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i
    FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (
    SELECT conv_id, count(*) AS n, {CRC_SQL.format("conv_id::VARCHAR")} % 9 AS h, conv_id - conv_id % 5 AS g
    FROM turns GROUP BY conv_id),
convs AS (
    SELECT c.*, least(c.h, coalesce(o.n, 0)) AS b FROM sizes c LEFT JOIN sizes o ON c.g = o.conv_id),
rebuilt AS (
    SELECT conv_id, b + i - h + 1 AS d, role, text FROM turns JOIN convs USING (conv_id) WHERE i >= h
    UNION ALL
    SELECT c.conv_id, t.i + 1, t.role, t.text FROM convs c JOIN turns t ON c.g = t.conv_id AND t.i < c.h),
placed AS (
    SELECT conv_id, d, strlen(text) AS bytes, md5(string_agg(md5(strlen(role) || ':' || role || text), '')
        OVER (PARTITION BY conv_id ORDER BY d)) AS node FROM rebuilt
    UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
members AS (
    SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY d) AS parent,
        d = max(d) OVER (PARTITION BY conv_id) AS ends FROM placed),
nodes AS (
    SELECT d, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
    FROM members GROUP BY d, node),
family AS (
    SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes k WHERE k.d = n.d + 1 AND k.parent = n.node)
        AS n_children FROM nodes n LEFT JOIN nodes p ON p.d = n.d - 1 AND p.node = n.parent),
totals AS (
    SELECT m.d, m.node, count(*) FILTER (f.n_children = 0) AS n_leaves,
        sum((f.n_convs - 1) * f.bytes)::BIGINT AS saved_tokens
    FROM family f JOIN members m ON m.conv_id = f.conv_id AND m.d <= f.d GROUP BY m.d, m.node)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM family JOIN totals USING (d, node)
"""
