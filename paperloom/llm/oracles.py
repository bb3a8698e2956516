"""SQL that states the results of the queries, where SQL can."""

from __future__ import annotations

import string

LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: CTEs ending in ``hits(doc_id, at, len, item_id)`` over the relation named in ``{docs}``.
CONTAMINATION = rf"""
bench AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, len, array_to_string(w[p:p + len - 1], ' ') AS gram FROM (
    SELECT item_id, w, least(10, len(w)) AS len, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p
    FROM bench WHERE len(w) > 0)),
words AS (SELECT doc_id, {_WORDS} AS w FROM {{docs}}),
grams AS (
  SELECT doc_id, len, p, array_to_string(w[p:p + len - 1], ' ') AS gram FROM (
    SELECT doc_id, w, l.len, unnest(range(1, len(w) - l.len + 2)) AS p
    FROM words, (SELECT DISTINCT len FROM wins) l WHERE len(w) >= l.len)),
hits AS (SELECT g.doc_id, g.p, g.len, b.item_id FROM grams g JOIN wins b ON g.len = b.len AND g.gram = b.gram)
"""

OP2 = f"""WITH {CONTAMINATION.format(docs="documents")},
hit_words AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + len)) AS i FROM hits) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: Rows as in mix_sources() with its default parameters, over the relation named in ``{docs}``.
MIXED = """
sized AS (SELECT *, greatest(length(coalesce(text, '')), 1) AS size_ FROM {docs}),
sizes AS (SELECT source AS src, sum(size_) AS size_, sqrt(sum(size_)) AS weight FROM sized GROUP BY 1),
rates AS (SELECT src, weight / (SELECT sum(weight) FROM sizes) * (SELECT sum(size_) FROM sizes) / size_ AS rate FROM sizes),
means AS (SELECT src, greatest(1, ceil(rate / 500.0))::INT AS pieces, rate / greatest(1, ceil(rate / 500.0)) AS mean FROM rates),
terms AS (
  SELECT src, k, CASE WHEN k = 0 THEN exp(-mean) ELSE exp(k * ln(mean) - mean - lgamma(k + 1)) END AS p
  FROM (SELECT src, mean, unnest(range(0, ceil(mean + 12 * sqrt(mean) + 31)::INT)) AS k FROM means)),
cdf AS (SELECT src, k, sum(p) OVER (PARTITION BY src ORDER BY k) AS c FROM terms),
dist AS (SELECT src, list(c ORDER BY k) AS cs FROM cdf GROUP BY 1),
pieced AS (
  SELECT doc_id, src, unnest(range(1, pieces + 1)) AS piece FROM sized JOIN means ON src IS NOT DISTINCT FROM source),
draws AS (
  SELECT doc_id, src, ('0x' || md5('mix-1|' || doc_id || '|' || piece)[1:13])::BIGINT / 4503599627370496.0 AS u FROM pieced),
counts AS (
  SELECT doc_id, sum(len(list_filter(cs, lambda x: x <= u))) AS n FROM draws d JOIN dist ON dist.src IS NOT DISTINCT FROM d.src GROUP BY 1),
mixed AS (
  SELECT s.*, CAST(c.n AS INT) AS n_copies, CAST(copy AS INT) AS copy,
    ('0x' || md5('mix-1|' || s.doc_id || '|order|' || copy)[1:13])::BIGINT AS shuffle_key
  FROM (SELECT doc_id, n, unnest(range(1, n::BIGINT + 1)) AS copy FROM counts) c JOIN sized s USING (doc_id))
"""

OP3 = f"""WITH {MIXED.format(docs="documents")}
SELECT doc_id, text, lang, source, n_chars, copy, n_copies, shuffle_key FROM mixed"""

OP4 = """SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
  count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents"""

_CONTROLS = r"[<\[]\\*(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|ROLE\]|TEXT\]|/TEXT\])"


def _escaped_length(c: str) -> str:
    """Length of ``c`` with one more character per control string or escape, and a name of seven per space mark."""
    return (
        f"length({c}) + len(regexp_extract_all({c}, '{_CONTROLS}')) + len(regexp_extract_all({c}, '\\{{\\\\*u2581\\}}'))"
        f" + 6 * (length({c}) - length(replace({c}, chr(9601), '')))"
    )


OP9 = f"""WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, {_escaped_length("text")} + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15
    ELSE 19 + {_escaped_length("role")} END AS size FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""

OP5 = rf"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s FROM (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= 75 * (x.n + y.n - c.n)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, coalesce(s.n, 0) AS n_shingles, least(w.doc_id, coalesce(r.least, w.doc_id)) AS component_id
FROM words w LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY 1) r USING (doc_id)"""


def _bit_votes() -> str:
    return ", ".join(f"sum(weight * ((x{p} >> {k}) & 1)) AS v{p}_{k}" for p in range(4) for k in range(32))


def _hex_piece(p: int) -> str:
    bits = " + ".join(f"CASE WHEN 2 * v{p}_{k} > total THEN {1 << k}::BIGINT ELSE 0 END" for k in range(32))
    return f"format('{{:08x}}', {bits})"


def _likeness(a: str, b: str) -> str:
    piece = lambda c, p: f"('0x' || {c}[{8 * p + 1}:{8 * p + 8}])::BIGINT"
    bits = " + ".join(f"bit_count(xor({piece(a, p)}, {piece(b, p)}))" for p in range(4))
    return f"({bits})"


OP12 = rf"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
followed AS (
  SELECT *, coalesce(lead(doc_id) OVER w, first(doc_id) OVER w) AS next_id, coalesce(lead(text) OVER w, first(text) OVER w) AS next_text
  FROM docs WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
edits AS (SELECT *, text[1:n - n // 3] || next_text[1:n // 3] AS edited FROM followed),
texts AS (SELECT doc_id, 0 AS kind, text AS t FROM edits UNION ALL SELECT doc_id, 1, edited FROM edits),
words AS (
  SELECT doc_id, kind, regexp_extract_all(translate(t, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^ 	-
]+') AS w FROM texts),
terms AS (
  SELECT doc_id, kind, array_to_string(w[p:p + 2], ' ') AS term FROM (
    SELECT doc_id, kind, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS p FROM words WHERE len(w) > 0)),
cut AS (
  SELECT doc_id, kind, length(term) AS weight, {", ".join(f"('0x' || h[{8 * p + 1}:{8 * p + 8}])::BIGINT AS x{p}" for p in range(4))}
  FROM (SELECT *, md5(term) AS h FROM terms)),
votes AS (SELECT doc_id, kind, sum(weight) AS total, {_bit_votes()} FROM cut GROUP BY 1, 2),
prints AS (SELECT doc_id, kind, {" || ".join(_hex_piece(p) for p in range(4))} AS fp FROM votes),
each AS (
  SELECT e.*, coalesce(a.fp, repeat('0', 32)) AS fp, coalesce(b.fp, repeat('0', 32)) AS efp, coalesce(c.fp, repeat('0', 32)) AS nfp
  FROM edits e LEFT JOIN prints a ON a.doc_id = e.doc_id AND a.kind = 0 LEFT JOIN prints b ON b.doc_id = e.doc_id AND b.kind = 1
  LEFT JOIN prints c ON c.doc_id = e.next_id AND c.kind = 0),
near AS (
  SELECT q.doc_id, count(*) AS n_near, count(*) FILTER (q.fp = o.fp) AS n_equal
  FROM each q JOIN each o ON q.doc_id % 50 = 0 AND {_likeness("q.fp", "o.fp")} <= 6 GROUP BY 1)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, fp AS fingerprint, efp AS edited_fingerprint,
  round(greatest(0.0, cos(pi() / 128 * {_likeness("fp", "efp")})), 6) AS near_edited,
  round(greatest(0.0, cos(pi() / 128 * {_likeness("fp", "nfp")})), 6) AS near_next, n_near, n_equal
FROM each LEFT JOIN near USING (doc_id)"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    byte = "list_reduce(list_concat([xor(a, b)], range(8)), lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))"
    start = f"list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT))"
    return f"xor(list_reduce({start}, lambda a, b: {byte}), 4294967295)"


OP11 = f"""WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, strlen(coalesce(text, '')) AS bytes,
    md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d
  FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, d) AS nth FROM turns),
own AS (SELECT conv_id, list({{'d': d, 'n': bytes}} ORDER BY nth) AS ts FROM numbered GROUP BY 1),
convs AS (SELECT conv_id, ts, {_crc32("conv_id::VARCHAR")} % 9 AS h, conv_id - conv_id % 5 AS base FROM own),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.ts, [])[1:h], c.ts[h + 1:]) AS ts FROM convs c LEFT JOIN own b ON b.conv_id = c.base),
paths AS (
  SELECT conv_id, len(ts) AS n, unnest(range(0, len(ts) + 1)) AS depth, ts FROM rebuilt),
members AS (
  SELECT conv_id, n, depth, array_to_string(list_transform(ts[1:depth], lambda t: t.d), '') AS path,
    array_to_string(list_transform(ts[1:depth - 1], lambda t: t.d), '') AS parent, CASE WHEN depth > 0 THEN ts[depth].n ELSE 0 END AS bytes
  FROM paths),
nodes AS (
  SELECT path, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM members GROUP BY 1, 2),
children AS (SELECT parent AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
counted AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (path)),
above AS (SELECT path[1:32 * up] AS top, n_children, (n_convs - 1) * bytes AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM counted)),
sums AS (SELECT top AS path, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM above GROUP BY 1)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens, c.ends_sha256
FROM counted c JOIN sums USING (path) LEFT JOIN nodes p ON c.depth > 0 AND p.path = c.parent"""
