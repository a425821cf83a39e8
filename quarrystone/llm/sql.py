"""DuckDB SQL for the whole results of the operators that SQL can express."""

from . import licenses

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3_SUBSTRING = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS a FROM documents),
 p AS (SELECT doc_id, i, md5(array_to_string(a[i + 1:i + 35], ' ')) AS h FROM (SELECT doc_id, a, unnest(range(0, greatest(len(a) - 34, 0))) AS i FROM w) x),
 r AS (SELECT h FROM p GROUP BY h HAVING count(*) > 1),
 g AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 35)) AS j FROM p WHERE h IN (SELECT h FROM r)) y),
 t AS (SELECT doc_id, unnest(a) AS word, unnest(range(0, len(a))) AS j FROM w),
 k AS (SELECT doc_id, count(g.j) AS n, string_agg(CASE WHEN g.j IS NULL THEN word END, ' ' ORDER BY t.j) AS kept FROM t LEFT JOIN g USING (doc_id, j) GROUP BY doc_id)
SELECT w.doc_id, len(w.a)::BIGINT AS n_words, coalesce(k.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""

OP7_DECONTAMINATE = f"""
WITH w AS (SELECT doc_id, {_ALNUM} AS a FROM documents),
 b AS (SELECT item_id, {_ALNUM} AS a FROM benchmark WHERE item_id IS NOT NULL),
 bw AS (SELECT DISTINCT item_id, k, array_to_string(a[i + 1:i + k], ' ') AS s FROM (SELECT item_id, a, least(len(a), 10) AS k, unnest(range(0, greatest(len(a) - 9, 1))) AS i FROM b WHERE len(a) > 0) x),
 ks AS (SELECT DISTINCT k FROM bw),
 dw AS (SELECT doc_id, i, k, array_to_string(a[i + 1:i + k], ' ') AS s FROM (SELECT doc_id, a, k, unnest(range(0, greatest(len(a) - k + 1, 0))) AS i FROM w CROSS JOIN ks) x),
 h AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.s = bw.s),
 n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM h) y) z GROUP BY doc_id),
 m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) y GROUP BY doc_id)
SELECT w.doc_id, len(w.a)::BIGINT AS n_words, coalesce(n.n_hit, 0)::BIGINT AS n_hit, coalesce(m.n_items, 0)::BIGINT AS n_items, sha256(coalesce(m.items, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
 FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

_QUOTED = lambda x: "'" + x.replace("'", "''") + "'"
_TEMPLATES = ", ".join(f"({i}, {_QUOTED(label)}, {_QUOTED(text)})" for i, (label, text) in enumerate((k, t) for k, ts in licenses.TEMPLATES.items() for t in ts))
_PHRASES = ", ".join(f"({_QUOTED(label)}, string_split({_QUOTED(p)}, ' '))" for p, label in licenses.PHRASES.items())

#: Spans are the groups of diagonals with gaps of 6 at most, and for each diagonal those up to 0, 1, ... 6 beyond it.
OP8_LICENSES = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_ALNUM} AS w FROM documents),
 p(label, ws) AS (VALUES {_PHRASES}),
 b AS (SELECT rid, label, i FROM (SELECT rid, w, unnest(range(0, len(w))) AS i FROM d) x JOIN p ON w[i + 1:i + len(ws)] = ws),
 base AS (SELECT rid, count(*) AS n, min(i) AS lo, max(i) AS hi, list(DISTINCT label) AS labels FROM b GROUP BY rid),
 t(template, label, text) AS (VALUES {_TEMPLATES}),
 tw AS (SELECT template, label, {_ALNUM} AS w FROM t),
 tr AS (SELECT template, label, len(w) - 3 AS runs, j, w[j + 1:j + 4] AS run FROM (SELECT template, label, w, unnest(range(0, len(w) - 3)) AS j FROM tw) x),
 dr AS (SELECT rid, i, w[i + 1:i + 4] AS run FROM (SELECT rid, w, unnest(range(0, greatest(len(w) - 3, 0))) AS i FROM d) x),
 h AS (SELECT rid, template, label, runs, i - j AS g, i, j FROM dr JOIN tr ON dr.run = tr.run),
 g AS (SELECT rid, template, g, sum(new) OVER (PARTITION BY rid, template ORDER BY g) AS part FROM (SELECT rid, template, g, CASE WHEN g - lag(g) OVER (PARTITION BY rid, template ORDER BY g) <= 6 THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT rid, template, g FROM h) x) y),
 s AS (SELECT rid, template, 'group ' || part AS span, g FROM g UNION ALL SELECT a.rid, a.template, 'near ' || a.g || ' ' || k AS span, c.g FROM g a, range(0, 7) n(k), g c WHERE c.rid = a.rid AND c.template = a.template AND c.g BETWEEN a.g AND a.g + k),
 m AS (SELECT h.rid, label, count(DISTINCT j) / runs::DOUBLE AS cover FROM s JOIN h ON h.rid = s.rid AND h.template = s.template AND h.g = s.g GROUP BY h.rid, h.template, label, runs, span HAVING count(DISTINCT j) / runs::DOUBLE >= 0.6 AND max(i) + 4 - min(i) <= 1.5 * (runs + 3)),
 more AS (SELECT rid, list(DISTINCT label) AS labels, max(cover) AS cover FROM m GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word, coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
 coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') AS labels, greatest(coalesce(cover, 0), CASE WHEN n > 0 THEN 0.5 ELSE 0 END)::DOUBLE AS score
 FROM d LEFT JOIN base USING (rid) LEFT JOIN more USING (rid)
"""

#: crc32 bit by bit; k is a node's whole sequence of turns.
OP11_TRIE = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
 o AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS own FROM t GROUP BY conv_id),
 bits AS (SELECT conv_id, own, list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
   lambda a, b: list_reduce(list_concat([xor(a, b)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda r, z: xor(r >> 1, (r & 1) * 3988292384::UBIGINT))) AS crc FROM o),
 h AS (SELECT conv_id, own, (xor(crc, 4294967295::UBIGINT) % 6)::BIGINT AS h FROM bits),
 r AS (SELECT c.conv_id, list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:]) AS s FROM h c LEFT JOIN o b ON b.conv_id = c.conv_id - c.conv_id % 100),
 m AS (SELECT conv_id, len(s) AS n, d, s[1:d] AS k, s[d] AS last FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM r) x),
 g AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256, bool_and(n = d) AS leaf,
   (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE length(any_value(last.text)) END AS saved FROM m GROUP BY k, d),
 up AS (SELECT k[1:e] AS k, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved_tokens, count(*) FILTER (d = e + 1) AS n_children FROM (SELECT k, d, leaf, saved, unnest(range(0, d + 1)) AS e FROM g) y GROUP BY 1)
SELECT g.conv_id::BIGINT AS conv_id, g.d::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, g.n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, g.ends_sha256
 FROM g JOIN up ON g.k = up.k LEFT JOIN g p ON p.d = g.d - 1 AND p.k = g.k[1:g.d - 1]
"""

OP12_NEGATIVES = """
WITH e AS (SELECT vec_id::BIGINT AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 100 = 0),
 p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
 FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
 WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 5
"""
