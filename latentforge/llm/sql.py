"""DuckDB twins of the operators that SQL can express."""

EXACT_DEDUP = r"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                           'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
           FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       coalesce(doc_id = max(doc_id) OVER g, max(doc_id) OVER g IS NULL) AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

HOST_RULES = r"""
WITH d AS (SELECT doc_id, coalesce('=' || source, 'null') AS host, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
           FROM documents),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n
                               FROM win) WHERE n >= 2),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n
          FROM hit, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (SELECT d.doc_id, host, len(ws)::BIGINT AS n_words,
             length(array_to_string(ws, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             [x for x in string_split(t, chr(10))
              if regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls,
             coalesce(cover.n, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN cover ON cover.doc_id = d.doc_id),
r AS (SELECT *, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
f AS (SELECT *, base_failed OR 100 * n_symbols > 50 * n_words
                OR 100 * n_dup_lines > 50 * len(ls) AS failed FROM r),
h AS (SELECT host, count(*) AS host_docs, sum(failed::BIGINT)::BIGINT AS host_failed
      FROM f GROUP BY host),
p AS (SELECT avg(host_failed / host_docs) AS a, var_pop(host_failed / host_docs) AS v FROM h),
s AS (SELECT h.*, CASE WHEN v > 0 AND a * (1 - a) > v
                       THEN (host_failed + a * (a * (1 - a) / v - 1))
                            / (host_docs + a * (1 - a) / v - 1)
                       WHEN v > 0 THEN host_failed / host_docs ELSE a END AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT failed AND NOT rate * 100 > 50 AS kept, host_docs, host_failed
FROM f JOIN s USING (host)
"""

TERM_SCAN = r"""
WITH it AS (SELECT item_id, unnest(regexp_extract_all(
              translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d)
      WHERE term IN (SELECT term FROM it) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
      FROM p, s GROUP BY term),
m AS (SELECT r, doc_id, 25 + (75 * len(ts) * n_docs) // n_terms AS m FROM d, s WHERE len(ts) > 0),
x AS (SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM it JOIN p USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY item_id, r),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank,
             doc_id, score FROM x JOIN m USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o WHERE rank <= 10
"""

PREFIX_TRIE = r"""
WITH tab AS (SELECT list_transform(range(256), lambda b: list_reduce(
               list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
               lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
sized AS (SELECT conv_id::BIGINT AS c, count(*) AS n,
                 list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
                      ORDER BY turn NULLS FIRST) AS own
          FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
hashed AS (SELECT c, n, own, c - c % 5 AS base, (xor(4294967295, list_reduce(
             list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''),
                                                             lambda x: ascii(x)::BIGINT)),
             lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 9)::BIGINT AS h
           FROM sized, tab),
built AS (SELECT x.c, coalesce(y.own[1:x.h], []) || x.own[x.h + 1:] AS turns
          FROM hashed x LEFT JOIN sized y ON y.c = x.base),
pre AS (SELECT c, unnest(range(0, len(turns) + 1)) AS d, turns FROM built),
p AS (SELECT c, d, len(turns) AS n, sha256(turns[1:d]::VARCHAR || d) AS k,
             sha256(turns[1:d - 1]::VARCHAR || (d - 1)) AS up,
             CASE WHEN d > 0 THEN strlen(turns[d].text) ELSE 0 END AS b FROM pre),
node AS (SELECT k, min(c) AS conv_id, any_value(d) AS depth, any_value(up) AS up, count(*) AS n_convs,
                any_value(b) AS b, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c)
                                            FILTER (WHERE d = n), '') AS ends
         FROM p GROUP BY k),
kids AS (SELECT up AS k, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY up),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (k)),
sub AS (SELECT a.k, sum((z.n_convs - 1) * z.b)::BIGINT AS saved_tokens,
               count(*) FILTER (WHERE z.n_children = 0) AS n_leaves
        FROM full_node z JOIN p a ON a.c = z.conv_id AND a.d <= z.depth GROUP BY a.k)
SELECT x.conv_id, x.depth::BIGINT AS depth, y.conv_id AS parent_conv_id, x.n_convs, x.n_children,
       n_leaves, saved_tokens, sha256(x.ends) AS ends_sha256
FROM full_node x JOIN sub USING (k) LEFT JOIN full_node y ON x.depth > 0 AND y.k = x.up
"""
