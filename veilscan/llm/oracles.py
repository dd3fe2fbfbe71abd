"""DuckDB SQL of the queries that SQL can express."""

OP7 = r"""
WITH a AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         coalesce(starts_with(translate(url, 'HTP', 'htp'), 'http://'), false) AS plain FROM a),
k AS (SELECT host || path AS key, bool_or(plain) AS listed FROM b GROUP BY 1),
r AS (
  SELECT b.*, k.listed,
    CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM b JOIN k ON k.key = b.host || b.path)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM r
"""

OP12 = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
         {'r': coalesce(role, ''), 't': coalesce(text, '')} AS said
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(said ORDER BY pos) AS turns, CAST(conv_id AS VARCHAR) AS name FROM t GROUP BY conv_id),
z(name, i, v) AS (
  SELECT name, 0, 4294967295::BIGINT FROM c
  UNION ALL
  SELECT name, i + 1, CASE WHEN (x & 1) = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END
  FROM (SELECT name, i, CASE WHEN i % 8 = 0 THEN xor(v, ascii(substr(name, CAST(i // 8 + 1 AS BIGINT), 1))::BIGINT) ELSE v END AS x
        FROM z WHERE i < 8 * length(name))),
h AS (SELECT c.*, (4294967295 - z.v) % 9 AS cut FROM c JOIN z ON z.name = c.name AND z.i = 8 * length(c.name)),
r AS (
  SELECT h.conv_id, list_concat(coalesce(list_slice(b.turns, 1, h.cut), []), list_slice(h.turns, h.cut + 1, len(h.turns))) AS turns
  FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 5),
m AS (
  SELECT conv_id, d, list_slice(turns, 1, d) AS path, d = len(turns) AS fin
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM r)),
g AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE fin), '')) AS ends_sha256
  FROM m GROUP BY path, d),
p AS (
  SELECT g.*, q.conv_id AS parent, CASE WHEN g.d = 0 THEN 0 ELSE (g.n_convs - 1) * strlen(g.path[g.d].t) END AS worth
  FROM g LEFT JOIN g q ON q.d = g.d - 1 AND q.path = list_slice(g.path, 1, g.d - 1)),
k AS (SELECT parent AS conv_id, d - 1 AS d, count(*) AS n FROM p WHERE parent IS NOT NULL GROUP BY 1, 2),
f AS (SELECT p.*, coalesce(k.n, 0) AS n_children FROM p LEFT JOIN k ON k.conv_id = p.conv_id AND k.d = p.d),
a AS (SELECT list_slice(path, 1, e) AS path, e AS d, worth, n_children FROM (SELECT path, worth, n_children, unnest(range(0, d + 1)) AS e FROM f)),
s AS (SELECT path, d, sum(worth) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves FROM a GROUP BY path, d)
SELECT f.conv_id, f.d AS depth, f.parent AS parent_conv_id, f.n_convs, f.n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN s ON s.d = f.d AND s.path = f.path
"""

OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
p AS (SELECT lang, row_number() OVER () AS piece, body FROM (SELECT lang, unnest(string_split_regex(body, '[.,;:!?\x0A-\x0D]')) AS body FROM d)),
w AS (
  SELECT lang, piece, regexp_extract_all(body, '[^\x20\x09]+') AS words FROM p),
n AS (SELECT lang, sum(len(words)) AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, k, list_aggregate(words[i:i + k - 1], 'string_agg', ' ') AS phrase
  FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) v(k))),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30),
c AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
x AS (
  SELECT c.lang, c.phrase, c.a, c.cut, l.f AS l, r.f AS r, CAST((2000000::HUGEINT * c.a) // (l.f + r.f) AS BIGINT) AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.phrase = list_aggregate(c.ws[1:c.cut], 'string_agg', ' ')
         JOIN f r ON r.lang = c.lang AND r.phrase = list_aggregate(c.ws[c.cut + 1:c.k], 'string_agg', ' ')),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
z AS (
  SELECT y.* FROM y WHERE NOT EXISTS (
    SELECT 1 FROM f g WHERE g.lang = y.lang AND g.k > len(string_split(y.phrase, ' '))
      AND strpos(' ' || g.phrase || ' ', ' ' || y.phrase || ' ') > 0 AND 100::HUGEINT * g.f >= 80::HUGEINT * y.a)),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z)
SELECT q.lang, q.rank, q.phrase, q.a, q.l, q.r, CAST(n.n AS BIGINT) AS n, q.score FROM q JOIN n ON n.lang = q.lang WHERE q.rank <= 2000
"""

ORACLE = {
    "op7_url_filter": OP7,
    "op12_prefix_trie": OP12,
    "op13_collocations": OP13,
}
