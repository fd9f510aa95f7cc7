"""DuckDB SQL for the queries of this subpackage that SQL can express."""

#: White space as the operators split it, as a pattern for DuckDB.
SPACE = r"[ \t\n\v\f\r\x1c-\x1f]+"
#: A document's words.
WORDS = f"SELECT doc_id, string_split_regex(trim(regexp_replace(text, '{SPACE}', ' ', 'g'), ' '), ' ') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL"

#: Greedy parse: every window with every earlier place of it, runs along a diagonal, the longest at each window, and the next start from each.
SUBSTRING = f"""
WITH RECURSIVE t AS ({WORDS}),
s AS (SELECT doc_id, i AS s, md5(array_to_string(w[i + 1:i + 50], ' ')) AS h FROM t, unnest(range(len(w) - 49)) u(i)),
p AS (SELECT a.doc_id, a.s, b.doc_id AS rd, b.s AS rs FROM s a JOIN s b ON a.h = b.h AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.s < a.s))),
g AS (SELECT *, s - row_number() OVER (PARTITION BY doc_id, rd, rs - s ORDER BY s) AS run FROM p),
e AS (SELECT *, max(s) OVER (PARTITION BY doc_id, rd, rs - s, run) - s + 50 AS n FROM g),
best AS (SELECT doc_id, s, n, rd, rs FROM e QUALIFY row_number() OVER (PARTITION BY doc_id, s ORDER BY n DESC, rd, rs) = 1),
nxt AS (SELECT a.*, b.s AS ahead FROM best a ASOF LEFT JOIN best b ON a.doc_id = b.doc_id AND a.s + a.n - 49 <= b.s),
parse AS (SELECT * FROM nxt WHERE s = (SELECT min(f.s) FROM nxt f WHERE f.doc_id = nxt.doc_id) UNION ALL SELECT nxt.* FROM parse JOIN nxt ON nxt.doc_id = parse.doc_id AND nxt.s = parse.ahead)
SELECT doc_id, CAST(s AS INTEGER) AS start_word, CAST(n AS INTEGER) AS n_words, rd AS ref_doc_id, CAST(rs AS INTEGER) AS ref_start_word FROM parse
"""

SUFFIX = f"""
WITH t AS ({WORDS}),
s AS (SELECT doc_id, i AS s, md5(array_to_string(w[i + 1:i + 50], ' ')) AS h FROM t, unnest(range(len(w) - 49)) u(i)),
f AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS nth, count(*) OVER (PARTITION BY h) AS n FROM s),
c AS (SELECT doc_id, s + k AS word, max(CASE WHEN nth > 1 THEN 1 ELSE 0 END) AS later FROM f, unnest(range(50)) u(k) WHERE n > 1 GROUP BY doc_id, s + k),
g AS (SELECT *, word - row_number() OVER (PARTITION BY doc_id, later ORDER BY word) AS run FROM c)
SELECT doc_id, CAST(min(word) AS INTEGER) AS start_word, CAST(count(*) AS INTEGER) AS n_words, later = 0 AS keep FROM g GROUP BY doc_id, later, run
"""

#: Rows of a table of vectors with the least id that links lead to and the number of links; v: (vec_id, e).
CLASSES = """
WITH RECURSIVE v AS ({vectors}),
t AS (SELECT *, row_number() OVER () AS r FROM (SELECT DISTINCT vec_id, e FROM v WHERE vec_id IS NOT NULL)),
p AS (SELECT a.r AS a, b.r AS b FROM t a JOIN t b ON a.r <> b.r WHERE list_cosine_similarity(a.e, b.e) BETWEEN 0.95 AND 2),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a),
tie AS (SELECT a, b FROM p UNION SELECT a.r, b.r FROM t a JOIN t b USING (vec_id)),
reach(r, other) AS (SELECT r, r FROM t UNION SELECT reach.r, tie.b FROM reach JOIN tie ON reach.other = tie.a),
c AS (SELECT reach.r, min(t.vec_id) AS class_id FROM reach JOIN t ON reach.other = t.r GROUP BY reach.r)
SELECT vec_id, class_id, coalesce(n, 0) AS n_links FROM t JOIN c USING (r) LEFT JOIN n ON t.r = n.a
"""
EMBEDDING = CLASSES.format(vectors="SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings")

NEAR_COPIES = """
WITH b AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
v AS (SELECT vec_id * 3 AS vec_id, e FROM b UNION ALL SELECT vec_id * 3 + 1, list_transform(e, lambda x: x * 2.5) FROM b
  UNION ALL SELECT vec_id * 3 + 2, list_transform(range(1, len(e) + 1), lambda i: e[i] + 0.02 * e[i % len(e) + 1]) FROM b)
SELECT a.vec_id AS vec_id_a, b.vec_id AS vec_id_b, round(list_cosine_similarity(a.e, b.e), 6) AS cosine
FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95
"""

LINES_CTE = """
l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {docs} WHERE doc_id IS NOT NULL AND text IS NOT NULL),
bad AS (SELECT trim(line) AS b, min(doc_id) AS first_id FROM l WHERE trim(line) <> '' GROUP BY trim(line) HAVING count(DISTINCT coalesce(source, '')) >= 5),
m AS (SELECT l.*, b IS NOT NULL AND first_id <> doc_id AS drop_it FROM l LEFT JOIN bad ON trim(line) = b),
clean AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT drop_it), '') AS text, CAST(count(*) FILTER (drop_it) AS INTEGER) AS n_removed FROM m GROUP BY doc_id)
"""
LINES = f"""
WITH {LINES_CTE.format(docs="documents")}
SELECT d.doc_id, c.text, d.lang, d.source, d.n_chars, coalesce(c.n_removed, 0) AS n_removed FROM documents d LEFT JOIN clean c USING (doc_id)
"""

QUALITY_CTE = r"""
w AS (SELECT *, string_split(text, ' ') AS ws FROM {docs}),
f AS (SELECT *, coalesce(lang, '') AS stratum,
  coalesce((length(text) - length(translate(text, '*$#%&|!~^=<>{{}}[]_@+', ''))) / greatest(length(text), 1), 0.0) AS symbols,
  coalesce(length(regexp_replace(text, '[^A-ZÀ-ÖØ-Þ]+', '', 'g')) / greatest(length(regexp_replace(text, '[^A-Za-zÀ-ÖØ-öø-ÿ]+', '', 'g')), 1), 0.0) AS capitals,
  coalesce(len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) / greatest(len(ws), 1), 0.0) AS stutter FROM w),
grid(rule, cut) AS (VALUES ('symbols', 0.03), ('symbols', 0.04), ('symbols', 0.06), ('symbols', 0.08), ('symbols', 0.12), ('capitals', 0.3), ('capitals', 0.4), ('capitals', 0.5), ('capitals', 0.6), ('capitals', 0.7), ('stutter', 0.1), ('stutter', 0.2), ('stutter', 0.3), ('stutter', 0.4), ('stutter', 0.5)),
told AS (SELECT DISTINCT doc_id, quality FROM labels WHERE doc_id IS NOT NULL AND quality IN (0, 1)),
c AS (SELECT stratum, rule, cut, count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality = 1 AND s >= cut) AS k, count(*) FILTER (quality = 0 AND s >= cut) AS caught
  FROM (SELECT stratum, quality, rule, CAST(cut AS DOUBLE) AS cut, CASE rule WHEN 'symbols' THEN symbols WHEN 'capitals' THEN capitals ELSE stutter END AS s FROM f JOIN told USING (doc_id), grid) GROUP BY ALL),
p AS (SELECT *, (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.1 / 3) + (n - i) * ln(1 - 0.1 / 3))) FROM unnest(range(k + 1)) u(i)) AS tail, count(*) FILTER (n > 0) OVER () AS tests FROM c),
chosen AS (SELECT stratum, rule, arg_max(cut, caught * 1000 + cut) AS cut FROM p WHERE n > 0 AND caught > 0 AND k < n * 0.1 / 3 AND tail <= 0.1 / tests GROUP BY stratum, rule),
kept AS (SELECT f.* FROM f WHERE NOT EXISTS (SELECT 1 FROM chosen ch WHERE ch.stratum = f.stratum AND CASE rule WHEN 'symbols' THEN symbols WHEN 'capitals' THEN capitals ELSE stutter END >= ch.cut))
"""
QUALITY = f"""
WITH {QUALITY_CTE.format(docs="documents")}
SELECT doc_id, stratum AS lang, round(symbols, 6) AS symbols, round(capitals, 6) AS capitals, round(stutter, 6) AS stutter FROM kept
"""

MIXING_CTE = r"""
base AS (SELECT *, coalesce(source, '') AS src, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]+')) AS tokens, md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), text, '')) AS key FROM {docs}),
s AS (SELECT src, sum(tokens) AS t FROM base GROUP BY src),
r AS (SELECT *, t / sum(t) OVER () AS p FROM s WHERE t > 0),
e AS (SELECT CASE WHEN max(p) / min(p) <= 1.5 THEN 0.0 ELSE ceil(round((1 - ln(1.5) / ln(max(p) / min(p))) * 1000000, 3)) / 1000000 END AS a FROM r),
w AS (SELECT src, t, p ** a / sum(p ** a) OVER () AS w FROM r, e),
b AS (SELECT src, t, CAST(floor(w * max(t / w) OVER () + 0.5) AS BIGINT) AS budget FROM w),
pl AS (SELECT src, coalesce(budget // b.t, 1) AS whole, coalesce(budget % b.t, 0) AS part FROM s LEFT JOIN b USING (src)),
dg AS (SELECT src, CAST(least(greatest(ceil(round(ln(greatest(t, 1) / 16777216) / ln(16), 9)), 2), 6) AS INTEGER) AS d FROM s),
bl AS (SELECT src, key[1:d] AS block, sum(tokens) AS bt FROM base JOIN dg USING (src) GROUP BY ALL),
x AS (SELECT src, block, bt, whole, part, epoch, md5('mix-1|' || src || '|' || epoch || '|' || block) AS bk FROM bl JOIN pl USING (src), unnest(range(CAST(whole AS BIGINT) + 1)) u(epoch)),
y AS (SELECT *, row_number() OVER o AS block_rank, coalesce(sum(bt) OVER (PARTITION BY src, epoch ORDER BY bk, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM x WINDOW o AS (PARTITION BY src, epoch ORDER BY bk, block)),
z AS (SELECT *, CASE WHEN epoch < whole THEN bt ELSE part - ahead END AS room FROM y WHERE epoch < whole OR (part > 0 AND part > ahead)),
u AS (SELECT base.*, epoch, block_rank, room, bt, sum(tokens) OVER (PARTITION BY base.src, z.block, epoch ORDER BY key) AS so_far FROM base JOIN dg ON base.src = dg.src JOIN z ON base.src = z.src AND key[1:d] = z.block),
mixed AS (SELECT * FROM u WHERE room >= bt OR so_far <= room)
"""
MIXING = f"""
WITH {MIXING_CTE.format(docs="documents")}
SELECT doc_id, src AS source, CAST(epoch AS INTEGER) AS epoch, CAST(block_rank AS INTEGER) AS block_rank FROM mixed
"""


# Addresses are read here by cutting texts at their separators, with no pattern of the operator's.


def _after(text: str, mark: str) -> str:
    """What follows the first mark, or nothing."""
    return f"(CASE WHEN instr({text}, '{mark}') > 0 THEN substr({text}, instr({text}, '{mark}') + {len(mark)}) ELSE '' END)"


def _before(text: str, mark: str) -> str:
    """What precedes the first mark, or all."""
    return f"split_part({text}, '{mark}', 1)"


def _rules(rules: tuple[str, ...]) -> str:
    return ", ".join("('{}', '{}')".format(r.partition("/")[0], "".join(r.partition("/")[1:])) for r in rules)


def _attribute(name: str) -> str:
    """A tag's attribute, with or without quotes."""
    found = rf"regexp_extract(tag, '\s{name}\s*=\s*(\"[^\"]*\"|''[^'']*''|[^\s>]+)', 1, 'i')"
    return f"trim(trim({found}, '\"'), '''')"


def url_sql(block: tuple[str, ...], allow: tuple[str, ...], redirects: str = "SELECT NULL::VARCHAR AS source, NULL::VARCHAR AS target WHERE false") -> str:
    """SQL for the URL filter, given its rules and a query for the redirects."""
    bare = _before(_before("url", "?"), "#")
    parts = f"string_split({bare}, '/')"
    host = _before(_before("node", "/"), "?")
    tracked = r"(split_part(x, '=', 1) IN ('ref', 'fbclid', 'gclid', 'sessionid') OR (starts_with(x, 'utm_') AND contains(x, '=')))"
    hit = lambda name: f"SELECT DISTINCT node FROM k, {name} r WHERE ('.' || {host}) LIKE '%.' || r.h AND starts_with(substr(node, length({host}) + 1), r.prefix)"
    return rf"""
WITH RECURSIVE pages_ AS (SELECT page_id, trim(url, ' ') AS url, html FROM pages),
tags AS (SELECT url, unnest(regexp_extract_all(html, '<(?:link|meta)\s[^>]*', 0, 'i')) AS tag FROM pages_ WHERE coalesce(url, '') <> ''),
attrs AS (SELECT url, lower(substr(tag, 2, 4)) AS kind, lower({_attribute('rel')}) AS rel, {_attribute('href')} AS href, lower({_attribute('property')}) AS property, {_attribute('content')} AS content, lower({_attribute('http-equiv')}) AS equiv FROM tags),
named AS (
  SELECT url, href AS t FROM attrs WHERE kind = 'link' AND rel = 'canonical'
  UNION ALL SELECT url, content FROM attrs WHERE kind = 'meta' AND property = 'og:url'
  UNION ALL SELECT url, trim({_after("replace(content, 'URL=', 'url=')", "url=")}) FROM attrs WHERE kind = 'meta' AND equiv = 'refresh'),
resolved AS (SELECT url, CASE WHEN t LIKE '%://%' THEN t WHEN starts_with(t, '//') THEN split_part(url, '//', 1) || t
  WHEN starts_with(t, '/') THEN split_part(url, '://', 1) || '://' || {_before(_before(_before("split_part(url, '://', 2)", "/"), "?"), "#")} || t
  ELSE array_to_string(CASE WHEN len({parts}) > 3 THEN {parts}[1:len({parts}) - 1] ELSE {parts} END, '/') || '/' || t END AS target FROM named WHERE coalesce(t, '') <> ''),
moved AS ({redirects}),
asked AS (SELECT DISTINCT trim(x, ' ') AS u FROM (SELECT url AS x FROM pages_ UNION ALL SELECT target FROM resolved UNION ALL SELECT source FROM moved UNION ALL SELECT target FROM moved) WHERE x IS NOT NULL),
cut AS (SELECT u, {_before("CASE WHEN contains(u, '://') THEN " + _after("u", "://") + " ELSE u END", "#")} AS b FROM asked),
ends AS (SELECT u, b, list_min(list_filter([instr(b, '/'), instr(b, '?'), length(b) + 1], lambda x: x > 0)) AS c FROM cut),
halves AS (SELECT u, lower(split_part(split_part(substr(b, 1, c - 1), '@', -1), ':', 1)) AS h, substr(b, c) AS rest FROM ends),
pieces AS (SELECT u, CASE WHEN starts_with(h, 'www.') THEN substr(h, 5) WHEN starts_with(h, 'm.') THEN substr(h, 3) ELSE h END AS host, {_before('rest', '?')} AS path,
  array_to_string(list_filter(string_split({_after('rest', '?')}, '&'), lambda x: x <> '' AND NOT {tracked}), '&') AS query FROM halves),
spelled AS (SELECT u, CASE WHEN u <> '' THEN host || rtrim(path, '/') || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS node FROM pieces),
e AS (SELECT a.node AS a, b.node AS b FROM (SELECT url AS x, target AS y FROM resolved UNION ALL SELECT source, target FROM moved) r JOIN spelled a ON trim(r.x, ' ') = a.u JOIN spelled b ON trim(r.y, ' ') = b.u WHERE a.node IS NOT NULL AND b.node IS NOT NULL),
both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
n AS (SELECT node FROM spelled WHERE node IS NOT NULL),
reach(node, other) AS (SELECT node, node FROM n UNION SELECT reach.node, both_.b FROM reach JOIN both_ ON reach.other = both_.a),
k AS (SELECT node, min(other) AS class FROM reach GROUP BY node),
block_rules(h, prefix) AS (VALUES {_rules(block)}), allow_rules(h, prefix) AS (VALUES {_rules(allow)}),
al AS ({hit('allow_rules')}), bl AS ({hit('block_rules')}),
bad AS (SELECT DISTINCT class FROM k WHERE node IN (SELECT node FROM bl) AND node NOT IN (SELECT node FROM al))
SELECT page_id, s.node, k.class, CASE WHEN s.node IN (SELECT node FROM al) THEN 'allow' WHEN k.class IN (SELECT class FROM bad) THEN 'block' ELSE 'pass' END AS decision
FROM pages_ p LEFT JOIN spelled s ON p.url = s.u LEFT JOIN k ON s.node = k.node
"""


#: Redirects for the query that has some: every fifth page leads to the next one.
REDIRECTS = "SELECT a.url AS source, b.url AS target FROM pages a JOIN pages b ON b.page_id = a.page_id + 1 WHERE a.page_id % 5 = 0"
