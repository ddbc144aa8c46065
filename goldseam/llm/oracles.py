"""DuckDB SQL that gives the rows of the queries which SQL can express."""

from __future__ import annotations

from goldseam.llm import collocations as co
from goldseam.llm import nn_descent as nn
from goldseam.llm import quality as q
from goldseam.llm.url_filter import UrlRule

_WS = r"[\x20\x09-\x0D]+"


def url_filter(rules: list[UrlRule]) -> str:
    values = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in rules)
    return f"""
WITH parts AS (
  SELECT page_id, row_number() OVER () AS n,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(verdict, h, p) AS (VALUES {values}),
best AS (
  SELECT n, max(struct_pack(size := length(h || p), rule := h || p, verdict := verdict)) AS b
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY n)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict
FROM parts LEFT JOIN best USING (n)"""


def quality() -> str:
    div = {r.name: r.score.replace(" div ", " // ") for r in q.RULES}
    tests = " UNION ALL ".join(
        f"SELECT stratum, n, {r} AS rule, {c} AS step, {cut} AS cut, k{r}_{c} AS k FROM counts"
        for r, rule in enumerate(q.RULES)
        for c, cut in enumerate(rule.grid)
    )
    sums = ", ".join(
        f"sum(CASE WHEN {div[rule.name]} > {cut} THEN 1 ELSE 0 END)::BIGINT AS k{r}_{c}"
        for r, rule in enumerate(q.RULES)
        for c, cut in enumerate(rule.grid)
    )
    risk = q.RISK / len(q.RULES)
    cuts = ", ".join(
        f"max(cut) FILTER (WHERE rule = {r}) AS c{r}" for r in range(len(q.RULES))
    )
    above = " OR ".join(
        f"coalesce({div[rule.name]} > c{r}, false)" for r, rule in enumerate(q.RULES)
    )
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce('=' || lang, '') AS stratum,
    coalesce(text, '') AS text FROM documents),
split AS (SELECT *, list_filter(string_split_regex(text, '{_WS}'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM docs),
word AS (SELECT row, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM split),
shingle AS (SELECT row, i, hash(w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o,
    lead(w, 4) OVER o) AS g, lead(i, 4) OVER o AS whole FROM word WINDOW o AS (PARTITION BY row ORDER BY i)),
twice AS (SELECT row, i FROM shingle WHERE whole IS NOT NULL QUALIFY count(*) OVER (PARTITION BY row, g) > 1),
covered AS (SELECT row, count(DISTINCT i + k) AS n FROM twice, range(0, 5) r(k) GROUP BY row),
f AS (SELECT s.row, doc_id, stratum, len(words)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines
  FROM split s LEFT JOIN covered c ON c.row = s.row),
b AS (SELECT *, n_words < {q.MIN_WORDS} OR n_repeat_words * 100 > n_words * {q.MAX_REPEAT_PERCENT}
    AS base_failed FROM f),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL),
counts AS (SELECT stratum, count(*) AS n, {sums} FROM b
  WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good) GROUP BY stratum),
tests AS ({tests}),
tail AS (SELECT stratum, rule, step, cut, k < n * {risk} AND list_sum(list_transform(range(0, k + 1),
    lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}) + (n - i) * ln(1 - {risk}))))
    <= {q.ERROR} / ({len(q.RULES)} * (SELECT count(*) FROM counts)) AS passed FROM tests),
prefix AS (SELECT *, bool_and(passed) OVER (PARTITION BY stratum, rule ORDER BY step) AS chosen FROM tail),
last AS (SELECT stratum, rule, max_by(cut, step) AS cut FROM prefix WHERE chosen GROUP BY stratum, rule),
cutoffs AS (SELECT stratum, {cuts} FROM last GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed,
  CASE WHEN base_failed THEN false ELSE NOT ({above}) END AS kept
FROM b LEFT JOIN cutoffs USING (stratum)"""


def quotation_linking() -> str:
    return r"""
WITH RECURSIVE msg AS (
  SELECT row_number() OVER () AS place, conv_id, turn, coalesce(turn, -1) AS tick, role, text
  FROM conversations),
raw AS (SELECT place, conv_id, tick, unnest(string_split(text, chr(10))) AS l,
    generate_subscripts(string_split(text, chr(10)), 1) AS i FROM msg),
line AS (SELECT place, conv_id, tick, i, l,
    length(regexp_replace(regexp_extract(l, '^(?:[ \t]{0,3}>)+'), '[^>]', '', 'g')) AS level,
    CASE WHEN regexp_matches(l, '^(?:[ \t]{0,3}>)') THEN regexp_replace(l, '^(?:[ \t]{0,3}>)+[ \t]?', '')
      ELSE l END AS body FROM raw),
mark AS (SELECT *, CASE WHEN level = lag(level) OVER w THEN 0 ELSE 1 END AS new FROM line
  WINDOW w AS (PARTITION BY place ORDER BY i)),
run AS (SELECT *, sum(new) OVER (PARTITION BY place ORDER BY i) AS r FROM mark),
piece AS (
  SELECT place, conv_id, tick, level, string_agg(body, ' ' ORDER BY i) AS body FROM run
    GROUP BY place, conv_id, tick, level, r
  UNION ALL SELECT place, conv_id, tick, level, body FROM line),
unit AS (SELECT DISTINCT place, conv_id, tick, level,
    lower(trim(regexp_replace(body, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS norm FROM piece),
said AS (SELECT conv_id, norm, min(tick) AS orig FROM unit WHERE level = 0 AND norm <> '' GROUP BY ALL),
link AS (SELECT u.place, u.level, s.orig, sum(len(string_split(u.norm, ' '))) AS words, count(*) AS n
  FROM unit u JOIN said s ON s.conv_id IS NOT DISTINCT FROM u.conv_id AND s.norm = u.norm
  WHERE u.level > 0 AND s.orig < u.tick GROUP BY ALL),
reply AS (SELECT place, arg_max(orig, struct_pack(a := -level, b := words, c := orig)) AS reply_to,
    sum(n)::BIGINT AS n_linked FROM link GROUP BY place),
parent AS (SELECT conv_id, tick, min(reply_to) AS up FROM msg JOIN reply USING (place) GROUP BY conv_id, tick),
climb AS (
  SELECT conv_id, tick, tick AS top FROM (SELECT DISTINCT conv_id, tick FROM msg)
  UNION ALL
  SELECT c.conv_id, c.tick, p.up FROM climb c JOIN parent p
    ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.tick = c.top),
root AS (SELECT conv_id, tick, min(top) AS thread_turn FROM climb GROUP BY conv_id, tick),
body AS (SELECT place, string_agg(body, chr(10) ORDER BY i) FILTER (WHERE level = 0) AS body,
    count(*) FILTER (WHERE level > 0) AS n_quoted_lines FROM line GROUP BY place)
SELECT m.conv_id, m.turn, m.role, root.thread_turn, reply.reply_to,
  row_number() OVER (PARTITION BY m.conv_id ORDER BY root.thread_turn, m.tick, m.place) - 1 AS position,
  coalesce(n_quoted_lines, 0) AS n_quoted_lines, coalesce(n_linked, 0) AS n_linked,
  trim(coalesce(body.body, ''), chr(10) || chr(13) || chr(9) || ' ') AS body
FROM msg m JOIN root ON root.conv_id IS NOT DISTINCT FROM m.conv_id AND root.tick = m.tick
LEFT JOIN reply ON reply.place = m.place LEFT JOIN body ON body.place = m.place"""


def collocations() -> str:
    """Phrases of 1 to 4 words by plain counting, every cut, and any longer candidate around a shorter one."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH piece AS (SELECT coalesce(lang, '{co.NO_LANG}') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM piece),
total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
counted AS (
  {" UNION ALL ".join(
      f"SELECT lang, {k} AS k, p, count(*) AS a FROM (SELECT lang, unnest(list_transform(range(1, len(ws) - {k - 1} + 1),"
      f" lambda i: array_to_string(ws[i:i + {k - 1}], ' '))) AS p FROM w) GROUP BY lang, p HAVING count(*) >= {co.LEAST}"
      for k in range(1, co.LONGEST + 1))}),
cut AS (SELECT lang, k, p, a, unnest(range(1, k)) AS j FROM counted WHERE k > 1),
part AS (SELECT *, array_to_string(string_split(p, ' ')[1:j], ' ') AS x,
    array_to_string(string_split(p, ' ')[j + 1:k], ' ') AS y FROM cut),
scored AS (SELECT c.lang, c.k, c.p, c.a, c.j, l.a AS l, r.a AS r,
    ({co.SCALE}::HUGEINT * c.a) // (l.a + r.a) AS score
  FROM part c JOIN counted l ON l.lang = c.lang AND l.p = c.x AND l.k = c.j
  JOIN counted r ON r.lang = c.lang AND r.p = c.y AND r.k = c.k - c.j),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
inside AS (SELECT lang, a, k, p, unnest(range(2, k)) AS len FROM counted WHERE k > 2),
inner_phrase AS (SELECT lang, a, len, p, unnest(range(1, k - len + 2)) AS i FROM inside),
around AS (SELECT lang, array_to_string(string_split(p, ' ')[i:i + len - 1], ' ') AS p, max(a) AS a
  FROM inner_phrase GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.p = b.p
  WHERE o.a IS NULL OR 100 * o.a::HUGEINT < {co.COVERED} * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, p AS phrase, a, l, r, n, score::BIGINT AS score
FROM ranked JOIN total USING (lang) WHERE rank <= {co.TOP}"""


def embedding_links() -> str:
    """All pairs of a label by plain comparison, and what links reach."""
    return f"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS place, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
  AND len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0
  AND len(list_filter(e, lambda c: c <> 0)) > 0),
link AS (SELECT a.place AS a, b.place AS b, b.vec_id FROM good a JOIN good b
  ON a.label = b.label AND a.place <> b.place AND len(a.e) = len(b.e)
  AND list_cosine_similarity(a.e, b.e) >= {nn.THRESHOLD}),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
least AS (SELECT r.a, min(v.vec_id) AS id FROM reach r JOIN v ON v.place = r.b GROUP BY r.a),
number AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(id, vec_id)) AS component_id,
  vec_id IS NOT DISTINCT FROM least(vec_id, coalesce(id, vec_id)) AS kept
FROM v LEFT JOIN number ON number.a = place LEFT JOIN least ON least.a = place"""
