"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

import math

from tillscope.llm.quality_rules import MEASURES

_STEP = math.log((1 + 0.01) / (1 - 0.01))
_MIDDLE = 2.0 / (1.0 + math.exp(_STEP))
_LEAST_ROWS, _FENCE = 100, 4.0


def _rate(m) -> str:
    return f"coalesce({m.numerator}::double / nullif({m.denominator}, 0)::double, 0.0)"


def _quartiles(keys: str, name: str) -> str:
    listed = f"{keys}, " if keys else ""
    by = f"partition by {listed}measure"
    return f"""
{name} as (
  select {listed}measure, max(n_rows) as n_rows,
    min(bucket) filter (upto > 0.25 * (n_rows - 1)) as b1, min(bucket) filter (upto > 0.75 * (n_rows - 1)) as b3
  from (
    select {listed}measure, bucket, sum(n) over ({by} order by bucket) as upto, sum(n) over ({by}) as n_rows
    from (select {listed}measure, bucket, sum(n) as n from sketch group by {listed}measure, bucket)
  ) group by {listed}measure
)"""


def _value(bucket: str) -> str:
    return f"case when {bucket} = -1048576 then 0.0 else exp({bucket} * {_STEP!r}) * {_MIDDLE!r} end"


def _limit(m, side: str) -> str:
    spread = f"greatest(q3 - q1, {m.grain!r})"
    edge = f"q3 + {_FENCE!r} * {spread}" if side == "high" else f"q1 - {_FENCE!r} * {spread}"
    return f"max({edge}) filter (measure = '{m.name}') as {m.name}_{side}"


def adaptive_rules() -> str:
    long = " union all ".join(f"select lang, source, '{m.name}' as measure, {_rate(m)} as v from passed" for m in MEASURES)
    limits = ", ".join([_limit(m, "high") for m in MEASURES] + [_limit(m, "low") for m in MEASURES if m.two_sided])
    within = " and ".join(
        [f"{_rate(m)} <= {m.name}_high" for m in MEASURES] + [f"{_rate(m)} >= {m.name}_low" for m in MEASURES if m.two_sided]
    )
    return f"""
with texts as (
  select row_number() over () as row_no, doc_id, lang, source, coalesce(text, '') as t from documents
), words as (
  select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls
  from texts
), windows as (
  select row_no, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] as g
  from (select row_no, ws, unnest(range(1, len(ws) - 1)) as p from words)
), repeats as (
  select row_no, p from (select row_no, p, count(*) over (partition by row_no, g) as c from windows) where c > 1
), covered as (
  select row_no, count(distinct word) as n from (select row_no, unnest([p, p + 1, p + 2]) as word from repeats) group by row_no
), counted as (
  select w.row_no, doc_id, lang, source, len(ws)::bigint as n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols,
    len(regexp_extract_all(t, '\\p{{Lu}}'))::bigint as n_upper,
    len(ls)::bigint as n_lines, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
    coalesce(c.n, 0)::bigint as n_repeat_words
  from words w left join covered c on c.row_no = w.row_no
), based as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counted
), passed as (
  select * from based where not base_failed
), sketch as (
  select lang, source, measure, case when v > 0 then ceil(ln(v) / {_STEP!r})::bigint else -1048576 end as bucket, count(*) as n
  from ({long}) group by 1, 2, 3, 4
), {_quartiles("lang, source", "own")}, {_quartiles("lang", "per_lang")}, {_quartiles("", "whole")}, picked as (
  select o.lang, o.source, o.measure,
    case when o.n_rows >= {_LEAST_ROWS} then o.b1 when l.n_rows >= {_LEAST_ROWS} then l.b1 else a.b1 end as b1,
    case when o.n_rows >= {_LEAST_ROWS} then o.b3 when l.n_rows >= {_LEAST_ROWS} then l.b3 else a.b3 end as b3
  from own o
  join per_lang l on l.measure = o.measure and l.lang is not distinct from o.lang
  join whole a on a.measure = o.measure
), limits as (
  select lang, source, {limits}
  from (select lang, source, measure, {_value("b1")} as q1, {_value("b3")} as q3 from picked) group by lang, source
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  coalesce(not base_failed and {within}, false) as kept
from based b left join limits g on g.lang is not distinct from b.lang and g.source is not distinct from b.source
"""


HAMMING = """
with codes as (
  select distinct vec_id, list_transform(range(1, 65), lambda i: coalesce(embedding[i] > 0, false)) as bits
  from embeddings where vec_id is not null
), pairs as (
  select distinct q.vec_id as query_id, c.vec_id as id,
    list_sum(list_transform(range(1, 65), lambda i: (q.bits[i] <> c.bits[i])::int))::int as distance
  from codes q join codes c on q.vec_id <> c.vec_id
  where q.vec_id % 100 = 0
)
select query_id, rank::int as rank, id, distance
from (select *, row_number() over (partition by query_id order by distance, id) as rank from pairs)
where rank <= 10
"""

#: The manifest by sorting and by levels, one row for each node; crc32 of the id is folded digit by digit.
MANIFEST = """
WITH RECURSIVE bits AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS i))
), docs AS (
  SELECT coalesce('=' || lang, '') AS grp, doc_id, row_number() OVER () AS row, source, lang, n_chars, text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc
  FROM documents, bits
), fields AS (
  SELECT grp, doc_id, row, n_chars, n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END AS n_changed,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS ahead,
    coalesce(strlen(text) || ':' || text, '-') AS behind
  FROM docs
), hashed AS (
  SELECT grp, doc_id, row,
    sha256(ahead || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || behind) AS leaf,
    sha256(ahead || coalesce(strlen(CAST(n_changed AS VARCHAR)) || ':' || n_changed, '-') || behind) AS changed
  FROM fields
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS pos FROM hashed
), nodes(grp, level, pos, h) AS (
  SELECT grp, 0, pos, leaf FROM leaves
  UNION ALL
  SELECT grp, level + 1, pos, h FROM (
    SELECT grp, any_value(level) AS level, pos // 2 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h, any_value(n) AS n
    FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM nodes) GROUP BY grp, pos // 2)
  WHERE n > 1
), subroots AS (
  SELECT grp, level AS height, h AS subroot, row_number() OVER (ORDER BY grp) - 1 AS pos
  FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY level DESC) AS last FROM nodes) WHERE last = 1
), tops(level, pos, h) AS (
  SELECT 0, pos, subroot FROM subroots
  UNION ALL
  SELECT level + 1, pos, h FROM (
    SELECT any_value(level) AS level, pos // 2 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h, any_value(n) AS n
    FROM (SELECT *, count(*) OVER () AS n FROM tops) GROUP BY pos // 2)
  WHERE n > 1
), root AS (
  SELECT level AS height, h AS root FROM tops ORDER BY level DESC LIMIT 1
), below AS (
  SELECT l.row, s.level, (l.pos >> s.level) & 1 AS side, n.h
  FROM leaves l JOIN subroots r USING (grp), LATERAL (SELECT unnest(range(r.height)) AS level) s
  LEFT JOIN nodes n ON n.grp = l.grp AND n.level = s.level AND n.pos = xor(l.pos >> s.level, 1)
), above AS (
  SELECT l.row, r.height + s.level AS level, (r.pos >> s.level) & 1 AS side, n.h
  FROM leaves l JOIN subroots r USING (grp), root t, LATERAL (SELECT unnest(range(t.height)) AS level) s
  LEFT JOIN tops n ON n.level = s.level AND n.pos = xor(r.pos >> s.level, 1)
), proofs AS (
  SELECT row, list({'side': side, 'h': coalesce(h, '')} ORDER BY level) AS steps, string_agg(coalesce(h, ''), '' ORDER BY level) AS proof
  FROM (SELECT * FROM below UNION ALL SELECT * FROM above) GROUP BY row
), folds AS (
  SELECT l.doc_id, l.leaf, r.subroot, t.root, sha256(coalesce(p.proof, '')) AS proof_sha256,
    coalesce(list_reduce(list_prepend({'side': 0, 'h': l.changed}, p.steps),
      lambda n, s: {'side': 0, 'h': sha256(CASE WHEN s.side = 1 THEN s.h || n.h ELSE n.h || s.h END)}).h, l.changed) AS folded_root
  FROM leaves l JOIN subroots r USING (grp) CROSS JOIN root t LEFT JOIN proofs p USING (row)
)
SELECT *, folded_root = root AS verified FROM folds
"""

#: Phrases counted as lists of words; sums of HUGEINT are exact.
COLLOCATIONS = """
WITH texts AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS words
  FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM texts)
), starts AS (
  SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces
), grams AS (
  SELECT lang, words[i : i + k - 1] AS phrase, count(*) AS f
  FROM starts, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(words) GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM pieces GROUP BY lang
), candidates AS (
  SELECT lang, phrase, f AS a FROM grams WHERE len(phrase) > 1 AND f >= 100
), inside AS (
  SELECT DISTINCT c.lang, c.phrase
  FROM (SELECT lang, a, unnest([phrase[1 : len(phrase) - 1], phrase[2 : len(phrase)]]) AS part FROM candidates WHERE len(phrase) > 2) b
  JOIN candidates c ON c.lang = b.lang AND c.phrase = b.part AND 100 * b.a >= 100 * c.a
), cuts AS (
  SELECT lang, phrase, a, unnest(range(1, len(phrase))) AS k FROM candidates ANTI JOIN inside USING (lang, phrase)
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, t.n,
    CAST(CAST(1000 AS HUGEINT) * c.a * t.n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM cuts c JOIN totals t ON t.lang = c.lang
  JOIN grams l ON l.lang = c.lang AND l.phrase = c.phrase[1 : c.k]
  JOIN grams r ON r.lang = c.lang AND r.phrase = c.phrase[c.k + 1 : len(c.phrase)]
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(phrase, ' ')) AS rank,
  array_to_string(phrase, ' ') AS phrase, a, l, r, n, score
FROM best QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(phrase, ' ')) <= 2000
"""
