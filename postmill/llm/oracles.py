"""SQL of those corpus queries that DuckDB can express; the others are tested against brute force."""

from __future__ import annotations

from postmill.llm.common import UPPER

WORDS = r"[^\x20\x09-\x0D]+"

TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM s QUALIFY rank <= 10"""

NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.w, c.w) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5"""

MIX = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS BIGINT) AS size,
         CAST(concat('0x', substr(md5(coalesce(CAST(doc_id AS STRING), '')), 1, 15)) AS BIGINT) AS h
  FROM documents
), by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
weighed AS (
  SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM by_source
), ordered AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS place FROM weighed
), filled AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM ordered
), lam AS (SELECT arg_min(level, place) AS l FROM filled WHERE level * weight <= 2 * source_size),
goals AS (
  SELECT source, source_size, CASE WHEN (SELECT l FROM lam) IS NULL THEN 2.0::DOUBLE * source_size ELSE least((SELECT l FROM lam) * weight, 2.0::DOUBLE * source_size) END AS target
  FROM filled
), budgets AS (
  SELECT *, target - whole * source_size AS budget FROM (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM goals)
), steps AS (
  SELECT source, h, held, sum(held) OVER (PARTITION BY source ORDER BY h) AS upto FROM (SELECT source, h, sum(size) AS held FROM d GROUP BY source, h)
), edges AS (
  SELECT b.source, min(s.h) AS edge, arg_min(s.held, s.h) AS held, arg_min(s.upto - s.held, s.h) AS below
  FROM budgets b JOIN steps s ON s.source IS NOT DISTINCT FROM b.source AND s.upto > b.budget GROUP BY b.source
), one AS (
  SELECT b.*, e.edge, e.held, b.budget - e.below AS gap, CAST(floor((b.budget - e.below) / 8) AS BIGINT) AS small
  FROM budgets b LEFT JOIN edges e ON e.source IS NOT DISTINCT FROM b.source
), rest AS (
  SELECT source, h, held, sum(held) OVER (PARTITION BY source ORDER BY h) AS upto FROM (
    SELECT d.source, d.h, sum(d.size) AS held FROM d JOIN one o ON o.source IS NOT DISTINCT FROM d.source AND d.h > o.edge AND d.size <= o.small GROUP BY d.source, d.h)
), edges2 AS (
  SELECT o.source, min(r.h) AS edge2, arg_min(r.held, r.h) AS held2, arg_min(r.upto - r.held, r.h) AS fill
  FROM one o JOIN rest r ON r.source IS NOT DISTINCT FROM o.source AND r.upto > o.gap GROUP BY o.source
), totals AS (SELECT source, max(upto) AS total FROM rest GROUP BY source),
two AS (
  SELECT o.*, e.edge2, e.held2, o.gap - coalesce(e.fill, t.total, 0) AS missing
  FROM one o LEFT JOIN edges2 e ON e.source IS NOT DISTINCT FROM o.source LEFT JOIN totals t ON t.source IS NOT DISTINCT FROM o.source
), chosen AS (
  SELECT *, coalesce(held2 - missing < missing, false) AS with_edge2,
         coalesce(held - gap < CASE WHEN held2 - missing < missing THEN held2 - missing ELSE missing END, false) AS with_edge
  FROM two
)
SELECT d.doc_id, d.size, c.source_size, c.target,
  CAST(d.size * (c.whole + CASE WHEN c.whole < 2 AND (c.edge IS NULL OR d.h < c.edge OR (c.with_edge AND d.h = c.edge)
    OR coalesce(NOT c.with_edge AND d.h > c.edge AND d.size <= c.small AND (c.edge2 IS NULL OR d.h < c.edge2 OR (c.with_edge2 AND d.h = c.edge2)), false)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN chosen c ON c.source IS NOT DISTINCT FROM d.source"""

NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORDS}') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1]))) END AS s FROM w
), n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
rows AS (SELECT doc_id, n, unnest(s) AS s FROM sets JOIN n USING (doc_id)),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM rows a JOIN rows b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY 1, 2, 3, 4 HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), links AS (SELECT a AS u, b AS v FROM common UNION ALL SELECT b, a FROM common),
reached AS (SELECT doc_id AS u, doc_id AS r FROM n UNION SELECT l.u, x.r FROM reached x JOIN links l ON l.v = x.u)
SELECT doc_id, n AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept FROM n JOIN reached ON u = doc_id GROUP BY doc_id, n"""

REPAIR = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')), ''), lambda ch: ascii(ch)::BIGINT),
      lambda crc, b: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc, b)), 4294967295), 4294967295) % 20 AS kind
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM c WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat_ws(':', length(role), role, text)), copy) AS place FROM damaged
), faults AS (
  SELECT *, substr(role, 1, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS before
  FROM placed
), by_conv AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND concat(before, initial) NOT IN ('su', 'ua', 'au')) AS illegal,
    list({'i': initial, 'r': role, 't': text, 'go': fault IN ('blank', 'duplicate'), 'more': CAST(fault = 'truncated' AS BIGINT)} ORDER BY place) AS rows
  FROM faults GROUP BY conv_id
), ways AS (
  -- of each state (0 nothing, 1 system, 2 user, 3 assistant) the cheapest way, then the least edits; m: messages, each behind a line feed
  SELECT * EXCLUDE (rows), list_reduce(rows, lambda acc, x:
    list_filter(list_transform([0, 1, 2, 3], lambda k: list_min(list_filter(
      flatten(list_transform(acc || list_transform(acc, lambda w: {'c': w.c + 2, 'e': w.e || 'I', 's': CASE WHEN w.s = 2 THEN 3 ELSE 2 END, 'm': concat(w.m, chr(10), CASE WHEN w.s = 2 THEN 'assistant:' ELSE 'user:' END)}),
        lambda w: [
          {'c': w.c + 3, 'e': w.e || 'D', 's': w.s, 'm': w.m},
          CASE WHEN NOT x.go AND (x.i = 's' AND w.s = 0 OR x.i = 'u' AND w.s <> 2 OR x.i = 'a' AND w.s = 2)
            THEN {'c': w.c + x.more, 'e': w.e || 'K', 's': CASE x.i WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, 'm': concat(w.m, chr(10), x.r, ':', x.t)} END,
          CASE WHEN NOT x.go THEN {'c': w.c + 2 + x.more, 'e': w.e || 'R', 's': CASE WHEN w.s = 2 THEN 3 ELSE 2 END, 'm': concat(w.m, chr(10), CASE WHEN w.s = 2 THEN 'assistant:' ELSE 'user:' END, x.t)} END
        ])), lambda w: w IS NOT NULL AND w.s = k))), lambda w: w IS NOT NULL),
    [{'c': 0::BIGINT, 'e': '', 's': 0, 'm': ''}]) AS ways
  FROM by_conv
), best AS (
  SELECT * EXCLUDE (ways), list_min(list_transform(ways, lambda w: CASE w.s
      WHEN 1 THEN {'c': w.c + 4, 'e': w.e || 'II', 's': 3, 'm': concat(w.m, chr(10), 'user:', chr(10), 'assistant:')}
      WHEN 2 THEN {'c': w.c + 2, 'e': w.e || 'I', 's': 3, 'm': concat(w.m, chr(10), 'assistant:')} ELSE w END)) AS way
  FROM ways
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(way.c, 0) AS cost, coalesce(way.e, '') AS audit, sha256(coalesce(substr(way.m, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id"""

ORACLES: dict[str, str] = {"op1_exact_topk": TOPK, "op4_source_mix": MIX, "op8_near_duplicates": NEAR, "op11_hard_negatives": NEGATIVES, "op12_conversation_repair": REPAIR}
