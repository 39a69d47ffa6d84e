"""The repair of conversations as one DuckDB statement: weights are strings of nine digits of cost and the labels, so that least() is their order."""

#: DuckDB has no crc32: it is computed bit by bit. The path goes backwards over the rows, with a weight for each of four grammar states.
REPAIR = r"""
WITH RECURSIVE numbered AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT),
      lambda crc, b: list_reduce(range(8), lambda a, i: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END), xor(crc, b)), 4294967295), 4294967295) % 20 AS fault
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM numbered WHERE fault <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k, count(*) OVER (PARTITION BY conv_id) AS n, left(role, 1) AS c FROM damaged),
judged AS (
  SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY k) || c AS pair,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
kinds AS (SELECT *, fault IN ('blank', 'duplicate') AS unfit, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS t FROM judged),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM kinds GROUP BY conv_id),
paths AS (
  SELECT DISTINCT conv_id, n + 1 AS k, '000000000' AS w0, '000000010II' AS w1, '000000005I' AS w2, '000000000' AS w3 FROM kinds
  UNION ALL
  SELECT conv_id, k, least(b0, lpad((left(least(b2, i3), 9)::BIGINT + 5)::VARCHAR, 9, '0') || 'I' || substr(least(b2, i3), 10)), least(b1, lpad((left(least(b2, i3), 9)::BIGINT + 5)::VARCHAR, 9, '0') || 'I' || substr(least(b2, i3), 10)),
    least(b2, i3), least(b3, i2)
  FROM (
    SELECT *, lpad((left(b2, 9)::BIGINT + 5)::VARCHAR, 9, '0') || 'I' || substr(b2, 10) AS i2, lpad((left(b3, 9)::BIGINT + 5)::VARCHAR, 9, '0') || 'I' || substr(b3, 10) AS i3
    FROM (
      SELECT conv_id, k, least(d0, CASE WHEN c = 's' THEN k1 WHEN c = 'u' THEN k2 END, r2) AS b0, least(d1, CASE WHEN c = 'u' THEN k2 END, r2) AS b1, least(d2, CASE WHEN c = 'a' THEN k3 END, r3) AS b2, least(d3, CASE WHEN c = 'u' THEN k2 END, r2) AS b3
      FROM (
        SELECT r.conv_id, r.k, c, lpad((left(w0, 9)::BIGINT + 2)::VARCHAR, 9, '0') || 'D' || substr(w0, 10) AS d0, lpad((left(w1, 9)::BIGINT + 2)::VARCHAR, 9, '0') || 'D' || substr(w1, 10) AS d1,
          lpad((left(w2, 9)::BIGINT + 2)::VARCHAR, 9, '0') || 'D' || substr(w2, 10) AS d2, lpad((left(w3, 9)::BIGINT + 2)::VARCHAR, 9, '0') || 'D' || substr(w3, 10) AS d3,
          CASE WHEN NOT unfit THEN lpad((left(w1, 9)::BIGINT + t)::VARCHAR, 9, '0') || 'K' || substr(w1, 10) END AS k1, CASE WHEN NOT unfit THEN lpad((left(w2, 9)::BIGINT + t)::VARCHAR, 9, '0') || 'K' || substr(w2, 10) END AS k2,
          CASE WHEN NOT unfit THEN lpad((left(w3, 9)::BIGINT + t)::VARCHAR, 9, '0') || 'K' || substr(w3, 10) END AS k3, CASE WHEN NOT unfit THEN lpad((left(w2, 9)::BIGINT + t + 1)::VARCHAR, 9, '0') || 'R' || substr(w2, 10) END AS r2,
          CASE WHEN NOT unfit THEN lpad((left(w3, 9)::BIGINT + t + 1)::VARCHAR, 9, '0') || 'R' || substr(w3, 10) END AS r3
        FROM paths p JOIN kinds r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.k = p.k - 1)))),
best AS (SELECT conv_id, left(w0, 9)::BIGINT AS cost, substr(w0, 10) AS audit FROM paths WHERE k = 1),
steps AS (SELECT conv_id, p, substr(audit, p, 1) AS label FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM best)),
sites AS (SELECT *, count(*) FILTER (WHERE label <> 'I') OVER w AS k, count(*) FILTER (WHERE label <> 'D') OVER w AS j FROM steps WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
lines AS (
  SELECT s.conv_id, p, j, label, CASE WHEN label = 'I' THEN '' ELSE r.text END AS text, r.role, r.c,
    max(CASE WHEN j = 1 AND label = 'K' AND r.c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY s.conv_id) AS head
  FROM sites s LEFT JOIN kinds r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.k = s.k WHERE label <> 'D'),
said AS (SELECT conv_id, string_agg(CASE WHEN label = 'K' THEN role WHEN (j - head) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS whole FROM lines GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN said s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
"""
