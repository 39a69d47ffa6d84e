"""The mixture of sources, as one DuckDB statement."""

#: Rows that agree in source, doc_id and text are numbered and so kept apart.
MIX = r"""
WITH sized AS (
  SELECT *, row_number() OVER (PARTITION BY source, tag) AS copy FROM (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           md5(coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS tag
    FROM documents)),
sources AS (
  SELECT source, source_size, sid, (sid - 1) % 3 + 1 AS weight, source_size * 3 AS cap, sum(source_size) OVER ()::BIGINT AS total
  FROM (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM sized GROUP BY source)),
judged AS (
  SELECT *, cap * sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= weight * (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS capped
  FROM sources),
targets AS (
  SELECT sid, source, source_size, total, CASE WHEN capped THEN cap::DOUBLE ELSE (weight * spare)::DOUBLE / share::DOUBLE END AS target
  FROM (SELECT *, total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS spare, sum(CASE WHEN NOT capped THEN weight END) OVER () AS share FROM judged)),
arcs AS (
  SELECT sid, sum(arc) OVER (ORDER BY sid) - arc AS lo, CASE WHEN sid = max(sid) OVER () THEN 9000000000 ELSE sum(arc) OVER (ORDER BY sid) END AS hi
  FROM (SELECT sid, round(target / total * 2147483648)::BIGINT AS arc FROM targets)),
slots AS (
  SELECT i AS slot, ((i % 2147483648) * 1327217885) % 2147483648 AS point
  FROM range((SELECT ceil(sum(size) / 64.0)::BIGINT FROM sized)) AS r(i)),
given AS (
  SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS block FROM slots JOIN arcs ON point >= lo AND point < hi),
needs AS (
  SELECT sid, round(target)::BIGINT AS goal, ceil(round(target) / 64.0)::BIGINT AS need, (SELECT count(*) FROM given g WHERE g.sid = t.sid) AS n FROM targets t),
schedule AS (
  SELECT sid, block FROM given JOIN needs USING (sid) WHERE block < need
  UNION ALL SELECT sid, unnest(range(n, need)) FROM needs),
streams AS (
  SELECT doc_id, sized.source, size, tag, copy, sid, epoch * source_size
    + sum(size) OVER (PARTITION BY sid, epoch ORDER BY md5(epoch::VARCHAR || ':' || tag), copy ROWS UNBOUNDED PRECEDING) AS stop
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source, range(3) AS e(epoch) WHERE size > 0),
pieces AS (
  SELECT *, unnest(range((stop - size)::BIGINT // 64, (stop - 1)::BIGINT // 64 + 1)) AS block FROM streams),
taken AS (
  SELECT source, tag, copy, sum(greatest(0, least(stop, block * 64 + 64, goal) - greatest(stop - size, block * 64))) AS words
  FROM pieces JOIN needs USING (sid) SEMI JOIN schedule USING (sid, block) GROUP BY ALL)
SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(k.words, 0)::BIGINT AS taken
FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
LEFT JOIN taken k ON d.tag = k.tag AND d.source IS NOT DISTINCT FROM k.source AND d.copy = k.copy
"""
