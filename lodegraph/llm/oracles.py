"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from .mixing import _STEP, BLOCK, FINE, SHARD_WORDS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

WARC = """
WITH d AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to FROM f
"""

DEDUP = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS low FROM documents UNION SELECT u.b, r.low FROM r JOIN u ON u.a = r.id WHERE r.low < u.b)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, c.low AS component_id, n.doc_id = c.low AS kept FROM n JOIN (SELECT id, min(low) AS low FROM r GROUP BY 1) c ON c.id = n.doc_id
"""

#: Highest quotients are ranked among all quotients up to a party's exact share and the number of parties.
MIXING = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5('1:' || CAST(doc_id AS VARCHAR)) AS draw FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS pos FROM d GROUP BY 1),
s1 AS (SELECT *, [3.0, 1.0, 2.0][pos % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s0),
s2 AS (SELECT *, cap / weight AS ratio, coalesce(sum(cap) OVER (ORDER BY cap / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(weight) OVER (ORDER BY cap / weight, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(source_size) OVER () AS total FROM s1),
s3 AS (SELECT *, (total * 1.5::DOUBLE - below) / rest AS level FROM s2),
s4 AS (SELECT *, (SELECT level FROM s3 WHERE ratio >= level ORDER BY ratio, pos LIMIT 1) AS water FROM s3),
s5 AS (SELECT source, pos, source_size, CASE WHEN water IS NULL OR ratio <= water THEN cap ELSE weight * water END AS target, CAST(round(total * 1.5::DOUBLE / {BLOCK}) AS BIGINT) AS seats, CAST(least({FINE}, pow(2, ceil(log2(greatest(1.0::DOUBLE, source_size / {SHARD_WORDS}::DOUBLE))))) AS BIGINT) AS shards FROM s4),
sq AS (SELECT pos, unnest(range(0, CAST(floor(target * seats / sum(target) OVER ()) AS BIGINT) + count(*) OVER () + 2)) AS k, target, seats FROM s5 WHERE target > 0),
sr AS (SELECT pos, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, pos, k) AS rank, seats FROM sq),
s6 AS (SELECT s5.*, coalesce(q, 0) AS quota FROM s5 LEFT JOIN (SELECT pos, count(*) AS q FROM sr WHERE rank <= seats GROUP BY 1) USING (pos)),
e AS (SELECT d.*, s6.pos, source_size, target, quota, ('0x' || left(draw, 8))::BIGINT % {FINE} % shards AS shard FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source),
c0 AS (SELECT pos, quota, shard, CAST(sum(size) AS BIGINT) AS words FROM e GROUP BY 1, 2, 3),
cq AS (SELECT pos, shard, unnest(range(0, CAST(floor(CAST(words * quota AS DOUBLE) / sum(words) OVER (PARTITION BY pos)) AS BIGINT) + count(*) OVER (PARTITION BY pos) + 2)) AS k, words, quota FROM c0 WHERE words > 0),
cr AS (SELECT pos, shard, row_number() OVER (PARTITION BY pos ORDER BY words / (2 * k + 1) DESC, shard, k) AS rank, quota FROM cq),
c1 AS (SELECT c0.pos, c0.shard, greatest(CAST(ceil(words / {BLOCK}::DOUBLE) AS BIGINT), 1) AS blocks, least(coalesce(q, 0), 2 * CAST(ceil(words / {BLOCK}::DOUBLE) AS BIGINT)) AS part FROM c0 LEFT JOIN (SELECT pos, shard, count(*) AS q FROM cr WHERE rank <= quota GROUP BY 1, 2) USING (pos, shard)),
g AS (SELECT doc_id, size, source_size, target, c1.*, ('0x' || left(md5('1:' || c1.pos || ':' || c1.shard), 8))::BIGINT % blocks AS shift, coalesce(CAST(sum(size) OVER (PARTITION BY e.pos, e.shard ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS place FROM e JOIN c1 ON c1.pos = e.pos AND c1.shard = e.shard)
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN CAST(list_sum(list_transform(range(place // {BLOCK}, (place + size - 1) // {BLOCK} + 1), lambda b: (least(place + size, (b + 1) * {BLOCK}) - greatest(place, b * {BLOCK})) * (part // blocks + CASE WHEN (b * {_STEP} + shift) % blocks < part % blocks THEN 1 ELSE 0 END))) AS BIGINT) ELSE 0 END AS taken FROM g
"""
