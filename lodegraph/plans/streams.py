"""Event-window queries (batch runs of the streaming operators) and sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detect as D
from ..sources import ingest, sinks
from ..sources.adapters import Tables
from ..streaming import events as E
from .code import put

put("events_tumbling", " SELECT epoch(time_bucket(INTERVAL '1 hour', ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")(lambda s, d: E.tumbling(Tables(s, d).raw("events")).select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total")))
put("events_sliding", ", k AS (SELECT unnest([0, 1, 2, 3]) AS k) SELECT epoch(time_bucket(INTERVAL '15 minutes', ts) - k * INTERVAL '15 minutes')::BIGINT AS start, event_type, count(*) AS n FROM events, k GROUP BY 1, 2")(lambda s, d: E.sliding(Tables(s, d).raw("events")).select(F.unix_timestamp("start").alias("start"), "event_type", "n"))
put("events_session", ", l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL '30 minutes' OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS b FROM events), g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l) SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start, count(*) AS n FROM g GROUP BY user_id, k")(
    lambda s, d: E.sessions(Tables(s, d).raw("events")).select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start"), "n")
)
put("mermaid_lines", " SELECT '  n' || e.src || '[\"' || a.name || '\"] --> n' || e.dst || '[\"' || b.name || '\"]' AS line FROM graph e JOIN symbols a ON a.id = e.src JOIN symbols b ON b.id = e.dst")(lambda s, d: sinks.mermaid_lines(Tables(s, d).graph, Tables(s, d).symbols))
put("sarif_results", None)(lambda s, d: sinks.sarif(D.rule_metric(Tables(s, d).metrics, "cc", 45), "lodegraph"))
put("capsule_paths", " SELECT id, substr(sha256(split_part(path, '/', 1)), 1, 12) || '/' || substr(sha256(split_part(path, '/', 2)), 1, 12) || '/' || substr(sha256(split_part(path, '/', 3)), 1, 12) AS path FROM paths")(lambda s, d: Tables(s, d).paths.select("id", sinks.redacted(F.col("path")).alias("path")))
put("file_languages", " SELECT CASE WHEN ends_with(path, '.py') THEN 'python' END AS language, count(*) AS files FROM files GROUP BY 1")(lambda s, d: Tables(s, d).files.groupBy(ingest.language(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("files")))
put("file_roles", " SELECT id, CASE WHEN starts_with(path, 'tests/') THEN 'test' ELSE 'source' END AS role FROM files")(lambda s, d: Tables(s, d).files.select("id", ingest.file_role(F.col("path"), F.lit(None).cast("string")).alias("role")))
put("runtime_upsert", ", a AS (SELECT name, event_type, ms, ts, span_id FROM spans) SELECT name, event_type, max(span_id) AS span_id FROM a GROUP BY 1, 2")(
    lambda s, d: (lambda x: sinks.upsert(x.filter("span_id % 2 = 0"), x.filter("span_id % 2 = 1"), ["name", "event_type"], "span_id").select("name", "event_type", "span_id"))(Tables(s, d).spans)
)
