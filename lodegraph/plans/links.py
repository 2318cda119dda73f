"""Link, framework and composite queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import composite as C
from ..operators import graph as G
from ..operators import links as L
from ..operators import relational as R
from ..operators import scores as S
from ..sources.adapters import Tables, oracle
from .code import FILES, file_features, put
from .graphs import SCC
from .registry import query

put("protobuf_bridge", ", pr AS (SELECT p_partkey AS id, replace(p_name, ' ', '_') AS name, CASE WHEN p_size % 2 = 0 THEN 'service' ELSE 'message' END AS kind FROM part) SELECT pr.id AS proto_id, s.id AS symbol_id, 'message' AS link FROM pr JOIN symbols s ON lower(s.name) = lower(pr.name)")(
    lambda s, d: (lambda t: L.protobuf_bridge(t.raw("part").select(F.col("p_partkey").alias("id"), F.regexp_replace("p_name", " ", "_").alias("name"), F.expr("CASE WHEN p_size % 2 = 0 THEN 'service' ELSE 'message' END").alias("kind")), t.symbols))(Tables(s, d))
)
put("config_bridge", ", k AS (SELECT id, name AS key FROM symbols), u AS (SELECT id, CASE id % 3 WHEN 0 THEN name WHEN 1 THEN upper(name) ELSE name || '.x' END AS key FROM symbols), p AS (SELECT k.id AS key_id, u.id AS use_id, max(CASE WHEN k.key = u.key THEN 1.0 WHEN lower(k.key) = lower(u.key) THEN 0.9 ELSE 0.85 END) AS confidence FROM k JOIN u ON k.key = u.key OR lower(k.key) = lower(u.key) OR (contains(u.key, '.') AND k.key = split_part(u.key, '.', 1)) GROUP BY 1, 2) SELECT key_id, use_id, CAST(confidence AS DOUBLE) AS confidence FROM p")(
    lambda s, d: (lambda x: L.config_bridge(x.select("id", F.col("name").alias("key")), x.select("id", F.expr("CASE id % 3 WHEN 0 THEN name WHEN 1 THEN upper(name) ELSE concat(name, '.x') END").alias("key"))))(Tables(s, d).symbols)
)
put("convention_tests", ", f AS (SELECT id, path FROM files), c AS (SELECT id, unnest([regexp_replace(path, '[^/]*$', '') || 'test_' || n || '.py', 'tests/test_' || n || '.py', regexp_replace(path, '[^/]*$', '') || 'tests/test_' || n || '.py']) AS path FROM (SELECT id, path, regexp_replace(split_part(path, '/', -1), '\\..*$', '') AS n FROM f)) SELECT DISTINCT c.id, f.id AS test_id FROM c JOIN f USING (path) WHERE c.id <> f.id")(lambda s, d: L.convention_tests(Tables(s, d).files.select("id", "path")))
put("relink_annotations", ", a AS (SELECT id AS note, CASE WHEN id % 3 = 0 THEN 'gone.' || name ELSE qualified END AS qualified FROM symbols), q AS (SELECT qualified, min(id) AS new_id FROM symbols GROUP BY 1) SELECT note, a.qualified, new_id FROM a LEFT JOIN q USING (qualified)")(
    lambda s, d: (lambda x: L.relink(x.select(F.col("id").alias("note"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("gone."), "name")).otherwise(F.col("qualified")).alias("qualified")), x))(Tables(s, d).symbols)
)
put("workspace_health", ", l AS (SELECT event_type AS repo, max_by(value, event_id) AS score FROM events GROUP BY 1), n AS (SELECT count(*) AS links FROM file_edges WHERE src % 3 <> dst % 3) SELECT round(avg(score), 6) AS score, count(*) AS repos, any_value(links) AS links, CASE WHEN any_value(links) > 50 THEN 'high' WHEN any_value(links) > 20 THEN 'moderate' ELSE 'low' END AS coupling FROM l, n")(
    lambda s, d: (lambda t: L.workspace_health(t.raw("events").select(F.col("event_type").alias("repo"), F.col("value").alias("score"), F.col("event_id").alias("ts")), t.file_edges.filter("src % 3 <> dst % 3")).withColumn("score", F.round("score", 6)))(Tables(s, d))
)
put("api_drift", ", b AS (SELECT DISTINCT kind AS model, list_aggregate(list_transform(string_split(base, '_'), lambda x, i: CASE WHEN i = 1 THEN x ELSE upper(x[1]) || x[2:] END), 'string_agg', '') AS field FROM (SELECT ['function', 'class', 'method', 'interface'][p_size % 4 + 1] AS kind, replace(p_name, ' ', '_') AS base FROM part WHERE p_partkey % 2 = 0)), f AS (SELECT DISTINCT ['function', 'class', 'method', 'interface'][p_size % 4 + 1] AS model, list_aggregate(list_transform(string_split(p_name, ' '), lambda x, i: CASE WHEN i = 1 THEN x ELSE upper(x[1]) || x[2:] END), 'string_agg', '') AS field FROM part WHERE p_partkey % 5 = 0) SELECT coalesce(b.model, f.model) AS model, coalesce(b.field, f.field) AS field, CASE WHEN b.field IS NULL THEN 'high' ELSE 'medium' END AS level FROM b FULL JOIN f ON b.model = f.model AND b.field = f.field WHERE (b.field IS NULL OR f.field IS NULL) AND coalesce(b.model, f.model) IN (SELECT model FROM b INTERSECT SELECT model FROM f)")(
    lambda s, d: (lambda p: L.api_drift(p.filter("p_partkey % 2 = 0").select("model", "field").distinct(), p.filter("p_partkey % 5 = 0").select("model", L.camel(F.col("field")).alias("field")).distinct()))(Tables(s, d).raw("part").select("p_partkey", F.element_at(F.array(*map(F.lit, ("function", "class", "method", "interface"))), (F.col("p_size") % 4 + 1).cast("int")).alias("model"), F.regexp_replace("p_name", " ", "_").alias("field")))
)
put("over_fetch", ", m AS (SELECT p_partkey AS model, p_size AS fields, p_partkey % 4 AS hidden, CASE WHEN p_partkey % 5 = 0 THEN p_partkey % 30 END AS exposed, p_partkey % 2 AS direct, p_partkey % 3 AS selects FROM part), l AS (SELECT model, CASE WHEN exposed IS NOT NULL AND exposed < 0.5 * fields THEN NULL WHEN fields >= 30 AND hidden = 0 AND exposed IS NULL THEN 'high' WHEN fields >= 20 AND hidden < 3 THEN CASE WHEN direct = 1 THEN 'high' ELSE 'medium' END WHEN fields >= 10 AND selects = 0 THEN 'low' END AS level FROM m) SELECT * FROM l WHERE level IS NOT NULL")(
    lambda s, d: L.over_fetch(Tables(s, d).raw("part").select(F.col("p_partkey").alias("model"), F.col("p_size").alias("fields"), (F.col("p_partkey") % 4).alias("hidden"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_partkey") % 30).alias("exposed"), (F.col("p_partkey") % 2).alias("direct"), (F.col("p_partkey") % 3).alias("selects")))
)
put("entry_protocol", " SELECT s.id, CASE WHEN regexp_matches(path, '(^|/)(routes|controllers|api)/') OR regexp_matches(name, '(?i)(route|handler|endpoint)') THEN 'HTTP' WHEN regexp_matches(name, '^(main|cli|cmd_)') THEN 'CLI' WHEN regexp_matches(name, '(?i)(on_|listen|subscribe)') THEN 'Event' WHEN regexp_matches(name, '(?i)(job|task|cron)') THEN 'Job' WHEN regexp_matches(path, '(^|/)tests?/') THEN 'Test' ELSE 'Export' END AS protocol FROM symbols s JOIN files f ON f.id = s.file_id")(
    lambda s, d: (lambda t: t.symbols.join(t.files.select(F.col("id").alias("file_id"), "path"), "file_id").select("id", L.entry_protocol(F.col("name"), F.col("path")).alias("protocol")))(Tables(s, d))
)
put("doc_staleness", ", bl AS (SELECT id // 10 AS file_id, id % 10 * 50 + 1 + k * 9 AS line, 1000000000 + (id * 7919 + k * 104729) % 40000000 AS ts FROM symbols, (SELECT unnest([0, 1, 2, 3]) AS k)), g AS (SELECT s.id, (max(CASE WHEN line > line_start + 10 THEN ts END) - max(CASE WHEN line <= line_start + 10 THEN ts END)) / 86400.0 AS drift FROM symbols s JOIN bl ON bl.file_id = s.file_id AND line BETWEEN line_start AND line_end GROUP BY 1) SELECT id, round(drift, 6) AS drift FROM g WHERE drift >= 90")(
    lambda s, d: (lambda x: L.doc_staleness(x.select("id", "file_id", F.col("line_start").alias("doc_start"), (F.col("line_start") + 10).alias("doc_end"), "line_end"), x.select("id", "file_id", F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("k")).select("file_id", (F.col("id") % 10 * 50 + 1 + F.col("k") * 9).alias("line"), (1000000000 + (F.col("id") * 7919 + F.col("k") * 104729) % 40000000).alias("ts"))).withColumn("drift", F.round("drift", 6)))(Tables(s, d).symbols)
)
put("preflight", ", dg AS (SELECT dst AS id, count(*) AS n FROM graph GROUP BY 1), x AS (SELECT s.id, greatest(CASE WHEN coalesce(n, 0) >= 10 THEN 4 WHEN coalesce(n, 0) >= 3 THEN 3 ELSE 1 END, CASE WHEN cc >= 40 THEN 5 WHEN cc >= 25 THEN 4 WHEN cc >= 15 THEN 3 ELSE 1 END, CASE WHEN s.id % 3 = 0 THEN 2 ELSE 1 END) AS l FROM symbols s LEFT JOIN dg USING (id) JOIN metrics m ON m.symbol_id = s.id) SELECT id, ['OK', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][l] AS severity FROM x")(
    lambda s, d: (lambda t: R.degrees(t.symbols, t.graph).join(t.metrics.select(F.col("symbol_id").alias("id"), "cc"), "id").select("id", C.preflight(F.col("in_degree"), F.col("cc"), F.col("id") % 3).alias("severity")))(Tables(s, d))
)


def _file_health(t: Tables):
    f = file_features(t).withColumnRenamed("complexity", "cc")
    return S.file_health(f.crossJoin(F.broadcast(f.agg(F.percentile("churn", F.lit(0.5)).alias("p50"), F.percentile("churn", F.lit(0.9)).alias("p90")))))  # one row


@query("health_score")
def health_score(spark: SparkSession, d: str) -> DataFrame:
    """The snapshot with betweenness and layers of the graph itself."""
    t = Tables(spark, d)
    return C.snapshot(t.symbols, t.graph, _file_health(t))


HEALTH = (
    SCC + FILES + ", tg AS (SELECT 100.0::DOUBLE * coalesce(sum(n) FILTER (n > 1), 0) / sum(n) AS tangle FROM (SELECT scc, count(*) AS n FROM sc GROUP BY 1)), dgs AS (SELECT id, count(*) AS d FROM (SELECT src AS id FROM graph UNION ALL SELECT dst FROM graph) GROUP BY 1 HAVING count(*) > 5 ORDER BY d DESC, id LIMIT 50), "
    "gd AS (SELECT CAST(3 * count(*) FILTER (d > 50) + 0.5 * count(*) AS DOUBLE) AS gods FROM dgs), bt AS (SELECT id, (id * 7919 % 1000) / 100.0::DOUBLE AS betweenness FROM symbols), p AS (SELECT quantile_cont(betweenness, 0.9) AS p90 FROM bt WHERE betweenness > 0), "
    "nk AS (SELECT CAST(2 * count(*) FILTER (betweenness > p90 * CASE WHEN id % 4 = 0 THEN 1.5 ELSE 1.0 END) + 0.3 * count(*) AS DOUBLE) AS necks FROM (SELECT * FROM bt WHERE betweenness > 0.5 ORDER BY betweenness DESC, id LIMIT 15), p), "
    "vi AS (SELECT CAST(count(*) AS DOUBLE) AS violations FROM graph WHERE src % 500 = 0 AND dst % 500 <> 0), q AS (SELECT quantile_cont(churn, 0.5) AS p50, quantile_cont(churn, 0.9) AS p90 FROM fx), "
    "fh AS (SELECT avg(greatest(1.0, least(10.0, 10.0 - (least(3.0, complexity / 20) + 2.0 * cyclic + CASE WHEN degree > 40 THEN 1.5 WHEN degree > 20 THEN 0.75 ELSE 0.0 END + least(1.0, dead * 0.1)) * CASE WHEN churn > p90 THEN 1.5 WHEN churn > p50 THEN 1.2 ELSE 1.0 END))) AS files FROM fx, q) "
    "SELECT round(tangle, 6) AS tangle, round(gods, 6) AS gods, round(necks, 6) AS necks, violations, round(files, 6) AS files, CAST(floor(100 * exp(0.30 * ln(greatest(exp(-tangle / 10), 1e-9)) + 0.20 * ln(greatest(exp(-gods / 5), 1e-9)) + 0.15 * ln(greatest(exp(-necks / 4), 1e-9)) + 0.15 * ln(greatest(exp(-violations / 5), 1e-9)) + 0.20 * ln(least(1.0, files / 10)))) AS INTEGER) AS score FROM tg, gd, nk, vi, fh"
)


@query("health_score_given", oracle(HEALTH, recursive=True))
def health_score_given(spark: SparkSession, d: str) -> DataFrame:
    """The snapshot with a given betweenness, layer map (every 500th symbol on layer 1) and set of utility symbols, as SQL can say it."""
    t = Tables(spark, d)
    given = t.symbols.select("id", (F.col("id") * 7919 % 1000 / 100.0).alias("betweenness"))
    layer = t.symbols.select("id", (F.col("id") % 500 == 0).cast("long").alias("layer"))
    out = C.snapshot(t.symbols, t.graph, _file_health(t), god=5, betweenness=given, layer=layer, utility=t.symbols.filter("id % 4 = 0").select("id"))
    return out.select(*[F.round(x, 6).alias(x) for x in ("tangle", "gods", "necks")], "violations", F.round("files", 6).alias("files"), "score")

put("fingerprint", None)(lambda s, d: C.fingerprint(Tables(s, d).symbols, Tables(s, d).graph))
put("partition", None)(lambda s, d: C.partition(Tables(s, d).symbols, Tables(s, d).graph, 4))
put("module_cohesion", ", x AS (SELECT fa.dir AS da, fb.dir AS db FROM graph g JOIN files fa ON fa.id = g.src // 10 JOIN files fb ON fb.id = g.dst // 10), e AS (SELECT da AS dir, CAST(da = db AS INT) AS i FROM x UNION ALL SELECT db, 0 FROM x WHERE da <> db) SELECT dir, count(*) AS edges, CAST(sum(i) AS BIGINT) AS internal, round(100.0 * avg(i), 6) AS cohesion FROM e GROUP BY 1")(
    lambda s, d: (lambda t: G.cohesion(t.graph, t.symbols.select("id", "file_id").join(t.files.select(F.col("id").alias("file_id"), F.col("dir").alias("cluster")), "file_id")).select(F.col("cluster").alias("dir"), F.col("total").alias("edges"), F.col("intra").alias("internal"), F.round(100.0 * F.col("share"), 6).alias("cohesion")))(Tables(s, d))
)
