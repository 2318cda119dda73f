"""Relational, score and series queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import ERFC_TERMS, case_style, r6
from ..operators import history as H
from ..operators import relational as R
from ..operators import scores as S
from ..operators import series as TS
from ..sources.adapters import Tables, oracle
from .registry import query


def _rounded(df, *names):
    for n in names:
        df = df.withColumn(n, r6(F.col(n)))
    return df


def put(name: str, sql: str | None, recursive: bool = False):
    return query(name, oracle(sql, recursive) if sql else None)


DEG = ", deg AS (SELECT s.id, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM symbols s LEFT JOIN (SELECT dst, count(*) AS n FROM graph GROUP BY 1) i ON i.dst = s.id LEFT JOIN (SELECT src, count(*) AS n FROM graph GROUP BY 1) o ON o.src = s.id)"


def _deg(t: Tables):
    return R.degrees(t.symbols, t.graph)


put("degrees", DEG + " SELECT * FROM deg")(lambda s, d: _deg(Tables(s, d)))
put("symbols_in_file", " SELECT s.id, name, kind, line_start, path FROM symbols s JOIN files f ON f.id = file_id WHERE file_id = 7 ORDER BY line_start")(
    lambda s, d: Tables(s, d).symbols.filter("file_id = 7").join(Tables(s, d).files.select(F.col("id").alias("file_id"), "path"), "file_id").select("id", "name", "kind", "line_start", "path")
)
put("symbol_search_topk", DEG + " SELECT s.id, name, in_degree FROM symbols s JOIN deg USING (id) WHERE name ILIKE '%widget%' ORDER BY in_degree DESC, name, s.id LIMIT 25")(
    lambda s, d: R.search_symbols(Tables(s, d).symbols, _deg(Tables(s, d)), "%widget%", 25).select("id", "name", "in_degree")
)
put("callers_of", " SELECT dst AS symbol_id, src AS neighbour_id, name, path, kind FROM (SELECT e.src, e.dst, e.kind, s.name, s.file_id FROM edges e JOIN symbols s ON s.id = e.src) x JOIN files f ON f.id = x.file_id")(
    lambda s, d: R.neighbours(Tables(s, d).edges, Tables(s, d).symbols.drop("kind"), Tables(s, d).files, of=F.lit(True), callers=True)
)
put("callees_of", " SELECT src AS symbol_id, dst AS neighbour_id, name, path, kind FROM (SELECT e.src, e.dst, e.kind, s.name, s.file_id FROM edges e JOIN symbols s ON s.id = e.dst) x JOIN files f ON f.id = x.file_id")(
    lambda s, d: R.neighbours(Tables(s, d).edges, Tables(s, d).symbols.drop("kind"), Tables(s, d).files, of=F.lit(True), callers=False)
)
for _n, _at, _other, _by in (("file_imports", "src", "dst", False), ("file_imported_by", "dst", "src", True)):
    put(_n, f" SELECT e.{_at} AS id, count(DISTINCT {_other}) AS files, CAST(sum(symbol_count) AS BIGINT) AS symbols, any_value(path) AS path FROM file_edges e JOIN files f ON f.id = e.{_at} GROUP BY 1")(
        lambda s, d, by=_by: R.file_links(Tables(s, d).file_edges, Tables(s, d).files, imported_by=by)
    )
put("top_by_degree", DEG + " SELECT id, in_degree + out_degree AS degree FROM deg ORDER BY degree DESC, id LIMIT 30")(lambda s, d: R.top(_deg(Tables(s, d)).select("id", (F.col("in_degree") + F.col("out_degree")).alias("degree")), 30, F.desc("degree"), "id"))
put("fan_symbols", DEG + " SELECT id, in_degree, out_degree, CASE WHEN in_degree >= 4 AND out_degree >= 4 THEN 'hub' WHEN in_degree >= 4 THEN 'high-in' WHEN out_degree >= 4 THEN 'high-out' ELSE '' END AS flag FROM deg WHERE in_degree + out_degree >= 3")(
    lambda s, d: _deg(Tables(s, d)).filter("in_degree + out_degree >= 3").withColumn("flag", F.when((F.col("in_degree") >= 4) & (F.col("out_degree") >= 4), "hub").when(F.col("in_degree") >= 4, "high-in").when(F.col("out_degree") >= 4, "high-out").otherwise(""))
)
put("fan_files", ", i AS (SELECT dst AS id, count(DISTINCT src) AS fan_in FROM file_edges GROUP BY 1), o AS (SELECT src AS id, count(DISTINCT dst) AS fan_out FROM file_edges GROUP BY 1) SELECT f.id, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out FROM files f LEFT JOIN i USING (id) LEFT JOIN o USING (id)")(
    lambda s, d: R.degrees(Tables(s, d).files, Tables(s, d).file_edges).withColumnsRenamed({"in_degree": "fan_in", "out_degree": "fan_out"})
)
put("unreferenced_exports", " SELECT id, name, kind FROM symbols WHERE is_exported = 1 AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.dst = symbols.id)")(lambda s, d: R.unreferenced_exports(Tables(s, d).symbols, Tables(s, d).edges).select("id", "name", "kind"))
put("clusters_summary", " SELECT cluster, count(*) AS size, string_agg(DISTINCT name, ', ' ORDER BY name) AS names FROM labelled JOIN symbols USING (id) GROUP BY 1")(lambda s, d: R.clusters_summary(Tables(s, d).labels, Tables(s, d).symbols))
put("top_churn_files", " SELECT file_id, CAST(sum(lines_added + lines_removed) AS BIGINT) AS churn FROM changes GROUP BY 1 ORDER BY churn DESC, file_id LIMIT 20")(lambda s, d: R.top(Tables(s, d).changes.groupBy("file_id").agg(F.sum(F.col("lines_added") + F.col("lines_removed")).alias("churn")), 20, F.desc("churn"), "file_id"))
put("change_log", " SELECT c.id AS commit_id, author, ts, lines_added FROM changes JOIN commits c ON c.id = commit_id WHERE file_id = 11")(lambda s, d: Tables(s, d).changes.filter("file_id = 11").join(Tables(s, d).commits.withColumnRenamed("id", "commit_id"), "commit_id").select("commit_id", "author", "ts", "lines_added"))
put("top_dir_counts", " SELECT split_part(path, '/', 1) AS top, count(*) AS files, CAST(sum(line_count) AS BIGINT) AS lines FROM paths GROUP BY 1")(lambda s, d: Tables(s, d).paths.groupBy(F.substring_index("path", "/", 1).alias("top")).agg(F.count(F.lit(1)).alias("files"), F.sum("line_count").alias("lines")))
put("files_by_language", " SELECT language, count(*) AS files FROM paths GROUP BY 1")(lambda s, d: Tables(s, d).paths.groupBy("language").agg(F.count(F.lit(1)).alias("files")))
put("symbols_in_dir", " SELECT s.id, name, path FROM symbols s JOIN files f ON f.id = file_id WHERE starts_with(path, 'src/m3/')")(lambda s, d: Tables(s, d).files.filter(F.col("path").startswith("src/m3/")).select(F.col("id").alias("file_id"), "path").join(Tables(s, d).symbols, "file_id").select("id", "name", "path"))
put("enclosing_span", ", pts AS (SELECT id AS file_id, id * 37 % 500 AS line FROM files) SELECT file_id, line, id, name FROM (SELECT p.file_id, line, s.id, name, row_number() OVER (PARTITION BY p.file_id, line ORDER BY line_end - line_start, s.id) AS n FROM pts p JOIN symbols s ON s.file_id = p.file_id AND line BETWEEN line_start AND line_end) WHERE n = 1")(
    lambda s, d: R.enclosing(Tables(s, d).files.select(F.col("id").alias("file_id"), (F.col("id") * 37 % 500).alias("line")), Tables(s, d).symbols.select("file_id", "id", "name", "line_start", "line_end")).select("file_id", "line", "id", "name")
)
put(
    "resolve_symbol",
    DEG + ", refs AS (SELECT DISTINCT CASE WHEN id % 3 = 0 THEN qualified WHEN id % 3 = 1 THEN name ELSE upper(name) END AS ref FROM symbols), c AS (SELECT ref, id, 1 AS p FROM refs JOIN symbols ON qualified = ref UNION ALL SELECT ref, id, 2 FROM refs JOIN symbols ON name = ref UNION ALL SELECT ref, id, 3 FROM refs JOIN symbols ON lower(name) = lower(ref)) "
    "SELECT ref, id, CAST(p AS INTEGER) AS priority FROM (SELECT ref, c.id, p, row_number() OVER (PARTITION BY ref ORDER BY p, in_degree DESC, c.id) AS n FROM c JOIN deg USING (id)) WHERE n = 1",
)(lambda s, d: R.resolve(Tables(s, d).symbols.select(F.when(F.col("id") % 3 == 0, F.col("qualified")).when(F.col("id") % 3 == 1, F.col("name")).otherwise(F.upper("name")).alias("ref")).distinct(), Tables(s, d).symbols, _deg(Tables(s, d))))
put("mutual_edge_members", " SELECT DISTINCT a.src AS id FROM graph a JOIN graph b ON a.src = b.dst AND a.dst = b.src")(lambda s, d: R.mutual(Tables(s, d).graph))
put("key_abstractions", DEG + " SELECT id, name, kind, in_degree FROM symbols JOIN deg USING (id) WHERE is_exported = 1 AND kind IN ('class', 'interface', 'function') ORDER BY in_degree DESC, id LIMIT 15")(
    lambda s, d: R.top(Tables(s, d).symbols.filter((F.col("is_exported") == 1) & F.col("kind").isin("class", "interface", "function")).join(_deg(Tables(s, d)), "id").select("id", "name", "kind", "in_degree"), 15, F.desc("in_degree"), "id")
)
put("entry_files", ", n AS (SELECT file_id AS id, count(*) AS symbols FROM symbols GROUP BY 1) SELECT f.id, path, n.symbols FROM files f JOIN n USING (id) WHERE NOT EXISTS (SELECT 1 FROM file_edges e WHERE e.dst = f.id)")(lambda s, d: R.entry_files(Tables(s, d).files, Tables(s, d).symbols, Tables(s, d).file_edges))
put("role_classes", DEG + " SELECT id, CASE WHEN in_degree >= 3 AND out_degree >= 3 THEN 'hub' WHEN in_degree >= 4 THEN 'core_utility' WHEN out_degree >= 4 THEN 'orchestrator' WHEN in_degree >= 2 AND out_degree = 0 THEN 'utility' WHEN in_degree = 0 AND out_degree = 0 THEN 'leaf' ELSE 'internal' END AS role FROM deg")(
    lambda s, d: _deg(Tables(s, d)).select("id", R.role(F.col("in_degree"), F.col("out_degree"), F.col("out_degree")).alias("role"))
)
put("case_styles", " SELECT kind, CASE WHEN regexp_full_match(name, '[A-Z][A-Z0-9_]+') THEN 'UPPER' WHEN regexp_full_match(name, '[a-z][a-z0-9]*(_[a-z0-9]+)+') THEN 'snake' WHEN regexp_full_match(name, '[a-z][a-z0-9]*([A-Z][a-z0-9]*)+') THEN 'camel' WHEN regexp_full_match(name, '[A-Z][a-zA-Z0-9]*[a-z][a-zA-Z0-9]*') THEN 'pascal' ELSE 'other' END AS style, count(*) AS n FROM symbols GROUP BY 1, 2")(
    lambda s, d: Tables(s, d).symbols.groupBy("kind", case_style(F.col("name")).alias("style")).agg(F.count(F.lit(1)).alias("n"))
)
put("affixes", ", p AS (SELECT regexp_extract(name, '^([a-z]+)_', 1) AS prefix FROM symbols) SELECT prefix, count(*) AS n FROM p WHERE prefix <> '' GROUP BY 1 HAVING count(*) >= greatest(5, 0.03::DOUBLE * (SELECT count(*) FROM symbols))")(
    lambda s, d: (lambda t: t.symbols.select(F.regexp_extract("name", "^([a-z]+)_", 1).alias("prefix")).filter("prefix <> ''").groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(t.symbols.agg(F.count(F.lit(1)).alias("all")))).filter(F.col("n") >= F.greatest(F.lit(5.0), 0.03 * F.col("all"))).select("prefix", "n"))(Tables(s, d))
)

CHURN = ", st AS (SELECT file_id, CAST(sum(lines_added + lines_removed) AS BIGINT) AS total_churn FROM changes GROUP BY 1)"
put(
    "weather_hotspots",
    CHURN + ", cx AS (SELECT id AS file_id, line_count AS complexity FROM paths), t AS (SELECT * FROM (SELECT * FROM st ORDER BY total_churn DESC, file_id LIMIT 40) JOIN cx USING (file_id)), q AS (SELECT greatest(list_sort(list(total_churn))[least(CAST(floor(count(*) * 0.75) AS INT), count(*) - 1) + 1], 1) AS pc, greatest(list_sort(list(complexity))[least(CAST(floor(count(*) * 0.75) AS INT), count(*) - 1) + 1], 1) AS px FROM t) "
    "SELECT file_id, total_churn, complexity, round(sqrt(total_churn / pc * (complexity / px)), 6) AS score, CASE WHEN total_churn >= pc AND complexity >= px THEN 'BOTH' WHEN total_churn >= pc THEN 'HIGH-CHURN' WHEN complexity >= px THEN 'HIGH-COMPLEXITY' ELSE '' END AS reason FROM t, q ORDER BY sqrt(total_churn / pc * (complexity / px)) DESC, file_id LIMIT 20",
)(lambda s, d: _rounded(S.weather(H.file_stats(Tables(s, d).changes, Tables(s, d).commits), Tables(s, d).paths.select(F.col("id").alias("file_id"), F.col("line_count").alias("complexity"))), "score"))

FILES = CHURN + (
    ", m AS (SELECT file_id, CAST(sum(cc) AS BIGINT) AS complexity, max(nesting) AS nesting, CAST(sum(line_count) AS BIGINT) AS loc FROM metrics JOIN symbols ON id = symbol_id GROUP BY 1), dg AS (SELECT id AS file_id, count(*) AS degree FROM (SELECT src // 10 AS id FROM graph UNION ALL SELECT dst // 10 FROM graph) GROUP BY 1), "
    "dd AS (SELECT file_id, count(*) AS dead FROM symbols WHERE is_exported = 1 AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.dst = symbols.id) GROUP BY 1), sz AS (SELECT file_id, count(*) AS symbols FROM symbols GROUP BY 1), ch AS (SELECT file_id // 10 AS file_id, CAST(sum(total_churn) AS BIGINT) AS churn FROM st GROUP BY 1), "
    "mu AS (SELECT DISTINCT a.src // 10 AS file_id FROM graph a JOIN graph b ON a.src = b.dst AND a.dst = b.src), "
    "fx AS (SELECT m.file_id, complexity, nesting, loc, coalesce(degree, 0) AS degree, coalesce(dead, 0) AS dead, symbols, coalesce(churn, 0) AS churn, CAST(mu.file_id IS NOT NULL AS INTEGER) AS cyclic FROM m LEFT JOIN dg USING (file_id) LEFT JOIN dd USING (file_id) JOIN sz USING (file_id) LEFT JOIN ch USING (file_id) LEFT JOIN mu USING (file_id))"
)


def file_features(t: Tables):
    """(file_id, complexity, nesting, loc, degree, dead, symbols, churn, cyclic): one pre-aggregated row per file."""
    st = t.changes.groupBy(F.expr("file_id div 10").alias("file_id")).agg(F.sum(F.col("lines_added") + F.col("lines_removed")).alias("churn"))
    sy = t.symbols.select(F.col("id").alias("symbol_id"), "file_id", "is_exported")
    m = t.metrics.join(sy, "symbol_id").groupBy("file_id").agg(F.sum("cc").alias("complexity"), F.max("nesting").alias("nesting"), F.sum("line_count").alias("loc"), F.count(F.lit(1)).alias("symbols"))
    dg = t.graph.select(F.explode(F.array(F.expr("src div 10"), F.expr("dst div 10"))).alias("file_id")).groupBy("file_id").agg(F.count(F.lit(1)).alias("degree"))
    dd = R.unreferenced_exports(t.symbols, t.edges).groupBy("file_id").agg(F.count(F.lit(1)).alias("dead"))
    mu = R.mutual(t.graph).select(F.expr("id div 10").alias("file_id"), F.lit(1).alias("cyclic")).distinct()
    d = m.join(dg, "file_id", "left").join(dd, "file_id", "left").join(st, "file_id", "left").join(mu, "file_id", "left")
    return d.fillna(0, ["degree", "dead", "churn", "cyclic"])


DEBT = FILES + (
    ", r AS (SELECT *, (rank() OVER (ORDER BY churn) - 1) / count(*) OVER () AS pctile, greatest(max(complexity) OVER (), 1) AS most FROM fx), db AS (SELECT file_id, 0.4 * complexity / most + 0.3 * cyclic + 0.2 * CAST(degree > 40 AS INT) + 0.1 * CAST(dead > 0 AS INT) AS penalty, greatest(1.0, 3 * pctile) AS hotspot, "
    "30 * CAST(complexity > 0.5 * most AS INT) + 120 * cyclic + 240 * CAST(degree > 40 AS INT) + 10 * dead AS minutes FROM r)"
)
put("debt_scores", DEBT + " SELECT file_id, round(penalty, 6) AS penalty, round(hotspot, 6) AS hotspot, round(penalty * hotspot, 6) AS debt, CAST(minutes AS BIGINT) AS minutes FROM db")(lambda s, d: _rounded(S.debt(file_features(Tables(s, d))), "penalty", "hotspot", "debt"))
put("debt_by_dir", DEBT + " SELECT dir, count(*) AS files, round(sum(penalty * hotspot), 5) AS debt, CAST(sum(minutes) AS BIGINT) AS minutes FROM db JOIN files f ON f.id = file_id GROUP BY 1")(lambda s, d: S.debt_by_dir(S.debt(file_features(Tables(s, d))), Tables(s, d).files).withColumn("debt", F.round("debt", 5)))
put(
    "file_health",
    FILES + ", q AS (SELECT quantile_cont(churn, 0.5) AS p50, quantile_cont(churn, 0.9) AS p90 FROM fx) SELECT file_id, round(greatest(1.0, least(10.0, 10.0 - (least(3.0, complexity / 20) + 2.0 * cyclic + CASE WHEN degree > 40 THEN 1.5 WHEN degree > 20 THEN 0.75 ELSE 0.0 END + least(1.0, dead * 0.1)) * CASE WHEN churn > p90 THEN 1.5 WHEN churn > p50 THEN 1.2 ELSE 1.0 END)), 6) AS health FROM fx, q",
)(lambda s, d: (lambda f: _rounded(S.file_health(f.withColumnRenamed("complexity", "cc").crossJoin(F.broadcast(f.agg(F.percentile("churn", F.lit(0.5)).alias("p50"), F.percentile("churn", F.lit(0.9)).alias("p90"))))), "health"))(file_features(Tables(s, d))))
put("cognitive_load", FILES + " SELECT file_id, round(100 * (0.30 * least(1.0, complexity / 50) + 0.15 * least(1.0, nesting / 6) + 0.20 * least(1.0, degree / 40) + 0.15 * 0.5 + 0.10 * least(1.0, dead / symbols) + 0.10 * least(1.0, loc / 500)), 6) AS load FROM fx")(
    lambda s, d: _rounded(S.cognitive_load(file_features(Tables(s, d)).withColumnRenamed("complexity", "cc").withColumn("entropy", F.lit(0.5)).withColumn("dead_share", F.col("dead") / F.col("symbols"))), "load")
)
put(
    "diagnose_risk",
    FILES + ", h AS (SELECT *, 10.0 - least(9.0, complexity / 40) AS health, dead / symbols AS entropy FROM fx), mm AS (SELECT avg(churn) a, stddev_pop(churn) b, avg(complexity) c, stddev_pop(complexity) e, avg(health) g, stddev_pop(health) i, avg(entropy) j, stddev_pop(entropy) k FROM h) "
    "SELECT file_id, round(0.30 * least(greatest((churn - a) / greatest(b, 0.01) / 3, 0), 1) + 0.30 * least(greatest((complexity - c) / greatest(e, 0.01) / 3, 0), 1) + 0.25 * least(greatest((g - health) / greatest(i, 0.01) / 3, 0), 1) + 0.15 * least(greatest((entropy - j) / greatest(k, 0.01) / 3, 0), 1), 6) AS risk FROM h, mm",
)(lambda s, d: _rounded(S.diagnose(file_features(Tables(s, d)).withColumnRenamed("complexity", "cc").withColumn("health", 10.0 - F.least(F.lit(9.0), F.col("cc") / 40)).withColumn("entropy", F.col("dead") / F.col("symbols"))), "risk"))
put("breaking_risk", ", g AS (SELECT dst AS id, count(*) AS callers, count(DISTINCT file_id) AS files FROM graph JOIN symbols s ON s.id = src GROUP BY 1) SELECT id, callers, files, callers * greatest(files, 1) AS risk, CASE WHEN callers * files >= 50 THEN 'critical' WHEN callers * files >= 20 THEN 'high' WHEN callers * files >= 5 THEN 'medium' ELSE 'low' END AS level FROM g")(lambda s, d: S.breaking_risk(Tables(s, d).edges, Tables(s, d).symbols))
put("bumpy_road", " SELECT file_id, count(*) AS functions, CAST(sum(cc) AS BIGINT) AS cc, max(cc) AS most FROM metrics JOIN symbols ON id = symbol_id WHERE cc >= 30 GROUP BY 1 HAVING count(*) >= 3")(lambda s, d: S.bumpy_road(Tables(s, d).metrics, Tables(s, d).symbols, cc=30))
put("complexity_list", " SELECT symbol_id, cc, CASE WHEN cc >= 25 THEN 'critical' WHEN cc >= 15 THEN 'high' WHEN cc >= 8 THEN 'medium' ELSE 'low' END AS severity FROM metrics")(lambda s, d: Tables(s, d).metrics.select("symbol_id", "cc", S.severity(F.col("cc")).alias("severity")))
put("complexity_by_file", " SELECT file_id, count(*) AS symbols, max(cc) AS most, round(avg(cc), 6) AS mean FROM metrics JOIN symbols ON id = symbol_id GROUP BY 1")(
    lambda s, d: _rounded(Tables(s, d).metrics.join(Tables(s, d).symbols.select(F.col("id").alias("symbol_id"), "file_id"), "symbol_id").groupBy("file_id").agg(F.count(F.lit(1)).alias("symbols"), F.max("cc").alias("most"), F.avg("cc").alias("mean")), "mean")
)
put("gini", CHURN + ", r AS (SELECT total_churn AS v, row_number() OVER (ORDER BY total_churn) AS i FROM st) SELECT round((2 * sum(i * v) - (count(*) + 1) * sum(v)) / CAST(count(*) * sum(v) AS DOUBLE), 6) AS gini FROM r")(lambda s, d: _rounded(S.gini(H.file_stats(Tables(s, d).changes, Tables(s, d).commits), "total_churn"), "gini"))
put("dead_action", ", imp AS (SELECT DISTINCT dst AS file_id FROM file_edges) SELECT s.id, CASE WHEN regexp_matches(name, '^(get_|main$|test)') THEN 'INTENTIONAL' WHEN imp.file_id IS NULL THEN 'SAFE' WHEN kind IN ('class', 'interface') THEN 'REVIEW' ELSE 'SAFE' END AS verdict, CASE WHEN regexp_matches(name, '^(get_|main$|test)') THEN 60 WHEN imp.file_id IS NULL THEN 90 WHEN kind IN ('class', 'interface') THEN 50 ELSE 75 END AS confidence FROM symbols s LEFT JOIN imp USING (file_id) WHERE is_exported = 1 AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.dst = s.id)")(
    lambda s, d: (lambda t: S.dead_action(R.unreferenced_exports(t.symbols, t.edges).join(t.file_edges.select(F.col("dst").alias("file_id"), F.lit(1).alias("imported")).distinct(), "file_id", "left").fillna(0, ["imported"])))(Tables(s, d))
)
put("dead_decay", ", last AS (SELECT file_id AS id, max(ts) AS ts, sum(lines_added) AS churn FROM changes JOIN commits c ON c.id = commit_id GROUP BY 1), x AS (SELECT id, 40 * least(greatest(((SELECT max(ts) FROM commits) - ts) / 86400.0 / 365, 0), 1) + 20 * CAST(id % 4 = 0 AS INT) + 15 * (1 - least(churn / 100, 1)) + 15 * least(line_count / 100, 1) + 10 * CAST(id % 2 = 0 AS INT) AS score FROM last JOIN paths USING (id)) SELECT id, CAST(floor(score) AS INTEGER) AS decay, CASE WHEN score >= 75 THEN 'fossil' WHEN score >= 50 THEN 'decayed' WHEN score >= 25 THEN 'stale' ELSE 'fresh' END AS tier FROM x")(
    lambda s, d: (lambda t: S.dead_decay(t.changes.join(t.commits.select(F.col("id").alias("commit_id"), "ts"), "commit_id").groupBy(F.col("file_id").alias("id")).agg(F.max("ts").alias("ts"), F.sum("lines_added").alias("churn")).join(t.paths, "id").crossJoin(F.broadcast(t.commits.agg(F.max("ts").alias("now")))).select("id", ((F.col("now") - F.col("ts")) / 86400).alias("age_days"), (F.col("id") % 4 == 0).cast("int").alias("author_gone"), "churn", F.col("line_count").alias("lines"), (F.col("id") % 2).alias("imported"))))(Tables(s, d))
)
put("trace_stats", " SELECT name, count(*) AS calls, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.99), 6) AS p99, round(avg(error), 6) AS error_rate FROM spans GROUP BY 1")(
    lambda s, d: _rounded(Tables(s, d).spans.groupBy("name").agg(F.count(F.lit(1)).alias("calls"), F.percentile("ms", F.lit(0.5)).alias("p50"), F.percentile("ms", F.lit(0.99)).alias("p99"), F.avg("error").alias("error_rate")), "p50", "p99", "error_rate")
)
put("trace_upsert_latest", " SELECT name, event_type, max_by(ms, (ts, span_id)) AS ms, max(ts) AS ts FROM spans GROUP BY 1, 2")(lambda s, d: Tables(s, d).spans.groupBy("name", "event_type").agg(F.max_by("ms", F.struct("ts", "span_id")).alias("ms"), F.max("ts").alias("ts")))
put(
    "runtime_hotspots",
    ", rt AS (SELECT name, count(*) * quantile_cont(ms, 0.5) AS load FROM spans GROUP BY 1), sc AS (SELECT 'op_' || (id % 40) AS name, CAST(sum(line_count) AS BIGINT) AS static_score FROM paths GROUP BY 1), j AS (SELECT name, row_number() OVER (ORDER BY load DESC, name) AS runtime_rank, row_number() OVER (ORDER BY static_score DESC, name) AS static_rank, count(*) OVER () AS n FROM rt JOIN sc USING (name)) "
    "SELECT name, CAST(runtime_rank AS INTEGER) AS runtime_rank, CAST(static_rank AS INTEGER) AS static_rank, CASE WHEN runtime_rank <= greatest(1, n * 0.3::DOUBLE) AND static_rank <= greatest(1, n * 0.3::DOUBLE) THEN 'CONFIRMED' WHEN runtime_rank <= greatest(1, n * 0.3::DOUBLE) THEN 'UPGRADE' WHEN static_rank <= greatest(1, n * 0.3::DOUBLE) THEN 'DOWNGRADE' ELSE 'COLD' END AS verdict FROM j",
)(lambda s, d: S.runtime_hotspots(Tables(s, d).spans.groupBy("name").agg((F.count(F.lit(1)) * F.percentile("ms", F.lit(0.5))).alias("load")), Tables(s, d).paths.groupBy(F.concat(F.lit("op_"), F.col("id") % 40).alias("name")).agg(F.sum("line_count").alias("static_score"))))
put("pr_risk_score", FILES + ", f AS (SELECT file_id, least(1.0, churn / 20000) * 0.3 AS a, least(1.0, degree / 40) * 0.4 AS b, least(1.0, complexity / 500) * 0.3 AS c FROM fx) SELECT file_id, round(100 * (1 - (1 - a) * (1 - b) * (1 - c)), 6) AS risk FROM f")(
    lambda s, d: file_features(Tables(s, d)).select("file_id", r6(H.risk_of([F.least(F.lit(1.0), F.col("churn") / 20000) * 0.3, F.least(F.lit(1.0), F.col("degree") / 40) * 0.4, F.least(F.lit(1.0), F.col("complexity") / 500) * 0.3])).alias("risk"))
)
put("symbol_risk", DEG + ", mx AS (SELECT greatest(max(in_degree + out_degree), 1) AS m FROM deg) SELECT id, round((in_degree + out_degree) / m * 5 * CASE WHEN name ILIKE '%bolt%' THEN 2.0 WHEN name ILIKE '%ring%' THEN 1.5 ELSE 1.0 END, 6) AS risk FROM deg JOIN symbols USING (id), mx")(
    lambda s, d: (lambda t, g: g.join(t.symbols, "id").crossJoin(F.broadcast(g.agg(F.greatest(F.max(F.col("in_degree") + F.col("out_degree")), F.lit(1)).alias("m")))).select("id", r6((F.col("in_degree") + F.col("out_degree")) / F.col("m") * 5 * F.when(F.col("name").ilike("%bolt%"), 2.0).when(F.col("name").ilike("%ring%"), 1.5).otherwise(1.0)).alias("risk")))(Tables(s, d), _deg(Tables(s, d)))
)

# series
MAD = ", m AS (SELECT series, median(value) AS med, count(*) AS n FROM series GROUP BY 1), dv AS (SELECT s.*, m.med, m.n, abs(value - med) AS dev FROM series s JOIN m USING (series)), md AS (SELECT series, median(dev) AS mad FROM dv GROUP BY 1)"
put("modified_z", MAD + ", z AS (SELECT series, idx, value, CASE WHEN mad > 0 THEN 0.6745 * (value - med) / mad WHEN value = med THEN 0 ELSE sign(value - med) * 'inf'::DOUBLE END AS z FROM dv JOIN md USING (series) WHERE n >= 5) SELECT series, idx, value, round(z, 6) AS z, CAST(abs(z) > 3.5 AS INTEGER) AS anomaly FROM z")(lambda s, d: _rounded(TS.modified_z(Tables(s, d).series), "z"))
SLOPE = ", sl AS (SELECT a.series, median((b.value - a.value) / (b.idx - a.idx)) AS slope FROM series a JOIN series b ON a.series = b.series AND a.idx < b.idx GROUP BY 1)"
put("theil_sen", SLOPE + " SELECT series, round(any_value(slope), 6) AS slope, round(median(value - slope * idx), 6) AS intercept, count(*) AS n, CASE WHEN any_value(slope) > 0.01 THEN 'increasing' WHEN any_value(slope) < -0.01 THEN 'decreasing' ELSE 'stable' END AS direction FROM series JOIN sl USING (series) GROUP BY 1 HAVING count(*) >= 4")(lambda s, d: _rounded(TS.theil_sen(Tables(s, d).series), "slope", "intercept"))
MK = ", ss AS (SELECT a.series, CAST(sum(sign(b.value - a.value)) AS BIGINT) AS s FROM series a JOIN series b ON a.series = b.series AND a.idx < b.idx GROUP BY 1), nn AS (SELECT series, count(*) AS n FROM series GROUP BY 1), ti AS (SELECT series, sum(t * (t - 1) * (2 * t + 5)) AS tied FROM (SELECT series, value, count(*) AS t FROM series GROUP BY 1, 2) GROUP BY 1)"
put("mann_kendall_s", MK + ", v AS (SELECT series, n, s, (n * (n - 1) * (2 * n + 5) - tied) / 18.0 AS var FROM ss JOIN nn USING (series) JOIN ti USING (series)) SELECT series, n, s, round(CASE WHEN var <= 0 OR s = 0 THEN 0 WHEN s > 0 THEN (s - 1) / sqrt(var) ELSE (s + 1) / sqrt(var) END, 6) AS z FROM v WHERE n >= 8")(lambda s, d: _rounded(TS.mann_kendall(Tables(s, d).series).drop("p", "trend"), "z"))
_T = "(1.0 / (1.0 + abs(z) / sqrt(2.0) / 2))"


def _erfc_sql() -> str:
    poly = repr(ERFC_TERMS[-1])
    for a in reversed(ERFC_TERMS[1:-1]):
        poly = f"({a!r} + {_T} * {poly})"
    return f"{_T} * exp(-(z * z / 2.0) - ({ERFC_TERMS[0]!r}) - {_T} * {poly})".replace("- (-", "+ (")


put(
    "mann_kendall_p",
    MK + ", v AS (SELECT series, n, s, n * (n - 1) * (2 * n + 5) / 18.0 AS var FROM ss JOIN nn USING (series)), z AS (SELECT series, n, s, CASE WHEN var <= 0 OR s = 0 THEN 0.0 WHEN s > 0 THEN (s - 1) / sqrt(var) ELSE (s + 1) / sqrt(var) END::DOUBLE AS z FROM v WHERE n >= 8), p AS (SELECT *, " + _erfc_sql() + " AS p FROM z) SELECT series, n, s, round(z, 6) AS z, round(p, 6) AS p, CAST(p < 0.10 AS INTEGER) AS trend FROM p",
)(lambda s, d: _rounded(TS.mann_kendall(Tables(s, d).series, ties=False, alpha=0.10), "z", "p"))
U = MAD + ", u AS (SELECT series, idx, value, (value - med) / greatest(mad * 1.4826, 1e-9) AS u FROM dv JOIN md USING (series))"


def _last(k: int) -> str:
    return f"OVER (PARTITION BY series ORDER BY idx ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


WE = U + (
    ", st AS (SELECT *, sign(value - lag(value) OVER (PARTITION BY series ORDER BY idx)) AS step FROM u), tu AS (SELECT *, CAST(step * lag(step) OVER (PARTITION BY series ORDER BY idx) < 0 AS INT) AS turn FROM st), h AS (SELECT series, idx, "
    f"abs(u) > 3 AS r1, count(*) {_last(3)} = 3 AND (sum(CAST(u > 2 AS INT)) {_last(3)} >= 2 OR sum(CAST(u < -2 AS INT)) {_last(3)} >= 2) AS r2, count(*) {_last(5)} = 5 AND (sum(CAST(u > 1 AS INT)) {_last(5)} >= 4 OR sum(CAST(u < -1 AS INT)) {_last(5)} >= 4) AS r3, "
    f"count(*) {_last(8)} = 8 AND (sum(CAST(u > 0 AS INT)) {_last(8)} = 8 OR sum(CAST(u < 0 AS INT)) {_last(8)} = 8) AS r4, count(*) {_last(6)} = 6 AND (sum(CAST(step > 0 AS INT)) {_last(5)} = 5 OR sum(CAST(step < 0 AS INT)) {_last(5)} = 5) AS r5, "
    f"count(*) {_last(14)} = 14 AND sum(turn) {_last(12)} = 12 AS r6 FROM tu) SELECT series, idx, unnest(list_filter([CASE WHEN r1 THEN 1 END, CASE WHEN r2 THEN 2 END, CASE WHEN r3 THEN 3 END, CASE WHEN r4 THEN 4 END, CASE WHEN r5 THEN 5 END, CASE WHEN r6 THEN 6 END], lambda x: x IS NOT NULL)) AS rule FROM h"
)
put("western_electric", WE)(lambda s, d: TS.western_electric(Tables(s, d).series))
put("we_rule1", MAD + " SELECT series, idx, 1 AS rule FROM dv JOIN md USING (series) WHERE abs((value - med) / greatest(mad * 1.4826, 1e-9)) > 3")(lambda s, d: TS.western_electric(Tables(s, d).series).filter("rule = 1"))
put("we_rule2", MAD + ", u AS (SELECT series, idx, (value - med) / greatest(mad * 1.4826, 1e-9) AS u FROM dv JOIN md USING (series)), w AS (SELECT series, idx, count(*) OVER x AS n, sum(CAST(u > 2 AS INT)) OVER x AS hi, sum(CAST(u < -2 AS INT)) OVER x AS lo FROM u WINDOW x AS (PARTITION BY series ORDER BY idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) SELECT series, idx, 2 AS rule FROM w WHERE n = 3 AND (hi >= 2 OR lo >= 2)")(lambda s, d: TS.western_electric(Tables(s, d).series).filter("rule = 2"))
put(
    "cusum",
    U + ", n AS (SELECT series, idx, u, row_number() OVER (PARTITION BY series ORDER BY idx) AS k FROM u), f AS (SELECT series, CAST(0 AS BIGINT) AS k, 0.0::DOUBLE AS hi, 0.0::DOUBLE AS lo, CAST(NULL AS BIGINT) AS idx, 0 AS side FROM (SELECT DISTINCT series FROM n) UNION ALL SELECT series, k, CASE WHEN hi > 2 OR lo > 2 THEN 0 ELSE hi END, CASE WHEN hi > 2 OR lo > 2 THEN 0 ELSE lo END, idx, CASE WHEN hi > 2 THEN 1 WHEN lo > 2 THEN -1 ELSE 0 END FROM (SELECT f.series, n.k, greatest(0.0, hi + u - 0.25) AS hi, greatest(0.0, lo - u - 0.25) AS lo, n.idx FROM f JOIN n ON n.series = f.series AND n.k = f.k + 1)) SELECT series, idx, side FROM f WHERE side <> 0",
    recursive=True,
)(lambda s, d: TS.cusum(Tables(s, d).series, 0.25, 2.0))
put("lag_deltas", ", l AS (SELECT series, idx, value, value - lag(value) OVER (PARTITION BY series ORDER BY idx) AS delta FROM series) SELECT *, CASE WHEN delta > 0 THEN 'up' WHEN delta < 0 THEN 'down' ELSE 'flat' END AS direction FROM l WHERE delta IS NOT NULL")(lambda s, d: TS.lag_deltas(Tables(s, d).series))
put("rate_of_change", ", l AS (SELECT series, idx, value, lag(value) OVER (PARTITION BY series ORDER BY idx) AS b FROM series) SELECT series, idx, round((value - b) / abs(b), 6) AS rate FROM l WHERE b <> 0 AND abs((value - b) / abs(b)) >= 0.2")(lambda s, d: _rounded(TS.rate_of_change(Tables(s, d).series), "rate"))
put("trend_rule", " SELECT series, idx, value, round(avg(value) OVER (PARTITION BY series ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS mean FROM series")(lambda s, d: _rounded(TS.moving_average(Tables(s, d).series), "mean"))
put("forecast_steps", SLOPE + ", la AS (SELECT series, max_by(value, idx) AS value FROM series GROUP BY 1) SELECT series, value, CASE WHEN slope <> 0 AND (500 - value) / slope >= 0 THEN CAST(ceil((500 - value) / slope) AS BIGINT) END AS steps FROM la JOIN sl USING (series)")(lambda s, d: TS.forecast_steps(TS.theil_sen(Tables(s, d).series), TS.latest(Tables(s, d).series), 500.0))
put("digest", ", l AS (SELECT series, idx, value, lag(value) OVER (PARTITION BY series ORDER BY idx) AS before, row_number() OVER (PARTITION BY series ORDER BY idx DESC) AS n FROM series) SELECT series, value, before, value - before AS delta FROM l WHERE n = 1")(lambda s, d: TS.digest(Tables(s, d).series))
put("metric_delta", ", b AS (SELECT series AS metric, value AS base FROM series WHERE idx = 3), h AS (SELECT series AS metric, value AS head FROM series WHERE idx = 20) SELECT metric, base, head, head - base AS delta, round(100 * (head - base) / abs(base), 6) AS pct, CASE WHEN (head - base) * CASE metric WHEN 'error' THEN -1 ELSE 1 END > 0 THEN 'improved' WHEN head = base THEN 'unchanged' ELSE 'degraded' END AS change FROM b JOIN h USING (metric)")(
    lambda s, d: _rounded(S.metric_delta(Tables(s, d).series.filter("idx = 3").select(F.col("series").alias("metric"), "value"), Tables(s, d).series.filter("idx = 20").select(F.col("series").alias("metric"), "value"), {"error": -1, "view": 1, "click": 1, "signup": 1, "purchase": 1}), "pct")
)
