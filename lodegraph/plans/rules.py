"""Detector, governance, what-if, text and link queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import r6
from ..operators import detect as D
from ..operators import relational as R
from ..operators import scores as S
from ..operators import text as T
from ..operators import whatif as W
from ..sources.adapters import Tables
from .code import put

CAND = ", memo AS (SELECT DISTINCT src AS id FROM edges WHERE dst % 10 = 0), cand AS (SELECT s.id, s.name, g.*, cc, CAST(s.id IN (SELECT id FROM memo) AS BOOLEAN) AS memo FROM symbols s JOIN signals g ON g.symbol_id = s.id JOIN metrics m ON m.symbol_id = s.id JOIN files f ON f.id = s.file_id WHERE is_test = 0)"


def _n(*parts: str) -> str:
    return "(" + " OR ".join(f"name ILIKE '%{p}%'" for p in parts) + ")"


def _h(*names: str) -> str:
    return "list_has_any(calls, [" + ", ".join(f"'{x}'" for x in names) + "])"


#: The detectors' conditions and confidences in SQL.
SQL = {
    "sorting": (f"{_n('sort')} AND nested = 1", "CASE WHEN subscript = 1 THEN 'high' ELSE 'medium' END"),
    "search-sorted": (f"{_n('search_sorted', 'searchsorted', 'find_sorted', 'findsorted', 'in_sorted', 'linear_search', 'linearsearch')} AND compares = 1 AND loop_depth >= 1", "'low'"),
    "membership": (f"{_n('contain', 'member', 'exist', 'has_', 'in_', 'check', 'includes')} AND compares = 1 AND loop_depth >= 1", "'medium'"),
    "string-concat": ("concat = 1 AND loop_depth >= 1", f"CASE WHEN {_h('add')} THEN 'high' ELSE 'medium' END"),
    "unique": (f"{_n('unique', 'dedup', 'distinct', 'remove_dup', 'removedup')} AND nested = 1 AND NOT {_h('add')}", "'medium'"),
    "max-min": (f"{_n('find_max', 'find_min', 'findmax', 'findmin', 'get_max', 'get_min', 'getmax', 'getmin', 'find_largest', 'find_smallest', 'findlargest', 'findsmallest')} AND compares = 1", "'low'"),
    "accumulation": (f"{_n('sum', 'total', 'accumulate')} AND accumulates = 1", "'low'"),
    "fibonacci": (f"{_n('fib')} AND self_calls >= 2 AND NOT memo", "'high'"),
    "nested-lookup": (f"nested = 1 AND compares = 1 AND cc >= 8 AND NOT {_n('grid', 'matrix')}", "'medium'"),
    "groupby": (f"{_n('group', 'bucket', 'partition', 'categorize', 'classify', 'bin_by', 'key_by', 'index_by')} AND loop_depth >= 1", "'low'"),
    "busy-wait": (f"{_h('sleep')} AND loop_depth >= 1 AND NOT {_n('poll', 'retry')}", "'medium'"),
    "regex-in-loop": (f"{_h('compile', 'match')} AND loop_depth >= 1", f"CASE WHEN {_h('compile')} THEN 'high' ELSE 'medium' END"),
    "io-in-loop": (f"{_h('query', 'insert')} AND loop_depth >= 1", f"CASE WHEN {_h('query')} THEN 'high' ELSE 'medium' END"),
    "list-prepend": (f"{_h('insert')} AND loop_depth >= 1 AND subscript = 1", "'medium'"),
    "sort-to-select": (f"{_h('sort')} AND {_n('top', 'kth', 'first', 'small')}", "'medium'"),
    "loop-lookup": (f"{_h('index')} AND loop_depth >= 1", "'high'"),
    "branching-recursion": (f"self_calls >= 2 AND NOT memo AND NOT {_n('walk', 'visit', 'traverse')}", "'medium'"),
    "quadratic-string": ("concat = 1 AND nested = 1", "'high'"),
    "loop-invariant-call": ("len(list_filter(invariant, lambda x: x <> 'now')) > 0 AND loop_depth >= 1", "'medium'"),
}


def _cand(t: Tables):
    return D.candidates(t.symbols, t.signals, t.metrics, t.files, t.edges.filter("dst % 10 = 0").select(F.col("src").alias("id")))


for _x in D.DETECTORS:
    put(f"detect_{_x.task.replace('-', '_')}", CAND + f" SELECT id, {SQL[_x.task][1]} AS confidence FROM cand WHERE {SQL[_x.task][0]}")(lambda s, d, x=_x: D.detect(_cand(Tables(s, d)), [x]).select("id", "confidence"))
HITS = CAND + ", hits AS (" + " UNION ALL ".join(f"SELECT '{x.task}' AS task_id, '{x.way}' AS way, id, {SQL[x.task][1]} AS confidence, bounded FROM cand WHERE {SQL[x.task][0]}" for x in D.DETECTORS) + ")"
put("detect_all", HITS + " SELECT task_id, way, id, confidence FROM hits")(lambda s, d: D.detect(_cand(Tables(s, d))).select("task_id", "way", "id", "confidence"))
put(
    "detect_calibrated",
    HITS + ", n AS (SELECT dst AS id, count(*) AS callers FROM edges WHERE kind = 'call' GROUP BY 1), l AS (SELECT task_id, way, h.id, coalesce(callers, 0) AS callers, greatest(1, least(3, CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END + CASE WHEN coalesce(callers, 0) >= 5 THEN 1 WHEN coalesce(callers, 0) = 0 THEN -1 ELSE 0 END - bounded)) AS v FROM hits h LEFT JOIN n USING (id)) SELECT task_id, way, id, callers, CASE v WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence FROM l",
)(lambda s, d: D.calibrated(D.detect(_cand(Tables(s, d))), Tables(s, d).edges))

PAT = {
    "singleton": ", kids AS (SELECT DISTINCT parent_id AS id FROM symbols WHERE parent_id IS NOT NULL AND regexp_matches(name, '^(get_|instance)')), own AS (SELECT DISTINCT parent_id AS id FROM symbols s JOIN edges e ON e.src = s.id AND e.dst = s.parent_id) SELECT s.id, CASE WHEN own.id IS NOT NULL THEN 'high' ELSE 'medium' END AS confidence FROM symbols s JOIN kids USING (id) LEFT JOIN own USING (id) WHERE kind = 'class'",
    "factory": ", mk AS (SELECT DISTINCT e.src AS id FROM edges e JOIN symbols c ON c.id = e.dst WHERE c.kind = 'class') SELECT s.id, CASE WHEN mk.id IS NOT NULL THEN 'high' ELSE 'low' END AS confidence FROM symbols s LEFT JOIN mk USING (id) WHERE regexp_matches(name, '(?i)^(create|make|build|get_)')",
    "observer": ", o AS (SELECT parent_id AS id, max(CAST(regexp_matches(name, '(?i)(emit|notify|red)') AS INT)) AS e, max(CAST(regexp_matches(name, '(?i)(subscribe|listen|on_|blue)') AS INT)) AS l FROM symbols WHERE parent_id IS NOT NULL GROUP BY 1) SELECT id, CASE WHEN e = 1 AND l = 1 THEN 'high' ELSE 'medium' END AS confidence FROM o WHERE e + l > 0",
    "repository": ", cr AS (SELECT DISTINCT parent_id AS id FROM symbols WHERE parent_id IS NOT NULL AND regexp_matches(name, '^(get_|find_|save|delete|sort_)')) SELECT s.id, CASE WHEN cr.id IS NOT NULL THEN 'high' ELSE 'medium' END AS confidence FROM symbols s LEFT JOIN cr USING (id) WHERE kind = 'class' AND regexp_matches(name, '(Repository|Store|Dao|Bolt)$')",
    "middleware": ", lk AS (SELECT id FROM symbols WHERE regexp_matches(name, '(?i)(middleware|handler|filter|gear)$')), ch AS (SELECT DISTINCT src AS id FROM edges WHERE dst IN (SELECT id FROM lk)) SELECT lk.id, CASE WHEN ch.id IS NOT NULL THEN 'high' ELSE 'low' END AS confidence FROM lk LEFT JOIN ch USING (id)",
    "strategy": ", im AS (SELECT DISTINCT e.dst AS id, e.src AS child FROM edges e JOIN symbols c ON c.id = e.dst WHERE c.kind IN ('class', 'interface')), n AS (SELECT id, count(*) AS n FROM im GROUP BY 1 HAVING count(*) >= 2), nm AS (SELECT im.id, name, count(DISTINCT child) AS c FROM im JOIN symbols s ON s.id = child GROUP BY 1, 2), cm AS (SELECT DISTINCT n.id FROM nm JOIN n USING (id) WHERE c = n) SELECT n.id, CASE WHEN cm.id IS NOT NULL THEN 'high' ELSE 'medium' END AS confidence FROM n LEFT JOIN cm USING (id)",
    "decorator": ", us AS (SELECT dst AS id, count(DISTINCT src) AS users FROM edges GROUP BY 1) SELECT s.id, CASE WHEN coalesce(users, 0) >= 2 THEN 'high' ELSE 'medium' END AS confidence FROM symbols s LEFT JOIN us USING (id) WHERE regexp_matches(name, '(?i)(decorator|wrapper|with_|washer)')",
}
for _p in D.PATTERNS:
    put(f"pattern_{_p.__name__}", PAT[_p.__name__])(lambda s, d, p=_p: p(Tables(s, d).symbols, Tables(s, d).edges).select("id", "confidence"))

put("rule_dependency", " SELECT 'dependency' AS rule, e.src AS id, a.path || ' -> ' || b.path AS detail FROM file_edges e JOIN files a ON a.id = e.src JOIN files b ON b.id = e.dst WHERE starts_with(a.path, 'src/m1/') AND starts_with(b.path, 'src/m2/')")(lambda s, d: D.rule_dependency(Tables(s, d).file_edges, Tables(s, d).files, "src/m1/**", "src/m2/**"))
put("rule_metric", " SELECT 'metric' AS rule, symbol_id AS id, 'cc=' || cc AS detail FROM metrics WHERE cc > 45")(lambda s, d: D.rule_metric(Tables(s, d).metrics, "cc", 45))
put("rule_naming", " SELECT 'naming' AS rule, id, name AS detail FROM symbols WHERE kind = 'function' AND NOT regexp_matches(name, '^(get|sort)_')")(lambda s, d: D.rule_naming(Tables(s, d).symbols, "function", "^(get|sort)_"))
put("rule_path_match", " SELECT 'path' AS rule, id, path AS detail FROM files WHERE regexp_matches(path, '^src/m[^/]*/f[^/]*5\\.py$') AND NOT starts_with(path, 'src/m3/')")(lambda s, d: D.rule_paths(Tables(s, d).files, "src/m*/f*5.py", ["src/m3/**"]))
put("rule_symbol_match", ", od AS (SELECT src AS id, count(*) AS n FROM graph GROUP BY 1) SELECT 'symbol' AS rule, s.id, 'fan-out ' || n AS detail FROM symbols s JOIN od USING (id) WHERE kind = 'function' AND n > 2")(lambda s, d: D.rule_symbols(Tables(s, d).symbols, R.degrees(Tables(s, d).symbols, Tables(s, d).graph), "function", 2))
put("gate_rules", ", n AS (SELECT dst AS id, count(DISTINCT src) AS tests FROM file_edges WHERE src IN (SELECT id FROM files WHERE is_test = 1) GROUP BY 1) SELECT 'gate' AS rule, f.id, coalesce(tests, 0) || ' tests' AS detail FROM files f LEFT JOIN n USING (id) WHERE is_test = 0 AND coalesce(tests, 0) < 1")(lambda s, d: D.gate_tests(Tables(s, d).files, Tables(s, d).file_edges, 1))


def _budget(s, d):
    x = Tables(s, d).series
    at = lambda k: x.filter(F.col("idx") == k).select(F.col("series").alias("metric"), "value")
    limits = s.createDataFrame([("error", 5.0, None), ("view", None, 3.0), ("click", 1000.0, 1000.0), ("lines", 1.0, 1.0)], "metric string, max_increase double, max_decrease double")
    return D.budget(S.metric_delta(at(3), at(20), {}), limits)


put("budget_eval", ", l(metric, up, down) AS (VALUES ('error', 5.0, NULL), ('view', NULL, 3.0), ('click', 1000.0, 1000.0), ('lines', 1.0, 1.0)), b AS (SELECT series AS metric, value AS base FROM series WHERE idx = 3), h AS (SELECT series AS metric, value AS head FROM series WHERE idx = 20) SELECT metric, head - base AS delta, CASE WHEN base IS NULL THEN 'SKIP' WHEN head - base > up OR base - head > down THEN 'FAIL' ELSE 'PASS' END AS verdict FROM l LEFT JOIN b USING (metric) LEFT JOIN h USING (metric)")(_budget)

# what-if
put("simulate_move", ", mv AS (SELECT id, CASE WHEN id % 17 = 2 THEN 0 ELSE file_id END AS file_id FROM symbols) SELECT a.file_id AS src, b.file_id AS dst, count(*) AS symbol_count FROM edges e JOIN mv a ON a.id = e.src JOIN mv b ON b.id = e.dst WHERE a.file_id <> b.file_id GROUP BY 1, 2")(
    lambda s, d: (lambda t: W.file_graph(W.move(t.symbols, t.symbols.filter("id % 17 = 2").select("id", F.lit(0).cast("long").alias("to_file"))), t.edges))(Tables(s, d))
)
put("simulate_merge", ", mv AS (SELECT id, CASE WHEN file_id = 3 THEN 4 ELSE file_id END AS file_id FROM symbols) SELECT a.file_id AS src, b.file_id AS dst, count(*) AS symbol_count FROM edges e JOIN mv a ON a.id = e.src JOIN mv b ON b.id = e.dst WHERE a.file_id <> b.file_id GROUP BY 1, 2")(lambda s, d: W.file_graph(W.merge(Tables(s, d).symbols, 4, 3), Tables(s, d).edges))
put("simulate_delete", ", e2 AS (SELECT DISTINCT src, dst FROM edges WHERE src % 19 <> 1 AND dst % 19 <> 1), v2 AS (SELECT id FROM symbols WHERE id % 19 <> 1) SELECT (SELECT count(*) FROM v2) AS nodes, (SELECT count(*) FROM e2) AS edges, (SELECT count(*) FROM v2 WHERE id NOT IN (SELECT src FROM e2 UNION SELECT dst FROM e2)) AS isolated, (SELECT max(n) FROM (SELECT count(*) AS n FROM e2 GROUP BY dst)) AS most_in")(
    lambda s, d: W.graph_metrics(*W.delete(Tables(s, d).symbols, Tables(s, d).edges, Tables(s, d).symbols.filter("id % 19 = 1").select("id")))
)
put("symbol_diff", ", o AS (SELECT name, min(id % 5) AS v FROM symbols WHERE id % 2 = 0 GROUP BY 1), n AS (SELECT name, min(id % 5) AS v FROM symbols WHERE id % 3 = 0 GROUP BY 1) SELECT name, CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed' ELSE 'modified' END AS status FROM o FULL JOIN n USING (name) WHERE o.v IS DISTINCT FROM n.v")(
    lambda s, d: (lambda x: W.symbol_diff(x.filter("id % 2 = 0").groupBy("name").agg(F.min(F.col("id") % 5).alias("v")), x.filter("id % 3 = 0").groupBy("name").agg(F.min(F.col("id") % 5).alias("v")), "name", "v"))(Tables(s, d).symbols)
)
put("incremental_diff", ", o AS (SELECT path, line_count % 7 AS m, md5(CAST(line_count AS VARCHAR)) AS h FROM paths WHERE id % 5 <> 1), n AS (SELECT path, CASE WHEN id % 4 = 0 THEN line_count % 7 + 1 ELSE line_count % 7 END AS m, CASE WHEN id % 8 = 0 THEN 'x' ELSE md5(CAST(line_count AS VARCHAR)) END AS h FROM paths WHERE id % 6 <> 2) SELECT path, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' ELSE 'modified' END AS status FROM o FULL JOIN n USING (path) WHERE o.h IS NULL OR n.h IS NULL OR (abs(o.m - n.m) > 0.001 AND o.h <> n.h)")(
    lambda s, d: (lambda p: W.incremental(p.filter("id % 5 <> 1").select("path", (F.col("line_count") % 7).alias("mtime"), F.md5(F.col("line_count").cast("string")).alias("hash")), p.filter("id % 6 <> 2").select("path", F.expr("CASE WHEN id % 4 = 0 THEN line_count % 7 + 1 ELSE line_count % 7 END").alias("mtime"), F.when(F.col("id") % 8 == 0, "x").otherwise(F.md5(F.col("line_count").cast("string"))).alias("hash"))))(Tables(s, d).paths)
)
put("edge_analysis", ", o AS (SELECT src, dst FROM graph WHERE src % 4 <> 1), n AS (SELECT src, dst FROM graph WHERE dst % 5 <> 2), j AS (SELECT CASE WHEN o.src IS NULL THEN 'added' WHEN n.src IS NULL THEN 'removed' ELSE 'kept' END AS status FROM o FULL JOIN n ON o.src = n.src AND o.dst = n.dst) SELECT status, count(*) AS edges FROM j GROUP BY 1")(lambda s, d: W.edge_analysis(Tables(s, d).graph.filter("src % 4 <> 1"), Tables(s, d).graph.filter("dst % 5 <> 2")))
put("footprint", ", c AS (SELECT id FROM symbols WHERE id % 13 = 6) SELECT (SELECT count(*) FROM c) AS changed, (SELECT count(DISTINCT src) FROM graph WHERE dst IN (SELECT id FROM c) AND src NOT IN (SELECT id FROM c)) AS dependents, (SELECT count(DISTINCT dst) FROM graph WHERE src IN (SELECT id FROM c) AND dst NOT IN (SELECT id FROM c)) AS dependencies")(lambda s, d: W.footprint(Tables(s, d).symbols.filter("id % 13 = 6"), Tables(s, d).graph))
put(
    "adversarial",
    ", lay AS (SELECT id, id % 5 AS layer FROM symbols) SELECT 'layer-skip' AS \"check\", src AS id, CAST(NULL AS BIGINT) AS other, abs(b.layer - a.layer) AS detail FROM graph JOIN lay a ON a.id = src JOIN lay b ON b.id = dst WHERE abs(b.layer - a.layer) > 1 UNION ALL SELECT 'cross-cluster', least(a.cluster, b.cluster), greatest(a.cluster, b.cluster), count(*) FROM graph JOIN labelled a ON a.id = src JOIN labelled b ON b.id = dst WHERE a.cluster <> b.cluster GROUP BY 2, 3 "
    "UNION ALL SELECT 'orphan', id, NULL, 0 FROM symbols WHERE is_exported = 1 AND kind <> 'interface' AND id NOT IN (SELECT dst FROM graph) UNION ALL SELECT 'fan-out', src, NULL, count(*) FROM graph GROUP BY 2 HAVING count(*) > 3",
)(lambda s, d: W.adversarial(Tables(s, d).graph, Tables(s, d).symbols.select("id", (F.col("id") % 5).alias("layer")), Tables(s, d).labels, Tables(s, d).symbols, fan=3))

# text
TOK = ", raw AS (SELECT doc_id AS doc, unnest(regexp_split_to_array(lower(regexp_replace(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-zA-Z0-9]+')) AS t FROM documents), tk AS (SELECT doc, CASE " + " ".join(f"WHEN ends_with(t, '{x}') AND length(t) - {len(x)} >= 3 THEN left(t, length(t) - {len(x)})" for x in T.SUFFIXES) + " ELSE t END AS t FROM raw WHERE length(t) >= 2 AND t NOT IN (" + ", ".join(f"'{x}'" for x in T.STOP) + ")), tc AS (SELECT doc, t, count(*) AS n FROM tk GROUP BY 1, 2)"
TFIDF = TOK + ", dfs AS (SELECT t, count(*) AS df FROM tc GROUP BY 1), wt AS (SELECT doc, t, n / max(n) OVER (PARTITION BY doc) * (ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1) AS weight FROM tc JOIN dfs USING (t))"


def _counts(s, d):
    return T.counted(Tables(s, d).raw("documents"), "doc_id", "text")


def _weights(s, d):
    return T.tfidf(_counts(s, d), Tables(s, d).raw("documents").agg(F.count(F.lit(1)).alias("n")))


put("tokenize_counts", TOK + " SELECT t, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs FROM tc GROUP BY 1")(lambda s, d: _counts(s, d).groupBy("t").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs")))
put("tfidf", TFIDF + " SELECT doc, count(*) AS terms, round(sum(weight), 4) AS weight FROM wt GROUP BY 1")(lambda s, d: _weights(s, d).groupBy("doc").agg(F.count(F.lit(1)).alias("terms"), F.round(F.sum("weight"), 4).alias("weight")))
put("tfidf_search", TFIDF + ", q(t, q) AS (VALUES ('licens', 1.0), ('public', 0.5), ('general', 0.5)), nr AS (SELECT doc, sqrt(sum(weight * weight)) AS norm FROM wt GROUP BY 1), dt AS (SELECT doc, sum(weight * q) AS dot FROM wt JOIN q USING (t) GROUP BY 1) SELECT doc, round(dot / (norm * (SELECT sqrt(sum(q * q)) FROM q)), 6) AS score FROM dt JOIN nr USING (doc) ORDER BY dot / norm DESC, doc LIMIT 20")(
    lambda s, d: T.cosine_topk(_weights(s, d), s.createDataFrame([("licens", 1.0), ("public", 0.5), ("general", 0.5)], "t string, q double"), 20).withColumn("score", r6(F.col("score")))
)
put("grep_lines", ", l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) SELECT doc, CAST(line AS INTEGER) AS line, CAST((line - 1) // 5 AS INTEGER) AS span FROM l WHERE regexp_matches(body, '[Ll]icensed|[0-9]{3}-[0-9]{2}')")(lambda s, d: T.grep(Tables(s, d).raw("documents"), "doc_id", "text", "[Ll]icensed|[0-9]{3}-[0-9]{2}"))
URL = ", u AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(url), '^[a-z]+://[^/?#]*', ''), '[?#].*$', ''), '\\.html?$', ''), '/$', ''), '/[0-9]+', '/{}', 'g') AS template FROM pages)"
put("url_normalize", URL + " SELECT page_id, template FROM u")(lambda s, d: Tables(s, d).raw("pages").select("page_id", T.url_template(F.col("url")).alias("template")))
put("url_match", URL + " SELECT a.page_id AS route_id, b.page_id AS call_id FROM u a JOIN u b USING (template)")(
    lambda s, d: (lambda u: T.url_match(u.select(F.col("page_id").alias("route_id"), "template"), u.select(F.col("page_id").alias("call_id"), "template")))(Tables(s, d).raw("pages").select("page_id", T.url_template(F.col("url")).alias("template")))
)
put("orphan_routes", ", r AS (SELECT page_id, split_part(regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1), '.', 1) AS segment FROM pages) SELECT page_id AS route_id FROM r WHERE segment NOT IN (SELECT segment FROM r WHERE page_id % 10 = 3)")(
    lambda s, d: (lambda r: T.orphan_routes(r.withColumnRenamed("page_id", "route_id"), r.filter("page_id % 10 = 3").select("segment")))(Tables(s, d).raw("pages").select("page_id", F.substring_index(F.regexp_extract(F.lower("url"), "^[a-z]+://([^/?#]*)", 1), ".", 1).alias("segment")))
)
