"""History queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import r6
from ..operators import history as H
from ..sources.adapters import Tables, oracle
from .registry import ORACLE_SQL, query

TOUCHED = ", t AS (SELECT DISTINCT commit_id, file_id FROM {src}), n AS (SELECT commit_id, count(*) AS k FROM t GROUP BY 1 HAVING count(*) BETWEEN 2 AND {most}), b AS (SELECT t.* FROM t JOIN n USING (commit_id))"
PAIRS = TOUCHED + ", p AS (SELECT x.file_id AS file_id_a, y.file_id AS file_id_b, count(*) AS cochange_count FROM b x JOIN b y ON x.commit_id = y.commit_id AND x.file_id < y.file_id GROUP BY 1, 2)"
SYM = ", s AS (SELECT file_id_a AS file_id, file_id_b AS partner, cochange_count FROM p UNION ALL SELECT file_id_b, file_id_a, cochange_count FROM p)"
COUNTS = ", c AS (SELECT file_id, count(*) AS commits FROM t GROUP BY 1), tot AS (SELECT count(DISTINCT commit_id) AS n FROM t)"
COUPLED = COUNTS + (
    ", cp AS (SELECT p.*, a.commits AS ca, b2.commits AS cb, cochange_count / ((a.commits + b2.commits) / 2.0) AS strength, CAST(cochange_count AS DOUBLE) * tot.n / (a.commits * b2.commits) AS lift, "
    "ln(CAST(cochange_count AS DOUBLE) * tot.n / (a.commits * b2.commits)) / -ln(CAST(cochange_count AS DOUBLE) / tot.n) AS npmi FROM p JOIN c a ON a.file_id = file_id_a JOIN c b2 ON b2.file_id = file_id_b, tot)"
)


def _pairs(src: str = "changes", most: int = 100) -> str:
    return PAIRS.format(src=src, most=most)


def _total(changes: DataFrame) -> DataFrame:
    return changes.agg(F.count_distinct("commit_id").alias("total"))


def _coupled(t: Tables) -> DataFrame:
    return H.coupling(H.cochange_pairs(t.changes), H.commit_counts(t.changes), _total(t.changes))


def _now(t: Tables) -> DataFrame:
    return t.commits.agg(F.max("ts").alias("now"))


@query("cochange_pairs", oracle(_pairs() + " SELECT * FROM p"))
def cochange_pairs(spark: SparkSession, d: str) -> DataFrame:
    return H.cochange_pairs(Tables(spark, d).changes)


@query("file_stats", oracle(" SELECT file_id, count(DISTINCT commit_id) AS commit_count, CAST(sum(lines_added + lines_removed) AS BIGINT) AS total_churn, count(DISTINCT author) AS distinct_authors FROM changes JOIN commits ON id = commit_id GROUP BY 1"))
def file_stats(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return H.file_stats(t.changes, t.commits)


@query("cochange_entropy", oracle(_pairs() + SYM + " SELECT file_id, count(*) AS partners, CASE WHEN count(*) > 1 THEN round(-log2(sum(cochange_count * cochange_count) / (CAST(sum(cochange_count) AS DOUBLE) * sum(cochange_count))) / log2(count(*)), 6) ELSE 0.0 END AS entropy FROM s GROUP BY 1"))
def cochange_entropy(spark: SparkSession, d: str) -> DataFrame:
    return H.cochange_entropy(H.cochange_pairs(Tables(spark, d).changes)).withColumn("entropy", r6(F.col("entropy")))


@query("hyperedges", oracle(TOUCHED.format(src="changes", most=100) + " SELECT commit_id, count(*) AS file_count, sha256(string_agg(CAST(file_id AS VARCHAR), '|' ORDER BY file_id))[1:16] AS sig_hash FROM b GROUP BY 1"))
def hyperedges(spark: SparkSession, d: str) -> DataFrame:
    return H.hyperedges(Tables(spark, d).changes).drop("fs")


@query("hyperedge_members", oracle(TOUCHED.format(src="changes", most=100) + " SELECT commit_id, CAST(row_number() OVER (PARTITION BY commit_id ORDER BY file_id) - 1 AS INTEGER) AS ordinal, file_id FROM b"))
def hyperedge_members(spark: SparkSession, d: str) -> DataFrame:
    return H.hyperedge_members(Tables(spark, d).changes)


def _measure(name: str) -> None:
    @query(f"coupling_{name}", oracle(_pairs() + COUPLED + f" SELECT file_id_a, file_id_b, cochange_count, round({name}, 6) AS {name} FROM cp WHERE cochange_count >= 2"))
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _coupled(Tables(spark, d)).filter("cochange_count >= 2").select("file_id_a", "file_id_b", "cochange_count", r6(F.col(name)).alias(name))


for _name in ("strength", "lift", "npmi"):
    _measure(_name)


@query("dark_matter", oracle(_pairs() + COUPLED + " SELECT file_id_a, file_id_b, cochange_count, round(npmi, 6) AS npmi, round(lift, 6) AS lift, round(strength, 6) AS strength FROM cp WHERE cochange_count >= 3 AND npmi >= 0.3 AND NOT EXISTS (SELECT 1 FROM graph g WHERE (g.src = file_id_a AND g.dst = file_id_b) OR (g.src = file_id_b AND g.dst = file_id_a))"))
def dark_matter(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    out = H.dark_matter(_coupled(t), t.graph)
    return out.select("file_id_a", "file_id_b", "cochange_count", *[r6(F.col(c)).alias(c) for c in ("npmi", "lift", "strength")])


CHANGE_SET = "SELECT DISTINCT file_id FROM coarse WHERE commit_id % 500 = 7"


@query("surprise", oracle(TOUCHED.format(src="coarse", most=100) + f", cs AS ({CHANGE_SET}), m AS (SELECT commit_id, count(*) AS i FROM b JOIN cs USING (file_id) GROUP BY 1), j AS (SELECT max(i / (n.k + (SELECT count(*) FROM cs) - i)) AS best FROM m JOIN n USING (commit_id)) SELECT round(CASE WHEN (SELECT count(*) FROM cs) < 2 THEN 0.0 WHEN best IS NULL THEN 0.5 ELSE 1 - best END, 6) AS surprise FROM j"))
def surprise(spark: SparkSession, d: str) -> DataFrame:
    c = Tables(spark, d).coarse
    return H.surprise(c, c.filter("commit_id % 500 = 7")).select(r6(F.col("surprise")).alias("surprise"))


CS2 = "SELECT DISTINCT file_id FROM coarse WHERE file_id IN (1, 5, 9)"


@query("missing_partners", oracle(_pairs("coarse") + SYM + COUNTS + f", cs AS ({CS2}), m AS (SELECT partner, cochange_count, cochange_count / ((a.commits + b2.commits) / 2.0) AS strength FROM s JOIN cs USING (file_id) JOIN c a USING (file_id) JOIN c b2 ON b2.file_id = partner WHERE cochange_count >= 2 AND partner NOT IN (SELECT file_id FROM cs)) SELECT partner, round(max(strength), 6) AS strength, max(cochange_count) AS cochange_count FROM m WHERE strength >= 0.02 GROUP BY 1"))
def missing_partners(spark: SparkSession, d: str) -> DataFrame:
    c = Tables(spark, d).coarse
    out = H.missing_partners(H.cochange_pairs(c), H.commit_counts(c), c.filter("file_id IN (1, 5, 9)"), strength=0.02)
    return out.withColumn("strength", r6(F.col("strength")))


FN = ", fc AS (SELECT commit_id, file_id // 10 AS file_id FROM changes)"


@query(
    "fn_coupling",
    oracle(
        FN + _pairs("fc", 30) + ", q AS (SELECT least(a.id, b2.id) AS a, greatest(a.id, b2.id) AS b, cochange_count FROM p JOIN symbols a ON a.file_id = file_id_a JOIN symbols b2 ON b2.file_id = file_id_b WHERE cochange_count >= 3), "
        "tied AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM graph) SELECT q.a, q.b, cochange_count FROM q ANTI JOIN tied USING (a, b)"
    ),
)
def fn_coupling(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return H.fn_coupling(t.changes.withColumn("file_id", F.expr("file_id div 10")), t.symbols, t.graph)


@query("fn_coupling_all", ORACLE_SQL["fn_coupling"])
def fn_coupling_all(spark: SparkSession, d: str) -> DataFrame:
    """The former name of `fn_coupling`, from when that was a slice."""
    return fn_coupling(spark, d)


@query(
    "bus_factor",
    oracle(
        ", by_author AS (SELECT dir, author, sum(lines_added) AS churn, max(ts) AS last FROM changes JOIN commits c ON c.id = commit_id JOIN paths p ON p.id = file_id GROUP BY 1, 2), "
        "w AS (SELECT *, sum(churn) OVER (PARTITION BY dir) AS total FROM by_author), g AS (SELECT dir, count(*) FILTER (churn / total > 0.1) AS major, count(*) AS authors, CAST(max(total) AS BIGINT) AS churn, max(last) AS last, -sum(churn / total * log2(churn / total)) AS h FROM w GROUP BY 1), "
        "f AS (SELECT *, greatest(major, 1) AS bf, ((SELECT max(ts) FROM commits) - last) / 86400.0 AS days FROM g) "
        "SELECT dir, bf AS bus_factor, authors, churn, round(CASE WHEN authors > 1 THEN h / log2(authors) ELSE 0 END, 6) AS entropy, CASE WHEN days > 180 THEN 3.0 WHEN days > 90 THEN 2.0 ELSE 1.0 END::DOUBLE AS staleness, round(1.0 / bf * (1 + ln(1 + churn) / 10) * CASE WHEN days > 180 THEN 3.0 WHEN days > 90 THEN 2.0 ELSE 1.0 END, 6) AS risk FROM f"
    ),
)
def bus_factor(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    out = H.bus_factor(t.changes, t.commits, t.paths, _now(t))
    return out.withColumn("entropy", r6(F.col("entropy"))).withColumn("risk", r6(F.col("risk")))


@query(
    "ownership_dir",
    oracle(
        ", by_author AS (SELECT dir, author, sum(lines_added) AS churn FROM changes JOIN commits c ON c.id = commit_id JOIN paths p ON p.id = file_id GROUP BY 1, 2), "
        "w AS (SELECT *, sum(churn) OVER (PARTITION BY dir) AS total, coalesce(sum(churn) OVER (PARTITION BY dir ORDER BY churn DESC, author ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY dir ORDER BY churn DESC, author) AS rank FROM by_author) "
        "SELECT dir, max(CASE WHEN rank = 1 THEN author END) AS owner, round(max(CASE WHEN rank = 1 THEN churn / total END), 6) AS share, count(*) FILTER (before < 0.8::DOUBLE * total) AS bus_factor FROM w GROUP BY 1"
    ),
)
def ownership_dir(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return H.ownership(t.changes, t.commits, t.paths).withColumn("share", r6(F.col("share")))


@query("author_familiarity", oracle(", w AS (SELECT file_id, author, sum(lines_added * exp(-0.005 * ((SELECT max(ts) FROM commits) - ts) / 86400)) AS weight FROM changes JOIN commits ON id = commit_id GROUP BY 1, 2) SELECT file_id, author, round(weight / max(weight) OVER (PARTITION BY file_id), 6) AS familiarity FROM w"))
def author_familiarity(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return H.author_familiarity(t.changes, t.commits, _now(t)).withColumn("familiarity", r6(F.col("familiarity")))


@query("minor_contributors", oracle(", a AS (SELECT file_id, author, sum(lines_added) AS churn FROM changes JOIN commits ON id = commit_id GROUP BY 1, 2), w AS (SELECT *, sum(churn) OVER (PARTITION BY file_id) AS total FROM a) SELECT file_id, count(*) FILTER (churn < 0.05::DOUBLE * total) AS minor, count(*) AS authors FROM w GROUP BY 1"))
def minor_contributors(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return H.minor_contributors(t.changes, t.commits)


@query("brain_methods", oracle(" SELECT symbol_id, cc, line_count FROM metrics WHERE cc >= 25 AND line_count >= 100"))
def brain_methods(spark: SparkSession, d: str) -> DataFrame:
    return H.brain_methods(Tables(spark, d).metrics)


@query("cochange_partners", oracle(_pairs() + SYM + " SELECT file_id, partner, cochange_count FROM s WHERE cochange_count >= 3"))
def cochange_partners(spark: SparkSession, d: str) -> DataFrame:
    return H.symmetrized(H.cochange_pairs(Tables(spark, d).changes).filter("cochange_count >= 3"))
