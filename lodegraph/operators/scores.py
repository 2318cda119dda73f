"""Composite scores: health, debt, risk and load, as arithmetic over joined frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import clamp, zero


def index_percentile(df: DataFrame, value: str, q: float) -> DataFrame:
    """One row (p): the value at place floor(n q) of the sorted values (from 0)."""
    n = df.agg(F.count(F.lit(1)).alias("n"))
    ranked = df.select(F.col(value).alias("p"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(value)).alias("r"))
    return ranked.join(F.broadcast(n), F.col("r") == F.least(F.floor(F.col("n") * q), F.col("n") - 1) + 1).select("p")


def weather(stats: DataFrame, complexity: DataFrame, k: int = 20) -> DataFrame:
    """Hotspots: sqrt(churn / p75 * complexity / p75) over the 2 k files of most churn, p75 by place, zeros counting as 1."""
    top = stats.select("file_id", "total_churn").orderBy(F.desc("total_churn"), "file_id").limit(2 * k).join(complexity, "file_id")
    pc = index_percentile(top, "total_churn", 0.75).select(F.greatest("p", F.lit(1)).alias("pc"))
    px = index_percentile(top, "complexity", 0.75).select(F.greatest("p", F.lit(1)).alias("px"))
    d = top.crossJoin(F.broadcast(pc)).crossJoin(F.broadcast(px))  # one row each
    why = F.when((F.col("total_churn") >= F.col("pc")) & (F.col("complexity") >= F.col("px")), "BOTH").when(F.col("total_churn") >= F.col("pc"), "HIGH-CHURN").when(F.col("complexity") >= F.col("px"), "HIGH-COMPLEXITY").otherwise("")
    d = d.select("file_id", "total_churn", "complexity", F.sqrt(F.col("total_churn") / F.col("pc") * (F.col("complexity") / F.col("px"))).alias("score"), why.alias("reason"))
    return d.orderBy(F.desc("score"), "file_id").limit(k)


def strict_rank(value: str, by: list[str] | None = None) -> Column:
    """Share of rows strictly below."""
    w = Window.partitionBy(*[F.col(c) for c in by or []] or [F.lit(0)])
    return (F.rank().over(w.orderBy(value)) - 1) / F.count(F.lit(1)).over(w)


def debt(files: DataFrame) -> DataFrame:
    """From (file_id, complexity, churn, cyclic, degree, dead): penalty times hotspot factor, and minutes of repair."""
    most = files.agg(F.greatest(F.max("complexity"), F.lit(1)).alias("most"))
    below = files.groupBy("churn").agg(F.count(F.lit(1)).alias("c")).select("churn", F.col("c"), (F.sum("c").over(Window.partitionBy(F.lit(0)).orderBy("churn")) - F.col("c")).alias("below"), F.sum("c").over(Window.partitionBy(F.lit(0))).alias("all"))
    d = files.join(below.select("churn", (F.col("below") / F.col("all")).alias("pctile")), "churn").crossJoin(F.broadcast(most))
    god = (F.col("degree") > 40).cast("int")
    penalty = 0.4 * F.col("complexity") / F.col("most") + 0.3 * F.col("cyclic") + 0.2 * god + 0.1 * (F.col("dead") > 0).cast("int")
    minutes = 30 * (F.col("complexity") > 0.5 * F.col("most")).cast("int") + 120 * F.col("cyclic") + 240 * god + 10 * F.col("dead")
    return d.select("file_id", penalty.alias("penalty"), F.greatest(F.lit(1.0), 3 * F.col("pctile")).alias("hotspot"), (penalty * F.greatest(F.lit(1.0), 3 * F.col("pctile"))).alias("debt"), minutes.cast("long").alias("minutes"))


def debt_by_dir(debts: DataFrame, files: DataFrame) -> DataFrame:
    return debts.join(files.select(F.col("id").alias("file_id"), "dir"), "file_id").groupBy("dir").agg(F.count(F.lit(1)).alias("files"), F.sum("debt").alias("debt"), F.sum("minutes").alias("minutes"))


def file_health(f: DataFrame) -> DataFrame:
    """1 to 10 from (file_id, cc, cyclic, degree, dead, churn, p50, p90): deductions, amplified by churn."""
    cut = F.least(F.lit(3.0), F.col("cc") / 20) + 2.0 * F.col("cyclic") + F.when(F.col("degree") > 40, 1.5).when(F.col("degree") > 20, 0.75).otherwise(0.0) + F.least(F.lit(1.0), F.col("dead") * 0.1)
    amp = F.when(F.col("churn") > F.col("p90"), 1.5).when(F.col("churn") > F.col("p50"), 1.2).otherwise(1.0)
    return f.select("file_id", F.greatest(F.lit(1.0), F.least(F.lit(10.0), 10.0 - cut * amp)).alias("health"))


def cognitive_load(f: DataFrame) -> DataFrame:
    """0 to 100 from (file_id, cc, nesting, degree, entropy, dead_share, loc)."""
    cap = lambda c: F.least(F.lit(1.0), c)
    load = 0.30 * cap(F.col("cc") / 50) + 0.15 * cap(F.col("nesting") / 6) + 0.20 * cap(F.col("degree") / 40) + 0.15 * cap(F.col("entropy")) + 0.10 * cap(F.col("dead_share")) + 0.10 * cap(F.col("loc") / 500)
    return f.select("file_id", (100 * load).alias("load"))


def runtime_hotspots(runtime: DataFrame, static: DataFrame, share: float = 0.3) -> DataFrame:
    """(name, runtime_rank, static_rank, verdict): hot at run time and not statically is an UPGRADE, the reverse a DOWNGRADE."""
    d = runtime.join(static, "name")
    one = Window.partitionBy(F.lit(0))
    d = d.withColumn("runtime_rank", F.row_number().over(one.orderBy(F.desc("load"), "name"))).withColumn("static_rank", F.row_number().over(one.orderBy(F.desc("static_score"), "name"))).withColumn("n", F.count(F.lit(1)).over(one))
    edge = F.greatest(F.lit(1.0), F.col("n") * share)
    a, b = F.col("runtime_rank") <= edge, F.col("static_rank") <= edge
    return d.select("name", "runtime_rank", "static_rank", F.when(a & b, "CONFIRMED").when(a, "UPGRADE").when(b, "DOWNGRADE").otherwise("COLD").alias("verdict"))


def diagnose(f: DataFrame) -> DataFrame:
    """Root-cause risk from z-scores (population deviation, 0.01 at least), each a third capped to 0..1."""
    m = f.agg(*[g(c).alias(f"{c}_{n}") for c in ("churn", "cc", "health", "entropy") for n, g in (("m", F.avg), ("s", F.stddev_pop))])
    d = f.crossJoin(F.broadcast(m))
    z = lambda c, sign=1: clamp(sign * (F.col(c) - F.col(f"{c}_m")) / F.greatest(F.col(f"{c}_s"), F.lit(0.01)) / 3)
    return d.select("file_id", (0.30 * z("churn") + 0.30 * z("cc") + 0.25 * z("health", -1) + 0.15 * z("entropy")).alias("risk"))


def gini(df: DataFrame, value: str) -> DataFrame:
    """One row: Gini coefficient."""
    d = df.select(F.col(value).alias("v"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(value)).alias("i"))
    a = d.agg(F.sum(F.col("i") * F.col("v")).alias("iv"), F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    return a.select(F.when(F.col("s") > 0, (2 * F.col("iv") - (F.col("n") + 1) * F.col("s")) / (F.col("n") * F.col("s"))).otherwise(0.0).alias("gini"))


def severity(cc: Column) -> Column:
    return F.when(cc >= 25, "critical").when(cc >= 15, "high").when(cc >= 8, "medium").otherwise("low")


def bumpy_road(metrics: DataFrame, symbols: DataFrame, cc: int = 5, least: int = 3) -> DataFrame:
    d = metrics.filter(F.col("cc") >= cc).join(symbols.select(F.col("id").alias("symbol_id"), "file_id"), "symbol_id")
    return d.groupBy("file_id").agg(F.count(F.lit(1)).alias("functions"), F.sum("cc").alias("cc"), F.max("cc").alias("most")).filter(F.col("functions") >= least)


def dead_action(d: DataFrame) -> DataFrame:
    """Ordered verdicts for unreferenced symbols: (id, verdict, confidence). The first rule that holds wins."""
    name = F.col("name")
    intentional = name.rlike("^(get_|main$|test)")
    return d.select(
        "id",
        F.when(intentional, "INTENTIONAL").when(F.col("imported") == 0, "SAFE").when(F.col("kind").isin("class", "interface"), "REVIEW").otherwise("SAFE").alias("verdict"),
        F.when(intentional, 60).when(F.col("imported") == 0, 90).when(F.col("kind").isin("class", "interface"), 50).otherwise(75).cast("int").alias("confidence"),
    )


def dead_decay(d: DataFrame) -> DataFrame:
    """0 to 100: age, author gone, churn, size and dependency parts of (id, age_days, author_gone, churn, lines, imported)."""
    score = 40 * clamp(F.col("age_days") / 365) + 20 * F.col("author_gone") + 15 * (1 - clamp(F.col("churn") / 100)) + 15 * clamp(F.col("lines") / 100) + 10 * (F.col("imported") == 0).cast("int")
    return d.select("id", F.floor(score).cast("int").alias("decay"), F.when(score >= 75, "fossil").when(score >= 50, "decayed").when(score >= 25, "stale").otherwise("fresh").alias("tier"))


def health(tangle: Column, gods: Column, bottlenecks: Column, violations: Column, files: Column) -> Column:
    """Weighted geometric mean of five health factors, 0 to 100."""
    parts = [(0.30, F.exp(-tangle / 10)), (0.20, F.exp(-gods / 5)), (0.15, F.exp(-bottlenecks / 4)), (0.15, F.exp(-violations / 5)), (0.20, F.least(F.lit(1.0), files / 10))]
    total = F.lit(0.0)
    for w, h in parts:
        total = total + w * F.log(F.greatest(h, F.lit(1e-9)))
    return (100 * F.exp(total)).cast("int")


def blast_verdict(n: Column, share: Column) -> Column:
    return F.when((share >= 0.10) | (n >= 50), "high").when((share >= 0.02) | (n >= 10), "medium").otherwise("low")


def breaking_risk(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, callers, files, risk, level): distinct callers times their files, at least one."""
    d = edges.select("src", F.col("dst").alias("id")).distinct().join(symbols.select(F.col("id").alias("src"), "file_id"), "src")
    d = d.groupBy("id").agg(F.count(F.lit(1)).alias("callers"), F.count_distinct("file_id").alias("files"))
    risk = F.col("callers") * F.greatest(F.col("files"), F.lit(1))
    return d.select("id", "callers", "files", risk.alias("risk"), F.when(risk >= 50, "critical").when(risk >= 20, "high").when(risk >= 5, "medium").otherwise("low").alias("level"))


def metric_delta(base: DataFrame, head: DataFrame, polarity: dict[str, int]) -> DataFrame:
    """(metric, base, head, delta, pct, change) by the metric's good direction (1 up, -1 down)."""
    good = F.create_map(*[F.lit(x) for kv in polarity.items() for x in kv])
    d = base.withColumnRenamed("value", "base").join(head.withColumnRenamed("value", "head"), "metric", "full")
    delta = zero(F.col("head")) - zero(F.col("base"))
    sign = F.signum(delta) * F.coalesce(F.element_at(good, F.col("metric")), F.lit(0))
    return d.select("metric", "base", "head", delta.alias("delta"), F.when(zero(F.col("base")) != 0, 100 * delta / F.abs("base")).otherwise(0.0).alias("pct"), F.when(sign > 0, "improved").when(sign < 0, "degraded").otherwise("unchanged").alias("change"))
