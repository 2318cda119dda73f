"""Quality rules: robust multivariate outliers by minimum covariance determinant, per language and source.

DataFrame operations only. Each document becomes five transformed statistics (log mean word length; square roots of the
shares of symbols, capitals, words in repeated windows and repeated lines). For every (language, source) three starts are
tried side by side: medians with interquartile ranges, medians with least deviations, and mean and covariance of all. Each
takes concentration steps (Mahalanobis distances under the current estimate, the nearest `share` of the group's documents, their
mean and covariance) until none lowers the covariance's determinant, and the start that ends with the least determinant
gives the estimate. The nearest are found by a histogram of distances, so a step is one pre-aggregated group-by over
(language, source, start, distance bin) of any size, and its sums are exact integers (statistics in thousandths): reruns agree
to the bit. The core so is whole bins, the last of which may take it beyond the share. A group below `LEAST` documents is
pooled with the other small groups of its language; a pool below that has no estimate and its documents pass: of fewer than
ten documents a statistic, distances would say nothing. A ridge (`FLOOR`) keeps statistics that are constant in the core finite.

Null texts have no words and fail the base rules. Texts of any length are read whole. Null languages and sources are values of
their own. Repeated rows count each. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, free_name, kept_where, staged, table
from .textstats import BASE, with_stats

#: Least standard deviation of each statistic: rounding and short texts alone spread it so far.
FLOOR = (0.06, 0.05, 0.06, 0.16, 0.16)
P = len(FLOOR)
SHARE = 0.75
LEAST = 60
#: Consistency of a 75 % core at the normal distribution with 5 dimensions: 0.75 / P(chi2_7 <= the 75 % point of chi2_5).
CONSISTENT = 1.41
#: Squared distance that one document in a million passes at the normal distribution (chi-square, 5 dimensions).
CUTOFF = 35.9
_NULL, _REST = "\x00null", "\x00rest"


def _milli(x: Column) -> Column:
    return F.coalesce(F.round(x * 1000), F.lit(0)).cast("long")


def vector(p: str = "") -> list[Column]:
    """The five statistics, in thousandths, from the columns of with_stats()."""
    c = lambda x: F.col(f"{p}{x}").cast("double")
    part = lambda a, b: F.sqrt(c(a) / F.greatest(c(b), F.lit(1.0)))
    mean = F.log(F.greatest(c("word_chars"), F.lit(1.0)) / F.greatest(c("n_words"), F.lit(1.0)))
    return [_milli(x) for x in (mean, part("n_symbols", "word_chars"), part("n_upper", "word_chars"), part("n_repeat_words", "n_words"), part("n_dup_lines", "n_lines"))]


def base_failed(p: str = "") -> Column:
    return (F.col(f"{p}n_words") < 50) | (100 * F.col(f"{p}n_repeat_words") > 50 * F.col(f"{p}n_words"))


def _keyed(df: DataFrame, p: str) -> DataFrame:
    d = df.withColumn(f"{p}k1", F.coalesce(F.col("lang").cast("string"), F.lit(_NULL))).withColumn(f"{p}k2", F.coalesce(F.col("source").cast("string"), F.lit(_NULL)))
    for i, x in enumerate(vector(p)):
        d = d.withColumn(f"{p}x{i}", x)
    return d


def _factored(d: DataFrame) -> DataFrame:
    """From n, s{i} and s{i}_{j} (sums over the core): means m{i} and the Cholesky factor l{i}_{j} of the covariance."""
    for i in range(P):
        d = d.withColumn(f"m{i}", F.col(f"s{i}") / F.col("n"))
    for i in range(P):
        for j in range(i + 1):
            v = (F.col(f"s{j}_{i}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * F.lit(CONSISTENT)
            for k in range(j):
                v = v - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            ridge = (1000 * FLOOR[i]) ** 2
            d = d.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(v, F.lit(0.0)) + F.lit(ridge)) if i == j else v / F.col(f"l{j}_{j}"))
    det = F.lit(0.0)
    for i in range(P):
        det = det + F.log(F.col(f"l{i}_{i}"))
    return d.select("k1", "k2", "start", *_PARAMETERS, det.alias("det"))


_PARAMETERS = [*[f"m{i}" for i in range(P)], *[f"l{i}_{j}" for i in range(P) for j in range(i + 1)]]


def _squared(d: DataFrame, p: str, name: str) -> DataFrame:
    """Adds `name`: the squared Mahalanobis distance of the row from the estimate that it carries."""
    for i in range(P):
        z = F.col(f"{p}x{i}") - F.col(f"m{i}")
        for j in range(i):
            z = z - F.col(f"l{i}_{j}") * F.col(f"{p}z{j}")
        d = d.withColumn(f"{p}z{i}", z / F.col(f"l{i}_{i}"))
    total = F.col(f"{p}z0") * F.col(f"{p}z0")
    for i in range(1, P):
        total = total + F.col(f"{p}z{i}") * F.col(f"{p}z{i}")
    return d.withColumn(name, total)


def _at(hist: DataFrame, q: float, by: list[str]) -> Column:
    w = Window.partitionBy(*by)
    return F.min(F.when(F.col("upto") >= F.lit(q) * F.col("n"), F.col("bin"))).over(w)


def fit(stats: DataFrame, p: str = "") -> tuple[DataFrame, DataFrame]:
    """(key map: k1, k2 -> e2, the source that stands for it; estimates by k1, e2 as k1, k2). `stats` has lang, source and the
    columns of with_stats(); give it staged, it is read once a step. Rows that fail the base rules take no part."""
    d = _keyed(stats.filter(~base_failed(p)), p)
    sizes = staged(d.groupBy(F.col(f"{p}k1").alias("k1"), F.col(f"{p}k2").alias("k2")).agg(F.count(F.lit(1)).alias("n")), "sizes")
    keys = staged(sizes.select("k1", "k2", F.when(F.col("n") >= LEAST, F.col("k2")).otherwise(F.lit(_REST)).alias("e2")), "keys")
    xs = [f"x{i}" for i in range(P)]
    rows = d.select(F.col(f"{p}k1").alias("k1"), F.col(f"{p}k2").alias("k2"), *[F.col(f"{p}{x}").alias(x) for x in xs])
    rows = staged(rows.join(keys, ["k1", "k2"]).select("k1", F.col("e2").alias("k2"), *xs), "vectors")
    long = rows.select("k1", "k2", F.posexplode(F.array(*[F.floor(F.col(x) / 10).cast("long") for x in xs])).alias("i", "bin"))
    hist = long.groupBy("k1", "k2", "i", "bin").agg(F.count(F.lit(1)).alias("c"))
    by = Window.partitionBy("k1", "k2", "i")
    hist = hist.withColumn("upto", F.sum("c").over(by.orderBy("bin"))).withColumn("n", F.sum("c").over(by))
    q = hist.select("k1", "k2", "i", *[(_at(hist, x, ["k1", "k2", "i"]) * 10 + 5).alias(f"q{x}".replace(".", "")) for x in (0.25, 0.5, 0.75)]).distinct()
    q = q.withColumn("sd", (F.col("q075") - F.col("q025")) / F.lit(1.349))
    pick = lambda name, i: F.max(F.when(F.col("i") == i, F.col(name))).cast("double")
    middle = q.groupBy("k1", "k2").agg(*[pick("q05", i).alias(f"m{i}") for i in range(P)], *[pick("sd", i).alias(f"sd{i}") for i in range(P)])
    floors = [(1000 * x) ** 2 for x in FLOOR]
    flat = lambda k, wide: middle.select("k1", "k2", F.lit(k).alias("start"), *[f"m{i}" for i in range(P)], *[(F.sqrt(wide(i) + F.lit(floors[i])) if i == j else F.lit(0.0)).alias(f"l{i}_{j}") for i in range(P) for j in range(i + 1)], F.lit(float("inf")).alias("det"))
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(xs)] + [F.sum(F.col(xs[j]) * F.col(xs[i])).alias(f"s{j}_{i}") for i in range(P) for j in range(i + 1)]
    names = ["n", *[f"s{i}" for i in range(P)], *[f"s{j}_{i}" for i in range(P) for j in range(i + 1)]]
    whole = _factored(rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), *sums).withColumn("start", F.lit(2))).withColumn("det", F.lit(float("inf")))
    est = flat(0, lambda i: F.col(f"sd{i}") * F.col(f"sd{i}")).unionByName(flat(1, lambda i: F.lit(0.0))).unionByName(whole)
    est = staged(est.join(rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("all")).filter(F.col("all") >= LEAST).select("k1", "k2"), ["k1", "k2"]).withColumn("moved", F.lit(True)), "starts")
    group = ["k1", "k2", "start"]
    while not est.filter("moved").isEmpty():
        far = _squared(rows.join(est.filter("moved"), ["k1", "k2"]), "", "d2")
        bins = far.withColumn("bin", F.least(F.floor(F.log1p(F.col("d2")) * 64), F.lit(4000)).cast("int")).groupBy(*group, "bin").agg(F.count(F.lit(1)).alias("n"), *sums)
        g = Window.partitionBy(*group)
        bins = bins.withColumn("all", F.sum("n").over(g)).withColumn("before", F.coalesce(F.sum("n").over(g.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        core = bins.filter(F.col("before") < F.lit(SHARE) * F.col("all")).groupBy(*group).agg(*[F.sum(x).alias(x) for x in names])
        new = _factored(core).withColumnRenamed("start", "again").withColumnsRenamed({x: f"new_{x}" for x in [*_PARAMETERS, "det"]})
        both = est.join(new.withColumnsRenamed({"k1": "j1", "k2": "j2"}), (F.col("k1") == F.col("j1")) & (F.col("k2") == F.col("j2")) & (F.col("start") == F.col("again")), "left")
        better = F.coalesce(F.col("new_det") < F.col("det") - F.lit(1e-9), F.lit(False))
        step = staged(both.select(*group, *[F.when(better, F.col(f"new_{x}")).otherwise(F.col(x)).alias(x) for x in [*_PARAMETERS, "det"]], better.alias("moved")), "estimate")
        discard(est)
        est = step
    best = est.groupBy("k1", "k2").agg(F.min_by(F.struct(*_PARAMETERS), F.struct("det", "start")).alias("best"))
    est = staged(best.select("k1", "k2", "best.*"), "estimates")
    return keys, est


def judged(stats: DataFrame, keys: DataFrame, est: DataFrame, p: str = "", *, cutoff: float = CUTOFF) -> DataFrame:
    """`stats` with `p`d2 (null where no estimate holds), `p`base_failed and `p`kept. The estimates are small (one row for a
    language and source); Spark broadcasts them only while they are."""
    d = _keyed(stats, p)
    mk = keys.select(F.col("k1").alias(f"{p}a"), F.col("k2").alias(f"{p}b"), F.col("e2").alias(f"{p}e"))
    d = d.join(mk, (F.col(f"{p}k1") == F.col(f"{p}a")) & (F.col(f"{p}k2") == F.col(f"{p}b")), "left")
    me = est.withColumnsRenamed({"k1": f"{p}ea", "k2": f"{p}eb"})
    d = d.join(me, (F.col(f"{p}k1") == F.col(f"{p}ea")) & (F.coalesce(F.col(f"{p}e"), F.lit(_REST)) == F.col(f"{p}eb")), "left")
    d = _squared(d, p, f"{p}d2").withColumn(f"{p}base_failed", base_failed(p))
    d = d.withColumn(f"{p}kept", ~F.col(f"{p}base_failed") & (F.coalesce(F.col(f"{p}d2"), F.lit(0.0)) <= F.lit(cutoff)))
    return d.select(*stats.columns, f"{p}d2", f"{p}base_failed", f"{p}kept")


def _stats(docs: DataFrame, p: str) -> DataFrame:
    return with_stats(docs, "text", p)


def filtered(docs: DataFrame) -> DataFrame:
    """The documents that base rules and distances keep, with the same columns. Texts are read twice and never shuffled."""
    p = free_name(docs, "_q_", prefix=True)
    cols = [f"{p}{x}" for x in [*BASE, "n_upper", "n_lines"]]
    light = staged(_stats(docs, p).select("lang", "source", *cols), "stats")
    keys, est = fit(light, p)
    return kept_where(judged(_stats(docs, p), keys, est, p), f"{p}kept").select(*docs.columns)


def op7_mcd_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics, base rules and the robust-distance verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    stats = staged(_stats(docs, "").drop("text"), "stats")
    keys, est = fit(stats)
    out = judged(stats, keys, est)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("d2").alias("distance2"))
