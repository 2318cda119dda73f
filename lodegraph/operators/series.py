"""Operators over metric series: rows (series, idx, value), idx the order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.scalars import erfc


def _order() -> WindowSpec:
    return Window.partitionBy("series").orderBy("idx")


def with_mad(d: DataFrame) -> DataFrame:
    """Adds n, med and mad (median of absolute deviations) of the series."""
    m = d.groupBy("series").agg(F.median("value").alias("med"), F.count(F.lit(1)).alias("n"))
    d = d.join(m, "series").withColumn("dev", F.abs(F.col("value") - F.col("med")))
    return d.join(d.groupBy("series").agg(F.median("dev").alias("mad")), "series")


def modified_z(d: DataFrame, threshold: float = 3.5, least: int = 5) -> DataFrame:
    """0.6745 (v - median) / MAD; with MAD 0 the z is 0 at the median and infinite elsewhere. Series below `least` are left out."""
    d = with_mad(d).filter(F.col("n") >= least)
    z = F.when(F.col("mad") > 0, 0.6745 * (F.col("value") - F.col("med")) / F.col("mad")).when(F.col("value") == F.col("med"), 0.0).otherwise(F.signum(F.col("value") - F.col("med")) * F.lit(float("inf")))
    return d.select("series", "idx", "value", z.alias("z")).withColumn("anomaly", (F.abs("z") > threshold).cast("int"))


def _pairs(d: DataFrame) -> DataFrame:
    a, b = d.select("series", F.col("idx").alias("i"), F.col("value").alias("vi")), d.select("series", F.col("idx").alias("j"), F.col("value").alias("vj"))
    return a.join(b, "series").filter("i < j")


def theil_sen(d: DataFrame, band: float = 0.01, least: int = 4) -> DataFrame:
    """Median of pairwise slopes, median intercept, and direction outside a dead band."""
    slope = _pairs(d).groupBy("series").agg(F.median((F.col("vj") - F.col("vi")) / (F.col("j") - F.col("i"))).alias("slope"))
    d = d.join(slope, "series")
    out = d.groupBy("series").agg(F.first("slope").alias("slope"), F.median(F.col("value") - F.col("slope") * F.col("idx")).alias("intercept"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return out.withColumn("direction", F.when(F.col("slope") > band, "increasing").when(F.col("slope") < -band, "decreasing").otherwise("stable"))


def mann_kendall(d: DataFrame, *, ties: bool = True, alpha: float = 0.05, least: int = 8) -> DataFrame:
    """S, continuity-corrected z and two-sided p; the variance with or without tie correction."""
    s = _pairs(d).groupBy("series").agg(F.sum(F.signum(F.col("vj") - F.col("vi"))).cast("long").alias("s"))
    n = d.groupBy("series").agg(F.count(F.lit(1)).alias("n"))
    t = d.groupBy("series", "value").agg(F.count(F.lit(1)).alias("t")).groupBy("series").agg(F.sum(F.col("t") * (F.col("t") - 1) * (2 * F.col("t") + 5)).alias("tied"))
    x = s.join(n, "series").join(t, "series").filter(F.col("n") >= least)
    var = (F.col("n") * (F.col("n") - 1) * (2 * F.col("n") + 5) - (F.col("tied") if ties else F.lit(0))) / 18.0
    z = F.when(var <= 0, 0.0).when(F.col("s") > 0, (F.col("s") - 1) / F.sqrt(var)).when(F.col("s") < 0, (F.col("s") + 1) / F.sqrt(var)).otherwise(0.0)
    return x.select("series", "n", "s", z.alias("z")).withColumn("p", erfc(F.abs("z") / F.sqrt(F.lit(2.0)))).withColumn("trend", (F.col("p") < alpha).cast("int"))


def western_electric(d: DataFrame) -> DataFrame:
    """(series, idx, rule): the window's last point for six rules on MAD-scaled sigma: one beyond 3, two of three beyond 2,
    four of five beyond 1 (one side), eight on one side, six rising or falling, fourteen alternating."""
    d = with_mad(d).withColumn("sd", F.greatest(F.col("mad") * 1.4826, F.lit(1e-9))).withColumn("u", (F.col("value") - F.col("med")) / F.col("sd"))
    step = F.signum(F.col("value") - F.lag("value").over(_order()))
    d = d.withColumn("step", step).withColumn("turn", (F.col("step") * F.lag("step").over(_order()) < 0).cast("int"))
    last = lambda k: _order().rowsBetween(1 - k, 0)
    over = lambda cond, k: F.sum(cond.cast("int")).over(last(k))
    u, full = F.col("u"), lambda k: F.count(F.lit(1)).over(last(k)) == k
    rules = [
        (1, F.abs(u) > 3),
        (2, full(3) & ((over(u > 2, 3) >= 2) | (over(u < -2, 3) >= 2))),
        (3, full(5) & ((over(u > 1, 5) >= 4) | (over(u < -1, 5) >= 4))),
        (4, full(8) & ((over(u > 0, 8) == 8) | (over(u < 0, 8) == 8))),
        (5, full(6) & ((over(F.col("step") > 0, 5) == 5) | (over(F.col("step") < 0, 5) == 5))),
        (6, full(14) & (F.sum("turn").over(last(12)) == 12)),
    ]
    d = d.select("series", "idx", F.array(*[F.when(c, F.lit(k)) for k, c in rules]).alias("hits"))
    return d.select("series", "idx", F.explode("hits").alias("rule")).filter(F.col("rule").isNotNull())


def cusum(d: DataFrame, drift: float = 0.5, threshold: float = 4.0) -> DataFrame:
    """Two-sided cumulative sums of standardised values, reset to 0 at a signal: a fold over each series in order. A series
    is one row here: metric series are short by nature."""
    d = with_mad(d).withColumn("u", (F.col("value") - F.col("med")) / F.greatest(F.col("mad") * 1.4826, F.lit(1e-9)))
    one = d.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("idx", "u"))).alias("xs"))
    start = F.struct(F.lit(0.0).alias("hi"), F.lit(0.0).alias("lo"), F.array().cast("array<struct<idx:bigint,side:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        hi, lo = F.greatest(F.lit(0.0), s["hi"] + x["u"] - drift), F.greatest(F.lit(0.0), s["lo"] - x["u"] - drift)
        hit = F.when(hi > threshold, 1).when(lo > threshold, -1)
        more = F.when(hit.isNotNull(), F.concat(s["out"], F.array(F.struct(x["idx"].cast("long").alias("idx"), hit.cast("int").alias("side"))))).otherwise(s["out"])
        return F.struct(F.when(hit.isNotNull(), 0.0).otherwise(hi).alias("hi"), F.when(hit.isNotNull(), 0.0).otherwise(lo).alias("lo"), more.alias("out"))

    return one.select("series", F.explode(F.aggregate("xs", start, step)["out"]).alias("h")).select("series", F.col("h.idx").alias("idx"), F.col("h.side").alias("side"))


def lag_deltas(d: DataFrame) -> DataFrame:
    """Step from the point before, and its direction."""
    d = d.withColumn("delta", F.col("value") - F.lag("value").over(_order())).filter(F.col("delta").isNotNull())
    return d.select("series", "idx", "value", "delta", F.when(F.col("delta") > 0, "up").when(F.col("delta") < 0, "down").otherwise("flat").alias("direction"))


def rate_of_change(d: DataFrame, least: float = 0.2) -> DataFrame:
    """Points at least `least` away from the one before, relatively."""
    d = d.withColumn("before", F.lag("value").over(_order()))
    return d.filter(F.col("before") != 0).withColumn("rate", (F.col("value") - F.col("before")) / F.abs("before")).filter(F.abs("rate") >= least).select("series", "idx", "rate")


def moving_average(d: DataFrame, w: int = 5) -> DataFrame:
    """Mean of the `w` points before each point."""
    return d.select("series", "idx", "value", F.avg("value").over(_order().rowsBetween(-w, -1)).alias("mean"))


def forecast_steps(fits: DataFrame, last: DataFrame, limit: float) -> DataFrame:
    """Whole steps until a series on its slope passes `limit`; null if it moves away."""
    d = fits.join(last, "series")
    gap = F.lit(limit) - F.col("value")
    return d.select("series", "value", F.when((F.col("slope") != 0) & (gap / F.col("slope") >= 0), F.ceil(gap / F.col("slope"))).cast("long").alias("steps"))


def latest(d: DataFrame) -> DataFrame:
    return d.groupBy("series").agg(F.max_by("value", "idx").alias("value"))


def digest(d: DataFrame) -> DataFrame:
    """The latest value against the one before."""
    d = d.withColumn("before", F.lag("value").over(_order())).withColumn("n", F.row_number().over(Window.partitionBy("series").orderBy(F.desc("idx"))))
    return d.filter("n = 1").select("series", "value", "before", (F.col("value") - F.col("before")).alias("delta"))
