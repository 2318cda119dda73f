"""Operators over change history: (commit_id, file_id, lines_added) rows and (id, author, ts) commits.

All are pure relational plans: pairs are made per commit after the 2..100 file bound, counts are pre-aggregated, and nothing
reads the wall clock (`as_of` is an argument).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import tasks_for
from ..functions.pairs import listed, paired
from ..functions.scalars import clamp


def touched(changes: DataFrame) -> DataFrame:
    """Distinct (commit_id, file_id); files that aren't indexed (null) play no part."""
    return changes.filter(F.col("file_id").isNotNull()).select("commit_id", "file_id").distinct()


def bounded(changes: DataFrame, least: int = 2, most: int = 100) -> DataFrame:
    """touched() of commits with `least` to `most` distinct files: the bound is part of the semantics and keeps pairs linear."""
    t = touched(changes)
    n = t.groupBy("commit_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(least, most))
    return t.join(n.select("commit_id"), "commit_id", "left_semi")


def _dealt(changes: DataFrame) -> DataFrame:
    """touched(), by commit. Rows of a commit seldom repeat, so they are dealt out before they are made distinct, to tasks by their
    number; what shares this shares its shuffle."""
    c = changes.filter(F.col("file_id").isNotNull()).select("commit_id", "file_id")
    return c.repartition(tasks_for(c), "commit_id").distinct()


def _gathered(changes: DataFrame, least: int, most: int) -> DataFrame:
    """(commit_id, n, fs) of commits of `least` to `most` files, in order. The first `most` + 1 files of a commit tell."""
    place = F.row_number().over(Window.partitionBy("commit_id").orderBy("file_id"))
    few = _dealt(changes).withColumn("place", place).filter(F.col("place") <= most + 1)
    return few.groupBy("commit_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("file_id")).alias("fs")).filter(F.col("n").between(least, most))


def cochange_pairs(changes: DataFrame, least: int = 2, most: int = 100) -> DataFrame:
    """(file_id_a, file_id_b, cochange_count) with a < b. One shuffle of changes by commit: its files are gathered, never more
    than `most` + 1 of them, and its pairs exploded there; one of pairs, to as many tasks, where they are counted."""
    files = _gathered(changes, least, most)
    one = files.select("fs", F.explode("fs").alias("file_id_a"))
    pairs = one.select("file_id_a", F.explode(F.filter("fs", lambda x: x > F.col("file_id_a"))).alias("file_id_b"))
    pairs = pairs.repartition(tasks_for(changes.select("commit_id", "file_id")), "file_id_a", "file_id_b")
    return pairs.groupBy("file_id_a", "file_id_b").agg(F.count(F.lit(1)).alias("cochange_count"))


def symmetrized(pairs: DataFrame) -> DataFrame:
    """(file_id, partner, cochange_count) both ways round."""
    p = pairs.select(F.col("file_id_a").alias("file_id"), F.col("file_id_b").alias("partner"), "cochange_count")
    return p.unionByName(p.select(F.col("partner").alias("file_id"), F.col("file_id").alias("partner"), "cochange_count"))


def cochange_entropy(pairs: DataFrame) -> DataFrame:
    """Normalised Renyi entropy of order 2 over a file's partners; 0 with one partner."""
    s = symmetrized(pairs)
    agg = s.groupBy("file_id").agg(F.sum(F.col("cochange_count") * F.col("cochange_count")).alias("q"), F.sum("cochange_count").alias("t"), F.count(F.lit(1)).alias("partners"))
    h = F.when(F.col("partners") > 1, -F.log2(F.col("q") / (F.col("t") * F.col("t"))) / F.log2("partners")).otherwise(0.0)
    return agg.select("file_id", "partners", h.alias("entropy"))


def file_stats(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """(file_id, commit_count, total_churn, distinct_authors)."""
    c = changes.filter(F.col("file_id").isNotNull()).join(commits.select(F.col("id").alias("commit_id"), "author"), "commit_id")
    return c.groupBy("file_id").agg(F.count_distinct("commit_id").alias("commit_count"), F.sum(F.col("lines_added") + F.col("lines_removed")).alias("total_churn"), F.count_distinct("author").alias("distinct_authors"))


def commit_counts(changes: DataFrame) -> DataFrame:
    return _dealt(changes).groupBy("file_id").agg(F.count(F.lit(1)).alias("commits"))


def coupling(pairs: DataFrame, counts: DataFrame, total: Column | int | DataFrame) -> DataFrame:
    """Adds strength = co / mean(commits), lift = co N / (ca cb) and normalised pointwise mutual information."""
    ca, cb = counts.select(F.col("file_id").alias("file_id_a"), F.col("commits").alias("ca")), counts.select(F.col("file_id").alias("file_id_b"), F.col("commits").alias("cb"))
    d = pairs.join(ca, "file_id_a").join(cb, "file_id_b")
    if isinstance(total, DataFrame):
        d, n = d.crossJoin(F.broadcast(total.toDF("total"))), F.col("total")  # one row
    else:
        n = total if isinstance(total, Column) else F.lit(total)
    co = F.col("cochange_count").cast("double")
    pxy = co / n
    npmi = F.when(pxy >= 1, 1.0).otherwise(F.log(co * n / (F.col("ca") * F.col("cb"))) / -F.log(pxy))
    return d.select("file_id_a", "file_id_b", "cochange_count", "ca", "cb", (co / ((F.col("ca") + F.col("cb")) / 2)).alias("strength"), (co * n / (F.col("ca") * F.col("cb"))).alias("lift"), npmi.alias("npmi"))


def dark_matter(coupled: DataFrame, file_edges: DataFrame, least: int = 3, npmi: float = 0.3) -> DataFrame:
    """Pairs that change together without a structural edge either way."""
    tied = file_edges.select(F.least("src", "dst").alias("file_id_a"), F.greatest("src", "dst").alias("file_id_b")).distinct()
    return coupled.filter((F.col("cochange_count") >= least) & (F.col("npmi") >= npmi)).join(tied, ["file_id_a", "file_id_b"], "left_anti")


def hyperedges(changes: DataFrame, least: int = 2, most: int = 100) -> DataFrame:
    """(commit_id, file_count, sig_hash): one per commit of 2..100 files; equal sets have equal signatures."""
    b = _gathered(changes, least, most)
    return b.select("commit_id", F.col("n").alias("file_count"), F.substring(F.sha2(F.array_join(F.transform("fs", lambda x: x.cast("string")), "|"), 256), 1, 16).alias("sig_hash"), "fs")


def hyperedge_members(changes: DataFrame) -> DataFrame:
    return hyperedges(changes).select("commit_id", F.posexplode("fs").alias("ordinal", "file_id"))


def surprise(changes: DataFrame, change_set: DataFrame) -> DataFrame:
    """Novelty of a set of files: 1 - best Jaccard with a past commit; 0.5 without overlap; 0 below two files. One row."""
    cs = change_set.select("file_id").distinct()
    size = cs.agg(F.count(F.lit(1)).alias("n"))
    past = bounded(changes)
    hits = past.join(cs, "file_id").groupBy("commit_id").agg(F.count(F.lit(1)).alias("i"))
    sizes = past.join(hits.select("commit_id"), "commit_id", "left_semi").groupBy("commit_id").agg(F.count(F.lit(1)).alias("s"))
    best = hits.join(sizes, "commit_id").crossJoin(F.broadcast(size)).agg(F.max(F.col("i") / (F.col("s") + F.col("n") - F.col("i"))).alias("best"))
    d = best.crossJoin(size)
    return d.select(F.when(F.col("n") < 2, 0.0).when(F.col("best").isNull(), 0.5).otherwise(1 - F.col("best")).alias("surprise"))


def missing_partners(pairs: DataFrame, counts: DataFrame, change_set: DataFrame, least: int = 2, strength: float = 0.3) -> DataFrame:
    """Usual partners of a change set that it lacks, each with its best strength."""
    cs = change_set.select("file_id").distinct()
    s = symmetrized(pairs).filter(F.col("cochange_count") >= least).join(cs, "file_id", "left_semi")
    s = s.join(cs.select(F.col("file_id").alias("partner")), "partner", "left_anti")
    s = s.join(counts.select("file_id", F.col("commits").alias("ca")), "file_id").join(counts.select(F.col("file_id").alias("partner"), F.col("commits").alias("cb")), "partner")
    s = s.withColumn("strength", F.col("cochange_count") / ((F.col("ca") + F.col("cb")) / 2.0)).filter(F.col("strength") >= strength)
    return s.groupBy("partner").agg(F.max("strength").alias("strength"), F.max("cochange_count").alias("cochange_count"))


def fn_coupling(changes: DataFrame, symbols: DataFrame, edges: DataFrame, least: int = 3, most: int = 30) -> DataFrame:
    """Pairs of symbols of different files whose files change together (commits up to `most` files) and that no edge joins.
    File pairs are counted first: all symbol pairs of a file pair have its count. Their symbols are joined as lists, and only
    pairs of files with an edge between are held against edges."""
    pairs = cochange_pairs(changes, 2, most).filter(F.col("cochange_count") >= least)
    tied = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    a, b = symbols.select(F.col("id").alias("a"), F.col("file_id").alias("fa")), symbols.select(F.col("id").alias("b"), F.col("file_id").alias("fb"))
    near = tied.join(a, "a").join(b, "b").select(F.least("fa", "fb").alias("file_id_a"), F.greatest("fa", "fb").alias("file_id_b"), F.lit(True).alias("near")).distinct()
    one = listed(symbols.select(F.col("file_id").alias("file_id_a"), F.col("id").alias("x")), ["file_id_a"], "x", "x")
    two = listed(symbols.select(F.col("file_id").alias("file_id_b"), F.col("id").alias("y")), ["file_id_b"], "y", "y")
    lists = pairs.join(near, ["file_id_a", "file_id_b"], "left").join(one, "file_id_a").join(two, "file_id_b")
    made = lambda d: paired(d, "x", "y", "cochange_count").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "cochange_count")
    return made(lists.filter("near IS NULL")).unionByName(made(lists.filter("near")).join(tied, ["a", "b"], "left_anti"))


def bus_factor(changes: DataFrame, commits: DataFrame, dirs: DataFrame, as_of: DataFrame) -> DataFrame:
    """By folder: authors with over 10 % of churn, authors, normalised entropy, staleness 1 to 3 by days since the last change
    (as_of: one row, `now`), risk = (1 / bus factor) (1 + ln(1 + churn) / 10) staleness."""
    c = changes.join(commits.select(F.col("id").alias("commit_id"), "author", "ts"), "commit_id").join(dirs.select(F.col("id").alias("file_id"), "dir"), "file_id")
    by = c.groupBy("dir", "author").agg(F.sum("lines_added").alias("churn"), F.max("ts").alias("last"))
    w = Window.partitionBy("dir")
    by = by.withColumn("total", F.sum("churn").over(w)).withColumn("p", F.col("churn") / F.greatest(F.col("total"), F.lit(1)))
    d = by.groupBy("dir").agg(F.count_if(F.col("p") > 0.1).alias("major"), F.count(F.lit(1)).alias("authors"), F.max("total").alias("churn"), F.max("last").alias("last"), (-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log2("p")).otherwise(0.0))).alias("h"))
    d = d.crossJoin(F.broadcast(as_of))
    days = (F.col("now") - F.col("last")) / 86400
    stale = F.when(days > 180, 3.0).when(days > 90, 2.0).otherwise(1.0)
    bf = F.greatest(F.col("major"), F.lit(1))
    return d.select("dir", bf.alias("bus_factor"), "authors", "churn", F.when(F.col("authors") > 1, F.col("h") / F.log2("authors")).otherwise(0.0).alias("entropy"), stale.alias("staleness"), ((1.0 / bf) * (1 + F.log1p("churn") / 10) * stale).alias("risk"))


def ownership(changes: DataFrame, commits: DataFrame, dirs: DataFrame, cover: float = 0.8) -> DataFrame:
    """By folder: main author with share, and how many authors (by churn) reach `cover` of it."""
    c = changes.join(commits.select(F.col("id").alias("commit_id"), "author"), "commit_id").join(dirs.select(F.col("id").alias("file_id"), "dir"), "file_id")
    by = c.groupBy("dir", "author").agg(F.sum("lines_added").alias("churn"))
    w, o = Window.partitionBy("dir"), Window.partitionBy("dir").orderBy(F.desc("churn"), "author")
    by = by.withColumn("total", F.sum("churn").over(w)).withColumn("before", F.coalesce(F.sum("churn").over(o.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("rank", F.row_number().over(o))
    return by.groupBy("dir").agg(F.max(F.when(F.col("rank") == 1, F.col("author"))).alias("owner"), F.max(F.when(F.col("rank") == 1, F.col("churn") / F.col("total"))).alias("share"), F.count_if(F.col("before") < F.lit(cover) * F.col("total")).alias("bus_factor"))


def author_familiarity(changes: DataFrame, commits: DataFrame, as_of: DataFrame, rate: float = 0.005) -> DataFrame:
    """(file_id, author, familiarity): churn decayed by age in days, as a share of the file's most familiar author."""
    c = changes.join(commits.select(F.col("id").alias("commit_id"), "author", "ts"), "commit_id").crossJoin(F.broadcast(as_of))
    d = c.groupBy("file_id", "author").agg(F.sum(F.col("lines_added") * F.exp(-rate * (F.col("now") - F.col("ts")) / 86400)).alias("weight"))
    return d.select("file_id", "author", (F.col("weight") / F.max("weight").over(Window.partitionBy("file_id"))).alias("familiarity"))


def minor_contributors(changes: DataFrame, commits: DataFrame, below: float = 0.05) -> DataFrame:
    """(file_id, minor, authors): authors below `below` of a file's churn."""
    c = changes.join(commits.select(F.col("id").alias("commit_id"), "author"), "commit_id").groupBy("file_id", "author").agg(F.sum("lines_added").alias("churn"))
    c = c.withColumn("total", F.sum("churn").over(Window.partitionBy("file_id")))
    return c.groupBy("file_id").agg(F.count_if(F.col("churn") < F.lit(below) * F.col("total")).alias("minor"), F.count(F.lit(1)).alias("authors"))


def brain_methods(metrics: DataFrame, cc: int = 25, lines: int = 100) -> DataFrame:
    return metrics.filter((F.col("cc") >= cc) & (F.col("line_count") >= lines)).select("symbol_id", "cc", "line_count")


def risk_of(factors: list[Column]) -> Column:
    """Noisy-or of factors in [0, 1], as a percentage."""
    left = F.lit(1.0)
    for f in factors:
        left = left * (1 - clamp(f))
    return 100 * (1 - left)
