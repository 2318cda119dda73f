"""Mixing sources to target weights by Sainte-Lague apportionment; DataFrame operations only.

1. Every source has a weight and shares the wanted total by it; no target passes `most` times what its source has, and the
   excess is shared again (the water level that solves this is found by one sorted running sum over sources).
2. The total is cut into blocks of equal tokens. Sources get blocks by the highest quotients target / (2k + 1), and each
   source's blocks go to its shards (hash cells of bounded size) by the same rule, so quotas are integers everywhere.
3. In a shard, documents follow each other in a seeded order; its blocks are taken `quota div blocks` times each, and
   `quota mod blocks` of them, chosen by a seeded permutation, once more. A document gets the words of its blocks.

Defined results: a null text has size 0 and is never taken; null sources are one source, ordered last; sources of size 0 get
target 0; an empty table stays empty; repeated rows are rows of their own, ordered beside each other.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, staged, table, word_count

BLOCK = 64  # words
SHARD_WORDS = 131_072
FINE = 65_536  # hash cells of which shards are made
_STEP = 1_000_000_007  # a prime: steps through any smaller number of blocks, each once


def sainte_lague(df: DataFrame, groups: list[str], party: str, votes: str, seats: str, name: str) -> DataFrame:
    """Adds `name`: seats of each party in its group, which shares `seats` (equal in all its rows) by the highest
    quotients votes / (2k + 1); equal quotients go to the smaller party. Only the quotients near the common divisor are
    ranked: seats that every rounding gives are given at once. Without votes or seats, 0."""
    g = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    d = df.withColumn("_all", F.sum(votes).over(g)).withColumn("_n", F.count(F.lit(1)).over(g))
    exact = F.when((F.col("_all") > 0) & (F.col(seats) > 0), F.col(votes) * F.col(seats) / F.col("_all")).otherwise(F.lit(0.0))
    d = d.withColumn("_exact", exact)
    d = d.withColumn("_half", (F.ceil(F.col("_exact") * F.col("_n") / (2 * F.greatest(F.col(seats), F.lit(1)))) + 1).cast("long"))
    d = d.withColumn("_base", F.greatest(F.floor("_exact") - F.col("_half"), F.lit(0)).cast("long"))
    d = d.withColumn("_left", F.col(seats) - F.sum("_base").over(g))
    tries = d.filter(F.col("_exact") > 0).select(*groups, party, votes, "_base", "_left", F.explode(F.sequence(F.col("_base"), F.col("_base") + 2 * F.col("_half") + 1)).alias("_k"))
    tries = tries.withColumn("_rank", F.row_number().over(g.orderBy(F.desc(F.col(votes) / (2 * F.col("_k") + 1)), party, "_k")))
    won = tries.filter(F.col("_rank") <= F.col("_left")).groupBy(*groups, party).agg(F.count(F.lit(1)).alias("_won"))
    keys = [*groups, party]
    won = won.select(*[F.col(k).alias(f"_w{k}") for k in keys], "_won")
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_w{k}")) for k in keys])
    return d.join(won, on, "left").select(*df.columns, (F.col("_base") + F.coalesce(F.col("_won"), F.lit(0))).alias(name))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """From (source, source_size): adds pos (order by code point, null last), weight (`weights`, repeating) and target."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    d = sizes.withColumn("pos", F.row_number().over(order) - 1)
    ws = F.array(*[F.lit(float(w)) for w in weights])
    d = d.withColumn("weight", F.element_at(ws, (F.col("pos") % len(weights) + 1).cast("int")))
    d = d.withColumn("_cap", F.col("source_size") * F.lit(float(most))).withColumn("_at", F.col("_cap") / F.col("weight"))
    one = Window.partitionBy(F.lit(0))
    by = one.orderBy("_at", "pos")
    d = d.withColumn("_below", F.coalesce(F.sum("_cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    d = d.withColumn("_rest", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
    d = d.withColumn("_level", (F.sum("source_size").over(one) * F.lit(float(share)) - F.col("_below")) / F.col("_rest"))
    first = F.min(F.when(F.col("_at") >= F.col("_level"), F.struct(F.col("_at"), F.col("pos"), F.col("_level")))).over(one)
    d = d.withColumn("_water", first["_level"])
    target = F.when(F.col("_water").isNull() | (F.col("_at") <= F.col("_water")), F.col("_cap")).otherwise(F.col("weight") * F.col("_water"))
    return d.select("source", "source_size", "pos", "weight", target.alias("target"))


def _draw(key: Column, seed: int) -> Column:
    return F.md5(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), "UTF-8"))


def _number(hexes: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(hexes, start, digits), 16, 10).cast("long")


def with_mix(df: DataFrame, key: str, size: str, source: str, *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = BLOCK, seed: int = 1) -> tuple[DataFrame, dict[str, str]]:
    """`df` with columns for source size, target, taken, and what block_times() needs; the dict gives the added columns'
    names, which no column of `df` has. Rows are shuffled once, by shard."""
    p = "_mix_"
    while any(x.lower().startswith(p) for x in df.columns):
        p = f"_{p}"
    c = {k: f"{p}{k}" for k in ("draw", "fine", "source_size", "target", "taken", "shard", "place", "blocks", "full", "extra", "shift")}
    d = df.withColumn(c["draw"], _draw(F.col(key), seed)).withColumn(c["fine"], _number(F.col(c["draw"]), 1, 8) % FINE)
    cells = staged(d.groupBy(F.col(source).alias("source"), F.col(c["fine"]).alias("fine")).agg(F.sum(size).cast("long").alias("words")), "cells")
    srcs = source_targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    srcs = srcs.withColumn("_all", F.sum("source_size").over(Window.partitionBy(F.lit(0))))
    srcs = srcs.withColumn("seats", F.round(F.col("_all") * F.lit(float(share)) / block).cast("long"))
    srcs = sainte_lague(srcs, [], "pos", "target", "seats", "quota").withColumn("shards", F.least(F.lit(FINE), F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("source_size") / SHARD_WORDS))))).cast("long"))
    srcs = staged(srcs.select("source", "source_size", "target", "pos", "quota", "shards"), "sources")
    at = cells.withColumnRenamed("source", "_csource").join(srcs, F.col("_csource").eqNullSafe(F.col("source"))).select("pos", "quota", (F.col("fine") % F.col("shards")).alias("shard"), "words")
    at = at.groupBy("pos", "quota", "shard").agg(F.sum("words").alias("words"))
    at = sainte_lague(at, ["pos"], "shard", "words", "quota", "part")
    at = at.withColumn("blocks", F.ceil(F.col("words") / F.lit(block)).cast("long")).withColumn("part", F.least(F.col("part"), (F.col("blocks") * int(most)).cast("long")))
    n = F.greatest(F.col("blocks"), F.lit(1))
    at = at.select(F.col("pos").alias(f"{p}pos_key"), F.col("shard").alias(f"{p}shard_key"), n.alias(c["blocks"]), F.floor(F.col("part") / n).cast("long").alias(c["full"]), (F.col("part") % n).alias(c["extra"]), (_number(F.md5(F.encode(F.concat_ws(":", F.lit(str(seed)), "pos", "shard"), "UTF-8")), 1, 8) % n).alias(c["shift"]))
    at = staged(at, "quotas")
    srcs = srcs.select(F.col("source").alias(f"{p}source_key"), F.col("source_size").alias(c["source_size"]), F.col("target").alias(c["target"]), F.col("pos").alias(f"{p}spos_key"), F.col("shards").alias(f"{p}shards_key"))
    d = d.join(srcs, d[source].eqNullSafe(srcs[f"{p}source_key"]), "left").withColumn(c["shard"], F.col(c["fine"]) % F.col(f"{p}shards_key"))
    d = d.join(at, (F.col(f"{p}spos_key") == F.col(f"{p}pos_key")) & (F.col(c["shard"]) == F.col(f"{p}shard_key")), "left")
    order = Window.partitionBy(f"{p}spos_key", c["shard"]).orderBy(c["draw"], key, size).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn(c["place"], F.coalesce(F.sum(size).over(order), F.lit(0)).cast("long"))
    first, end = F.col(c["place"]), F.col(c["place"]) + F.col(size)
    spans = F.sequence(F.floor(first / block).cast("long"), F.floor((end - 1) / block).cast("long"))
    taken = F.aggregate(spans, F.lit(0).cast("long"), lambda a, b: a + (F.least(end, (b + 1) * block) - F.greatest(first, b * block)) * block_times(b, c))
    d = d.withColumn(c["taken"], F.when(F.col(size) > 0, taken).otherwise(F.lit(0)).cast("long"))
    return d.drop(f"{p}source_key", f"{p}spos_key", f"{p}shards_key", f"{p}pos_key", f"{p}shard_key"), c


def block_times(b: Column, c: dict[str, str]) -> Column:
    """How often the shard's block number `b` is taken."""
    mixed = F.pmod(b * F.lit(_STEP) + F.col(c["shift"]), F.col(c["blocks"]))
    return F.col(c["full"]) + F.when(mixed < F.col(c["extra"]), 1).otherwise(0)


def mixed_texts(docs: DataFrame, *, block: int = BLOCK, seed: int = 1) -> DataFrame:
    """The mix itself, with the columns of `docs`: a document's n-th row holds, unchanged and in their order, the words
    (with the space after them) of its blocks that are taken at least n times. n_chars follows the text."""
    size = free_name(docs, "size")
    d, c = with_mix(docs.withColumn(size, word_count(F.col("text"))), "doc_id", size, "source", block=block, seed=seed)
    first, end = F.col(c["place"]), F.col(c["place"]) + F.col(size)
    spans = F.sequence(F.floor(first / block).cast("long"), F.floor((end - 1) / block).cast("long"))
    n = free_name(d, "copy")
    d = d.filter(F.col(c["taken"]) > 0).withColumn(n, F.explode(F.sequence(F.lit(1), F.least(F.lit(2), F.ceil(F.col(c["taken"]) / 1)).cast("int"))))
    chosen = F.filter(spans, lambda b: block_times(b, c) >= F.col(n))
    units = F.split(F.col("text"), "(?<=[\\x20\\x09-\\x0D])(?=[^\\x20\\x09-\\x0D])")
    led = F.col("text").rlike("^[\\x20\\x09-\\x0D]").cast("int")  # white space before the first word is a unit of its own
    parts = F.transform(chosen, lambda b: F.slice(units, (F.greatest(first, b * block) - first + 1 + led).cast("int"), (F.least(end, (b + 1) * block) - F.greatest(first, b * block)).cast("int")))
    text = F.when(F.size(chosen) == F.size(spans), F.col("text")).otherwise(F.array_join(F.flatten(parts), ""))
    d = d.filter(F.size(chosen) > 0).withColumn("text", text)
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.length("text").cast("long"))
    return d.select(*docs.columns)


def op8_sainte_lague_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: weights 3, 1, 2 by source order, 150 % of all words, no document over twice its size."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    d, c = with_mix(staged(docs, "sized"), "doc_id", "size", "source")
    return d.select("doc_id", "size", F.col(c["source_size"]).alias("source_size"), F.col(c["target"]).alias("target"), F.col(c["taken"]).alias("taken"))
