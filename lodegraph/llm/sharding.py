"""Sharding by rendezvous hashing.

Every shard draws a pseudo-random score for a record's key, stretched by the shard's weight (-w / ln u), and the highest
score wins. A record's shard thus depends only on its key and the shards there are: one more shard can only win records
for itself, and a shard's share of the records follows its weight. No state is kept and nothing is shuffled to decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, numbered, table, text_crc32

#: 2 to the power 52, which doubles hold exactly.
_SPAN = float(1 << 52)


def shard_of(key: Column, weights: list[float], seed: int = 0) -> Column:
    """The number of the winning shard. A null key is a key of its own; ties (which need equal 52-bit draws) go to the
    smaller shard; a shard of weight 0 wins nothing. Raises ValueError unless some weight is positive and all finite."""
    if not any(w > 0 for w in weights) or any(not 0 <= w < float("inf") for w in weights):
        raise ValueError("weights are finite, none below 0, and one above 0")
    text = F.coalesce(key.cast("string"), F.lit("\x00null"))
    best = None
    for j, w in enumerate(weights):
        if w <= 0:
            continue
        u = (F.pmod(F.xxhash64(text, F.lit(seed), F.lit(j)), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(_SPAN)
        one = F.struct((F.lit(float(w)) / -F.log(u)).alias("score"), F.lit(-j).alias("shard"))
        best = [one] if best is None else [*best, one]
    top = F.greatest(*best) if len(best) > 1 else best[0]
    return (-top["shard"]).cast("int")


def with_shards(df: DataFrame, key: str, shards: int | list[float], *, seed: int = 0, name: str = "shard") -> DataFrame:
    """Adds the column `name`. `shards`: how many of equal weight, or the weights. A projection: no shuffle, any columns,
    empty tables stay empty, and repeated rows of a key share its shard."""
    weights = [1.0] * shards if isinstance(shards, int) else list(shards)
    return df.withColumn(name, shard_of(F.col(key), weights, seed))


def with_slots(df: DataFrame, shard: str, order: list[str], *, name: str = "slot") -> DataFrame:
    """Adds a gapless place from 0 inside each shard. A shard's rows are numbered in hash buckets of bounded size, equal rows too."""
    return numbered(df, [shard], order, name)


def write_shards(df: DataFrame, key: str, shards: int | list[float], path: str, *, files_per_shard: int = 1, seed: int = 0) -> str:
    """Writes each record below `path`/shard=N/. Spark's commit protocol replaces lost tasks' files."""
    s, f = free_name(df, "shard"), free_name(df, "file")
    out = with_shards(df, key, shards, seed=seed, name=s).withColumn(f, F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(files_per_shard)))
    out.repartition(s, f).drop(f).write.partitionBy(s).parquet(path)
    return path


def op3_rendezvous_sharding(spark: SparkSession, sf_dir: str, shards: int = 16) -> DataFrame:
    """All documents by the law `key`: doc_id and the shard count decide. Null texts have size 1; repeated rows are kept."""
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    d = docs.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), text_crc32(text).alias("text_crc32"))
    d = with_shards(d, "doc_id", shards)
    d = with_shards(d, "doc_id", shards + 1, name="grown_shard")
    d = with_slots(d, "shard", ["doc_id", "size", "text_crc32"])
    return d.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


__all__ = ["op3_rendezvous_sharding", "shard_of", "with_shards", "with_slots", "write_shards"]
