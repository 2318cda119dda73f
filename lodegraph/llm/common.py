"""Shared helpers: table reading, staged tables in the cluster's shared folder, scale-free row numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import discard, drop_path, new_path, shared_dir, staged, work_dir

#: Characters between words; a word is a longest run of anything else.
SPACES = " \t\n\x0b\x0c\r"


__all__ = ["SPACES", "discard", "drop_path", "free_name", "kept_where", "new_path", "numbered", "shared_dir", "staged", "table", "text_crc32", "word_count", "words", "work_dir"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str, *, prefix: bool = False) -> str:
    """`wanted`, with underscores added until no column of `df` is called that, or starts with it (case ignored)."""
    have = [c.lower() for c in df.columns]
    while any(c.startswith(wanted.lower()) if prefix else c == wanted.lower() for c in have):
        wanted = f"_{wanted}"
    return wanted


def kept_where(df: DataFrame, verdict: str) -> DataFrame:
    """The rows whose column `verdict` is true. The row number, which the optimizer can't move, keeps the filter above the
    projection that makes the verdict; pushed below, it would copy every statistic into every rule that uses it."""
    row = free_name(df, "row")
    return df.withColumn(row, F.monotonically_increasing_id()).filter(F.col(verdict) & (F.col(row) >= 0)).drop(row)


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text; null gives an empty array."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES)), " "), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def text_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; null counts as no bytes."""
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def numbered(df: DataFrame, groups: list[str], order: list[str], name: str, per_task: int = 200_000, least: int = 64) -> DataFrame:
    """Adds `name`: a gapless number from 0 within each group, whatever the group's size.

    A group is dealt out over as many hash buckets as its count asks for (`per_task` rows each), numbered inside each
    bucket, and shifted by the counts of the buckets before it. Every row has a staged serial number that is hashed too, so
    equal rows spread like any others and no task holds more than a bucket. A row's number may differ between runs.
    """
    b, cnt, off, row = (free_name(df, x) for x in ("bucket", "cnt", "off", "row"))
    df = staged(df.withColumn(row, F.monotonically_increasing_id()), "rows")
    buckets = max(least, -(-df.count() // per_task))
    keyed = df.withColumn(b, F.pmod(F.xxhash64(F.lit(7), *order, row), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy(*groups, b).agg(F.count(F.lit(1)).alias(cnt))
    before = Window.partitionBy(*groups).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*groups, b, F.coalesce(F.sum(cnt).over(before), F.lit(0)).alias(off))
    offsets = staged(offsets, "offsets")
    ranked = keyed.withColumn(name, F.row_number().over(Window.partitionBy(*groups, b).orderBy(*order, row)) - 1)
    on = [ranked[g].eqNullSafe(offsets[g]) for g in [*groups, b]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return ranked.join(offsets, cond, "left").select(*[ranked[c] for c in df.columns if c != row], (ranked[name] + offsets[off]).cast("long").alias(name))
