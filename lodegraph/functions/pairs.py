"""Many-to-many joins whose output is larger than their input by far, dealt out by output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ids in a list: a pair of lists makes up to a million rows.
A_LIST = 1000


def listed(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """(keys, `out`): the values of equal keys in lists of at most A_LIST structs (v), duplicates and nulls kept."""
    row = F.row_number().over(Window.partitionBy(*keys).orderBy(value)) - 1
    d = df.select(*keys, value, F.floor(row / A_LIST).alias(f"{out}_no"))
    return d.groupBy(*keys, f"{out}_no").agg(F.collect_list(F.struct(F.col(value).alias("v"))).alias(out))


def dealt(lists: DataFrame, *by: str) -> DataFrame:
    """`lists` in a named number of partitions: the planner would judge by their few bytes and make all their pairs in one task."""
    n = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lists.repartition(4 * n, *by)


def paired(lists: DataFrame, x: str, y: str, *kept: str) -> DataFrame:
    """(kept, x, y) of all pairs of the lists x and y of a row; a pair of lists is a step of one task."""
    d = dealt(lists, *[c for c in lists.columns if c not in (x, y)])
    return d.select(*kept, F.explode(x).alias(x), y).select(*kept, F.col(x)["v"].alias(x), F.explode(y).alias(y)).select(*kept, x, F.col(y)["v"].alias(y))
