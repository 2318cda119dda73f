"""Cutting the lineage of iterative plans in the cluster's shared folder.

Staged tables and checkpoints live below `spark.checkpoint.dir`, which driver and executors share. Where it is unset, a local
master gets a folder of its own (tests); on a cluster that would be a folder that executors can't read, so it raises.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_BASES: dict[str, str] = {}
_PATHS: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`; a folder of our own only where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().conf().get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _BASES.setdefault("unset", tempfile.mkdtemp(prefix="lodegraph-"))
    return found.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder; quietly, as the session may have ended (the folder is then the cluster's to clean)."""
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001
        pass


def work_dir(spark: SparkSession) -> str:
    """This application's own folder below the shared one; removed when the process ends."""
    key = spark.sparkContext.applicationId
    if key not in _BASES:
        _BASES[key] = f"{shared_dir(spark)}/lodegraph-{key}-{uuid.uuid4().hex[:8]}"
        atexit.register(drop_path, spark, _BASES[key])
    return _BASES[key]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str = "staged") -> DataFrame:
    """Writes `df` as Parquet in the shared folder and reads it again: cuts the lineage, survives lost executors,
    and gives the planner true sizes to choose joins by."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Deletes the files of staged tables that nothing reads any more (no plan built on them may run later)."""
    for df in frames:
        path = getattr(df, "_staged_path", None)
        if path:
            drop_path(df.sparkSession, path)


def cut(df: DataFrame) -> DataFrame:
    """Materialises `df` by checkpoint() in the shared folder: columnar files aren't written, so short rounds stay cheap."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def tasks_for(df: DataFrame, each: int = 1 << 20) -> int:
    """A number of partitions by the planner's estimate of `df`'s bytes, at least that of shuffles; of shuffles where the planner
    doesn't know. For what takes more memory than its compressed bytes tell, by which partitions are put together."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return least if size > 1 << 50 else max(least, min(size // each, 20_000))
