"""Execution helpers: session defaults, lineage cuts, ordered prefix sums."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F


def session_defaults() -> dict[str, str]:
    """Settings every job here is written for (AQE on, UI off)."""
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # post-shuffle partitions are coalesced towards this size; on a
        # cluster also set coalescePartitions.parallelismFirst=false
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }


def cluster_settings(input_bytes: float, total_cores: int,
                     target_partition_bytes: int = 256 * 1024 ** 2,
                     shuffle_share: float = 0.05) -> dict[str, str]:
    """Partition sizing for a cluster run over ``input_bytes`` of input.

    Scan splits of ``target_partition_bytes`` (``maxPartitionBytes``) keep a
    task's input well inside executor memory. The initial shuffle partition
    count follows the bytes that are shuffled: the aggregates here combine on
    the map side, which leaves ``shuffle_share`` of the input (a parameter:
    measure it on a sample run), one partition per target size and at least
    three waves of the cluster's cores. AQE coalesces smaller shuffles towards
    the advisory size and splits skewed join partitions.
    """
    by_size = int(input_bytes * shuffle_share // target_partition_bytes) + 1
    partitions = max(by_size, 3 * total_cores)
    return {
        **session_defaults(),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_bytes),
    }


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "shelfsight") -> SparkSession:
    """Session for tests and local benchmarking."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "8g"))
    for k, v in session_defaults().items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_ROOT: str | None = None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediates: ``spark.checkpoint.dir`` or
    the folder given to ``SparkContext.setCheckpointDir``. Where neither is
    set, a local master gets a scratch folder (once per process) and any
    other master an error: its executors do not share a local disk."""
    global _LOCAL_ROOT
    sc = spark.sparkContext
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if conf:
        return conf
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _LOCAL_ROOT is None:
        _LOCAL_ROOT = tempfile.mkdtemp(prefix="shelfsight-ckpt-",
                                       dir=os.environ.get("TMPDIR") or "/tmp")
    return _LOCAL_ROOT


def _rdd_checkpoint(df: DataFrame, root: str) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return df.checkpoint(eager=True)


_PARQUET_BAD = set(" ,;{}()\n\t=")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a parquet table under the shared checkpoint
    directory and return a frame that reads it back.

    The lineage is cut (a lost executor re-reads the table instead of
    re-running the plan), the plan runs exactly once (an eager RDD
    checkpoint runs it twice: once to count, once to write), and later
    reads get column pruning and filter pushdown. Frames whose column names
    parquet cannot hold fall back to a reliable ``checkpoint()``."""
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark)
    if any(ch in _PARQUET_BAD for name in df.columns for ch in name):
        return _rdd_checkpoint(df, root)
    path = table_path(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def table_path(spark: SparkSession) -> str:
    """A new folder for a written table, owned by the running job."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/shelfsight-tables/{uuid.uuid4().hex}"
    owned = _OWNED.get()
    if owned is not None:
        owned.append(path)  # before the write: a failed one is cleaned up too
    return path


# Paths of the tables the running job wrote (one list per job and thread).
_OWNED: ContextVar[list[str] | None] = ContextVar("shelfsight_owned_tables", default=None)


@contextmanager
def owned_tables(spark: SparkSession, keep: bool = False):
    """Tables that ``materialize`` writes inside the block belong to it and
    are deleted at its end, also after an error; ``keep`` leaves them after
    success (their reader deletes them with ``drop_tables``). Yields the list
    of paths. Blocks of other threads keep their own lists."""
    paths: list[str] = []
    token = _OWNED.set(paths)
    done = False
    try:
        yield paths
        done = True
    finally:
        _OWNED.reset(token)
        if not (done and keep):
            drop_tables(spark, paths)


def drop_tables(spark: SparkSession, paths: list[str]) -> int:
    """Delete written tables once nothing reads them any more; returns how
    many were there."""
    jvm = getattr(spark.sparkContext, "_jvm", None)
    if jvm is None:
        return 0
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    done = 0
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        done += bool(path.getFileSystem(conf).delete(path, True))
    return done


def rows_before(counts: DataFrame, group: list[str], order, n: str, out: str = "before",
                partitions: int | None = None) -> DataFrame:
    """``counts`` (one row per distinct value of a group, ``n`` rows each) with
    ``out``: how many rows of the group come before the value in ``order``.

    Values are range-partitioned on (group, order) and written once, so a
    group with very many values spans several tasks; a value's result is the
    sum inside its slice plus the totals of the group's earlier slices (one
    row per slice). No group is ever put into one task."""
    size = partitions or int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = materialize(counts.repartitionByRange(size, *[F.col(g).asc() for g in group], order)
                         .withColumn("_pid", F.spark_partition_id()))
    earlier = Window.partitionBy(*group, "_pid").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = sliced.withColumn("_in", F.coalesce(F.sum(n).over(earlier), F.lit(0)))
    slices = sliced.groupBy(*group, "_pid").agg(F.sum(n).alias("_n"))
    above = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_pid").alias("_p"),
                           F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_off"))
    match = [F.col("_pid") == F.col("_p")]
    match += [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    return inside.join(slices, match).select(*counts.columns, (F.col("_in") + F.col("_off")).alias(out))
