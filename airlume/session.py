"""Session helpers: where intermediate tables live and how they are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Bytes of input files for one task of a sized exchange; rows take some ten times as much when sorted.
TASK_BYTES = 8 * 1024 * 1024
_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local[*] session may fall back to a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="spark-")
    return _local_folders[app]


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh, unused path below the shared folder."""
    return f"{shared_folder(spark)}/airlume/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table", *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage so that a lost executor costs only a re-read, freezes anything
    that depends on how a shuffle was sampled, and gives Catalyst a real file
    size, so that later joins are broadcast only when the table is known to be
    small.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    """Number of tasks for an explicit repartition ahead of a row expansion."""
    return max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        spark.sparkContext.defaultParallelism,
    )


def sized_width(df: DataFrame, times: int = 1) -> int | None:
    """Number of tasks for an exchange of ``df`` that follows the bytes of the files it is read from.

    None while the session's own number is enough. ``times``: rows made of each row read.
    With a fixed number a task's memory would grow with the table. Sizes of joins are no guide:
    Catalyst multiplies them, so the leaves count.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    read = sum(s for s in sizes if s < 1 << 60)  # rows from elsewhere have no known size
    width = -(-read * times // TASK_BYTES)
    return width if width > shuffle_width(df.sparkSession) else None


def place_by(key: str, *frames: DataFrame, times: int = 1) -> tuple[DataFrame, ...]:
    """The frames dealt by ``key`` over one sized number of tasks, for joins, windows and groups by that key."""
    widths = [w for w in (sized_width(df, times) for df in frames) if w]
    return tuple(df.repartition(max(widths), key) for df in frames) if widths else frames


def remove_intermediates(spark: SparkSession) -> None:
    """Delete what ``materialize`` wrote; results that still read it must be stored first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/airlume")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
