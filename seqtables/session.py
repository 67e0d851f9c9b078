"""Session defaults and the shared folders that jobs cut lineage or stage files in."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: str = "*", partitions: int = 8, app: str = "seqtables") -> SparkSession:
    """A single-machine session for tests and the benchmark. Clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session that names none (a test) gets a temporary folder; on a cluster, whose
    executors would not share it, that is an error.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not named:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors of {master} share")
        named = tempfile.mkdtemp(prefix="seqtables-")
        spark.conf.set(CHECKPOINT_CONF, named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage and return it without its lineage.

    Later reads see the same rows in the same partitions even when executors are lost.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` written as packed Parquet in the shared folder and read again, and where; takes a part of a checkpoint's room."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


_released = 0.0


def release(spark: SparkSession, pause: float = 4.0) -> None:
    """Have Spark delete the shuffle files of tables that nothing refers to any more.

    Spark deletes them once the driver's collector finds their tables gone (``spark.cleaner.periodicGC.interval``,
    30 minutes by default). A job of many short rounds collects little garbage and would keep them all.
    Calls within ``pause`` seconds of the last one do nothing.
    """
    global _released
    if time.monotonic() - _released >= pause:
        for _ in range(2):  # Python's references reach the driver's collector with a delay
            gc.collect()
            spark._jvm.System.gc()
            time.sleep(0.1)
        _released = time.monotonic()


def file_system(path: str):
    """The file system of a path or URI and the path in it, for Python workers."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on whichever file system it names."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder that a job wrote for itself."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the input comes in fewer pieces than there are cores.

    A file of one row group is read by one task, which would keep heavy row work there.
    Larger inputs pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scatter(df: DataFrame) -> DataFrame:
    """Small rows that stand for heavy work, over all shuffle partitions.

    Adaptive execution merges partitions by their bytes, which says nothing about the work
    that a pair of ids stands for.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *df.columns)


def stack(*frames: DataFrame, allow_missing: bool = False) -> DataFrame:
    """The rows of all frames, columns matched by name.

    Spark 4.1 lets a union keep the partitioning that its inputs share. Where such a union
    meets reused exchanges it gave wrong rows (see the gene plan's test), so the sessions
    that stack tables plan their unions without it.
    """
    frames[0].sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)
