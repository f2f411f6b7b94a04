"""Session settings and helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BROADCAST_BYTES_KEY = "spark.xspace.broadcastBytes"
DEFAULT_BROADCAST_BYTES = 128 * 1024 * 1024


def broadcast_limit(spark: SparkSession) -> int:
    """Largest vector table, in bytes, that may be shipped whole to every task."""
    return int(spark.conf.get(BROADCAST_BYTES_KEY, str(DEFAULT_BROADCAST_BYTES)))


def parallelism(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; tests without one get a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="xspace-ckpt-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Lost executors then cost no recomputation. Parquet rather than an RDD
    checkpoint: later counts and id-only steps skip the vectors, and the planner
    knows the size.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give a file scan with fewer input partitions than cores one task per core.

    Only for plain scans of files too small to split; larger inputs already
    arrive as many partitions and keep them.
    """
    cores = parallelism(df.sparkSession)
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
