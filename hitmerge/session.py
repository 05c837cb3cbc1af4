"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Sizes follow the data: AQE merges small shuffle partitions and splits hot ones, and a join
# side is broadcast only while its measured size is under autoBroadcastJoinThreshold.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Comparing two texts is much work for few bytes: do not merge such partitions by size alone.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.autoBroadcastJoinThreshold": "32m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Recording the Python call site of every column costs more than planning these queries.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "hitmerge", **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: the one the session names, or a local one in local mode only."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="hitmerge-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Reliable checkpoint: survives lost executors, unlike a local one.

    :param tasks: at most so many tasks compute the partitions, one after the other, and write a file each. On a local file system
        without Hadoop's native library each file starts several processes (``chmod``), which many small files make dear.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return (df if tasks is None else df.coalesce(tasks)).checkpoint(eager=True)


def fewer_tasks(spark: SparkSession) -> int:
    """Tasks enough for the cores here, and more the more partitions a shuffle has."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)


def bucketed(df: DataFrame, column: str, buckets: int) -> tuple[DataFrame, str]:
    """The rows as a table in the folder of checkpoints, dealt by ``column`` once: joins on it shuffle the other side only.

    :return: the table and its name, to be dropped when no longer read
    """
    spark, name = df.sparkSession, f"kept_{uuid.uuid4().hex}"
    df.repartition(buckets, column).write.format("parquet").bucketBy(buckets, column) \
        .option("path", f"{ensure_checkpoint_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name), name
