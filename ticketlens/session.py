"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "ticketlens", cores: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; ``cores`` asks for local mode."""
    builder = SparkSession.builder.appName(app)
    if cores is not None:
        builder = (
            builder.master(f"local[{cores}]")
            .config("spark.sql.shuffle.partitions", str(cores))
            .config("spark.ui.enabled", "false")
            .config("spark.driver.memory", "12g")
        )
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> None:
    """Dates are derived from zone-less timestamps, so the session zone must be UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see. The cluster names it in ``spark.checkpoint.dir``; a
    machine-local one is made only in local mode, where driver and executors share a disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="ticketlens-")
    return _local_folders[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder for one run of one job."""
    return f"{shared_folder(spark)}/ticketlens/{label}-{uuid.uuid4().hex[:12]}"


def spread(scan: DataFrame) -> DataFrame:
    """A table scan over at least as many tasks as there are cores. Text work is heavy per byte,
    so a table of few files is dealt out first; a table of many files is left as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def materialise(df: DataFrame, label: str, heavy: bool = False, at_once: int | None = None) -> DataFrame:
    """Write ``df`` once below the shared folder and read it back. Unlike a cache, the table
    outlives lost executors, and later steps neither recompute nor re-plan what produced it.
    ``heavy``: the rows are going to cost much work each. ``at_once``: rows are long, and no more of them are
    to be held at a time (a row group of the file is held whole, and is not cut before its 100th row)."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.mode("overwrite")
    if at_once is not None:
        writer = writer.option("parquet.block.row.count.limit", str(at_once))
    writer.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    return spread(table) if heavy else table
