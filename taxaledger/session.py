"""Session defaults and the one way this library cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "taxaledger", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine.

    On a cluster the caller brings its own session; nothing in the library
    depends on these settings.
    """
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Name parsing is heavy for its few bytes: keep small inputs on all cores.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.files.openCostInBytes", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's checkpoint folder.

    ``spark.checkpoint.dir``, or what ``SparkContext.setCheckpointDir`` was
    given, names storage that every executor sees. Only where both are unset in
    a session on one machine a temporary folder takes their place; on a cluster
    each executor would write to its own disk, so there it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    held = spark.conf.get("taxaledger.local.dir", None)
    if held is None:
        held = tempfile.mkdtemp(prefix="taxaledger-")
        spark.conf.set("taxaledger.local.dir", held)
    return held


def run_folder(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{shared_folder(spark)}/taxaledger-{spark.sparkContext.applicationId}"


def drop_stages(spark: SparkSession) -> None:
    """Delete this application's intermediate tables.

    To be called once all results are written: a result that was only planned
    still reads them.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def write_stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Used where several consumers need one result. Unlike a cached block, the
    written table survives the loss of executors, keeps column pruning, and
    tells the planner its real size.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
