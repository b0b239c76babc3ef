"""Session helpers: a tuned local session, table access and the shared work folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MARKED: set[str] = set()


def get_spark(cores: int = 8, app: str = "kelpmill") -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a session on one machine may do without: it gets a
    temporary folder of its own; on a cluster that would be lost or torn apart, so there it is an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.kelpmill.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="kelpmill-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        configured = "file://" + folder
        spark.conf.set("spark.kelpmill.dir", configured)
    return configured.rstrip("/")


def written(df: DataFrame, name: str, partition_by: str | None = None) -> tuple[DataFrame, str]:
    """Writes df to the shared folder and reads it again: the lineage ends there and survives lost executors.

    What a session wrote is removed when it ends; clear() removes it before."""
    spark = df.sparkSession
    path = f"{_run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _run_dir(spark: SparkSession) -> str:
    path = f"{shared_dir(spark)}/kelpmill/{spark.sparkContext.applicationId}"
    if path not in _MARKED:
        _MARKED.add(path)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
    return path


def removed(spark: SparkSession, path: str) -> None:
    """Removes a table of written() that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def clear(spark: SparkSession) -> None:
    """Removes the intermediate tables of this session; frames that read them are of no use any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_run_dir(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
