"""Session construction and the shared folder used to cut lineage.

A cluster names its shared, reliable folder in ``spark.checkpoint.dir``.
We read it from the session and only create our own folder when it is
unset and the master is local (tests, benchmarks on one machine).
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
    "spark.ui.enabled": "false",
    # superseded per-epoch checkpoints are deleted once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "latentforge", driver_memory: str = "16g",
                  extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = driver_memory
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; set one only for local masters."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not _is_local(spark):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; a cluster run needs a shared "
            "folder for checkpoints and derived tables")
    local_dir = tempfile.mkdtemp(prefix="latentforge-ckpt-", dir="/tmp")
    sc.setCheckpointDir(local_dir)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder for derived tables, inside the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return base.rstrip("/") + "/tables/" + name


def new_scratch_path(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Writes ``df`` as Parquet and returns it re-read: later plans start at
    the files, which every executor can read."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder this library wrote (on any Hadoop file system)."""
    if "/tables/" not in path:
        raise ValueError("only derived tables are deleted: " + path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def path_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files under a folder (on any Hadoop file system)."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(
        target).getLength()


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage. Spark deletes shuffle files and cached blocks
    that nothing refers to any more only then, which may otherwise be half an hour later."""
    gc.collect()
    spark._jvm.System.gc()


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint (never a machine-local one)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def read_or_build(spark: SparkSession, path: str, build) -> None:
    """Write ``build(path)`` once; later calls reuse the files.

    Reuse requires the job-commit marker ``_SUCCESS``, so a folder left by
    an interrupted write is rebuilt (``build`` writes with overwrite).
    """
    from pyspark.errors import AnalysisException
    try:
        spark.read.text(path.rstrip("/") + "/_SUCCESS").limit(1).collect()
        return
    except AnalysisException:
        pass
    build(path)
