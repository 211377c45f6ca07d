"""Session settings the jobs are written for."""

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # plans here hold hundreds of column expressions; recording a call site for each slows their construction
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(master: str | None = None, app: str = "moneytrail", **extra) -> SparkSession:
    """A session with the package settings; on a cluster leave ``master`` to the submit command."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str | None:
    """Shared folder for checkpoints and streaming state, as the session names it."""
    return spark.conf.get("spark.checkpoint.dir", None) or fallback


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Only a local session may name none."""
    folder = checkpoint_dir(spark) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="moneytrail-")


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any file system Spark can reach."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def stable(df: DataFrame) -> DataFrame:
    """Rows an iterative job reads many times: checkpointed in the shared folder if the session names one, so that
    neither a lost executor nor a long lineage repeats the work; otherwise cached."""
    folder = checkpoint_dir(df.sparkSession)
    if folder:
        context = df.sparkSession.sparkContext
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(folder)
        return df.checkpoint()
    return df.persist(StorageLevel.MEMORY_AND_DISK)
