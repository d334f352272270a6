"""Session settings and durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Spark's setting to remove an execution's shuffle files when it ends, else they stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; existing settings are kept."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where that is unset and the master is local."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop, which knows remote stores as well as local folders."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = hadoop_path(spark, path)
    return fs.exists(at)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """The frame as a table in the shared checkpoint folder, and the path of that. It is removed when the driver ends."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # what was shuffled for the table is not needed once it is there
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    fs, at = hadoop_path(spark, path)
    fs.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path), path


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in the shared checkpoint folder; survives the loss of executors.

    What comes back has the size of its files as its statistics, so joins behind it are planned by what is there and
    not by an estimate of the plan before it.
    """
    out, path = stored(df)
    out._stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables that ``durable`` made. No frame that still reads them may be evaluated later."""
    for df in tables:
        fs, at = hadoop_path(df.sparkSession, df._stored_at)
        fs.delete(at, True)


def shuffled(df: DataFrame) -> DataFrame:
    """For a join side with as many rows as there are records, or more: never sent to all tasks as a broadcast.

    Spark estimates an exploded array no larger than the array itself, so its size check can't be left to decide here.
    """
    return df.hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """For a Python function per group: two tasks a core, whatever the size in bytes. Adaptive execution sizes tasks by
    bytes and would give a small table with a costly function to one task."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
