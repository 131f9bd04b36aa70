"""Session settings and lineage cutting shared by every job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Settings the results or their speed depend on; they may be changed in a running session.
# Methods above 8000 bytes are never compiled by the JVM, so wide projections run faster
# as split methods than as one fused one. Rows with long texts go to Python in small batches.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Give a session made elsewhere the runtime settings."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def spark_session(app_name: str = "logloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Times are read and shown in UTC; AQE coalesces small shuffle partitions and
    splits skewed join partitions, so the partition count may be set generously.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        **RUNTIME,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; set here only where a local session has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="logloom-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stage(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and continue from the files.

    ``codec`` compresses them; ``zstd`` is for wide text. Later readers take the columns they need; ``unstage`` drops the files once nothing
    that still has to run reads them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read._stage_path = path
    return read


def unstage(*frames: DataFrame) -> None:
    """Delete what ``stage`` wrote for these frames."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stage_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def durable(df: DataFrame) -> DataFrame:
    """``stage`` for results of operators: what reads it later takes only the columns it needs."""
    return stage(df)
