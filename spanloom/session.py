"""Session set-up and the one way this package cuts lineage."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app="spanloom", **conf) -> SparkSession:
    """Session with the settings every job here expects; the cluster's own settings win elsewhere."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for reliable checkpoints: the cluster's shared one, a scratch one only in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="spanloom-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame, **options) -> DataFrame:
    """Write as a table in the shared checkpoint folder and go on from there.

    A lost executor re-reads files instead of repeating the whole history, readers take only the columns they need, and
    the planner knows the real size. ``options`` go to the writer.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, bytes_per_core=64 << 20) -> DataFrame:
    """``df`` dealt out to all cores if it is small; a large table is left as it is read.

    A small table often lies in one file that a single task reads, and all work on its rows would stay there. Beyond
    ``bytes_per_core``, or with a file for each core, a table has enough parts of its own, and its texts are not worth
    moving. A table of unknown size, or a stream, is left alone.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > cores * bytes_per_core or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)
