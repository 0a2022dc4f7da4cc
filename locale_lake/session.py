"""Session settings and lineage helpers shared by the operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the plans are tuned for. They are read-or-set: a value the cluster
# already chose wins, so nothing here overrides a production configuration.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str | int = "*", **extra: str) -> SparkSession:
    """A session for tests and the local bench; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("locale_lake")
    settings = {
        **DEFAULTS,
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        # do not look up the Python call site of every column expression
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **extra,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; make one only for local runs."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError(
                "set spark.checkpoint.dir to a folder all executors share"
            )
        shared = os.path.join(tempfile.gettempdir(), "locale_lake_checkpoints")
    context.setCheckpointDir(shared)


def spread(scan: DataFrame) -> DataFrame:
    """Give a plain file scan as many partitions as there are cores.

    Only where it has fewer, which happens with few or unsplittable files; a large
    input keeps its partitions and is not shuffled. For steps that cost much more
    CPU than a shuffle of their input.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder.

    Used between the rounds of an iterative operator (so plans do not grow with
    the number of rounds) and after a model call (so a lost executor can never
    cause a second call with a different answer).
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def rewritten(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder.

    For loops: the plan starts anew at a scan with its true size and prunes columns. A
    checkpoint keeps the size estimate of the plan it cuts off, and estimates that are
    multiplied round by round soon cost more than the rounds.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{folder}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme it has for Spark; paths of local disks stay plain.

    Tasks open paths by themselves, so what the default file system means has to be
    settled before they do.
    """
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        return path
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.getUri().getScheme() == "file":
        return os.path.abspath(path)
    return system.makeQualified(place).toString()
