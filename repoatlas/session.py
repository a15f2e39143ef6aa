"""Session settings, shared-folder checkpoints and scan parallelism."""

import atexit
import contextlib
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app_name: str = "repoatlas", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the jobs are written for.

    Adaptive execution sizes the shuffle partitions, picks broadcast joins from
    measured sizes and splits skewed join partitions, so no job sets any of
    these by hand. ``master`` is given in tests only; on a cluster the launcher
    sets it.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_checkpoint_folder(spark: SparkSession) -> str:
    """The checkpoint folder of this application.

    The cluster names a shared folder in ``spark.checkpoint.dir``. Where that is
    unset, a session of one machine gets a fresh local folder, and any other
    fails, since its executors would not see each other's files.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get(
            "spark.checkpoint.dir", None
        )
        if shared is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="repoatlas-"))
    folder = context.getCheckpointDir()
    # Spark has made it for this application alone.
    if getattr(context, "_repoatlas_folder", None) != folder:
        context._repoatlas_folder = folder
        _delete_at_exit(spark, folder)
    # As Spark names the files in it.
    return re.sub("^file:/(?!/)", "file:///", folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once as a Parquet table in the checkpoint folder, and read back.

    Later steps then see one fixed set of rows, also after an executor is lost,
    and read only the columns they need.
    """
    spark = df.sparkSession
    place = f"{use_checkpoint_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


written = cut_lineage


def _delete_at_exit(spark: SparkSession, folder: str) -> None:
    """Deletes this application's own checkpoint folder when the program ends."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def delete() -> None:
        # The JVM may be gone already.
        with contextlib.suppress(Exception):
            files.delete(path, True)

    atexit.register(delete)


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application.

    Workers that were started from another folder, or on another machine, could
    not import the functions they are to run.
    """
    context = spark.sparkContext
    if getattr(context, "_repoatlas_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="repoatlas-"), "repoatlas.zip")
    with zipfile.ZipFile(archive, "w") as packed:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    packed.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    context._repoatlas_shipped = True


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash ``df`` over the cluster by a unique ``key`` if its scan is too narrow.

    A small file with one row group arrives as one partition, which would run
    the text work on a single core. A scan of a large table already has many
    splits and is left alone, so nothing is shuffled there; what is shuffled is
    never more than four splits per core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < 4 * cores:
        return df.repartition(cores, key)
    return df
