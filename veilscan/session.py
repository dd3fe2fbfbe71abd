"""Session helpers.

On a cluster the session is created by the platform; we only read settings
from it. ``get_session`` is for tests, the bench and local runs.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession


def get_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "veilscan",
                event_log_dir: str | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("VEILSCAN_DRIVER_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # AQE broadcasts a join side only where its measured size is below this.
        .config("spark.sql.autoBroadcastJoinThreshold", str(16 * 1024 * 1024))
    )
    if event_log_dir:
        builder = (builder.config("spark.eventLog.enabled", "true")
                   .config("spark.eventLog.dir", event_log_dir))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints / state tables.

    ``spark.checkpoint.dir``, else the folder the context was given; only a
    local master (tests) may fall back to a private scratch folder. Repeated
    keys of a JSON object are allowed from here on: the last one counts.
    """
    allow_duplicate_keys(spark)
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not conf_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        conf_dir = tempfile.mkdtemp(prefix="veilscan-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(conf_dir)
    return conf_dir


def allow_duplicate_keys(spark: SparkSession) -> None:
    """A repeated JSON key must not make its document or span unparsable."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def is_missing_path(error: Exception) -> bool:
    """Only "no such path" means "nothing written yet"; any other failure must surface."""
    return isinstance(error, AnalysisException) and error.getCondition() == "PATH_NOT_FOUND"


def local_folder(spark: SparkSession, path: str) -> str | None:
    """Plain path of a folder in a store that tasks open by themselves (``file:``); None in any other store."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def materialize(df):
    """Cut lineage with a reliable checkpoint in ``spark.checkpoint.dir``, computing ``df`` once.

    A reliable checkpoint recomputes its input when writing; persisting first
    makes the eager count fill the cache and the write read from it. The cache
    is dropped once the checkpoint files exist.
    """
    from pyspark import StorageLevel
    checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    done = cached.checkpoint(eager=True)
    cached.unpersist()
    return done


class Checkpoints:
    """How a job keeps its intermediate tables: cached while one other table is made of them, or as checkpoints."""

    def hold(self, df):
        from pyspark import StorageLevel
        return df.persist(StorageLevel.MEMORY_AND_DISK)

    def keep(self, df):
        return materialize(df)

    def free(self, df) -> None:
        df.unpersist()


class StagedFiles(Checkpoints):
    """Intermediate tables as packed Parquet files, for a job whose result is written inside the block.

    A checkpoint holds whole rows unpacked and goes when the driver's garbage
    is collected; these go when ``free`` is called or the block ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{checkpoint_dir(spark).rstrip('/')}/veilscan-staged-{uuid.uuid4().hex}"

    def __enter__(self):
        return self

    def __exit__(self, *_):
        remove_folder(self.spark, self.root)

    def keep(self, df):
        path = f"{self.root}/{uuid.uuid4().hex}"
        with shuffles_removed(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    hold = keep

    def free(self, df) -> None:
        for path in {os.path.dirname(f) for f in df.inputFiles()}:
            if f"/{os.path.basename(self.root)}/" in path:
                remove_folder(self.spark, path)


CHECKPOINTS = Checkpoints()


def remove_folder(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Jobs of the block remove their shuffle files when they end, not when the driver's garbage is collected."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application.

    Functions of the package are pickled by reference, so a worker has to import
    it; Spark's own file distribution carries the zip, whatever folder the job
    was started from.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="veilscan-package-"), f"veilscan_{context.applicationId.replace('-', '_')}")
    with zipfile.ZipFile(f"{base}.zip", "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(f"{base}.zip")
    _SHIPPED.add(context.applicationId)
