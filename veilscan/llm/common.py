"""Helpers shared by the operators: shared folder, staged tables, folds."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.session import ship_package

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Falls back to the context's checkpoint folder; only a local master may use
    a private temporary folder (tests).
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    conf = tempfile.mkdtemp(prefix="veilscan-llm-")
    spark.conf.set("spark.checkpoint.dir", conf)
    return conf


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared one; removed when the driver ends."""
    path = f"{shared_dir(spark)}/veilscan-llm-{label}-{uuid.uuid4().hex[:12]}"
    _CLEANUP.append((spark, path))
    return path


_CLEANUP: list[tuple[SparkSession, str]] = []


def remove_work_dirs() -> None:
    """Delete every folder made by ``work_dir``; results that still read them end."""
    while _CLEANUP:
        spark, path = _CLEANUP.pop()
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the context may be gone when the interpreter ends
            return


atexit.register(remove_work_dirs)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Compute ``df`` once into a Parquet table in the shared folder and read it back.

    Cuts lineage in a way that survives lost executors: the files are complete
    before any later job reads them.
    """
    spark = df.sparkSession
    path = work_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def workers(df: DataFrame) -> DataFrame:
    """``df``, once the Python workers can import this package."""
    ship_package(df.sparkSession)
    return df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def crc_mod(col: Column, k: int) -> Column:
    """crc32(value as text) mod k, the fold rule of the learning operators."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(k))


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))
