"""Session helpers shared by every operator: checkpoint folder, intermediate tables, input parallelism."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: A join whose sides are both split by some of its keys uses that split instead of shuffling both again, if this is false. Only
#: for the queries that set it, whose sides are known not to be skewed.
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"
#: Settings of every query: times are UTC, plans adapt at run time, and a union isn't taken to be split as its parts are: in Spark
#: 4.1 that leaves the rows of one group in several partitions when the parts are coalesced differently, so groups come out twice.
SETTINGS = {"spark.sql.unionOutputPartitioning": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", CO_PARTITION: "true"}


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in (SETTINGS | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where it is unset and all runs on one machine.

    On a cluster a folder must be named: in a machine's own each executor would write to its own disk.
    """
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or getattr(context, "_tidemark_folder", None)
    if not at:
        master = context.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        at = context._tidemark_folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    return at.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; `clear` removes what was written to it."""
    at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    context = spark.sparkContext
    context._tidemark_paths = [*getattr(context, "_tidemark_paths", []), at]
    return at


def _located(spark: SparkSession, at: str) -> tuple:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, at: str) -> bool:
    files, path = _located(spark, at)
    return files.exists(path)


def clear(spark: SparkSession) -> None:
    """Remove all intermediate tables of the session; frames that still read them can't be used any more."""
    context = spark.sparkContext
    for at in getattr(context, "_tidemark_paths", []):
        files, path = _located(spark, at)
        files.delete(path, True)
    context._tidemark_paths = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table of the shared folder and read it back: cuts the lineage and survives lost executors. `clear` removes it."""
    spark = df.sparkSession
    at = fresh(spark, name)
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def spread(df: DataFrame, *, factor: int = 1) -> DataFrame:
    """Repartition a scan with fewer partitions than the cluster has cores; larger inputs stay as they are split.

    Only for frames without a shuffle (scans, projections): counting partitions then runs no job.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism * factor
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Give a session the library's settings and send this package to its Python workers, once, so that they find it whatever folder they start in."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    context = spark.sparkContext
    if getattr(context, "_tidemark_shipped", False):
        return
    home = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="spark-")) / "tidemark.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    context.addPyFile(str(at))
    context._tidemark_shipped = True
