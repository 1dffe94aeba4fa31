"""Session helpers: reading tables, shared folders and cutting lineage."""

from __future__ import annotations

import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once a context, for clusters that don't have it installed."""
    context = spark.sparkContext
    if getattr(context, "_paperloom_shipped", False):
        return
    home = pathlib.Path(__file__).parent
    file = pathlib.Path(tempfile.mkdtemp(prefix="paperloom-")) / "paperloom.zip"
    with zipfile.ZipFile(file, "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    context.addPyFile(str(file))
    context._paperloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is what the cluster names in ``spark.checkpoint.dir``. Only where that is unset and
    everything runs in one process (tests, one machine) a local temporary folder is set instead;
    a cluster without it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="paperloom-")
        shared_dir.own = found
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def work_dir(spark: SparkSession) -> str:
    """The folder of this application's tables in the shared one; it is deleted when the application ends."""
    context = spark.sparkContext
    base = f"{shared_dir(spark).rstrip('/')}/paperloom-{context.applicationId}"
    if getattr(context, "_paperloom_work", None) != base:
        path = context._jvm.org.apache.hadoop.fs.Path(base)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        context._paperloom_work = base
    return base


def materialise(df: DataFrame, partition_hint: int | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back; survives lost executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/table-{uuid.uuid4().hex}"
    (df if partition_hint is None else df.repartition(partition_hint)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df``, a scan, over all cores, where its files give fewer partitions than there are; else as it is.

    Not for plans with a shuffle: to count their partitions would run their stages.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
