"""Session settings and the checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A broadcast side is used only after its rows were counted against this bound.
BROADCAST_ROWS = 1_000_000

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "couponmill", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the reports are tuned for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; a
    cluster without it is an error, because executors could not share one.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="couponmill-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
    return folder


def pin(df: DataFrame) -> DataFrame:
    """Compute an aggregated frame once into the checkpoint folder and cut its lineage.

    Used where one result feeds several jobs.  The files survive the loss of
    any executor.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name inside the checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write a large frame once as Parquet in the checkpoint folder and read it back.

    Compressed and columnar, so a later pass reads only the columns it needs;
    row positions stored in a column stay as they were written.
    """
    folder = scratch_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _file_system(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store the path names."""
    store, jpath = _file_system(spark, path)
    return store.exists(jpath)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a file, or a folder with all it holds."""
    store, jpath = _file_system(spark, path)
    store.delete(jpath, True)


def folders_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly under ``path``, sorted; none if it is not there."""
    store, jpath = _file_system(spark, path)
    if not store.exists(jpath):
        return []
    return sorted(f.getPath().getName() for f in store.listStatus(jpath) if f.isDirectory())


class Scratch:
    """Frames written for one computation and removed together when it is done."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folder = scratch_folder(spark)
        self._written = 0

    def stage(self, df: DataFrame) -> DataFrame:
        """Like :func:`stage`, into this scratch folder."""
        self._written += 1
        folder = f"{self.folder}/{self._written}"
        df.write.parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def remove(self) -> None:
        """Delete the folder; no frame staged here can be read afterwards."""
        delete_path(self.spark, self.folder)
