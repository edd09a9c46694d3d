"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: For tables in a local folder: no checksum files. Hadoop's Java code starts a chmod for each file it makes there, and until
#: that runs on its own, the system shows the executor's memory a second time.
_BARE = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset, a temporary folder of this machine serves a local
    session, whose executors run here; a cluster's executors would not see it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"{tempfile.gettempdir()}/lexiquarry-shared"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that gives Python at most ``BATCH`` bytes (or one row) a batch.

    A task holds a batch several times over, in the JVM and in its worker, and
    rows of very long texts would make large ones of few rows.
    """
    spark = df.sparkSession
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH))
    if now > BATCH:
        spark.conf.set(_BATCH, f"{BATCH}b")
    return df


class Scratch:
    """Written tables of one query. They cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/lexiquarry-{uuid.uuid4().hex}"
        self._n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as Parquet and read it back."""
        self._n += 1
        path = f"{self.root}/{self._n:04d}"
        df.write.options(**_BARE).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more; those that are no written tables are passed over."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = getattr(t, "_scratch_path", None)
            if path is not None:
                path = jvm.org.apache.hadoop.fs.Path(path)
                path.getFileSystem(conf).delete(path, True)
