"""Lineage cuts: tables written to the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where it is unset, a temporary folder in local mode; elsewhere an error, since executors do not share local folders."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="variantforge-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Rows and bytes of an Arrow batch of whole texts: a worker holds a few batches at a time.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch limits to BATCH_ROWS and BATCH_BYTES; lower ones stay.

    Spark reads these limits when a plan runs, so the application sets them for its session: the registered
    queries and the pipeline do, the operators never change a session.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = re.match(r"\d+", spark.conf.get(key))
        if not now or not 0 < int(now.group()) <= most:
            spark.conf.set(key, str(most))


def bounded(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A function of (spark, ...) that bounds the session's batches first."""

    @wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        bound_batches(spark)
        return query(spark, *args)

    return run


class Scratch:
    """Tables of one run of one operator, each under a folder of its own.

    ``cut`` writes a DataFrame and returns the table read back, so that later jobs start from files
    which any executor can read again.  ``drop`` removes a table that nothing lazy still reads; the rest
    goes when the application ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
        self._marked = False

    def _path(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        if not self._marked:
            path, fs = self._path()
            fs.mkdirs(path)
            fs.deleteOnExit(path)
            self._marked = True
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path, fs = self._path(name)
            fs.delete(path, True)

    def drop_all_but(self, *names: str) -> None:
        path, fs = self._path()
        for status in fs.listStatus(path):
            if status.getPath().getName() not in names:
                fs.delete(status.getPath(), True)

    def tidy(self) -> None:
        """Lets Spark delete the shuffle files of finished jobs now: it does so once the driver has collected their plans as garbage, which may otherwise take long."""
        gc.collect()
        self.spark._jvm.System.gc()
