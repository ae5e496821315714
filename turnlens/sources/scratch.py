"""Tables that cut lineage, in the folder that ``spark.checkpoint.dir`` names.

Unlike executor-local blocks they survive a lost executor: a lost task reads its input again from there.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which an execution's shuffle files end with it.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session. Only a local master may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='turnlens-checkpoints-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def release(spark: SparkSession) -> None:
    """Lets the driver's JVM collect its garbage once its heap has grown past half of what it may take. Else a long session
    keeps the largest heap that any of its tables asked for, and broadcasts and shuffles that nobody reads any more."""
    runtime = spark._jvm.Runtime.getRuntime()
    if 2 * runtime.totalMemory() > runtime.maxMemory():
        spark._jvm.System.gc()


#: The innermost ``owned`` block's scratches, for each thread or task of the driver by itself.
_owner: ContextVar[list | None] = ContextVar("turnlens_scratch_owner", default=None)


class Scratch:
    """Tables of one operator call in the shared folder; deleted by ``drop``, at the end of an ``owned`` block or when the
    driver's JVM ends. An operator's result reads them, so they may go only after it is written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/turnlens-{name}-{uuid.uuid4().hex}"
        self._fs(self.root, lambda fs, path: fs.deleteOnExit(path))
        if (own := _owner.get()) is not None:
            own.append(self)

    def _fs(self, where: str, act):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(where)
        return act(path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and reads it back, with its lineage cut. The write's shuffle files go with its end, not when the driver
        happens to collect its garbage."""
        where, before = f"{self.root}/{name}", self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(where)
        finally:
            self.spark.conf.set(CLEANUP, before) if before is not None else self.spark.conf.unset(CLEANUP)
            release(self.spark)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, name: str = "") -> None:
        self._fs(f"{self.root}/{name}".rstrip("/"), lambda fs, path: fs.delete(path, True))


@contextmanager
def owned():
    """Deletes at its end the tables of the operator calls made inside it, and no others. A driver that lives long makes and
    writes a result inside such a block; results that are still to be written outside of it keep their tables."""
    mine: list[Scratch] = []
    token = _owner.set(mine)
    try:
        yield mine
    finally:
        _owner.reset(token)
        for scratch in mine:
            scratch.drop()
