"""Lineage cuts that survive a lost executor: intermediate tables in the shared folder."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder and all of it runs on one machine, as in tests.
LOCAL_FALLBACK = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; on one machine, without it, a folder of our own."""
    conf = spark.sparkContext.getConf()
    if named := spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir"):
        return named.rstrip("/")
    if not conf.get("spark.master", "local").startswith("local") or conf.get("spark.master").startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return LOCAL_FALLBACK


class Workspace:
    """Intermediate tables of one query, written once as Parquet and read by what follows.

    A written table is computed once (checkpoint() would compute it twice unless it is cached too), is columnar, so that
    later reads prune columns, and outlives any executor. drop() frees a table as soon as nothing reads it; the rest goes
    when the Python process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/pagewright/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        atexit.register(self.close)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._workspace_path = path
        return back

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        if jvm is None:
            return
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no result still to be computed reads."""
        for df in tables:
            self._delete(df._workspace_path)

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session may already have ended  # noqa: BLE001
            pass
