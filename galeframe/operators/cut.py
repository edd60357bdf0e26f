"""Written state: the lineage of a loop cut, and scratch folders, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where it is unset, a folder of the warehouse, but on a cluster not one of the driver's own disk."""
    given, warehouse = spark.conf.get("spark.checkpoint.dir", ""), spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not given and not spark.sparkContext.master.startswith("local") and warehouse.startswith(("file:", "/")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return given or f"{warehouse}/_checkpoints"


def scratch(spark: SparkSession) -> str:
    """A new folder's path."""
    return f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


class Scratch:
    """Written tables of one operator call. drop() deletes those no longer read; the rest goes with close(), or at the end of the session."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, scratch(spark)
        atexit.register(self.close)

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._work_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if getattr(t, "_work_path", None):
                self._delete(t._work_path)

    def close(self) -> None:
        atexit.unregister(self.close)
        try:
            self._delete(self.root)
        except Exception:  # the session has ended, and its folder with it
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
