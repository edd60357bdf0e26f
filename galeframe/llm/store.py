"""Tables written to the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where it is unset, a folder of the warehouse, but on a cluster not one of the driver's own disk."""
    given = spark.conf.get("spark.checkpoint.dir", "")
    if given:
        return given
    if not spark.sparkContext.master.startswith("local") and spark.conf.get("spark.sql.warehouse.dir").startswith(("file:", "/")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"


class Work:
    """Written tables of one operator call. drop() deletes those no longer read; the rest goes at the end of the session."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/galeframe-{uuid.uuid4().hex}"
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
        try:
            self._delete(self.root)
        except Exception:  # the session has ended, and its folder with it
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
