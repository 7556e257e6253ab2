"""Tables that are written and read again between rounds, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession


class Staging:
    """Cuts lineage: a lost executor costs a re-read, never a recomputation of all rounds before.

    The folder is the one that spark.checkpoint.dir names, or the warehouse
    where the session names none. `drop` forgets what no later round reads; the
    rest goes when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
        self.spark, self.root = spark, f"{root.rstrip('/')}/tessera-{uuid.uuid4().hex}"
        atexit.register(self._clear)

    def _clear(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended before
            self.drop("")

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path, schema = f"{self.root}/{name}", df.schema
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
            path.getFileSystem(conf).delete(path, True)
