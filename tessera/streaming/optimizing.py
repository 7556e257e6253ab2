"""Files that arrive are optimised and written once, whatever is stopped and started again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import optimize
from tessera.streaming.arrivals import BINARY_FILE


def arriving(spark: SparkSession, path: str, pattern: str = "*", most_files: int = 1000) -> DataFrame:
    """path, content of files as they arrive, some at a time."""
    found = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", most_files).load(path)
    return found.select("path", "content")


def optimize_stream(files: DataFrame, out: str, checkpoint: str, quality: int = 80, once: bool = False) -> StreamingQuery:
    """Starts a query that writes optimize(files) below `out`, one folder for each batch.

    A batch goes to the folder of its number and replaces what lies there. So a
    batch that was written, but not noted in the checkpoint, before its query
    was stopped, is written over when it is done again, and no file appears
    twice. `once` takes what is there and ends.
    """

    def write(batch: DataFrame, number: int) -> None:
        optimize.optimize(batch, quality).write.mode("overwrite").parquet(f"{out}/batch={number}")

    made = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (made.trigger(availableNow=True) if once else made).start()


def results(spark: SparkSession, out: str) -> DataFrame:
    """What has been written so far, and in which batch."""
    return spark.read.parquet(out).withColumn("batch", F.col("batch").cast("long"))
