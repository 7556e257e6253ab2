"""Files and operation logs as streams: the batch operators on readStream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.detect import detect_format
from tessera.operators.metrics import is_violation

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def arriving_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, format of files as they arrive."""
    found = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", pattern).load(path)
    return found.select("path", "length", "modificationTime", detect_format(F.col("content")).alias("format"))


def violations_by_window(log: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Operations and violations by family and window of time; rows later than the watermark don't count."""
    return log.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window), "family").agg(F.count("*").alias("operations"), F.count_if(is_violation()).alias("violations"))
