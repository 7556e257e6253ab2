"""Files as a table: (path, length, content), one row each; a bad file is a row with an error, never a failed job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.detect import detect_format
from tessera.operators import rules

IMAGE_EXTENSIONS = tuple(e for _, es, *_ in rules.IMAGE_FORMATS for e in es.split(","))
MESH_EXTENSIONS = tuple(e for _, es, *_ in rules.MESH_FORMATS for e in es.split(","))
#: Larger cells than this don't fit a row.
LARGEST = 1 << 30


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, error, format, content. A file beyond LARGEST has an error; files without bytes are passed over by Spark's reader."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    error = F.when(F.col("length") == 0, "empty file").when(F.col("length") > LARGEST, "file too large")
    return found.select("path", "length", error.alias("error"), F.when(error.isNull(), detect_format(F.col("content"))).otherwise("unknown").alias("format"), "content")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def family(path: Column) -> Column:
    e = extension(path)
    return F.when(e.isin(*IMAGE_EXTENSIONS), "image").when(e.isin(*MESH_EXTENSIONS), "mesh").otherwise("unknown")


def accepted(files: DataFrame) -> DataFrame:
    return files.where(family(F.col("path")) != "unknown")


def first_of_name(files: DataFrame) -> DataFrame:
    """One file of each name: the one with the smallest id."""
    return files.groupBy(name(F.col("path")).alias("name")).agg(F.min_by(F.struct(*files.columns), "file_id").alias("f")).select("f.*")


def output_name(path: Column, extension_out: Column, suffix: str = "_opt") -> Column:
    return F.concat(F.regexp_replace(name(path), r"\.[^.]*$", ""), F.lit(f"{suffix}."), extension_out)


def with_format(files: DataFrame, rows: tuple = rules.IMAGE_FORMATS) -> DataFrame:
    """Files with the format, MIME type and properties of their extension; others have nulls."""
    known = rules.formats(files.sparkSession, rows)
    return files.withColumn("extension", extension(F.col("path"))).join(F.broadcast(known), "extension", "left")


def write_results(results: DataFrame, path: str) -> None:
    """Successful rows of results (out_name, content, ...) as a table by output format."""
    results.where("success").write.mode("overwrite").partitionBy("out_format").parquet(path)
