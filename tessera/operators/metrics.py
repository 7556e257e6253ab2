"""Metrics over an operation log (family, elapsed_ms, size, ok) and over results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL, SMALL_MS, OTHER_MS, TOLERATED = 512_000, 100, 150, 0.05


def is_violation() -> Column:
    """Took longer than its size allows."""
    return F.col("elapsed_ms") > F.when(F.col("size") < SMALL, SMALL_MS).otherwise(OTHER_MS)


def snapshot(log: DataFrame) -> DataFrame:
    """One row: operations, mean and longest time by family, bytes, violations, compliance. No operation complies."""
    image, mesh = F.col("family") == "image", F.col("family") == "mesh"
    return log.agg(
        F.count_if(image).alias("images"), F.count_if(mesh).alias("meshes"),
        F.coalesce(F.avg(F.when(image, F.col("elapsed_ms"))), F.lit(0.0)).alias("mean_image_ms"), F.coalesce(F.avg(F.when(mesh, F.col("elapsed_ms"))), F.lit(0.0)).alias("mean_mesh_ms"),
        F.max(F.when(image, F.col("elapsed_ms"))).alias("longest_image_ms"), F.max(F.when(mesh, F.col("elapsed_ms"))).alias("longest_mesh_ms"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_if(is_violation()).alias("violations"),
        (F.count_if(is_violation()) < F.when(F.count("*") == 0, F.lit(1.0)).otherwise(TOLERATED * F.count("*"))).alias("compliant"),
    )


def compliance_by_family(log: DataFrame) -> DataFrame:
    """Operations, violations and their share for each family and over all (null), by rollup."""
    return log.rollup("family").agg(F.count("*").alias("operations"), F.count_if(is_violation()).alias("violations"), F.avg(is_violation().cast("double")).alias("share"))


def reduction(before: Column, after: Column) -> Column:
    """Per cent saved; 0 for an empty input."""
    return F.when(before == 0, 0.0).otherwise((before - after) / before * 100.0)


def ratio(before: Column, after: Column) -> Column:
    return F.when(before == 0, 1.0).otherwise(after / before)


def totals(results: DataFrame) -> DataFrame:
    """results (original_size, optimized_size, success) -> sums over the successes, per cent saved, successes, failures."""
    good = F.col("success")
    sums = results.agg(
        F.coalesce(F.sum(F.when(good, F.col("original_size"))), F.lit(0)).alias("original"), F.coalesce(F.sum(F.when(good, F.col("optimized_size"))), F.lit(0)).alias("optimized"),
        F.count_if(good).alias("successes"), F.count_if(~good).alias("failures"),
    )
    return sums.select("*", reduction(F.col("original"), F.col("optimized")).alias("saved_percent"))
