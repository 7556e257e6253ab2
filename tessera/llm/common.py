"""Helpers that several operators share: tables, shared scratch space, words, prefix sums."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: Texts longer than this many bytes are cut into words piece by piece.
PIECE = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the warehouse where the session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    return root.rstrip("/")


class Scratch:
    """Written tables that cut lineage: a lost executor costs a re-read, never a recomputation of all that came before.

    Tables that no result reads are dropped by those who wrote them, the others when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{scratch_root(spark)}/tessera-{uuid.uuid4().hex}"
        atexit.register(self._clear)

    def _clear(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended before
            self.drop("")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path, schema = self.path(name), df.schema
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name).rstrip("/"))
            path.getFileSystem(conf).delete(path, True)


    def drop_but(self, prefix: str, *names: str) -> None:
        """Drops the tables whose names begin with the prefix, but those named."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        for entry in root.getFileSystem(conf).listStatus(root):
            name = entry.getPath().getName()
            if name.startswith(prefix) and name not in names:
                self.drop(name)


def schema_with(df: DataFrame, **kinds: str) -> StructType:
    """The schema of df and more columns after it."""
    return StructType([*df.schema.fields, *(StructField(name, _parse_datatype_string(kind)) for name, kind in kinds.items())])


def unused(df: DataFrame, prefix: str = "_") -> str:
    """A prefix that no column of df begins with."""
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id is not held out."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bounded(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """The first `rows` rows in the order of a hash of `by`: the same sample on every run, `rows` at most.

    Rows whose hash is too large to be among the first go before anything is
    ordered, so that no task passes on much more than its share: twice as many
    as are wanted stay on average, and thousands more.
    """
    share = (2 * rows + 10_000) / max(1, df.count())
    if share < 1:
        df = df.where(F.xxhash64(*by) <= F.lit(int((2 * share - 1) * (1 << 63))))
    return df.orderBy(F.xxhash64(*by), *by).limit(rows)


def those_of(df: DataFrame, ids: DataFrame, on: str, how: str = "left_semi", few: int = 2_000_000) -> DataFrame:
    """The rows of df whose `on` is in ids (left_anti: is not), rows of a number each: up to `few` of them go to every task, so that df stays where it is."""
    return df.join(F.broadcast(ids) if ids.count() <= few else ids, on, how)


def values_of(column: pa.Array, together: int = 256) -> Iterator:
    """The values of a column of texts, of which no more than `together` are Python objects at a time."""
    for i in range(0, len(column), together):
        yield from column.slice(i, together).to_pylist()


def word_pieces(data: bytes, overlap: int = 0) -> Iterator[list[bytes]]:
    """Words between ASCII white space, in lists for pieces of PIECE bytes; each list repeats the last `overlap` words of the one before."""
    if len(data) <= PIECE:
        yield data.split()
        return
    start, kept = 0, []
    while start < len(data):
        stop = min(len(data), start + PIECE)
        while stop < len(data) and data[stop] not in b" \t\n\x0b\x0c\r":
            stop += 1
        words = kept + data[start:stop].split()
        if len(words) > overlap or stop >= len(data):
            yield words
            kept = words[len(words) - overlap :] if overlap else []
        else:
            kept = words
        start = stop


def running_total(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, into: str) -> DataFrame:
    """Adds the sum of `value` over all rows of the group before each row, in the order (bucket, order).

    Buckets subdivide a group, so that no task gets a whole group: totals by
    bucket are few and are summed first, rows are summed within their bucket.
    Nulls in `group` form a group of their own.
    """
    totals = df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*(F.col(c).alias(f"_g_{c}") for c in group), F.col(bucket).alias("_g_bucket"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    match = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group]
    inner = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = df.withColumn("_within", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    on = F.col(bucket) == F.col("_g_bucket")
    for m in match:
        on = on & m
    return within.join(totals, on, "left").withColumn(into, F.col("_before") + F.col("_within")).drop("_before", "_within", "_g_bucket", *(f"_g_{c}" for c in group))
