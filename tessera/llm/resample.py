"""Operator 1: quality by importance resampling.

Words and word pairs are hashed to buckets. A bag model of target text and one
of raw text give each document the log of its importance weight: the sum over
its n-grams of log p_target - log p_raw. Adding Gumbel noise and keeping the
k largest keys draws k documents without replacement by these weights.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, bounded, schema_with, table, values_of, word_pieces

BUCKETS = 1 << 14
#: Target documents that the target model is fitted on, at most (a sample by hash); the raw model counts every document.
FIT_DOCUMENTS = 20_000
#: Share of documents that are kept; pseudo-counts of each bucket.
KEEP, SMOOTHING = 0.8, 1.0
#: Words whose hash a task keeps; values that the driver sorts at the end of a selection.
CACHE, LAST = 500_000, 20_000


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        h = self[word] = zlib.crc32(word)
        return h

    def buckets(self, text: str | None) -> Iterator[np.ndarray]:
        """Buckets of the words and of the pairs of neighbours, lower-cased, for pieces of the text."""
        first = True
        for words in word_pieces((text or "").lower().encode("utf-8", "surrogatepass"), 1):
            h = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
            pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(50)
            yield np.concatenate([h[0 if first else 1 :] % BUCKETS, pair % BUCKETS]).astype(np.int64)
            first = False


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, hashes = np.zeros(BUCKETS, np.int64), WordHash()
    for b in batches:
        for text in values_of(b.column(0)):
            for k in hashes.buckets(text):
                total += np.bincount(k, minlength=BUCKETS)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])


def bag_model(texts: DataFrame) -> np.ndarray:
    """Log-probability of each bucket over all rows of texts (text); BUCKETS rows reach the driver."""
    found = texts.select("text").mapInArrow(_count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    n = np.full(BUCKETS, SMOOTHING)
    n[found.bucket.to_numpy(np.int64)] += found.n.to_numpy(np.float64)
    return np.log(n / n.sum())


def log_weights(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, log_weight, n_grams; no text or word: zero."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for b in batches:
            weight, grams = [], []
            for text in values_of(b.column(1)):
                parts = [(float(shared.value[k].sum()), len(k)) for k in hashes.buckets(text)]
                weight.append(sum(w for w, _ in parts))
                grams.append(sum(n for _, n in parts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(weight, pa.float64()), pa.array(grams, pa.int64())], ["doc_id", "log_weight", "n_grams"])

    return docs.select("doc_id", "text").mapInArrow(run, schema_with(docs.select("doc_id"), log_weight="double", n_grams="long"))


def nth_largest(df: DataFrame, column: str, n: int) -> tuple[float, int]:
    """The n-th largest value and how many rows are larger. Counts by bins narrow it down; the driver sees bins, and LAST values at the end."""
    lo, hi, above = *df.agg(F.min(column), F.max(column)).first(), 0
    while True:
        inside = df.where(F.col(column).between(lo, hi))
        count = inside.count()
        if count <= LAST or lo == hi:
            for value, k in sorted(((r[0], r[1]) for r in inside.groupBy(column).count().collect()), reverse=True):
                if above + k >= n:
                    return value, above
                above += k
            return lo, above
        at = F.least(F.floor((F.col(column) - F.lit(lo)) / F.lit((hi - lo) / 4096)), F.lit(4095))
        for r in sorted(inside.groupBy(at.alias("bin")).agg(F.count("*").alias("k"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect(), reverse=True):
            if above + r.k >= n:
                lo, hi = r.lo, r.hi
                break
            above += r.k


def resample(docs: DataFrame, target: DataFrame, keep: float = KEEP, seed: int = 42, scratch: Scratch | None = None) -> DataFrame:
    """docs (doc_id, text), target (text) -> doc_id, log_weight, n_grams, key, selected.

    The noise is a function of the id and the seed, so reruns agree. Of equal
    keys the smaller ids are kept (null ids last); rows that share key and id
    stand or fall together. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    ratio = bag_model(target) - bag_model(docs)
    unit = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    keyed = scratch.write(log_weights(docs, ratio).withColumn("key", F.col("log_weight") - F.log(-F.log(unit))), "keyed")
    n = round(keep * keyed.count())
    if n <= 0:
        return keyed.withColumn("selected", F.lit(False))
    least, above = nth_largest(keyed, "key", n)
    ties = keyed.where(F.col("key") == least).withColumn("_order", -F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).cast("decimal(20,0)"))
    chosen = F.col("key") > least
    if ties.count() <= n - above:
        return keyed.withColumn("selected", F.col("key") >= least)
    last = ties.agg(F.min("_order")).first()[0]
    if ties.where(F.col("_order") != last).count():
        last, _ = nth_largest(ties.withColumn("_order", F.col("_order").cast("double")), "_order", n - above)
    return keyed.withColumn("selected", chosen | ((F.col("key") == least) & (-F.coalesce(F.col("doc_id").cast("double"), F.lit(9.3e18)) >= F.lit(float(last)))))


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents` with its importance weight towards those of good quality, and whether it is drawn."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = bounded(table(spark, sf_dir, "labels").where("quality = 1 and doc_id is not null").select("doc_id").distinct(), FIT_DOCUMENTS, "doc_id")
    target = docs.join(F.broadcast(good), "doc_id", "left_semi")
    return resample(docs, target)
