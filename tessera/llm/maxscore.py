"""Operator 13: exact top-k by inner product of integer vectors, with MaxScore over postings.

A component is a term, its value an impact, which may be negative. A shard
keeps, for each term, the places of its vectors with a positive and with a
negative value, as postings, and their largest impacts. For a query, a term
adds at most its bound: the query's weight times the largest impact of its
sign, or nothing. Terms in the order of falling bounds are essential up to the
one after which all remaining bounds together cannot reach the k-th best so
far. Places in the postings of essential terms are candidates; each collects
what these terms give it, and the other terms are probed while what it has and
the bounds of what is left can reach the k-th best. Shards give their best to
one merge for each query.

Vectors stand in a shard in blocks of falling length, so that the k-th best is
high early; a place is dropped only below it, never at it, since equal scores
go by the smaller id.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, partitions, table

#: Best scores of a query; every how many-th vector asks; a component's scale.
K, EVERY, SCALE = 5, 50, 256
#: Vectors of a shard at least and at most, queries that go to a shard as one part, places of a block.
LEAST, MOST, PART, BLOCK = 2048, 16_384, 4096, 512
#: Non-essential terms that are probed together.
PROBE = 8
_LONG = 1 << 63


class Shard:
    """Postings of some vectors: values by block and term, and the bounds of both."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        wide = values.dtype == object
        length = np.array([float(sum(float(x) ** 2 for x in v)) for v in values]) if wide else (values.astype(np.float64) ** 2).sum(axis=1)
        order = np.lexsort((ids, -length))
        self.ids, self.values = ids[order], values[order]
        self.blocks = []
        for low in range(0, len(ids), BLOCK):
            own = self.values[low : low + BLOCK]
            # Term by term, so that the postings of a term lie together.
            self.blocks.append((low, np.ascontiguousarray(own.T), own.max(axis=0), own.min(axis=0)))

    def best(self, query: np.ndarray, k: int, own: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Scores and ids of the k best, best first, equals by the smaller id; postings that were read. A score beyond a long is the nearest long."""
        scores, ids, read = np.zeros(0, query.dtype), np.zeros(0, np.int64), 0
        for low, columns, most, least in self.blocks:
            bound = np.maximum(np.maximum(query * most, query * least), 0)
            ceiling = np.maximum(query * most, query * least).sum()
            floor = scores[-1] if len(scores) == k else None
            if floor is not None and ceiling < floor:
                continue
            term = np.argsort(-bound, kind="stable")
            # What all terms from each on can add at most.
            left = np.append(np.cumsum(bound[term][::-1])[::-1], 0)
            essential = len(term) if floor is None or floor <= 0 else int(np.searchsorted(-left, -floor, side="right"))
            first, columns_q = term[:essential], query[:, None]
            part = columns[first]
            read += part.size
            gained = part * columns_q[first]
            # Candidates: places in a posting of an essential term whose impact has the query's sign.
            place = np.arange(columns.shape[1]) if floor is None or floor <= 0 else np.flatnonzero((gained > 0).any(axis=0))
            have = gained[:, place].sum(axis=0)
            for at in range(essential, len(term), PROBE):
                if floor is not None:
                    on = have + left[at] >= floor
                    place, have = place[on], have[on]
                if not len(place):
                    break
                some = term[at : at + PROBE]
                read += len(some) * len(place)
                have = have + (columns[np.ix_(some, place)] * columns_q[some]).sum(axis=0)
            if have.dtype == object:
                have = np.array([max(1 - _LONG, min(_LONG - 1, s)) for s in have.tolist()], dtype=object)
            key = self.ids[low + place]
            if own is not None:
                other = key != own
                key, have = key[other], have[other]
            if floor is not None:
                on = have >= floor
                key, have = key[on], have[on]
            scores, ids = np.concatenate([scores, have]), np.concatenate([ids, key])
            top = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[top], ids[top]
        return scores, ids, read


def _valid(df: DataFrame) -> DataFrame:
    """Vectors without null or non-finite components, as doubles; null ids and vectors go."""
    v = F.col("embedding")
    rows = df.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def quantised(vectors: list, scale: int = SCALE) -> np.ndarray:
    """floor(scale x) of every component: longs, or Python's integers where a sum of products might pass 63 bits."""
    if not vectors:
        return np.zeros((0, 0), np.int64)
    x = np.floor(np.array([np.asarray(v, np.float64) for v in vectors]) * scale)
    if x.size and np.abs(x).max() ** 2 * x.shape[1] >= _LONG / 2:
        exact = [[int(scale) * int(a) if abs(a) >= 2**53 else int(np.floor(a * scale)) for a in v] for v in vectors]
        return np.array(exact, dtype=object).reshape(len(vectors), -1)
    return x.astype(np.int64)


def _answers(k: int, scale: int):
    """Rows of (shard, part): its postings, then its queries; out: the k best of the shard for each query."""
    kind = pa.list_(pa.struct([("loss", pa.int64()), ("vec_id", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard = None, None
        for b in batches:
            cells = list(zip(b.column("shard").to_pylist(), b.column("part").to_pylist(), strict=True))
            asked, found = [], []
            for i, (cell, query) in enumerate(zip(cells, b.column("query_id").to_pylist(), strict=True)):
                if b.column("index")[i].is_valid:
                    held, shard = cell, pickle.loads(b.column("index")[i].as_py())
                elif cell == held:
                    ask = quantised([b.column("embedding")[i].as_py()], scale)[0]
                    score, ids, _ = shard.best(ask, k, query)
                    asked.append(i)
                    found.append([{"loss": -int(s), "vec_id": v} for s, v in zip(score.tolist(), ids.tolist(), strict=True)])
            at = pa.array(asked, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in ("query_id", "ask", "shard")), pa.array(found, kind)], ["query_id", "ask", "shard", "found"])

    return run


def top_scores(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, shard: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """vectors, queries (vec_id, embedding) -> query_id, rank, vec_id, score: the k largest inner products of the components' floor(scale x), without the query's own id.

    Exact; ties go to the smaller id. Vectors that are null or hold a null or
    non-finite component, and null ids, take no part; zero vectors do, with
    score 0. Rows that repeat both id and vector count once. Vectors must have
    one length. Other columns are not looked at. An empty table gives no rows.
    Products beyond 62 bits are summed as whole numbers of any size; a score
    beyond a long counts as the nearest long.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark)
    own, asked = _valid(vectors), _valid(queries).dropDuplicates(["vec_id", "embedding"])
    number, questions, tasks = own.count(), asked.count(), partitions(spark)
    shards = max(1, -(-number // (shard or min(MOST, max(LEAST, number // (2 * tasks))))))
    parts = max(1, -(-questions // PART))

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows = {(i, v.tobytes()): v for i, v in zip(group["vec_id"].tolist(), group["embedding"], strict=True)}
        index = Shard(np.array([i for i, _ in rows], np.int64), quantised(list(rows.values()), scale))
        return pd.DataFrame({"shard": [key[0]], "index": [pickle.dumps(index)]})

    dealt = own.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    postings = scratch.write(dealt.groupBy("shard").applyInPandas(build, "shard bigint, index binary"), "postings")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part")
    none = {"query_id": "bigint", "ask": "bigint", "embedding": "array<double>"}
    tops = postings.select("shard", every, "index", *(F.lit(None).cast(kind).alias(c) for c, kind in none.items()))
    place = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard")
    rows = asked.select(place, F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias("part"), F.lit(None).cast("binary").alias("index"), F.col("vec_id").alias("query_id"), F.xxhash64("embedding").alias("ask"), "embedding")
    cells = tops.unionByName(rows).repartition(max(tasks, min(100_000, 2 * shards * parts)), "shard", "part")
    cells = cells.sortWithinPartitions("shard", "part", F.col("index").isNull())
    found = cells.mapInArrow(_answers(k, scale), "query_id bigint, ask bigint, shard bigint, found array<struct<loss: bigint, vec_id: bigint>>")

    def top() -> Column:
        return F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, k).alias("found")

    some = found.groupBy("query_id", "ask", F.pmod("shard", F.lit(32)).alias("some")).agg(top())
    best = some.groupBy("query_id", "ask").agg(top()).select("query_id", F.posexplode("found").alias("pos", "hit"))
    return best.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.loss")).alias("score"))


def op13_maxscore_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The K largest integer inner products of every EVERY-th vector of `embeddings` with all others, by `top_scores`."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_scores(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


OP13_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
