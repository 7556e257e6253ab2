"""Operator 7: nearest neighbours by vantage-point trees, one for each shard.

Inner products become distances: with one more component, sqrt(M^2 - |x|^2),
all vectors of a shard lie on a sphere of radius M, and the nearest point to
(q, 0) has the largest inner product with q. A tree node splits its points by
their distance to a vantage point. By the triangle inequality a child cannot
hold a point nearer than its bound; it is skipped if the bound times a factor
exceeds the distance of the k-th best so far. Factor one is exact search,
larger factors skip more.

Shards are cells around pivots, and parts of a cell that has too many vectors.
A query first goes to the cell of its nearest pivot, and then, knowing its
k-th best, to those cells only that can hold a better one: no point of a cell
with centre c and radius r has a larger product than q.c + |q| r. Queries
travel to the trees, which stay where they are.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, partitions, table

#: Neighbours; every how many-th vector asks; factor of the query (see README for what other factors visit and find).
K, EVERY, FACTOR = 20, 20, 1.0
#: Distinct vectors of a shard at most, on average; cells at most, whose centres go to every task; points of a leaf.
SHARD, CELLS, LEAF = 10_000, 4096, 256
#: Queries that a task searches together.
TOGETHER = 2048
#: Rounding allowed for, as a share of the squared distances that are compared.
SLACK = 1e-9


@dataclass
class Tree:
    points: np.ndarray  # original vectors, in the order of the leaves
    first: np.ndarray  # what decides between equal products: the smaller goes first
    rows: np.ndarray  # their row numbers before
    norm: float
    nodes: list[tuple]  # (first, end) of a leaf, or (vantage, near, far, lo/hi of near, lo/hi of far)

    @staticmethod
    def build(vectors: np.ndarray, first: np.ndarray | None = None, leaf: int = LEAF) -> Tree:
        size = np.sqrt((vectors**2).sum(axis=1))
        norm = float(size.max(initial=0.0))
        lifted = np.c_[vectors, np.sqrt(np.maximum(norm**2 - size**2, 0))]
        order, nodes = np.arange(len(vectors)), []

        def grow(low: int, end: int) -> int:
            at = len(nodes)
            nodes.append((low, end))
            if end - low > leaf:
                mine = order[low:end]
                start = lifted[mine[0]]
                vantage = lifted[mine[np.argmax(((lifted[mine] - start) ** 2).sum(axis=1))]]
                d = np.sqrt(((lifted[mine] - vantage) ** 2).sum(axis=1))
                by = np.argsort(d, kind="stable")
                half = len(by) // 2
                order[low:end], d = mine[by], d[by]
                near = grow(low, low + half)
                far = grow(low + half, end)
                nodes[at] = (vantage, near, far, d[0], d[half - 1], d[half], d[-1])
            return at

        grow(0, len(vectors))
        first = np.arange(len(vectors)) if first is None else first
        return Tree(vectors[order], first[order], order, norm, nodes)

    def search(self, queries: np.ndarray, k: int, factor: float = FACTOR, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Row numbers and products of the k best points of each query, best first, equals by `first`; -1 where there are fewer; points visited.

        Points whose product is below the query's floor are not looked for.
        """
        n, visited = len(queries), 0
        score, at = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64)
        floor = np.full(n, -np.inf) if floor is None else floor
        lifted = np.c_[queries, np.zeros(n)]
        length = (queries**2).sum(axis=1)
        base = length + self.norm**2
        # Products of the same pair by other sums may differ by so much.
        apart = 1e-12 * np.sqrt(length) * self.norm

        def exact(q: int, places: np.ndarray) -> np.ndarray:
            return (self.points[places] * queries[q]).sum(axis=1)

        def leaf(low: int, end: int, who: np.ndarray) -> None:
            both = np.c_[score[who], queries[who] @ self.points[low:end].T]
            index = np.c_[at[who], np.broadcast_to(np.arange(low, end), (len(who), end - low))]
            line = np.arange(len(who))[:, None]
            if both.shape[1] > k:
                best = np.argpartition(-both, k - 1, axis=1)[:, :k]
                edge = both[line, best].min(axis=1)
                near = both >= (edge - apart[who])[:, None]
                for i in np.flatnonzero((near.sum(axis=1) > k) & (edge > -np.inf)).tolist():  # equals at the edge
                    some = np.flatnonzero(near[i])
                    places = index[i, some]
                    best[i] = some[np.lexsort((self.first[places], -exact(int(who[i]), places)))[:k]]
                both, index = both[line, best], index[line, best]
            down = np.argsort(-both, axis=1, kind="stable")
            score[who], at[who] = both[line, down], index[line, down]

        def may(bound: np.ndarray, who: np.ndarray) -> np.ndarray:
            reach = base[who] - 2 * np.maximum(score[who, -1], floor[who])
            return (factor * bound) ** 2 <= reach + SLACK * base[who]

        def visit(node: int, who: np.ndarray) -> None:
            nonlocal visited
            if not len(who):
                return
            if len(self.nodes[node]) == 2:
                low, end = self.nodes[node]
                visited += len(who) * (end - low)
                leaf(low, end, who)
                return
            vantage, near, far, near_lo, near_hi, far_lo, far_hi = self.nodes[node]
            d = np.sqrt(((lifted[who] - vantage) ** 2).sum(axis=1))
            to_near, to_far = np.maximum(np.maximum(d - near_hi, near_lo - d), 0), np.maximum(np.maximum(d - far_hi, far_lo - d), 0)
            first = d <= (near_hi + far_lo) / 2
            for child, bound, when in ((near, to_near, first), (far, to_far, ~first), (far, to_far, first), (near, to_near, ~first)):
                mine = np.flatnonzero(when)
                visit(child, who[mine[may(bound[mine], who[mine])]])

        visit(0, np.arange(n))
        row = np.full((n, k), -1, np.int64)
        for q in range(n):
            places = at[q][at[q] >= 0]
            value = exact(q, places)
            by = np.lexsort((self.first[places], -value))
            score[q, : len(by)], row[q, : len(by)] = value[by], self.rows[places[by]]
        return row, score, visited


def _valid(df: DataFrame) -> DataFrame:
    """Vectors without null, non-finite or only zero components."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def _smallest_ids(kept: int):
    """A row (v, ids) for each distinct vector of a batch, with its `kept` smallest ids; v: the bytes of its components as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids: dict[bytes, list[int]] = {}
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.setdefault((np.array(v, np.float64) + 0.0).tobytes(), []).append(i)
            yield pa.RecordBatch.from_arrays([pa.array(list(ids), pa.binary()), pa.array([sorted(set(x))[:kept] for x in ids.values()], pa.list_(pa.int64()))], ["v", "ids"])

    return run


def _matrix(vectors: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors)).reshape(-1, width)


def _cells_of(x: np.ndarray, pivots: np.ndarray, rows: int = 4096) -> np.ndarray:
    """The nearest pivot of each row."""
    half = (pivots**2).sum(axis=1) / 2
    return np.concatenate([np.zeros(0, np.int64), *((x[i : i + rows] @ pivots.T - half).argmax(axis=1) for i in range(0, len(x), rows))])


def _lists(kind: str = "found") -> pa.DataType:
    return pa.list_(pa.struct([("loss", pa.float64()), ("vec_id", pa.int64())]))


def _searched(trees: DataFrame, asked: DataFrame, kept: int, factor: float, tasks: int) -> DataFrame:
    """trees (shard, tree), asked (shard, v, floor) -> v, shard, found: what each shard adds, `kept` at most; a task meets a shard's tree, then its queries."""
    tree_rows = trees.select("shard", F.lit(None).cast("binary").alias("v"), F.lit(None).cast("double").alias("floor"), "tree")
    rows = tree_rows.unionByName(asked.select("shard", "v", "floor", F.lit(None).cast("binary").alias("tree")))
    rows = rows.repartition(tasks, "shard").sortWithinPartitions("shard", F.col("tree").isNull())

    def answer(tree: Tree, ids: list, v: list[bytes], floor: np.ndarray) -> list:
        got, score, _ = tree.search(_matrix(v, tree.points.shape[1]), kept, factor, floor)
        out = []
        for low, found, s in zip(floor.tolist(), got.tolist(), score.tolist(), strict=True):
            pairs = sorted((-x, i) for x, r in zip(s, found, strict=True) if r >= 0 and x >= low for i in ids[r])[:kept]
            out.append([{"loss": x, "vec_id": i} for x, i in pairs])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tree, ids = None, None, []
        for b in batches:
            shard = b.column("shard").to_numpy()
            edge = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for s, e in zip(edge, edge[1:], strict=False):
                if e > s and shard[s] != held:
                    held, (tree, ids) = shard[s], pickle.loads(b.column("tree")[s].as_py())
                    s += 1
                for i in range(s, e, TOGETHER):
                    part = b.slice(i, min(TOGETHER, e - i))
                    v = part.column("v").to_pylist()
                    floor = part.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)
                    yield pa.RecordBatch.from_arrays([part.column("v"), part.column("shard"), pa.array(answer(tree, ids, v, floor), _lists())], ["v", "shard", "found"])

    return rows.mapInArrow(run, "v binary, shard bigint, found array<struct<loss: double, vec_id: bigint>>")


def _best(found: DataFrame, kept: int) -> DataFrame:
    """v, found: the best of all shards, first within 32 groups of them."""

    def top(*by: str) -> Column:
        return F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, kept).alias("found")

    some = found.groupBy("v", F.pmod("shard", F.lit(32)).alias("part")).agg(top())
    return some.groupBy("v").agg(top())


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR, shard: int = SHARD, scratch: Scratch | None = None, leaf: int = LEAF) -> DataFrame:
    """vectors, queries (vec_id, embedding) -> query_id, rank, vec_id, score: the k nearest found, without the query's own row.

    Copies of a vector are searched once and stand for their k + 1 smallest
    ids: no more can be among a query's k. Rows that repeat both id and vector
    count once, in queries too. Ties go to the smaller id. Invalid vectors and
    null ids take no part; vectors must have one length. Other columns are not
    looked at. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark)
    kept = k + 1
    own = _valid(vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")))
    asked = _valid(queries.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")))
    merged = own.mapInArrow(_smallest_ids(kept), "v binary, ids array<bigint>").groupBy("v").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, kept).alias("ids"))
    merged = scratch.write(merged, "ann-distinct")
    each = scratch.write(asked.mapInArrow(_each_vector, "v binary, query_id bigint").distinct(), "ann-queries")
    number = merged.count()
    cells = max(1, min(CELLS, -(-number // shard)))
    sample = [bytes(x.v) for x in merged.orderBy(F.xxhash64("v"), "v").limit(cells).select("v").collect()]
    if not sample:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    width = len(sample[0]) // 8
    pivots = spark.sparkContext.broadcast(_matrix(sample, width))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("v").to_pylist(), width)
            cell = _cells_of(x, pivots.value)
            away = np.sqrt(((x - pivots.value[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int64()), pa.array(away)], [*b.schema.names, "cell", "away"])

    dealt = scratch.write(merged.mapInArrow(placed, "v binary, ids array<bigint>, cell bigint, away double"), "ann-placed")
    # One row for each cell, CELLS at most: its radius and in how many shards it is.
    of = {x.cell: (x.r, -(-x.n // shard)) for x in dealt.groupBy("cell").agg(F.max("away").alias("r"), F.count("*").alias("n")).collect()}
    radius, parts = np.array([of.get(c, (0.0, 0))[0] for c in range(cells)]), np.array([of.get(c, (0.0, 0))[1] for c in range(cells)], np.int64)
    start = np.cumsum(parts) - parts
    by_cell = F.array(*(F.struct(F.lit(int(s)).cast("long").alias("start"), F.lit(int(p)).cast("long").alias("parts")) for s, p in zip(start, parts, strict=True))) if cells <= 64 else None
    if by_cell is not None:
        shard_of = by_cell[F.col("cell").cast("int")]
        dealt = dealt.withColumn("shard", shard_of["start"] + F.pmod(F.xxhash64("v"), F.greatest(shard_of["parts"], F.lit(1))))
    else:
        sizes = F.broadcast(spark.createDataFrame([(c, int(s), int(p)) for c, (s, p) in enumerate(zip(start, parts, strict=True))], "cell bigint, start bigint, parts bigint"))
        dealt = dealt.join(sizes, "cell").withColumn("shard", F.col("start") + F.pmod(F.xxhash64("v"), F.col("parts")))

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("v")
        tree = Tree.build(_matrix(list(group["v"]), width), np.array([x[0] for x in group["ids"]], np.int64), leaf)
        return pd.DataFrame({"shard": [key[0]], "tree": [pickle.dumps((tree, [list(x) for x in group["ids"]]))]})

    trees = scratch.write(dealt.select("shard", "v", "ids").groupBy("shard").applyInPandas(build, "shard bigint, tree binary"), "ann-trees")
    scratch.drop("ann-distinct", "ann-placed")
    shared = spark.sparkContext.broadcast((radius, parts, start))
    tasks = max(partitions(spark), min(4 * CELLS, 2 * int(parts.sum())))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, parts, start = shared.value
        for b in batches:
            cell = _cells_of(_matrix(b.column(0).to_pylist(), width), pivots.value)
            yield _visits(b.column(0), np.arange(b.num_rows), cell, np.full(b.num_rows, -np.inf), parts, start)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        radius, parts, start = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                x = _matrix(part.column(0).to_pylist(), width)
                floor = part.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
                length = np.sqrt((x**2).sum(axis=1))
                most = x @ pivots.value.T + length[:, None] * radius / factor
                may = (most + SLACK * length[:, None] * (1 + radius) >= floor[:, None]) & (parts > 0)
                may[np.arange(len(x)), _cells_of(x, pivots.value)] = False
                who, cell = np.nonzero(may)
                yield _visits(part.column(0), who, cell, floor[who], parts, start)

    questions = each.select("v").distinct()
    visit = "v binary, shard bigint, floor double"
    near = scratch.write(_searched(trees, questions.mapInArrow(home, visit), kept, factor, tasks), "ann-near")
    known = _best(near, kept)
    floor = F.when(F.size("found") >= kept, -F.element_at("found", kept)["loss"]).otherwise(F.lit(float("-inf")))
    far = _searched(trees, known.select("v", floor.alias("floor")).mapInArrow(others, visit), kept, factor, tasks)
    best = _best(near.unionByName(far), kept)
    rest = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    listed = each.join(best, "v").select("query_id", F.posexplode(rest).alias("pos", "hit"))
    return listed.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.loss")).alias("score"))


def _visits(v: pa.Array, who: np.ndarray, cell: np.ndarray, floor: np.ndarray, parts: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """A row for each shard of the cells that the queries go to."""
    n = parts[cell]
    again = np.repeat(np.arange(len(who)), n)
    shard = start[cell][again] + np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
    return pa.RecordBatch.from_arrays([v.take(pa.array(who[again])), pa.array(shard, pa.int64()), pa.array(floor[again])], ["v", "shard", "floor"])


def _each_vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([(np.array(v, np.float64) + 0.0).tobytes() for v in b.column(1).to_pylist()], pa.binary()), b.column(0)], ["v", "query_id"])


def op7_vantage_point_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The K nearest neighbours of every EVERY-th vector of `embeddings` among all others, by `nearest`."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % EVERY == 0))
