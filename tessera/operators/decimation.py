"""Edge collapse in rounds: every round collapses many edges, each the cheapest around both of its ends, at costs made anew.

A mesh is vertices (mesh_id, vid, x, y, z) and faces (mesh_id, fid, i0, i1, i2).
No mesh is gathered anywhere: prices, the cheapest edge of a vertex, the share
of a round and the new corners are joins and groupings by mesh and vertex.
Sides of joins that have a row for each vertex or edge are merged, not
broadcast: every round would send them through the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import mesh
from tessera.operators.mesh import AXES, QUADRIC
from tessera.staging import Staging

#: A round takes this share of what is still to go, at least one edge of a mesh.
SHARE = 0.5
#: Classes of cost for each doubling, within which the order of collapses is free; parts of a class.
CLASSES, PARTS = 16, 16
#: Costs below this count as nothing.
NOTHING = 1e-12

_Q = tuple(f"q{i}{j}" for i, j in QUADRIC)


def quadric_price(end: Callable[[str, str], Column]) -> Column:
    """Error of the midpoint under the quadrics of both ends, not below zero."""
    middle = [(end("lo", a) + end("hi", a)) / 2 for a in AXES] + [F.lit(1.0)]
    total = reduce(lambda a, b: a + b, ((1 if i == j else 2) * (end("lo", f"q{i}{j}") + end("hi", f"q{i}{j}")) * middle[i] * middle[j] for i, j in QUADRIC))
    return F.greatest(total, F.lit(0.0))


def length_price(end: Callable[[str, str], Column]) -> Column:
    """Squared length of the edge."""
    return reduce(lambda a, b: a + b, ((end("lo", a) - end("hi", a)) * (end("lo", a) - end("hi", a)) for a in AXES))


def priced_edges(points: DataFrame, faces: DataFrame, price: Callable, columns: tuple[str, ...]) -> DataFrame:
    """mesh_id, lo, hi, n (faces that go with the edge), cost."""
    e = mesh.with_ends(mesh.edges(faces), points, columns)
    return e.select("mesh_id", "lo", "hi", "n", price(lambda side, c: F.col(f"{side}_{c}")).alias("cost"))


def locally_cheapest(edges: DataFrame) -> DataFrame:
    """Edges that are the cheapest at both their ends (ties: smaller ends): no two of them share a vertex."""
    order = F.struct("cost", "lo", "hi")
    at = edges.select("mesh_id", F.explode(F.array("lo", "hi")).alias("vid"), order.alias("e")).groupBy("mesh_id", "vid").agg(F.min("e").alias("e"))
    twice = at.groupBy("mesh_id", F.col("e.lo").alias("lo"), F.col("e.hi").alias("hi")).agg(F.count("*").alias("ends")).where("ends = 2")
    return edges.join(twice.drop("ends").hint("merge"), ["mesh_id", "lo", "hi"])


def within_need(edges: DataFrame, need: DataFrame, weight: Column) -> DataFrame:
    """The cheapest edges of each mesh while those before them weigh less than its `need` (mesh_id, need).

    Costs go to classes of a few per cent, and these to parts; sums over parts
    are few, and ranks are taken within a part, so no task orders a whole mesh.
    """
    level = F.floor(F.log2(F.greatest("cost", F.lit(NOTHING))) * CLASSES)
    placed = edges.withColumns({"_w": weight, "_level": level * PARTS + F.pmod(F.xxhash64("lo", "hi"), F.lit(PARTS))})
    sums = placed.groupBy("mesh_id", "_level").agg(F.sum("_w").alias("_s"))
    before = Window.partitionBy("mesh_id").orderBy("_level").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("mesh_id", "_level", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("mesh_id", "_level").orderBy("cost", "lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("_own", F.coalesce(F.sum("_w").over(inner), F.lit(0))).join(sums.hint("merge"), ["mesh_id", "_level"]).join(need, "mesh_id")
    return ranked.where(F.col("_before") + F.col("_own") < F.col("need")).select(*edges.columns)


def collapse_rounds(vertices: DataFrame, faces: DataFrame, target: Column, by: str = "vertices", price: str = "quadric", share: float = SHARE, staging: Staging | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """vertices, faces and a target for each mesh -> vertices (mesh_id, vid, x, y, z), faces (mesh_id, fid, i0, i1, i2), collapses (mesh_id, round, lo, hi, cost).

    `target` is made from `nv` and `nf`, the vertices and faces of a mesh; `by`
    says which of the two it limits. A collapsed edge becomes its midpoint under
    the number of its lower end, which takes over both quadrics (price
    `quadric`) or just the place (`length`); the other end goes, and with it
    the faces on the edge. A mesh stops at its target, or when no edge is left.
    By faces, the last round may pass the target by one edge's faces. Meshes
    without vertices or faces stay as they are; corners that name no vertex
    drop their face.
    """
    spark = vertices.sparkSession
    staging = staging or Staging(spark)
    columns = (*AXES, *_Q) if price == "quadric" else AXES
    f = staging.write(mesh.drop_degenerate(mesh.at_corners(faces, vertices, ()).select("mesh_id", "fid", "i0", "i1", "i2")), "faces-0")
    v = vertices.select("mesh_id", "vid", *AXES)
    if price == "quadric":
        zero = {q: F.coalesce(q, F.lit(0.0)) for q in _Q}
        v = v.join(mesh.vertex_quadrics(v, f).hint("merge"), ["mesh_id", "vid"], "left").withColumns(zero)
    v = staging.write(v, "vertices-0")
    counted = v.groupBy("mesh_id").agg(F.count("*").alias("nv")).join(f.groupBy("mesh_id").agg(F.count("*").alias("nf")), "mesh_id")
    limit = staging.write(counted.select("mesh_id", target.alias("target")), "targets")
    cost = quadric_price if price == "quadric" else length_price
    weight, done, log = F.lit(1) if by == "vertices" else F.col("n"), 0, []
    while True:
        left = (v if by == "vertices" else f).groupBy("mesh_id").agg(F.count("*").alias("left"))
        need = left.join(limit, "mesh_id").where("left > target").select("mesh_id", F.greatest(F.lit(1), F.ceil((F.col("left") - F.col("target")) * share)).cast("long").alias("need"))
        open_ = f.join(need, "mesh_id", "left_semi")
        chosen = within_need(locally_cheapest(priced_edges(v, open_, cost, columns)), need, weight)
        chosen = staging.write(chosen.select("mesh_id", F.lit(done + 1).alias("round"), "lo", "hi", "cost"), f"chosen-{done + 1}")
        if chosen.isEmpty():
            break
        done += 1
        log.append(chosen)
        into = chosen.select("mesh_id", F.col("hi").alias("vid"), F.col("lo").alias("new")).hint("merge")
        gone = v.join(into, ["mesh_id", "vid"]).select("mesh_id", F.col("new").alias("vid"), *(F.col(c).alias(f"_{c}") for c in columns))
        merged = v.join(into, ["mesh_id", "vid"], "left_anti").join(gone.hint("merge"), ["mesh_id", "vid"], "left")
        place = {a: F.when(F.col(f"_{a}").isNull(), F.col(a)).otherwise((F.col(a) + F.col(f"_{a}")) / 2) for a in AXES}
        sums = {q: F.col(q) + F.coalesce(f"_{q}", F.lit(0.0)) for q in columns if q not in AXES}
        v = staging.write(merged.select("mesh_id", "vid", *((place | sums)[c].alias(c) for c in columns)), f"vertices-{done}")
        moved = mesh.corners(f).join(into, ["mesh_id", "vid"], "left").select("mesh_id", "fid", "corner", F.coalesce("new", "vid").alias("vid"))
        picks = [F.max(F.when(F.col("corner") == k, F.col("vid"))).alias(f"i{k}") for k in range(3)]
        f = staging.write(mesh.drop_degenerate(moved.groupBy("mesh_id", "fid").agg(*picks)), f"faces-{done}")
        staging.drop(f"vertices-{done - 1}", f"faces-{done - 1}")
    staging.drop(f"chosen-{done + 1}")
    empty = spark.createDataFrame([], "mesh_id long, round int, lo long, hi long, cost double")
    return v.select("mesh_id", "vid", *AXES), f, reduce(DataFrame.unionByName, log, empty)


def collapse(vertices: DataFrame, faces: DataFrame, ratio: float, price: str = "quadric", staging: Staging | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`collapse_rounds` until max(1, ceil(n x ratio)) faces of each mesh are left."""
    return collapse_rounds(vertices, faces, F.greatest(F.lit(1), F.ceil(F.col("nf") * ratio)), "faces", price, staging=staging)


def collapse_vertices(vertices: DataFrame, faces: DataFrame, ratio: float, staging: Staging | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`collapse_rounds` by quadrics until max(3, floor(n x ratio)) vertices of each mesh are left."""
    return collapse_rounds(vertices, faces, F.greatest(F.lit(3), F.floor(F.col("nv") * ratio)), staging=staging)


def decimate(vertices: DataFrame, faces: DataFrame, ratio: float, algorithm: str) -> DataFrame:
    """Faces of decimated meshes (mesh_id, fid, i0, i1, i2), by one of `quadric`, `shortest`, `cluster`, `prefix` and `stride`; the ratio is kept within 0.01 and 1."""
    ratio = min(1.0, max(0.01, ratio))
    if algorithm in ("quadric", "shortest"):
        return collapse(vertices, faces, ratio, "quadric" if algorithm == "quadric" else "length")[1]
    if algorithm == "cluster":
        return mesh.cluster(vertices, faces, ratio)[1]
    if algorithm in ("prefix", "stride"):
        return (mesh.decimate_prefix if algorithm == "prefix" else mesh.decimate_stride)(faces, ratio)
    raise ValueError(f"no algorithm {algorithm!r}")
