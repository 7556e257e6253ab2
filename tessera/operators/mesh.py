"""Mesh operators on two tables: vertices (mesh_id, vid, x, y, z) and faces (mesh_id, fid, i0, i1, i2)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import numbers

AXES = ("x", "y", "z")
#: Keys of a quadric: the upper triangle of the symmetric matrix of a plane (a, b, c, d).
QUADRIC = tuple((i, j) for i in range(4) for j in range(i, 4))


# ---- access by index ----


def corners(faces: DataFrame) -> DataFrame:
    """mesh_id, fid, corner, vid: one row for each corner."""
    return faces.select("mesh_id", "fid", F.posexplode(F.array("i0", "i1", "i2")).alias("corner", "vid"))


def at_corners(faces: DataFrame, values: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """faces with, for each corner k, the columns of `values` (mesh_id, vid, ...) as name + k.

    One join on the vertex and one aggregation by the face, whatever the number
    of corners. A face with an index that names no vertex is left out.
    """
    joined = corners(faces).join(values.select("mesh_id", "vid", *columns).hint("merge"), ["mesh_id", "vid"])
    picks = [F.max(F.when(F.col("corner") == k, F.col(c))).alias(f"{c}{k}") for k in range(3) for c in ("vid", *columns)]
    found = joined.groupBy("mesh_id", "fid").agg(F.count("*").alias("_n"), *picks).where("_n = 3").drop("_n")
    return found.withColumnsRenamed({f"vid{k}": f"i{k}" for k in range(3)})


def triangles(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """faces with x0, y0, z0, x1, ..., z2."""
    return at_corners(faces, vertices, AXES)


def drop_degenerate(faces: DataFrame) -> DataFrame:
    return faces.where("i0 <> i1 and i1 <> i2 and i0 <> i2")


def fan(polygons: DataFrame) -> DataFrame:
    """polygons (mesh_id, pid, corners array) -> triangles around the first corner: mesh_id, pid, step, i0, i1, i2."""
    steps = polygons.where(F.size("corners") >= 3).withColumn("step", F.explode(F.sequence(F.lit(1), F.size("corners") - 2)))
    return steps.select("mesh_id", "pid", "step", F.col("corners")[0].alias("i0"), F.col("corners")[F.col("step")].alias("i1"), F.col("corners")[F.col("step") + 1].alias("i2"))


def numbered(df: DataFrame, order: str, name: str, bucket: int = 1 << 16) -> DataFrame:
    """df with `name`: the place of each row of a mesh, from zero, in the order of a column of distinct numbers.

    Rows are ranked within buckets of the numbers, and buckets are counted, so
    that no task ranks a whole mesh.
    """
    placed = df.withColumn("_bucket", F.floor(F.col(order) / bucket))
    counts = placed.groupBy("mesh_id", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("mesh_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("mesh_id", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("mesh_id", "_bucket").orderBy(order)) - 1
    ranked = placed.withColumn("_rank", rank).join(starts, ["mesh_id", "_bucket"])
    return ranked.withColumn(name, (F.col("_start") + F.col("_rank")).cast("long")).drop("_bucket", "_start", "_rank")


# ---- welding and clustering ----


def weld_keys(vertices: DataFrame, tolerance: float, rounded: bool = True) -> DataFrame:
    """vertices with kx, ky, kz: the cell of the tolerance, by rounding half away from zero or by cutting towards it."""
    tolerance = tolerance if tolerance > 0 else 1e-6
    cell = (lambda v: F.round(v / tolerance)) if rounded else (lambda v: v / tolerance)
    return vertices.select("*", *(cell(F.col(a)).cast("long").alias(f"k{a}") for a in AXES))


def weld(vertices: DataFrame, faces: DataFrame, tolerance: float, rounded: bool = True, degenerate: bool = False) -> tuple[DataFrame, DataFrame]:
    """Vertices in one cell become the first of them, unchanged; faces are renumbered, and lose those that collapse unless `degenerate`."""
    keyed = weld_keys(vertices, tolerance, rounded)
    cells = keyed.groupBy("mesh_id", "kx", "ky", "kz").agg(F.min("vid").alias("rep"), *(F.min_by(a, "vid").alias(a) for a in AXES))
    cells = numbered(cells, "rep", "new_vid")
    remap = keyed.select("mesh_id", "vid", "kx", "ky", "kz").join(cells, ["mesh_id", "kx", "ky", "kz"]).select("mesh_id", "vid", "new_vid")
    moved = at_corners(faces, remap, ("new_vid",)).select("mesh_id", "fid", *(F.col(f"new_vid{k}").alias(f"i{k}") for k in range(3)))
    return cells.select("mesh_id", F.col("new_vid").alias("vid"), *AXES), moved if degenerate else drop_degenerate(moved)


def cluster(vertices: DataFrame, faces: DataFrame, ratio: float) -> tuple[DataFrame, DataFrame]:
    """Cells of a grid over the bounding box with about ratio x vertices cells: the mean position of each, numbered in their order, and faces between different cells."""
    box = vertices.groupBy("mesh_id").agg(
        F.count("*").alias("n"), *(F.min(a).alias(f"{a}_lo") for a in AXES), *(F.greatest(F.max(a) - F.min(a), F.lit(1e-6)).alias(f"{a}_size") for a in AXES)
    )
    cells = F.greatest(F.lit(2), F.ceil(F.round(F.cbrt(F.greatest(F.lit(4), F.ceil(F.col("n") * ratio)).cast("double")), 9)))
    box = box.withColumn("cells", cells.cast("long")).drop("n")

    def cell(a: str) -> Column:
        return F.least(F.floor((F.col(a) - F.col(f"{a}_lo")) * F.col("cells") / F.col(f"{a}_size")), F.col("cells") - 1)

    keys = ["mesh_id", *(f"c{a}" for a in AXES)]
    placed = vertices.join(box, "mesh_id").select("mesh_id", "vid", *(cell(a).alias(f"c{a}") for a in AXES), *AXES)
    means = placed.groupBy(*keys).agg(*(F.avg(a).alias(a) for a in AXES))
    # Cells in the order of their keys, by one number.
    means = means.join(box.select("mesh_id", "cells"), "mesh_id").withColumn("cell", (F.col("cx") * F.col("cells") + F.col("cy")) * F.col("cells") + F.col("cz"))
    means = numbered(means, "cell", "new_vid")
    remap = placed.select("vid", *keys).join(means, keys).select("mesh_id", "vid", "new_vid")
    moved = at_corners(faces, remap, ("new_vid",)).select("mesh_id", "fid", *(F.col(f"new_vid{k}").alias(f"i{k}") for k in range(3)))
    return means.select("mesh_id", F.col("new_vid").alias("vid"), *AXES), drop_degenerate(moved)


# ---- edges, normals, quadrics ----


def edges(faces: DataFrame) -> DataFrame:
    """mesh_id, lo, hi, n: each undirected edge and how many faces use it."""
    sides = F.explode(F.array(*(F.struct(F.col(a).alias("p"), F.col(b).alias("q")) for a, b in (("i0", "i1"), ("i1", "i2"), ("i2", "i0")))))
    side = faces.select("mesh_id", sides.alias("e")).where("e.p <> e.q")
    return side.groupBy("mesh_id", F.least("e.p", "e.q").alias("lo"), F.greatest("e.p", "e.q").alias("hi")).agg(F.count("*").alias("n"))


def with_ends(edge: DataFrame, values: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Edges with the columns of `values` at both ends, as lo_name and hi_name."""
    for end in ("lo", "hi"):
        edge = edge.join(values.select("mesh_id", F.col("vid").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in columns)).hint("merge"), ["mesh_id", end])
    return edge


def edge_lengths(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """mesh_id, lo, hi, length2: squared lengths of the distinct edges."""
    square = sum(((F.col(f"lo_{a}") - F.col(f"hi_{a}")) * (F.col(f"lo_{a}") - F.col(f"hi_{a}")) for a in AXES), F.lit(0.0))
    return with_ends(edges(faces), vertices, AXES).select("mesh_id", "lo", "hi", square.alias("length2"))


def face_vectors(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Triangles with nx, ny, nz: the cross product of two sides, not normalised."""
    t = triangles(vertices, faces)
    p, q = ([F.col(f"{a}{k}") - F.col(f"{a}0") for a in AXES] for k in (1, 2))
    return t.select("*", *(v.alias(f"n{a}") for a, v in zip(AXES, numbers.cross(p, q), strict=True)))


def vertex_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """mesh_id, vid, nx, ny, nz: the sum of the vectors of a vertex's faces, at length one unless it is nearly nothing."""
    each = face_vectors(vertices, faces).select("mesh_id", F.explode(F.array("i0", "i1", "i2")).alias("vid"), "nx", "ny", "nz")
    total = each.groupBy("mesh_id", "vid").agg(*(F.sum(f"n{a}").alias(f"n{a}") for a in AXES))
    square = sum((F.col(f"n{a}") * F.col(f"n{a}") for a in AXES), F.lit(0.0))
    length = F.when(square > 1e-20, F.sqrt(square)).otherwise(1.0)
    return total.select("mesh_id", "vid", *((F.col(f"n{a}") / length).alias(f"n{a}") for a in AXES))


def vertex_tangents(vertices: DataFrame, faces: DataFrame, normals: DataFrame) -> DataFrame:
    """vertices with u, v -> mesh_id, vid, tx, ty, tz, w: tangents along u, square to the normal, and their handedness."""
    t = at_corners(faces, vertices, (*AXES, "u", "v"))
    (du1, dv1), (du2, dv2) = ((F.col(f"u{k}") - F.col("u0"), F.col(f"v{k}") - F.col("v0")) for k in (1, 2))
    det = du1 * dv2 - du2 * dv1
    e1, e2 = ([F.col(f"{a}{k}") - F.col(f"{a}0") for a in AXES] for k in (1, 2))
    values = [((dv2 * p - dv1 * q) / det).alias(f"t{a}") for a, p, q in zip(AXES, e1, e2, strict=True)] + [((du1 * q - du2 * p) / det).alias(f"b{a}") for a, p, q in zip(AXES, e1, e2, strict=True)]
    each = t.where(F.abs(det) > 1e-20).select("mesh_id", F.explode(F.array("i0", "i1", "i2")).alias("vid"), *values)
    names = [f"{k}{a}" for k in "tb" for a in AXES]
    total = each.groupBy("mesh_id", "vid").agg(*(F.sum(c).alias(c) for c in names)).join(normals, ["mesh_id", "vid"])
    along = sum((F.col(f"t{a}") * F.col(f"n{a}") for a in AXES), F.lit(0.0))
    square = total.select("*", *((F.col(f"t{a}") - F.col(f"n{a}") * along).alias(f"s{a}") for a in AXES))
    length = F.sqrt(sum((F.col(f"s{a}") * F.col(f"s{a}") for a in AXES), F.lit(0.0)))
    side = numbers.cross([F.col(f"n{a}") for a in AXES], [F.col(f"t{a}") for a in AXES])
    hand = F.when(sum((s * F.col(f"b{a}") for s, a in zip(side, AXES, strict=True)), F.lit(0.0)) < 0, -1.0).otherwise(1.0)
    return square.where(length > 1e-10).select("mesh_id", "vid", *((F.col(f"s{a}") / length).alias(f"t{a}") for a in AXES), hand.alias("w"))


def face_planes(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """mesh_id, fid, i0, i1, i2, a, b, c, d: unit normal and offset; faces without area are left out."""
    v = face_vectors(vertices, faces)
    length = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    offset = -(F.col("nx") * F.col("x0") + F.col("ny") * F.col("y0") + F.col("nz") * F.col("z0")) / length
    return v.where(length >= 1e-12).select("mesh_id", "fid", "i0", "i1", "i2", (F.col("nx") / length).alias("a"), (F.col("ny") / length).alias("b"), (F.col("nz") / length).alias("c"), offset.alias("d"))


def vertex_quadrics(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """mesh_id, vid, q00 ... q33: the sum over a vertex's faces of the products of their plane's coefficients."""
    plane = "abcd"
    products = [(F.col(plane[i]) * F.col(plane[j])).alias(f"q{i}{j}") for i, j in QUADRIC]
    each = face_planes(vertices, faces).select("mesh_id", F.explode(F.array("i0", "i1", "i2")).alias("vid"), *products)
    return each.groupBy("mesh_id", "vid").agg(*(F.sum(f"q{i}{j}").alias(f"q{i}{j}") for i, j in QUADRIC))


def collapse_costs(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """mesh_id, lo, hi, cost: the quadric error of each edge's midpoint, not below zero."""
    names = tuple(f"q{i}{j}" for i, j in QUADRIC)
    known = vertices.join(vertex_quadrics(vertices, faces), ["mesh_id", "vid"])
    e = with_ends(edges(faces), known, (*AXES, *names))
    middle = [(F.col(f"lo_{a}") + F.col(f"hi_{a}")) / 2 for a in AXES] + [F.lit(1.0)]
    total = sum(((1 if i == j else 2) * (F.col(f"lo_q{i}{j}") + F.col(f"hi_q{i}{j}")) * middle[i] * middle[j] for i, j in QUADRIC), F.lit(0.0))
    return e.select("mesh_id", "lo", "hi", F.greatest(total, F.lit(0.0)).alias("cost"))


# ---- decimation ----


def _ranked(faces: DataFrame) -> DataFrame:
    """faces with _k, their place in the order of fid, and _n, how many their mesh has."""
    return numbered(faces, "fid", "_k").join(faces.groupBy("mesh_id").agg(F.count("*").alias("_n")), "mesh_id")


def decimate_prefix(faces: DataFrame, ratio: float) -> DataFrame:
    """The first floor(n x ratio) faces of each mesh; fid is distinct within a mesh."""
    return _ranked(faces).where(F.col("_k") < F.floor(F.col("_n") * ratio)).select(*faces.columns)


def decimate_stride(faces: DataFrame, ratio: float) -> DataFrame:
    """Every step-th face, step being n over the target, up to the target."""
    target = F.greatest(F.floor(F.col("_n") * ratio), F.lit(1))
    step = F.floor(F.col("_n") / target)
    return _ranked(faces).where((F.col("_k") % step == 0) & (F.col("_k") / step < target)).select(*faces.columns)


def compact(faces: DataFrame) -> DataFrame:
    """Faces without the degenerate ones, vertices renumbered by their first use."""
    kept = drop_degenerate(faces)
    first = corners(kept).groupBy("mesh_id", "vid").agg(F.min(F.col("fid") * 3 + F.col("corner")).alias("use"))
    number = numbered(first, "use", "new_vid")
    return at_corners(kept, number, ("new_vid",)).select("mesh_id", "fid", *(F.col(f"new_vid{k}").alias(f"i{k}") for k in range(3)))


def union_primitives(primitives: DataFrame) -> DataFrame:
    """primitives (mesh_id, prim, n_vertices, indices array) -> mesh_id, pos, vid: indices moved behind the vertices of the primitives before."""
    before = Window.partitionBy("mesh_id").orderBy("prim").rowsBetween(Window.unboundedPreceding, -1)
    moved = primitives.withColumn("base", F.coalesce(F.sum("n_vertices").over(before), F.lit(0)))
    flat = moved.select("mesh_id", "prim", "base", F.posexplode("indices").alias("at", "index"))
    return flat.select("mesh_id", "prim", F.col("at").cast("long").alias("pos"), (F.col("index") + F.col("base")).cast("long").alias("vid"))


# ---- adjacency and the vertex cache ----


def adjacency(faces: DataFrame) -> DataFrame:
    """mesh_id, vid, fids: the faces of each vertex, ascending."""
    return corners(faces).groupBy("mesh_id", "vid").agg(F.array_sort(F.collect_set("fid")).alias("fids"))


def cache_score(valence: Column, position: Column, size: int = 32) -> Column:
    """Score of a vertex: -1 without faces; by its place in the cache (null: outside), and more the fewer faces it has left."""
    place = F.when(position.isNull(), 0.0).when(position < 3, 0.75).otherwise(F.pow(1 - (position - 3) / float(size - 3), F.lit(1.5)))
    return F.when(valence == 0, -1.0).otherwise(place + 2.0 / F.sqrt(valence.cast("double")))


#: Faces that are put in order together: a cache of 64 vertices forgets what lies further apart.
TILE = 1 << 14


def order_for_cache(faces: DataFrame, size: int = 32, tile: int = TILE) -> DataFrame:
    """mesh_id, place, fid: faces in the order that a greedy choice by cache scores gives.

    A mesh is cut into tiles of faces in the order of fid, each of which is one
    group and keeps its places, so that no mesh is in one task. fid is distinct
    within a mesh.
    """
    size = min(64, max(4, size))

    place = np.array([0.75 if at < 3 else (1 - (at - 3) / (size - 3)) ** 1.5 for at in range(size)])

    def run(key: tuple, face: pd.DataFrame) -> pd.DataFrame:
        face = face.sort_values("fid")
        names, flat = np.unique(face[["i0", "i1", "i2"]].to_numpy(np.int64), return_inverse=True)
        tri = flat.reshape(-1, 3)
        # Faces of each vertex, each once; those that are done are swept out now and then.
        by = np.unique(np.stack([flat.reshape(-1), np.repeat(np.arange(len(tri)), 3)]), axis=1)
        left = np.bincount(by[0], minlength=len(names))
        uses = np.split(by[1], np.cumsum(left)[:-1])
        few = np.array([0.0, *(2 * n**-0.5 for n in range(1, int(left.max(initial=0)) + 1))])
        score = np.where(left > 0, few[left], -1.0)
        corners = tri.tolist()
        cache: list[int] = []
        order, done, first = [], np.zeros(len(tri), bool), 0
        while len(order) < len(tri):
            near = np.concatenate([uses[v] for v in cache]) if cache else by[1][:0]
            near = near[~done[near]]
            if len(near):
                a, b, c = score[tri[near]].T
                # Rounding is that of Python's sum, so that equal scores stay equal.
                ab = a + b
                lost = np.where(abs(a) >= abs(b), (a - ab) + b, (b - ab) + a)
                abc = ab + c
                total = abc + (lost + np.where(abs(ab) >= abs(c), (ab - abc) + c, (c - abc) + ab))
                f = int(near[total == total.max()].min())
            else:
                while done[first]:
                    first += 1
                f = first
            done[f] = True
            order.append(f)
            own = list(dict.fromkeys(corners[f]))
            for v in own:
                left[v] -= 1
                if 2 * left[v] < len(uses[v]):
                    uses[v] = uses[v][~done[uses[v]]]
            kept = own + [v for v in cache if v not in own]
            gone, cache = kept[size:], kept[:size]
            for vs, at in ((cache, place[: len(cache)]), (gone, 0.0)):
                n = left[vs] if vs else left[:0]
                score[vs] = np.where(n > 0, at + few[n], -1.0)
        return pd.DataFrame({"mesh_id": key[0], "place": key[1] * tile + np.arange(len(order)), "fid": face["fid"].to_numpy()[order]})

    cut = numbered(faces, "fid", "_k").withColumn("_tile", F.floor(F.col("_k") / tile))
    return cut.groupBy("mesh_id", "_tile").applyInPandas(run, "mesh_id long, place long, fid long")


# ---- summaries and checks ----


def bounds(vertices: DataFrame) -> DataFrame:
    """mesh_id, n, lowest and highest coordinates, size, centre and volume."""
    box = vertices.groupBy("mesh_id").agg(F.count("*").alias("n"), *(F.min(a).alias(f"{a}_min") for a in AXES), *(F.max(a).alias(f"{a}_max") for a in AXES))
    size = {a: F.col(f"{a}_max") - F.col(f"{a}_min") for a in AXES}
    return box.select("*", *(size[a].alias(f"{a}_size") for a in AXES), *(((F.col(f"{a}_max") + F.col(f"{a}_min")) / 2).alias(f"{a}_mid") for a in AXES), (size["x"] * size["y"] * size["z"]).alias("volume"))


def fit_to_box(vertices: DataFrame, box: float = 2.0) -> DataFrame:
    """Vertices centred, and scaled so that the diagonal of the mesh's box has length `box`."""
    b = bounds(vertices)
    diagonal = F.sqrt(sum((F.col(f"{a}_size") * F.col(f"{a}_size") for a in AXES), F.lit(0.0)))
    b = b.select("mesh_id", *(f"{a}_mid" for a in AXES), (F.lit(box) / F.when(diagonal > 0, diagonal).otherwise(1.0)).alias("scale"))
    return vertices.join(b, "mesh_id").select("mesh_id", "vid", *(((F.col(a) - F.col(f"{a}_mid")) * F.col("scale")).alias(a) for a in AXES))


def invalid_data(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """mesh_id, missing, not_finite: corners that name no vertex, and vertices with a coordinate that is no number; only meshes that have some."""
    missing = corners(faces).join(vertices, ["mesh_id", "vid"], "left_anti").groupBy("mesh_id").agg(F.count("*").alias("missing"))
    finite = [F.abs(F.col(a)) < float("inf") for a in AXES]
    odd = vertices.where(~(finite[0] & finite[1] & finite[2]) | F.isnan("x") | F.isnan("y") | F.isnan("z")).groupBy("mesh_id").agg(F.count("*").alias("not_finite"))
    both = missing.join(odd, "mesh_id", "full")
    return both.select("mesh_id", F.coalesce("missing", F.lit(0)).alias("missing"), F.coalesce("not_finite", F.lit(0)).alias("not_finite"))


def summary(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """bounds and the number of faces; meshes without vertices or faces are left out."""
    return bounds(vertices).join(faces.groupBy("mesh_id").agg(F.count("*").alias("faces")), "mesh_id").where("n > 0 and faces > 0")


def obj_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """mesh_id, part (0 vertices, 1 faces), line, s: the lines of an OBJ text, each a row, so that no mesh is collected."""
    v = vertices.select("mesh_id", F.lit(0).alias("part"), F.col("vid").alias("line"), F.format_string("v %.6f %.6f %.6f", "x", "y", "z").alias("s"))
    f = faces.select("mesh_id", F.lit(1).alias("part"), F.col("fid").alias("line"), F.format_string("f %d %d %d", *(F.col(c) + 1 for c in ("i0", "i1", "i2"))).alias("s"))
    return v.unionByName(f)


def optimized_obj(vertices: DataFrame, faces: DataFrame, ratio: float, tolerance: float) -> DataFrame:
    """The lines of an OBJ text of each mesh with a share of its faces, vertices welded, and faces in the order of the vertex cache.

    mesh_id, part (0 heading, 1 vertices, 2 faces), line, s; the text is the
    lines in the order (part, line). Welding cuts towards zero and keeps faces
    that collapse.
    """
    points, welded = weld(vertices, decimate_prefix(faces, ratio), tolerance, rounded=False, degenerate=True)
    ordered = welded.join(order_for_cache(welded), ["mesh_id", "fid"]).select("mesh_id", F.col("place").alias("fid"), "i0", "i1", "i2")
    head = points.select("mesh_id").distinct().select("mesh_id", F.lit(0).alias("part"), F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("line"), F.lit(x).alias("s")) for k, x in enumerate(("# optimized", "o mesh"))))).alias("e"))
    body = obj_lines(points, ordered)
    return head.select("mesh_id", "part", "e.line", "e.s").unionByName(body.withColumn("part", F.col("part") + 1))
