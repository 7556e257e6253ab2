import math
import random
import time

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import decimation, mesh

V = "mesh_id long, vid long, x double, y double, z double"
T = "mesh_id long, fid long, i0 long, i1 long, i2 long"
CUBE = [(x, y, z) for x in (0.0, 1.0) for y in (0.0, 1.0) for z in (0.0, 1.0)]
SIDES = [(0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)]


def cube(spark, copies=1):
    v = spark.createDataFrame([(m, i, *p) for m in range(copies) for i, p in enumerate(CUBE)], V)
    f = spark.createDataFrame([(m, i, *t) for m in range(copies) for i, t in enumerate(SIDES)], T)
    return v, f


def test_weld_merges_equal_vertices_and_keeps_both_triangles(spark):
    v = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, 0.0, 0.0, 0.0), (0, 2, 1.0, 0.0, 0.0), (0, 3, 0.0, 1.0, 0.0)], V)
    f = spark.createDataFrame([(0, 0, 0, 2, 3), (0, 1, 1, 2, 3)], T)
    points, faces = mesh.weld(v, f, 1e-4)
    assert points.count() == 3
    assert [tuple(r)[2:] for r in faces.orderBy("fid").collect()] == [(0, 1, 2), (0, 1, 2)]


def test_weld_drops_collapsed_faces_and_bad_indices(spark):
    v = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, 0.00001, 0.0, 0.0), (0, 2, 1.0, 0.0, 0.0)], V)
    f = spark.createDataFrame([(0, 0, 0, 1, 2), (0, 1, 0, 2, 9)], T)
    assert mesh.weld(v, f, 1e-3)[1].count() == 0
    assert mesh.weld(v, f, 1e-3, degenerate=True)[1].count() == 1


def grid(mesh_id, n):
    """A wavy sheet of n x n vertices."""
    rnd = random.Random(mesh_id)
    v = [(mesh_id, i * n + j, float(i), float(j), math.sin(i / 3) * math.cos(j / 4) + 0.05 * rnd.gauss(0, 1)) for i in range(n) for j in range(n)]
    cells = [(i * n + j, i * n + j + 1, (i + 1) * n + j, (i + 1) * n + j + 1) for i in range(n - 1) for j in range(n - 1)]
    return v, [(mesh_id, k, *t) for k, t in enumerate(t for a, b, c, d in cells for t in ((a, b, d), (a, d, c)))]


def greedy_error(vertices, faces, target):
    """Summed error of one collapse after the other, each the cheapest of all at its time."""
    at, faces = {r[1]: np.array(r[2:]) for r in vertices}, {r[1]: r[2:] for r in faces}
    q = {k: np.zeros((4, 4)) for k in at}
    for t in faces.values():
        a, b, c = (at[k] for k in t)
        n = np.cross(b - a, c - a)
        plane = np.append(n, -n @ a) / np.linalg.norm(n)
        for k in t:
            q[k] += np.outer(plane, plane)
    total = 0.0
    while len(at) > target:
        edges = {(min(t[i], t[j]), max(t[i], t[j])) for t in faces.values() for i, j in ((0, 1), (1, 2), (2, 0))}
        cost = {(a, b): max(0.0, float(m @ (q[a] + q[b]) @ m)) for a, b in edges for m in [np.append((at[a] + at[b]) / 2, 1)]}
        a, b = min(cost, key=lambda e: (cost[e], e))
        total += cost[a, b]
        at[a], q[a] = (at[a] + at[b]) / 2, q[a] + q[b]
        del at[b]
        faces = {k: t for k, t in ((k, tuple(a if x == b else x for x in t)) for k, t in faces.items()) if len(set(t)) == 3}
    return total


def test_rounds_of_collapses_are_as_good_as_the_greedy_order(spark):
    sheets = {m: grid(m, 9) for m in range(2)}
    v = spark.createDataFrame([r for s in sheets.values() for r in s[0]], V)
    f = spark.createDataFrame([r for s in sheets.values() for r in s[1]], T)
    points, left, log = decimation.collapse_vertices(v, f, 0.5)
    assert {tuple(r) for r in points.groupBy("mesh_id").count().collect()} == {(0, 40), (1, 40)}
    for r in log.groupBy("mesh_id").agg(F.sum("cost").alias("cost"), F.count("*").alias("n")).collect():
        assert r.n == 41 and r.cost <= 1.1 * greedy_error(*sheets[r.mesh_id], 40)
    assert mesh.at_corners(left, points, ()).count() == left.count() == mesh.drop_degenerate(left).count()


def test_collapse_reaches_its_target_and_keeps_valid_faces(spark):
    v, f = cube(spark, 2)
    for price in ("quadric", "length"):
        points, out, _ = decimation.collapse(v, f, 0.5, price)
        assert {r["count"] for r in out.groupBy("mesh_id").count().collect()} <= {5, 6}
        assert mesh.drop_degenerate(out).count() == out.count()
        known = {(r.mesh_id, r.vid) for r in points.collect()}
        assert {(r.mesh_id, i) for r in out.collect() for i in (r.i0, r.i1, r.i2)} <= known
        assert all(0 <= c <= 1 for r in points.collect() for c in (r.x, r.y, r.z)) and any(c == 0.5 for r in points.collect() for c in (r.x, r.y, r.z))


def test_collapse_of_bad_corners_and_of_a_mesh_that_is_small_enough(spark):
    v = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, 1.0, 0.0, 0.0), (0, 2, 0.0, 1.0, 0.0)], V)
    f = spark.createDataFrame([(0, 0, 0, 1, 2), (0, 1, 0, 1, 9), (0, 2, 1, 1, 2), (5, 0, 0, 1, 2)], T)
    points, out, log = decimation.collapse_vertices(v, f, 0.1)
    assert points.count() == 3 and [tuple(r) for r in out.collect()] == [(0, 0, 0, 1, 2)] and log.count() == 0


def test_rounds_send_no_rows_of_vertices_to_the_driver(spark):
    v, f = grid(0, 6)
    v, f = spark.createDataFrame(v, V), spark.createDataFrame(f, T)
    for made in (mesh.with_ends(mesh.edges(f), v, mesh.AXES), decimation.locally_cheapest(decimation.priced_edges(v, f, decimation.length_price, mesh.AXES)), mesh.at_corners(f, v, ())):
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
        made.collect()
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()


def test_cache_order_is_a_permutation(spark):
    _, f = cube(spark)
    rows = mesh.order_for_cache(f).collect()
    assert sorted(r.fid for r in rows) == list(range(12)) and sorted(r.place for r in rows) == list(range(12))


def test_cube_bounds_normals_edges(spark):
    v, f = cube(spark)
    b = mesh.bounds(v).first()
    assert (b.n, b.volume, b.x_mid) == (8, 1.0, 0.5)
    assert mesh.edges(f).count() == 18
    for r in mesh.vertex_normals(v, f).collect():
        assert abs(r.nx**2 + r.ny**2 + r.nz**2 - 1) < 1e-9
    assert mesh.invalid_data(v, f).count() == 0


def test_empty_tables(spark):
    v, f = spark.createDataFrame([], V), spark.createDataFrame([], T)
    assert mesh.weld(v, f, 0.1)[1].count() == 0
    assert decimation.collapse(v, f, 0.5)[1].count() == 0
    assert mesh.summary(v, f).count() == 0


def test_cache_order_of_a_tile_with_few_vertices(spark):
    n, v = 6_000, 40
    rnd = random.Random(1)
    f = spark.createDataFrame([(0, k, *(rnd.randrange(v) for _ in range(3))) for k in range(n)], T)
    begin = time.monotonic()
    rows = mesh.order_for_cache(f).collect()
    assert time.monotonic() - begin < 45
    assert sorted(r.fid for r in rows) == list(range(n)) == sorted(r.place for r in rows)
