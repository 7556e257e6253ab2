"""Queries of the readers and writers: meshes of the driver's tables written as files, read back, and compared with the tables in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import mesh
from tessera.plans import views
from tessera.plans.registry import query
from tessera.sources import meshes, writers

#: Vertices and faces of the tables, as one relation.
_MESH = "select mesh_id,'v' kind,vid id,x a,y b,z c from v_vertices union all select mesh_id,'f',fid,i0::double,i1::double,i2::double from v_faces"
#: Formats without shared vertices: three for each face.
_SOUP = "select mesh_id,'v' kind,fid*3+k id,case k when 0 then x0 when 1 then x1 else x2 end a,case k when 0 then y0 when 1 then y1 else y2 end b,case k when 0 then z0 when 1 then z1 else z2 end c from v_tri cross join (select unnest([0,1,2]) k) union all select mesh_id,'f',fid,fid*3::double,fid*3+1::double,fid*3+2::double from v_faces"


def packed(spark: SparkSession, d: str) -> DataFrame:
    return writers.packed(views.vertices(spark, d), views.faces(spark, d))


def as_files(written: DataFrame, kind: str) -> DataFrame:
    return written.select(F.col("mesh_id").cast("string").alias("path"), F.lit(kind).alias("format"), "content")


def both(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """mesh_id, kind, id, a, b, c: what a reader gave, as one relation."""

    def part(df: DataFrame, kind: str, key: str, values: tuple[str, ...]) -> DataFrame:
        return df.select(F.col("path").cast("long").alias("mesh_id"), F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), *(F.col(v).cast("double").alias(n) for v, n in zip(values, "abc", strict=True)))

    return part(vertices, "v", "vid", ("x", "y", "z")).unionByName(part(faces, "f", "fid", ("i0", "i1", "i2")))


@query("load_obj", _MESH)
def load_obj(spark: SparkSession, d: str) -> DataFrame:
    """Faces count from one, back from the last vertex, and with slashes, by turns; there are comments, groups and normals."""
    n = F.size("points")

    def corner(t: Column, k: int) -> Column:
        i = t[f"i{k}"]
        return F.when(t["fid"] % 3 == 0, (i + 1).cast("string")).when(t["fid"] % 3 == 1, (i - n).cast("string")).otherwise(F.concat((i + 1).cast("string"), F.lit("//1")))

    v = F.transform("points", lambda p: F.concat_ws(" ", F.lit("v"), *(p[a].cast("string") for a in "xyz")))
    f = F.transform("corners", lambda t: F.concat_ws(" ", F.lit("f"), *(corner(t, k) for k in range(3))))
    text = F.array_join(F.concat(F.array(F.lit("# a mesh"), F.lit("o mesh"), F.lit("vn 0 0 1")), v, F.array(F.lit("")), f, F.array(F.lit("f 1 2 99999999"))), "\r\n")
    return both(*meshes.read_obj(as_files(packed(spark, d).select("mesh_id", F.encode(text, "UTF-8").alias("content")), "Obj")))


@query("load_stl_ascii", _SOUP)
def load_stl_ascii(spark: SparkSession, d: str) -> DataFrame:
    return both(*meshes.read_stl_text(as_files(writers.stl_text(packed(spark, d)), "Stl")))


@query("load_ply_ascii", _MESH)
def load_ply_ascii(spark: SparkSession, d: str) -> DataFrame:
    return both(*meshes.read_binary(as_files(writers.ply_text(packed(spark, d)), "Ply"))[:2])


def _binary(name: str, kind: str, reader: str, sql: str) -> None:
    @query(name, sql)
    def load(spark: SparkSession, d: str) -> DataFrame:
        return both(*meshes.read_binary(as_files(writers.write_binary(packed(spark, d), kind), reader))[:2])


_binary("load_stl_bin", "Stl", "Stl", _SOUP)
_binary("load_ply_bin", "Ply", "Ply", _MESH)
_binary("load_ply_big_endian", "PlyBig", "Ply", _MESH)
_binary("load_gltf", "Gltf", "Gltf", _MESH)
_binary("load_glb", "Glb", "Glb", _MESH)
_binary("load_fbx_bin", "Fbx", "Fbx", _MESH)
_binary("load_fbx_bin_wide", "FbxWide", "Fbx", _MESH)


@query("load_fbx_ascii", _MESH)
def load_fbx_ascii(spark: SparkSession, d: str) -> DataFrame:
    points = F.array_join(F.transform("points", lambda p: F.concat_ws(",", *(p[a].cast("string") for a in "xyz"))), ",")
    index = F.array_join(F.transform("corners", lambda t: F.concat_ws(",", t["i0"].cast("string"), t["i1"].cast("string"), (-t["i2"] - 1).cast("string"))), ",")
    text = F.concat(
        F.lit("; FBX 7.4.0 project file\nObjects:  {\n\tGeometry: 1, \"Geometry::\", \"Mesh\" {\n\t\tVertices: *"), (F.size("points") * 3).cast("string"), F.lit(" {\n\t\t\ta: "), points,
        F.lit("\n\t\t}\n\t\tPolygonVertexIndex: *"), (F.size("corners") * 3).cast("string"), F.lit(" {\n\t\t\ta: "), index, F.lit("\n\t\t}\n\t}\n}\n"),
    )
    return both(*meshes.read_binary(as_files(packed(spark, d).select("mesh_id", F.encode(text, "UTF-8").alias("content")), "Fbx"))[:2])


@query("ply_header", "select mesh_id,'vertex' element,count(*) n from v_vertices group by 1 union all select mesh_id,'face',count(*) from v_faces group by 1")
def ply_header(spark: SparkSession, d: str) -> DataFrame:
    """Elements and their numbers, by the header alone: the body is not read."""
    head = F.substring_index(F.decode(F.substring("content", 1, 1024), "ISO-8859-1"), "end_header", 1)
    each = writers.write_binary(packed(spark, d), "Ply").select("mesh_id", F.explode(F.regexp_extract_all(head, F.lit(r"(?m)^element (\S+ \d+)"), F.lit(1))).alias("e"))
    return each.select("mesh_id", F.split("e", " ")[0].alias("element"), F.split("e", " ")[1].cast("long").alias("n"))


@query("opt_stl_bin", "select mesh_id,count(*) faces,(84+50*count(*))::bigint bytes from (select mesh_id,row_number() over (partition by mesh_id order by fid) rn,count(*) over (partition by mesh_id) n from v_faces) t where rn<=floor(n*0.5) group by 1")
def opt_stl_bin(spark: SparkSession, d: str) -> DataFrame:
    """The first half of the records, with a count that is right."""
    written = writers.write_binary(writers.packed(views.vertices(spark, d), mesh.decimate_prefix(views.faces(spark, d), 0.5)), "Stl")
    faces = meshes.read_binary(as_files(written, "Stl"))[1].groupBy("path").agg(F.count("*").alias("faces"))
    return written.join(faces, F.col("mesh_id").cast("string") == F.col("path")).select("mesh_id", "faces", F.length("content").cast("long").alias("bytes"))


def _attributed(spark: SparkSession, d: str, kind: str) -> DataFrame:
    v = views.textured(spark, d)
    return writers.write_attributed(v.join(mesh.vertex_normals(v, views.faces(spark, d)), ["mesh_id", "vid"]), views.faces(spark, d), kind)


_CARRIED = "select '{k}' kind,mesh_id,vid,nx::float nx,ny::float ny,nz::float nz,u::float u,v::float v from v_normals join v_vertices using (mesh_id,vid)"


@query("load_attributes", " union all ".join(_CARRIED.format(k=k) for k in ("Ply", "PlyBig", "Glb")))
def load_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Normals and texture coordinates written to PLY of both byte orders and to GLB, and read back."""

    def one(kind: str) -> DataFrame:
        found = meshes.read_attributes(as_files(_attributed(spark, d, kind), kind.removesuffix("Big")))
        return found.select(F.lit(kind).alias("kind"), F.col("path").cast("long").alias("mesh_id"), "vid", *(F.col(c).cast("float").alias(c) for c in meshes.ATTRIBUTES))

    return one("Ply").unionByName(one("PlyBig")).unionByName(one("Glb"))


_MOST = ",".join(f"('a_{t}',{most}::bigint)" for t, most in writers.SCALARS)


@query("ply_scalar", f"select o kind,mesh_id,vid,property,((vid*7919)%most)::double value from v_vertices cross join (values {_MOST}) m(property,most) cross join (select unnest(['Ply','PlyBig']) o) k")
def ply_scalar(spark: SparkSession, d: str) -> DataFrame:
    """Properties of every scalar type, written in both byte orders and read back."""

    def one(kind: str) -> DataFrame:
        found = meshes.read_ply_scalars(as_files(_attributed(spark, d, kind), "Ply")).where(F.col("property").startswith("a_"))
        return found.select(F.lit(kind).alias("kind"), F.col("path").cast("long").alias("mesh_id"), F.col("row").alias("vid"), "property", "value")

    return one("Ply").unionByName(one("PlyBig"))
