"""Queries of the mesh operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import numbers
from tessera.operators import decimation, mesh
from tessera.plans import views
from tessera.plans.registry import query, rounded


def r(*names: str, digits: int = 6) -> str:
    """The named columns, rounded, for SQL; "expression name" or a plain name."""
    return ",".join(f"round({n.rpartition(' ')[0] or n},{digits})+0.0 {n.rpartition(' ')[2]}" for n in names)


_KEYS = "select mesh_id,vid,x,y,z,cast(round(x/0.1) as bigint) kx,cast(round(y/0.1) as bigint) ky,cast(round(z/0.1) as bigint) kz from v_vertices"
_WELD = f"""k as ({_KEYS}), c as (select mesh_id,kx,ky,kz,min(vid) rep from k group by all), d as (select *,row_number() over (partition by mesh_id order by rep)-1 nv from c),
m as (select k.mesh_id,k.vid,d.nv from k join d using (mesh_id,kx,ky,kz)),
f as (select v.mesh_id,v.fid,cast(a.nv as bigint) i0,cast(b.nv as bigint) i1,cast(c.nv as bigint) i2 from v_faces v join m a on a.mesh_id=v.mesh_id and a.vid=v.i0 join m b on b.mesh_id=v.mesh_id and b.vid=v.i1 join m c on c.mesh_id=v.mesh_id and c.vid=v.i2)"""


def nested(ctes: str, sql: str) -> str:
    """Named parts that use the views, as derived tables of one statement."""
    return f"select * from (with {ctes} {sql})"


@query("mesh_weld_round", nested(_WELD, "select * from f where i0<>i1 and i1<>i2 and i0<>i2"))
def weld_round(spark: SparkSession, d: str) -> DataFrame:
    return mesh.weld(views.vertices(spark, d), views.faces(spark, d), 0.1)[1]


@query("mesh_weld_keeps_degenerate", nested(_WELD, "select * from f"))
def weld_keeps(spark: SparkSession, d: str) -> DataFrame:
    return mesh.weld(views.vertices(spark, d), views.faces(spark, d), 0.1, degenerate=True)[1]


@query("mesh_weld_vertices", nested(_WELD, "select d.mesh_id,cast(nv as bigint) vid,v.x,v.y,v.z from d join v_vertices v on v.mesh_id=d.mesh_id and v.vid=d.rep"))
def weld_vertices(spark: SparkSession, d: str) -> DataFrame:
    return mesh.weld(views.vertices(spark, d), views.faces(spark, d), 0.1)[0]


_TRUNC = _WELD.replace("round(x/0.1)", "trunc(x/0.1)").replace("round(y/0.1)", "trunc(y/0.1)").replace("round(z/0.1)", "trunc(z/0.1)").replace(_KEYS, _KEYS.replace("round(", "trunc("))


@query("mesh_weld_trunc", nested(_TRUNC, "select * from f"))
def weld_trunc(spark: SparkSession, d: str) -> DataFrame:
    """Faces renumbered after a weld by cells that are cut towards zero; those that collapse stay."""
    return mesh.weld(views.vertices(spark, d), views.faces(spark, d), 0.1, rounded=False, degenerate=True)[1]


_CELLS = "b as (select *, greatest(2,cast(ceil(round(cbrt(greatest(4,ceil(n*0.5))::double),9)) as bigint)) k from v_box), c as (select v.mesh_id,vid,least(cast(floor((x-x0)*k/greatest(x1-x0,1e-6)) as bigint),k-1) cx,least(cast(floor((y-y0)*k/greatest(y1-y0,1e-6)) as bigint),k-1) cy,least(cast(floor((z-z0)*k/greatest(z1-z0,1e-6)) as bigint),k-1) cz,x,y,z from v_vertices v join b on v.mesh_id=b.mesh_id), g as (select *,cast(row_number() over (partition by mesh_id order by cx,cy,cz)-1 as bigint) nv from (select mesh_id,cx,cy,cz,avg(x) mx,avg(y) my,avg(z) mz from c group by 1,2,3,4) a), m as (select c.mesh_id,c.vid,g.nv from c join g using (mesh_id,cx,cy,cz))"


@query("mesh_cluster", nested(_CELLS, f"select mesh_id,nv vid,{r('mx x', 'my y', 'mz z')} from g"))
def cluster(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mesh.cluster(views.vertices(spark, d), views.faces(spark, d), 0.5)[0], "x", "y", "z")


@query("mesh_cluster_faces", nested(_CELLS, "select f.mesh_id,fid,a.nv i0,b.nv i1,c.nv i2 from v_faces f join m a on a.mesh_id=f.mesh_id and a.vid=f.i0 join m b on b.mesh_id=f.mesh_id and b.vid=f.i1 join m c on c.mesh_id=f.mesh_id and c.vid=f.i2 where a.nv<>b.nv and b.nv<>c.nv and a.nv<>c.nv"))
def cluster_faces(spark: SparkSession, d: str) -> DataFrame:
    return mesh.cluster(views.vertices(spark, d), views.faces(spark, d), 0.5)[1]


@query("mesh_edges", "select * from v_edges")
def edges(spark: SparkSession, d: str) -> DataFrame:
    return mesh.edges(views.faces(spark, d))


@query("mesh_edge_len", f"select e.mesh_id,lo,hi,{r('(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) length2')} from v_edges e join v_vertices a on a.mesh_id=e.mesh_id and a.vid=lo join v_vertices b on b.mesh_id=e.mesh_id and b.vid=hi")
def edge_len(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mesh.edge_lengths(views.vertices(spark, d), views.faces(spark, d)), "length2")


@query("mesh_normals", f"select mesh_id,vid,{r('nx', 'ny', 'nz')} from v_normals")
def normals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mesh.vertex_normals(views.vertices(spark, d), views.faces(spark, d)), "nx", "ny", "nz")


@query(
    "mesh_tangents",
    nested(
        "e as (select *, (u1-u0)*(v2-v0)-(u2-u0)*(v1-v0) det from v_tri), g as (select mesh_id, unnest([i0,i1,i2]) vid, ((v2-v0)*(x1-x0)-(v1-v0)*(x2-x0))/det tx,((v2-v0)*(y1-y0)-(v1-v0)*(y2-y0))/det ty,((v2-v0)*(z1-z0)-(v1-v0)*(z2-z0))/det tz,((u1-u0)*(x2-x0)-(u2-u0)*(x1-x0))/det bx,((u1-u0)*(y2-y0)-(u2-u0)*(y1-y0))/det by_,((u1-u0)*(z2-z0)-(u2-u0)*(z1-z0))/det bz from e where abs(det)>1e-20), s as (select mesh_id,vid,sum(tx) tx,sum(ty) ty,sum(tz) tz,sum(bx) bx,sum(by_) by_,sum(bz) bz from g group by 1,2), j as (select s.*,nx,ny,nz,tx*nx+ty*ny+tz*nz k from s join v_normals using (mesh_id,vid)), q as (select *,tx-nx*k sx,ty-ny*k sy,tz-nz*k sz,(ny*tz-nz*ty)*bx+(nz*tx-nx*tz)*by_+(nx*ty-ny*tx)*bz hand from j)",
        f"select mesh_id,vid,{r('sx/l tx', 'sy/l ty', 'sz/l tz', digits=4)},case when hand<0 then -1.0::double else 1.0::double end w from (select *,sqrt(sx*sx+sy*sy+sz*sz) l from q) t where l>1e-10",
    ),
)
def tangents(spark: SparkSession, d: str) -> DataFrame:
    v, f = views.textured(spark, d), views.faces(spark, d)
    return rounded(mesh.vertex_tangents(v, f, mesh.vertex_normals(v, f)), "tx", "ty", "tz", digits=4)


@query("mesh_face_plane", f"select mesh_id,fid,i0,i1,i2,{r('a', 'b', 'c', 'd')} from v_plane")
def face_plane(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mesh.face_planes(views.vertices(spark, d), views.faces(spark, d)), *"abcd")


@query("mesh_vertex_quadric", f"select mesh_id,vid,{r(*(f'q{i}{j}' for i, j in mesh.QUADRIC))} from v_quadric")
def quadric(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mesh.vertex_quadrics(views.vertices(spark, d), views.faces(spark, d)), *(f"q{i}{j}" for i, j in mesh.QUADRIC))


_MID = {0: "(a.x+b.x)/2", 1: "(a.y+b.y)/2", 2: "(a.z+b.z)/2", 3: "1.0"}
_COST = "+".join(f"{1 if i == j else 2}*(p.q{i}{j}+q.q{i}{j})*({_MID[i]})*({_MID[j]})" for i, j in mesh.QUADRIC)


@query(
    "mesh_qem_edge_cost",
    f"select e.mesh_id,lo,hi,{r(f'greatest({_COST},0.0) cost')} from v_edges e join v_vertices a on a.mesh_id=e.mesh_id and a.vid=lo join v_vertices b on b.mesh_id=e.mesh_id and b.vid=hi join v_quadric p on p.mesh_id=e.mesh_id and p.vid=lo join v_quadric q on q.mesh_id=e.mesh_id and q.vid=hi",
)
def edge_cost(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mesh.collapse_costs(views.vertices(spark, d), views.faces(spark, d)), "cost")


def _facts(vertices: DataFrame, faces: DataFrame, made: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """What holds for every mesh after collapses: vertices left and gone, whether all faces name vertices that are left, none of them twice, and all vertices lie in the box of the mesh."""
    v, f, log = made
    box = mesh.bounds(vertices)
    inside = reduce(lambda a, b: a & b, (F.col(a).between(F.col(f"{a}_min") - 1e-9, F.col(f"{a}_max") + 1e-9) for a in mesh.AXES))
    left = v.join(box, "mesh_id").groupBy("mesh_id").agg(F.count("*").alias("vertices"), F.every(inside).alias("inside"))
    gone = log.groupBy("mesh_id").agg(F.count("*").alias("gone"), F.every(F.col("cost") >= 0).alias("priced"))
    sound = mesh.at_corners(f, v, ()).where("i0 <> i1 and i1 <> i2 and i0 <> i2").groupBy("mesh_id").agg(F.count("*").alias("sound"))
    kept = f.groupBy("mesh_id").agg(F.count("*").alias("faces"))
    all_ = left.join(gone, "mesh_id").join(kept, "mesh_id").join(sound, "mesh_id").join(faces.groupBy("mesh_id").agg(F.count("*").alias("nf")), "mesh_id")
    return all_.select("*", (F.col("sound") == F.col("faces")).alias("whole"), F.greatest(F.lit(1), F.ceil(F.col("nf") * 0.5)).alias("target"))


_HALF = "(select v.mesh_id,nv,nf,greatest(1,cast(ceil(nf*0.5) as bigint)) target from (select mesh_id,count(*) nv from v_vertices group by 1) v join (select mesh_id,count(*) nf from v_faces group by 1) f using (mesh_id))"
_BY_FACES = f"select mesh_id,nv was,target,true met,true whole,true inside,true priced from {_HALF} t"


def _by_faces(spark: SparkSession, d: str, price: str) -> DataFrame:
    v, f = views.vertices(spark, d), views.faces(spark, d)
    facts = _facts(v, f, decimation.collapse(v, f, 0.5, price))
    # An edge of these strips lies on two faces at most, so one is missing at most.
    met = F.col("faces").between(F.col("target") - 1, F.col("target"))
    return facts.select("mesh_id", (F.col("vertices") + F.col("gone")).alias("was"), "target", met.alias("met"), "whole", "inside", "priced")


@query("mesh_qem", _BY_FACES)
def qem(spark: SparkSession, d: str) -> DataFrame:
    """Half of the faces by quadrics."""
    return _by_faces(spark, d, "quadric")


@query("mesh_collapse_shortest", _BY_FACES)
def collapse_shortest(spark: SparkSession, d: str) -> DataFrame:
    """Half of the faces by lengths of edges."""
    return _by_faces(spark, d, "length")


@query("mesh_qem_c", f"select mesh_id,greatest(3,nv//2) vertices,nv-greatest(3,nv//2) gone,true whole,true inside,true priced from {_HALF} t")
def qem_vertices(spark: SparkSession, d: str) -> DataFrame:
    """Half of the vertices by quadrics, at costs made anew."""
    v, f = views.vertices(spark, d), views.faces(spark, d)
    return _facts(v, f, decimation.collapse_vertices(v, f, 0.5)).select("mesh_id", "vertices", "gone", "whole", "inside", "priced")


@query("mesh_vcache")
def vcache(spark: SparkSession, d: str) -> DataFrame:
    return mesh.order_for_cache(views.faces(spark, d))


@query("mesh_vcache_tiles", "select mesh_id,count(*) n,count(*) places,sum(fid)::bigint faces,(count(*)*(count(*)-1)//2)::bigint total,true near from v_faces group by 1")
def vcache_tiles(spark: SparkSession, d: str) -> DataFrame:
    """The order for the cache in tiles of 16 faces: every face once, every place once, and no face outside its tile's places."""
    f = views.faces(spark, d)
    made = mesh.order_for_cache(f, tile=16)
    near = F.every(F.floor(F.col("fid") / 16) == F.floor(F.col("place") / 16))
    return made.groupBy("mesh_id").agg(F.count_distinct("fid").alias("n"), F.count_distinct("place").alias("places"), F.sum("fid").alias("faces"), F.sum("place").alias("total"), near.alias("near"))


@query("mesh_decimate_prefix", "select mesh_id,fid,i0,i1,i2 from (select *,row_number() over (partition by mesh_id order by fid) rn,count(*) over (partition by mesh_id) n from v_faces) t where rn<=floor(n*0.3)")
def decimate_prefix(spark: SparkSession, d: str) -> DataFrame:
    return mesh.decimate_prefix(views.faces(spark, d), 0.3)


@query(
    "mesh_decimate_stride",
    "select mesh_id,fid,i0,i1,i2 from (select *,row_number() over (partition by mesh_id order by fid)-1 k,count(*) over (partition by mesh_id) n from v_faces) t where k%(n//greatest(cast(floor(n*0.3) as bigint),1))=0 and k//(n//greatest(cast(floor(n*0.3) as bigint),1))<greatest(cast(floor(n*0.3) as bigint),1)",
)
def decimate_stride(spark: SparkSession, d: str) -> DataFrame:
    return mesh.decimate_stride(views.faces(spark, d), 0.3)


@query(
    "mesh_decimate_dispatch",
    nested(
        _CELLS,
        "select 'cluster' algorithm,f.mesh_id,count(*) faces from v_faces f join m a on a.mesh_id=f.mesh_id and a.vid=f.i0 join m b on b.mesh_id=f.mesh_id and b.vid=f.i1 join m c on c.mesh_id=f.mesh_id and c.vid=f.i2 where a.nv<>b.nv and b.nv<>c.nv and a.nv<>c.nv group by 2 "
        "union all select 'prefix',mesh_id,count(*) from v_faces group by 2 union all select 'stride',mesh_id,greatest(cast(floor(count(*)*0.3) as bigint),1) from v_faces group by 2",
    ),
)
def decimate_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Faces that three algorithms leave; a ratio above one counts as one."""
    v, f = views.vertices(spark, d), views.faces(spark, d)
    left = (decimation.decimate(v, f, ratio, name).groupBy("mesh_id").agg(F.count("*").alias("faces")).select(F.lit(name).alias("algorithm"), "mesh_id", "faces") for name, ratio in (("cluster", 0.5), ("prefix", 5.0), ("stride", 0.3)))
    return reduce(DataFrame.unionByName, left)


@query(
    "mesh_compact",
    nested(
        "f as (select mesh_id,fid,i0,i1%5 i1,i2%5 i2 from v_faces where i0<>i1%5 and i1%5<>i2%5 and i0<>i2%5), c as (select mesh_id,fid,unnest([0,1,2]) k,unnest([i0,i1,i2]) vid from f), u as (select mesh_id,vid,min(fid*3+k) use from c group by 1,2), n as (select mesh_id,vid,cast(row_number() over (partition by mesh_id order by use)-1 as bigint) nv from u)",
        "select f.mesh_id,fid,a.nv i0,b.nv i1,c.nv i2 from f join n a on a.mesh_id=f.mesh_id and a.vid=i0 join n b on b.mesh_id=f.mesh_id and b.vid=i1 join n c on c.mesh_id=f.mesh_id and c.vid=i2",
    ),
)
def compact(spark: SparkSession, d: str) -> DataFrame:
    return mesh.compact(views.faces(spark, d).withColumns({"i1": F.col("i1") % 5, "i2": F.col("i2") % 5}))


@query("mesh_drop_degenerate", "select mesh_id,fid,i0,i1 % 5 i1,i2 % 5 i2 from v_faces where i0<>i1%5 and i1%5<>i2%5 and i0<>i2%5")
def drop_degenerate(spark: SparkSession, d: str) -> DataFrame:
    return mesh.drop_degenerate(views.faces(spark, d).withColumns({"i1": F.col("i1") % 5, "i2": F.col("i2") % 5}))


@query("mesh_adjacency", "select mesh_id,vid,count(distinct fid) n,min(fid) first,max(fid) last from (select mesh_id,fid,unnest([i0,i1,i2]) vid from v_faces) c group by 1,2")
def adjacency(spark: SparkSession, d: str) -> DataFrame:
    return mesh.adjacency(views.faces(spark, d)).select("mesh_id", "vid", F.size("fids").cast("long").alias("n"), F.element_at("fids", 1).alias("first"), F.element_at("fids", -1).alias("last"))


@query("mesh_vcache_score", f"select mesh_id,vid,{r('case when vid%40>=32 then 0.0 when vid%40<3 then 0.75 else power(1-(vid%40-3)/29.0,1.5) end+2.0/sqrt(n) score')} from (select mesh_id,vid,count(distinct fid) n from (select mesh_id,fid,unnest([i0,i1,i2]) vid from v_faces) c group by 1,2) t")
def vcache_score(spark: SparkSession, d: str) -> DataFrame:
    at = F.when(F.col("vid") % 40 < 32, F.col("vid") % 40)
    return rounded(mesh.adjacency(views.faces(spark, d)).select("mesh_id", "vid", mesh.cache_score(F.size("fids"), at).alias("score")), "score")


@query("mesh_union_prims", "select mesh_id,prim,pos,index+coalesce(sum(3) over (partition by mesh_id,pos order by prim rows between unbounded preceding and 1 preceding),0)::bigint vid from (select mesh_id,fid prim,unnest([0,1,2])::bigint pos,unnest([0,2,1])::bigint index from v_faces) t")
def union_prims(spark: SparkSession, d: str) -> DataFrame:
    prims = views.faces(spark, d).select("mesh_id", F.col("fid").alias("prim"), F.lit(3).cast("long").alias("n_vertices"), F.array(*(F.lit(i).cast("long") for i in (0, 2, 1))).alias("indices"))
    return mesh.union_primitives(prims)


@query("mesh_fan", "select mesh_id,fid pid,cast(s as bigint) step,fid i0,fid+s i1,fid+s+1 i2 from (select mesh_id,fid,unnest(generate_series(1,1+fid%3)) s from v_faces) t")
def fan(spark: SparkSession, d: str) -> DataFrame:
    polygons = views.faces(spark, d).select("mesh_id", F.col("fid").alias("pid"), F.sequence(F.col("fid"), F.col("fid") + 2 + F.col("fid") % 3).alias("corners"))
    return mesh.fan(polygons).withColumn("step", F.col("step").cast("long"))


@query(
    "mesh_bbox",
    f"select mesh_id,n,x0 x_min,y0 y_min,z0 z_min,x1 x_max,y1 y_max,z1 z_max,{r('x1-x0 x_size', 'y1-y0 y_size', 'z1-z0 z_size', '(x0+x1)/2 x_mid', '(y0+y1)/2 y_mid', '(z0+z1)/2 z_mid', '(x1-x0)*(y1-y0)*(z1-z0) volume')} from v_box",
)
def bbox(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mesh.bounds(views.vertices(spark, d)), *(f"{a}_{k}" for a in "xyz" for k in ("size", "mid")), "volume")


@query("src_preview_fit", nested("b as (select *,2.0/sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)+(z1-z0)*(z1-z0)) s from v_box)", f"select v.mesh_id,vid,{r('(x-(x0+x1)/2)*s x', '(y-(y0+y1)/2)*s y', '(z-(z0+z1)/2)*s z')} from v_vertices v join b using (mesh_id)"))
def preview_fit(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mesh.fit_to_box(views.vertices(spark, d)), *"xyz")


@query("val_mesh_data", nested("m as (select mesh_id,count(*) missing from (select f.mesh_id,unnest([i0,i1,i2+2]) vid from v_faces f) c anti join v_vertices v using (mesh_id,vid) group by 1), o as (select mesh_id,count(*) odd from v_vertices where vid%9=4 group by 1)", "select mesh_id,coalesce(missing,0) missing,coalesce(odd,0) not_finite from m full join o using (mesh_id)"))
def val_mesh_data(spark: SparkSession, d: str) -> DataFrame:
    odd = views.vertices(spark, d).withColumn("y", F.when(F.col("vid") % 18 == 4, float("nan")).when(F.col("vid") % 18 == 13, float("-inf")).otherwise(F.col("y")))
    found = mesh.invalid_data(odd, views.faces(spark, d).withColumn("i2", F.col("i2") + 2))
    return found.select("mesh_id", F.col("missing").cast("long").alias("missing"), F.col("not_finite").cast("long").alias("not_finite"))


@query("mesh_analyze", f"select b.mesh_id,n,faces,{r('x1-x0 x_size', 'y1-y0 y_size', 'z1-z0 z_size')} from v_box b join (select mesh_id,count(*) faces from v_faces group by 1) f using (mesh_id) where n>0 and faces>0")
def analyze(spark: SparkSession, d: str) -> DataFrame:
    return rounded(mesh.summary(views.vertices(spark, d), views.faces(spark, d)), "x_size", "y_size", "z_size").select("mesh_id", "n", "faces", "x_size", "y_size", "z_size")


@query("vec3_cross", f"select mesh_id,fid,{r('y0*z1-z0*y1 cx', 'z0*x1-x0*z1 cy', 'x0*y1-y0*x1 cz', 'x0*x1+y0*y1+z0*z1 dot', 'x0+x1 sum_x', 'y0-y1 diff_y', 'z0*2.5 scaled_z', 'sqrt(x0*x0+y0*y0+z0*z0) length', 'case when sqrt(x0*x0+y0*y0+z0*z0)>1e-10 then x0/sqrt(x0*x0+y0*y0+z0*z0) else x0 end unit_x')} from v_tri")
def vec3_cross(spark: SparkSession, d: str) -> DataFrame:
    """Products, sums, lengths and directions of two corners of each face."""
    t = views.triangles(spark, d)
    a, b = ([F.col(f"{c}{k}") for c in "xyz"] for k in (0, 1))
    more = {"dot": numbers.dot(F.array(*a), F.array(*b)), "sum_x": a[0] + b[0], "diff_y": a[1] - b[1], "scaled_z": numbers.scaled(F.array(*a), F.lit(2.5))[2], "length": numbers.norm(F.array(*a)), "unit_x": numbers.normalized(F.array(*a))[0]}
    out = t.select("mesh_id", "fid", *(v.alias(n) for v, n in zip(numbers.cross(a, b), ("cx", "cy", "cz"), strict=True)), *(v.alias(n) for n, v in more.items()))
    return rounded(out, "cx", "cy", "cz", *more)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Welded meshes: vertices, faces, size and volume of the box."""
    vertices, faces = mesh.weld(views.vertices(spark, d), views.faces(spark, d), 0.1)
    return mesh.summary(vertices, faces)
