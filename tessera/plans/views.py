"""Asset tables made from the driver's tables, so that every operator has rows to work on; VIEWS has the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import mesh

EXTENSIONS = ("png", "jpg", "jpeg", "webp", "gif", "bmp", "tiff", "tif", "ico", "svg", "tga", "pdf", "obj", "gltf", "glb", "ply", "stl", "fbx", "txt", "PNG")
#: First bytes of made files, by event_id modulo their number.
HEADS = (
    "89504E470D0A1A0A0000000D49484452", "FFD8FFE000104A464946000101000001", "524946462400000057454250565038", "47494638396101000100800000", "47494638376101000100800000", "424D3600000000000000360000002800",
    "49492A0008000000", "4D4D002A00000008", "0000010001001010000001002000", "000002000000000000000000400040002000", "676C54460200000040000000", "706C790A666F726D6174206173636969", "4B617964617261204642582042696E617279",
    "736F6C696420637562650A", "7620302E302031202D320A662031203220330A", "00",
)
#: Whole small files, by p_partkey modulo their number, in turn cut by none to three bytes; the last ones are binary.
SAMPLES = (
    *(x.encode("ascii").hex().upper() for x in (
        "v 0 0 0\nf 1 1 1\n", "# a comment\nmtllib a\nv 1 2 3\n", "mtllib a\n\n\n  vn 0 0 1\n", '{"asset":{"version":"2.0"},"meshes":[]}', ' {"asset":{"version":"2.0"},"nodes":[]} ', "SOLID x\nendsolid\n", "ply\nformat ascii 1.0\nelement vertex 0\nend_header\n",
        "solid cube\nfacet normal 0 0 1\nouter loop\nvertex 0 0 0\nvertex 1 0 0\nvertex 0 1 0\nendloop\nendfacet\nendsolid cube\n   \n", "solid of many words that never comes to an end, though it is long enough to be a file of that kind\n", "ply\r\ncomment x\nend_header\n",
        "; FBX 7.4.0 project file\nObjects:  {\n}\n", "; FBX 7.4.0 project\nnothing here at all\n", "not a valid mesh format", '<svg width="3"></svg>', '<?xml version="1.0"?><svg/>', "<?xml version='1.0'?><html/>", "<!DOCTYPE svg><svg></svg>",
    )),
    "676C5446020000001C000000080000004A534F4E7B7D202020202020", "676C5446010000001C000000080000004A534F4E7B7D202020202020", "FF" * 80 + "00000000", "FE" * 80 + "01000000" + "00" * 50, "FD" * 80 + "02000000" + "00" * 53,
    "706C790A666F726D61742062696E6172795F6C6974746C655F656E6469616E20312E300A656E645F6865616465720AFFFEFD0000", "4B617964617261204642582042696E6172792020001A00E81C0000" + "00" * 20, "00000A000000000000000000400040002008", "00000A000000000000000000400040000700", "00020200000000000000000040004000200800",
    "FF00" + "00" * 20 + "5452554556495349" + "4F4E2D5846494C45" + "2E000000" * 2 + "2E00",
)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def vertices(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    vid = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return e.select(F.col("label").cast("long").alias("mesh_id"), vid.cast("long").alias("vid"), *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")))


def textured(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    vid = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return e.select(F.col("label").cast("long").alias("mesh_id"), vid.cast("long").alias("vid"), *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyzuv")))


def faces(spark: SparkSession, d: str) -> DataFrame:
    v = vertices(spark, d).select("mesh_id", "vid", F.count("*").over(Window.partitionBy("mesh_id")).alias("n"))
    return v.where("vid + 2 < n").select("mesh_id", F.col("vid").alias("fid"), F.col("vid").alias("i0"), (F.col("vid") + 1).alias("i1"), (F.col("vid") + 2).alias("i2"))


def pixels(spark: SparkSession, d: str) -> DataFrame:
    order = ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_shipdate")
    pos = (F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*order)) - 1).cast("long")
    p = table(spark, d, "lineitem").select("*", pos.alias("pos"))
    return p.select(
        F.col("l_suppkey").alias("img_id"), F.floor(F.col("pos") / 16).alias("y"), (F.col("pos") % 16).alias("x"), ((F.col("l_partkey") * 37) % 256).alias("r"), ((F.col("l_orderkey") * 91) % 256).alias("g"),
        ((F.col("l_quantity").cast("long") * 153 + F.col("l_partkey")) % 256).alias("b"), F.when(F.col("l_partkey") % 11 == 0, 128).otherwise(255).cast("long").alias("a"),
    )


def palette(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey").cast("long")
    return table(spark, d, "nation").select(k.alias("idx"), ((k * 37) % 256).alias("r"), ((k * 91) % 256).alias("g"), ((k * 153) % 256).alias("b"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    seq = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    kind = F.col("event_type")
    tag = F.when(kind == "view", "VP8 ").when(kind == "click", "EXIF").when(kind == "signup", "ICCP").when(kind == "purchase", "ANMF").otherwise("XMP ")
    return table(spark, d, "events").select(F.col("user_id").alias("file_id"), seq.alias("seq"), tag.alias("tag"), F.floor("value").alias("len"))


def icons(spark: SparkSession, d: str) -> DataFrame:
    w = F.col("p_size").cast("long")
    bpp = F.when(F.col("p_partkey") % 3 == 0, 8).when(F.col("p_partkey") % 3 == 1, 24).otherwise(32).cast("long")
    return table(spark, d, "part").select(F.col("p_brand").alias("file_id"), F.col("p_partkey").alias("idx"), w.alias("w"), w.alias("h"), bpp.alias("bpp"))


def log(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, d, "events").select(
        "event_id", "ts", F.when(kind.isin("view", "click"), "image").otherwise("mesh").alias("family"), F.col("value").alias("elapsed_ms"), ((F.col("event_id") * 977) % 1000000).alias("size"), (kind != "error").alias("ok")
    )


def candidates(spark: SparkSession, d: str) -> DataFrame:
    ordinal = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("long")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("file_id"), ordinal.alias("ordinal"), F.floor("o_totalprice").alias("len"))


def files(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (k % len(EXTENSIONS) + 1).cast("int"))
    path = F.concat(F.lit("in/"), (k % 97).cast("string"), F.lit("/"), F.concat_ws("_", F.lit("asset"), (k % 300).cast("string")), F.lit("."), ext)
    return table(spark, d, "part").select(k.alias("file_id"), path.alias("path"), F.when(k % 17 == 0, 0).otherwise((k * 3701) % 5000000).cast("long").alias("length"))


def contents(spark: SparkSession, d: str) -> DataFrame:
    """file_id, content: one of HEADS and the event's properties, spaced so that trailing rules see text."""
    k = F.col("event_id")
    start = F.unhex(F.element_at(F.array(*map(F.lit, HEADS)), (k % len(HEADS) + 1).cast("int")))
    return table(spark, d, "events").select(k.alias("file_id"), F.concat(start, F.encode(F.col("props"), "UTF-8")).alias("content"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    """file_id, content: one of SAMPLES, cut by a few bytes."""
    k = F.col("p_partkey")
    whole = F.element_at(F.array(*map(F.lit, SAMPLES)), (k % len(SAMPLES) + 1).cast("int"))
    cut = (F.floor(k / len(SAMPLES)) % 4).cast("int")
    return table(spark, d, "part").select(k.alias("file_id"), F.unhex(F.substring(whole, F.lit(1), F.length(whole) - cut * 2)).alias("content"))


def results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("file_id"), F.floor("o_totalprice").alias("original_size"), F.floor(F.col("o_totalprice") * (F.col("o_orderkey") % 7 + 3) / 10).alias("optimized_size"), (F.col("o_orderstatus") != "P").alias("success")
    )


def triangles(spark: SparkSession, d: str) -> DataFrame:
    return mesh.triangles(vertices(spark, d), faces(spark, d))


_PIXEL_ORDER = "l_orderkey,l_linenumber,l_partkey,l_extendedprice,l_quantity,l_shipdate"
_NAMES = "[" + ",".join(f"'{e}'" for e in EXTENSIONS) + "]"
_SAMPLES = "[" + ",".join(f"'{e}'" for e in SAMPLES) + "]"
_HEADS = "[" + ",".join(f"'{e}'" for e in HEADS) + "]"
#: name: views that it needs, SQL.
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_vertices": ((), "select cast(label as bigint) mesh_id, cast(row_number() over (partition by label order by vec_id)-1 as bigint) vid, cast(embedding[1] as double) x, cast(embedding[2] as double) y, cast(embedding[3] as double) z, cast(embedding[4] as double) u, cast(embedding[5] as double) v from embeddings"),
    "v_faces": (("v_vertices",), "select mesh_id, vid fid, vid i0, vid+1 i1, vid+2 i2 from (select mesh_id, vid, count(*) over (partition by mesh_id) n from v_vertices) t where vid+2<n"),
    "v_pixels": ((), f"select img_id, cast(pos // 16 as bigint) y, pos%16 x, (l_partkey*37)%256 r, (l_orderkey*91)%256 g, (cast(trunc(l_quantity) as bigint)*153+l_partkey)%256 b, cast(case when l_partkey%11=0 then 128 else 255 end as bigint) a from (select l_suppkey img_id, cast(row_number() over (partition by l_suppkey order by {_PIXEL_ORDER})-1 as bigint) pos, l_partkey,l_orderkey,l_quantity from lineitem) t"),
    "v_palette": ((), "select cast(n_nationkey as bigint) idx, cast((n_nationkey*37)%256 as bigint) r, cast((n_nationkey*91)%256 as bigint) g, cast((n_nationkey*153)%256 as bigint) b from nation"),
    "v_chunks": ((), "select user_id file_id, cast(row_number() over (partition by user_id order by ts,event_id)-1 as bigint) seq, case event_type when 'view' then 'VP8 ' when 'click' then 'EXIF' when 'signup' then 'ICCP' when 'purchase' then 'ANMF' else 'XMP ' end tag, cast(floor(value) as bigint) len from events"),
    "v_ico": ((), "select p_brand file_id, p_partkey idx, cast(p_size as bigint) w, cast(p_size as bigint) h, cast(case p_partkey%3 when 0 then 8 when 1 then 24 else 32 end as bigint) bpp from part"),
    "v_log": ((), "select event_id, ts, case when event_type in ('view','click') then 'image' else 'mesh' end family, value elapsed_ms, (event_id*977)%1000000 size, event_type<>'error' ok from events"),
    "v_cand": ((), "select o_custkey file_id, cast(row_number() over (partition by o_custkey order by o_orderkey)-1 as bigint) ordinal, cast(floor(o_totalprice) as bigint) len from orders"),
    "v_files": ((), f"select p_partkey file_id, 'in/' || (p_partkey%97) || '/asset_' || (p_partkey%300) || '.' || {_NAMES}[p_partkey%{len(EXTENSIONS)}+1] path, cast(case when p_partkey%17=0 then 0 else (p_partkey*3701)%5000000 end as bigint) length from part"),
    "v_content": ((), f"select event_id file_id, unhex({_HEADS}[event_id%{len(HEADS)}+1]) || encode(props) content from events"),
    "v_samples": ((), f"select file_id, unhex(h) content, h, length(h)//2 n, try(decode(unhex(h))) t from (select p_partkey file_id, left({_SAMPLES}[p_partkey%{len(SAMPLES)}+1],length({_SAMPLES}[p_partkey%{len(SAMPLES)}+1])-2*(p_partkey//{len(SAMPLES)}%4)) h from part) s"),
    "v_results": ((), "select o_orderkey file_id, cast(floor(o_totalprice) as bigint) original_size, cast(floor(o_totalprice*(o_orderkey%7+3)/10) as bigint) optimized_size, o_orderstatus<>'P' success from orders"),
    "v_tri": (("v_faces",), "select f.*, a.x x0,a.y y0,a.z z0,b.x x1,b.y y1,b.z z1,c.x x2,c.y y2,c.z z2,a.u u0,a.v v0,b.u u1,b.v v1,c.u u2,c.v v2 from v_faces f join v_vertices a on a.mesh_id=f.mesh_id and a.vid=f.i0 join v_vertices b on b.mesh_id=f.mesh_id and b.vid=f.i1 join v_vertices c on c.mesh_id=f.mesh_id and c.vid=f.i2"),
    "v_fn": (("v_tri",), "select *,(y1-y0)*(z2-z0)-(z1-z0)*(y2-y0) nx,(z1-z0)*(x2-x0)-(x1-x0)*(z2-z0) ny,(x1-x0)*(y2-y0)-(y1-y0)*(x2-x0) nz from v_tri"),
    "v_inc": (("v_fn",), "select *, unnest([i0,i1,i2]) vid from v_fn"),
    "v_normals": (("v_inc",), "select mesh_id,vid,x/l nx,y/l ny,z/l nz from (select *,case when x*x+y*y+z*z>1e-20 then sqrt(x*x+y*y+z*z) else 1.0 end l from (select mesh_id,vid,sum(nx) x,sum(ny) y,sum(nz) z from v_inc group by mesh_id,vid) s) t"),
    "v_plane": (("v_fn",), "select mesh_id,fid,i0,i1,i2,nx/l a,ny/l b,nz/l c,-(nx*x0+ny*y0+nz*z0)/l d from (select *,sqrt(nx*nx+ny*ny+nz*nz) l from v_fn) t where l>=1e-12"),
    "v_quadric": (("v_plane",), "select mesh_id,vid,sum(a*a) q00,sum(a*b) q01,sum(a*c) q02,sum(a*d) q03,sum(b*b) q11,sum(b*c) q12,sum(b*d) q13,sum(c*c) q22,sum(c*d) q23,sum(d*d) q33 from (select *, unnest([i0,i1,i2]) vid from v_plane) p group by mesh_id,vid"),
    "v_edges": (("v_faces",), "select mesh_id,least(p,q) lo,greatest(p,q) hi,count(*) n from (select mesh_id,i0 p,i1 q from v_faces union all select mesh_id,i1,i2 from v_faces union all select mesh_id,i2,i0 from v_faces) e where p<>q group by 1,2,3"),
    "v_box": (("v_vertices",), "select mesh_id,count(*) n,min(x) x0,max(x) x1,min(y) y0,max(y) y1,min(z) z0,max(z) z1 from v_vertices group by mesh_id"),
}


def with_views(sql: str) -> str:
    """The query behind definitions of the views that it names, in the order in which they need each other."""
    needed: dict[str, None] = {}

    def add(name: str) -> None:
        for below in VIEWS[name][0]:
            add(below)
        needed[name] = None

    for name in VIEWS:
        if name in sql:
            add(name)
    return f"with {', '.join(f'{name} as ({VIEWS[name][1]})' for name in needed)} {sql}" if needed else sql
