"""Queries of shorter SVG, JSON and mesh texts; what is expected is put together in SQL from the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import markup
from tessera.operators import mesh
from tessera.plans import views
from tessera.plans.codec_queries import _le
from tessera.plans.loader_queries import packed
from tessera.plans.mesh_queries import nested
from tessera.plans.registry import query
from tessera.sources import writers
from tessera.sources.rasters import little_hex

_XMLNS = 'xmlns="http://www.w3.org/2000/svg"'
_TWICE = "printf('%02x',p_partkey%256)"


def svg_files(spark: SparkSession, d: str) -> DataFrame:
    """An SVG for each part: declarations, comments, metadata with and without a prefix, colours, and text that must be escaped."""
    one = F.lower(F.lpad(F.hex(F.col("p_partkey") % 256), 2, "0"))
    parts = [
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE svg>\n<?style none?>\n<svg ' + _XMLNS + ' version="1.1" width="'), F.col("p_size").cast("string"), F.lit('">\n  <!-- a > b -->\n  <svg:title>'), F.col("p_name"),
        F.lit('</svg:title><metadata><a>x</a><b/></metadata>\n  <rect fill="#AABBCC" stroke="#'), one, one, one, F.lit('" id="#aabbcc"/>\n  <text x="&quot;&lt;"> a &amp; '), F.col("p_name"), F.lit(" <![CDATA[<b>]]></text><g></g>\n</svg>"),
    ]
    return views.table(spark, d, "part").select("p_partkey", F.encode(F.concat(*parts), "UTF-8").alias("content"))


def _svg(head: str, version: str) -> str:
    """In SQL: equal digits make a colour short."""
    stroke = f"case when substr({_TWICE},1,1)=substr({_TWICE},2,1) then '#'||repeat(substr({_TWICE},1,1),3) else '#'||repeat({_TWICE},3) end"
    return f"""select p_partkey, '{head}<svg {_XMLNS}{version} width="'||p_size||'"><rect fill="#abc" stroke="'||{stroke}||'" id="#aabbcc"/><text x=''"&lt;''> a &amp; '||p_name||' &lt;b&gt;</text><g/></svg>' s from part"""


def _text(df: DataFrame) -> DataFrame:
    return df.select("p_partkey", F.decode("s", "UTF-8").alias("s"))


@query("opt_svg", _svg("", ""))
def opt_svg(spark: SparkSession, d: str) -> DataFrame:
    return _text(svg_files(spark, d).select("p_partkey", markup.pruned_svg(F.col("content"), 50).alias("s")))


@query("svg_attr_rewrite", _svg("", ' version="1.1"'))
def svg_rewrite(spark: SparkSession, d: str) -> DataFrame:
    return _text(svg_files(spark, d).select("p_partkey", markup.pruned_svg(F.col("content"), 80).alias("s")))


@query("svg_strip_meta", _svg('<?xml version="1.0" encoding="UTF-8"?><?style none?>', ' version="1.1"'))
def svg_preserving(spark: SparkSession, d: str) -> DataFrame:
    """Metadata and comments go, declarations stay."""
    return _text(svg_files(spark, d).select("p_partkey", markup.pruned_svg(F.col("content"), 80, preserve=True).alias("s")))


# ---- JSON ----

_DOC = """'{{"asset": {{"version": "2.0", "generator": "x", "copyright": ""}}, "extras": {{"a": 1}}, "scenes": [], "nodes": [{{"name": "n", "mesh": '||event_id||', "children": []}}, {{"extras": {{}}}}], "props": '||props||', "note": null}}'""".replace("{{", "{").replace("}}", "}")
_PRUNED = """'{"asset":{"version":"2.0"},"nodes":[{"mesh":'||event_id||'},{}],"props":'||replace(props,' ','')||'}'"""


def documents(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "events").select("event_id", F.encode(F.expr(_DOC), "UTF-8").alias("content"))


@query("json_prune", """select event_id, '{"asset":{"version":"2.0","generator":"x"},"extras":{"a":1},"nodes":[{"name":"n","mesh":'||event_id||'},{}],"props":'||replace(props,' ','')||'}' s from events""")
def json_prune(spark: SparkSession, d: str) -> DataFrame:
    """Empty members of nested objects, but not the keys that only an aggressive pruning drops."""
    return documents(spark, d).select("event_id", F.decode(markup.pruned_gltf(F.col("content"), aggressive=False), "UTF-8").alias("s"))


@query("opt_gltf", f"select event_id, {_PRUNED} s from events")
def opt_gltf(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("event_id", F.decode(markup.pruned_gltf(F.col("content")), "UTF-8").alias("s"))


_JSON = "s||repeat(' ',cast((4-length(s)%4)%4 as integer))"


@query("opt_glb", f"select event_id, md5(unhex('676C5446'||{_le('2', 4)}||{_le('12+8+length(j)+8+4', 4)}||{_le('length(j)', 4)}||'4A534F4E'||hex(encode(j))||{_le('4', 4)}||'42494E00'||'01020300')) md5 from (select event_id,{_JSON} j from (select event_id,{_PRUNED} s from events) a) b")
def opt_glb(spark: SparkSession, d: str) -> DataFrame:
    """GLB files with a chunk of an unknown kind, which goes."""
    doc = documents(spark, d)
    chunk = lambda tag, data, n: F.concat(little_hex(n, 4), F.lit(tag), data)
    body = F.concat(chunk("4A534F4E", F.hex("content"), F.length("content")), chunk("58545241", F.lit("FFFFFFFF"), F.lit(4)), chunk("42494E00", F.lit("010203"), F.lit(3)))
    made = doc.withColumn("body", body).select("event_id", F.unhex(F.concat(F.lit("676C5446"), little_hex(F.lit(2), 4), little_hex(12 + F.length("body") / 2, 4), F.col("body"))).alias("content"))
    return made.select("event_id", F.md5(markup.pruned_glb(F.col("content"))).alias("md5"))


# ---- texts of lines ----


def _rows(df: DataFrame) -> DataFrame:
    """mesh_id, s, n: the lines of each text and how often each is there."""
    return df.select("mesh_id", F.explode(F.split("s", "\n")).alias("s")).groupBy("mesh_id", "s").agg(F.count("*").alias("n"))


def _short(c: str) -> str:
    return rf"regexp_replace(regexp_replace(printf('%.6f',round({c}/0.001)*0.001+0.0),'(\.[0-9]*?)0+$','\1'),'\.$','')"


_HEADER = "unnest(['ply','format ascii 1.0','property double x','property double y','property double z','property list uchar int vertex_indices','end_header',''])"


@query(
    "opt_ply_ascii",
    f"select mesh_id,s,count(*) n from (select mesh_id,{_HEADER} s from (select distinct mesh_id from v_vertices) m union all select mesh_id,'element vertex '||count(*) from v_vertices group by 1 union all select mesh_id,'element face '||count(*) from v_faces group by 1 "
    f"union all select mesh_id,{_short('x')}||' '||{_short('y')}||' '||{_short('z')} from v_vertices union all select mesh_id,'3 '||i0||' '||i1||' '||i2 from v_faces) t group by 1,2",
)
def opt_ply_ascii(spark: SparkSession, d: str) -> DataFrame:
    s = F.decode("content", "UTF-8")
    noted = F.replace(s, F.lit("end_header\n"), F.lit("end_header\n# a note\n"))
    return _rows(writers.ply_text(packed(spark, d)).select("mesh_id", markup.slim_ply(noted, 0.001).alias("s")))


def _vertex(k: int) -> str:
    return "'vertex '||" + "||' '||".join(f"printf('%.3f',{a}{k})" for a in "xyz")


@query(
    "opt_stl_ascii",
    f"select mesh_id,s,count(*) n from (select mesh_id,unnest(['facet normal 0.000 0.000 0.000','outer loop',{_vertex(0)},{_vertex(1)},{_vertex(2)},'endloop','endfacet']) s from v_tri union all select mesh_id,unnest(['solid mesh','endsolid mesh']) from (select distinct mesh_id from v_vertices) m) t group by 1,2",
)
def opt_stl_ascii(spark: SparkSession, d: str) -> DataFrame:
    spaced = F.replace(F.decode("content", "UTF-8"), F.lit("outer loop\n"), F.lit("  outer loop \n\n"))
    return _rows(writers.stl_text(packed(spark, d)).select("mesh_id", markup.slim_stl(spaced, 3).alias("s")))


@query("opt_fbx_ascii", "select mesh_id,'; FBX 7.4.0 project file'||chr(10)||'Vertices: *'||count(*)||' {'||chr(10)||'a: '||string_agg(cast(vid as varchar),',' order by vid)||chr(10)||'}' s from v_vertices group by 1")
def opt_fbx_ascii(spark: SparkSession, d: str) -> DataFrame:
    ids = F.array_join(F.transform("points", lambda p: p["vid"].cast("string")), " , ")
    s = F.concat(F.lit("; FBX 7.4.0 project file\n;  a note\n\nVertices:   *"), F.size("points").cast("string"), F.lit(" {\n\t\ta: "), ids, F.lit("\n  }\n"))
    return packed(spark, d).select("mesh_id", markup.slim_fbx(s).alias("s"))


_PREFIX = "(select mesh_id,fid,i0,i1,i2 from (select *,row_number() over (partition by mesh_id order by fid) rn,count(*) over (partition by mesh_id) n from v_faces) t where rn<=floor(n*0.5))"


@query(
    "opt_obj",
    nested(
        f"k as (select mesh_id,vid,x,y,z,cast(trunc(x/0.1) as bigint) kx,cast(trunc(y/0.1) as bigint) ky,cast(trunc(z/0.1) as bigint) kz from v_vertices), c as (select mesh_id,kx,ky,kz,min(vid) rep,arg_min(x,vid) x,arg_min(y,vid) y,arg_min(z,vid) z from k group by 1,2,3,4), d as (select *,row_number() over (partition by mesh_id order by rep)-1 nv from c), m as (select k.mesh_id,k.vid,d.nv from k join d using (mesh_id,kx,ky,kz))",
        f"select mesh_id,part,s,count(*) n from (select mesh_id,0 part,unnest(['# optimized','o mesh']) s from (select distinct mesh_id from v_vertices) q union all select mesh_id,1,printf('v %.6f %.6f %.6f',x,y,z) from d union all select f.mesh_id,2,'f '||(a.nv+1)||' '||(b.nv+1)||' '||(c.nv+1) from {_PREFIX} f join m a on a.mesh_id=f.mesh_id and a.vid=f.i0 join m b on b.mesh_id=f.mesh_id and b.vid=f.i1 join m c on c.mesh_id=f.mesh_id and c.vid=f.i2) t group by 1,2,3",
    ),
)
def opt_obj(spark: SparkSession, d: str) -> DataFrame:
    """The lines, with their number; their order, the vertex cache's, has no form in SQL."""
    return mesh.optimized_obj(views.vertices(spark, d), views.faces(spark, d), 0.5, 0.1).groupBy("mesh_id", "part", "s").agg(F.count("*").alias("n"))


@query("info_svg_files", "select p_partkey,p_size::bigint w,case p_partkey%3 when 0 then 100 when 1 then p_size*2 else 7 end::bigint h from part")
def info_svg_files(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of SVG files: by attributes, by a viewBox where there is one, and by default; another element and a comment have sizes as well."""
    k = F.col("p_partkey") % 3
    text = F.decode("content", "UTF-8")
    put = F.when(k == 1, F.concat(F.lit(' viewBox="0 0 '), F.col("p_size").cast("string"), F.lit(" "), (F.col("p_size") * 2).cast("string"), F.lit('"'))).when(k == 2, F.lit(" height='7.5px'")).otherwise("")
    both = svg_files(spark, d).join(views.table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey")
    own = F.concat(F.lit('<!-- <svg width="1" height="2"> -->'), F.concat_ws("", F.substring_index(text, "<svg", 1), F.lit("<svg"), put, F.expr("substring(decode(content, 'UTF-8'), instr(decode(content, 'UTF-8'), '<svg') + 4)")))
    w, h = markup.svg_dims(F.replace(own, F.lit("<rect"), F.lit('<rect width="900" height="901"')))
    return both.select("p_partkey", w.alias("w"), h.alias("h"))
