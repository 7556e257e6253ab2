"""Queries of headers, boxes, running metrics and mesh text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import detect
from tessera.operators import metrics
from tessera.plans import views
from tessera.plans.mesh_queries import r
from tessera.plans.registry import query, rounded
from tessera.streaming import running

_BOX = "(select mesh_id,min(x) x0,max(x) x1,min(y) y0,max(y) y1,min(z) z0,max(z) z1 from v_vertices group by 1)"


@query("bbox_size", f"select mesh_id,{r('x1-x0 sx', 'y1-y0 sy', 'z1-z0 sz', '(x0+x1)/2 cx', '(y0+y1)/2 cy', '(z0+z1)/2 cz', '(x1-x0)*(y1-y0)*(z1-z0) volume')} from {_BOX} t")
def box_size(spark: SparkSession, d: str) -> DataFrame:
    box = views.vertices(spark, d).groupBy("mesh_id").agg(*(f(c).alias(f"{c}{i}") for c in "xyz" for i, f in enumerate((F.min, F.max))))
    size = {c: F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz"}
    out = box.select("mesh_id", *(size[c].alias(f"s{c}") for c in "xyz"), *(((F.col(f"{c}0") + F.col(f"{c}1")) / 2).alias(f"c{c}") for c in "xyz"), (size["x"] * size["y"] * size["z"]).alias("volume"))
    return rounded(out, "sx", "sy", "sz", "cx", "cy", "cz", "volume")


@query("val_nonempty_mesh", "select mesh_id,count(*) vertices from v_vertices where mesh_id in (select mesh_id from v_faces) group by 1")
def nonempty(spark: SparkSession, d: str) -> DataFrame:
    return views.vertices(spark, d).join(views.faces(spark, d).select("mesh_id").distinct(), "mesh_id", "left_semi").groupBy("mesh_id").agg(F.count("*").alias("vertices"))


_HEX = "(select file_id, hex(content) h, octet_length(content) n from v_content)"


def _byte(i: int) -> str:
    return f"('0x'||substr(h,{2 * i + 1},2))::bigint"


@query("info_gif", f"select file_id,{_byte(6)}+256*{_byte(7)} w,{_byte(8)}+256*{_byte(9)} h,{_byte(10)}%8+1 depth from {_HEX} t where substr(h,1,12) in ('474946383761','474946383961') and n>10")
def gif_size(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    found = views.contents(spark, d).where(detect.is_gif(c) & (F.length(c) > 10))
    return found.select("file_id", detect.little(c, 6, 2).alias("w"), detect.little(c, 8, 2).alias("h"), (detect.byte(c, 10) % 8 + 1).alias("depth"))


@query(
    "val_mesh_headers",
    "select file_id, n>=20 and starts_with(h,'676C5446') and substr(h,9,8)='02000000' glb, starts_with(h,'706C790A') and contains(h,'666F726D617420') ply, starts_with(h,'4B617964617261204642582042696E617279') or starts_with(h,'3B2046425820') fbx from " + _HEX + " t",
)
def mesh_headers(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    glb = (F.length(c) >= 20) & detect.is_glb(c) & (detect.little(c, 4, 4) == 2)
    ply = (detect.head(c, 4) == "706C790A") & F.contains(detect.as_text(c), F.lit("format "))
    return views.contents(spark, d).select("file_id", *(F.coalesce(v, F.lit(False)).alias(k) for k, v in (("glb", glb), ("ply", ply), ("fbx", detect.is_fbx(c)))))


@query("info_svg", r"""select page_id, coalesce(nullif(regexp_extract(html,'width="([0-9]+)',1),'')::bigint,100) w, coalesce(nullif(regexp_extract(html,'height="([0-9]+)',1),'')::bigint,100) h from pages""")
def svg_size(spark: SparkSession, d: str) -> DataFrame:
    def of(name: str) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract("html", f'{name}="([0-9]+)', 1), F.lit("")).cast("long"), F.lit(100).cast("long"))

    return views.table(spark, d, "pages").select("page_id", of("width").alias("w"), of("height").alias("h"))


@query("fn_base64", "select doc_id, to_base64(encode(coalesce(text,''))) packed, coalesce(text,'') back from documents")
def base64(spark: SparkSession, d: str) -> DataFrame:
    """Base64 without line ends, and what it gives when it is read back with line ends in it."""
    plain = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    packed = F.regexp_replace(F.base64(plain), r"\s", "")
    spaced = F.regexp_replace(packed, "(.{60})", "$1\n")
    return views.table(spark, d, "documents").select("doc_id", packed.alias("packed"), F.decode(F.unbase64(F.regexp_replace(spaced, r"\s", "")), "UTF-8").alias("back"))


@query(
    "agg_perf_update",
    f"select event_id,family,n,bytes,violations,longest,{r('total_ms', digits=2)} from (select event_id,family,count(*) over w n,sum(size) over w::bigint bytes,count(*) filter (elapsed_ms>case when size<512000 then 100 else 150 end) over w violations,max(elapsed_ms) over w longest,sum(elapsed_ms) over w total_ms from (select *,event_id//1000 run from v_log) l window w as (partition by family,run order by event_id)) t",
)
def running_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Counters, longest and total time after each operation of a run of a thousand."""
    w = Window.partitionBy("family", F.floor(F.col("event_id") / 1000)).orderBy("event_id")
    out = views.log(spark, d).select("event_id", "family", F.count("*").over(w).alias("n"), F.sum("size").over(w).alias("bytes"), F.count_if(metrics.is_violation()).over(w).alias("violations"), F.max("elapsed_ms").over(w).alias("longest"), F.sum("elapsed_ms").over(w).alias("total_ms"))
    return rounded(out, "total_ms", digits=2)


@query("agg_perf_running", f"select event_id,family,count(*) over w n,sum(size) over w::bigint bytes,count(*) filter (elapsed_ms>case when size<512000 then 100 else 150 end) over w violations,max(elapsed_ms) over w longest,{r('sum(elapsed_ms) over w total_ms', digits=2)} from v_log window w as (partition by family order by event_id)")
def running_totals(spark: SparkSession, d: str) -> DataFrame:
    """Counters, longest and total time of a family after each of its operations; `running_stream` gives the same as they come."""
    return rounded(running.running_table(views.log(spark, d)), "total_ms", digits=2)


@query("agg_ratio", f"select file_id%97 run,{r('case when sum(original_size)=0 then 1.0 else sum(optimized_size)/sum(original_size)::double end ratio', 'avg(success::int) hit_rate')},count(*) n from v_results group by 1")
def rates(spark: SparkSession, d: str) -> DataFrame:
    by = views.results(spark, d).groupBy((F.col("file_id") % 97).alias("run")).agg(F.sum("original_size").alias("a"), F.sum("optimized_size").alias("b"), F.avg(F.col("success").cast("int")).alias("hit_rate"), F.count("*").alias("n"))
    return rounded(by.select("run", metrics.ratio(F.col("a"), F.col("b")).alias("ratio"), "hit_rate", "n"), "ratio", "hit_rate")


@query("agg_mesh_details", f"select mesh_id,n vertices,{r('(1-least(n,20)/n::double)*100 vertex_reduction', '(1-least(f,20)/f::double)*100 face_reduction')} from (select mesh_id,count(*) n from v_vertices group by 1) v join (select mesh_id,count(*) f from v_faces group by 1) f using (mesh_id)")
def mesh_details(spark: SparkSession, d: str) -> DataFrame:
    """Per cent of vertices and faces that go if twenty of each stay."""
    n, f = (df.groupBy("mesh_id").agg(F.count("*").alias(c)) for df, c in ((views.vertices(spark, d), "vertices"), (views.faces(spark, d), "faces")))
    left = lambda c: metrics.reduction(F.col(c), F.least(F.col(c), F.lit(20)))
    return rounded(n.join(f, "mesh_id").select("mesh_id", "vertices", left("vertices").alias("vertex_reduction"), left("faces").alias("face_reduction")), "vertex_reduction", "face_reduction")


@query("sort_f32", "select vec_id,list_sort(embedding)[1] least,list_sort(embedding)[-1] most,list_position(embedding,list_sort(embedding)[1])::bigint place,len(list_filter(embedding,lambda x: x<=embedding[1]))::bigint found from embeddings")
def sorted_values(spark: SparkSession, d: str) -> DataFrame:
    ordered = F.sort_array("embedding")
    return views.table(spark, d, "embeddings").select("vec_id", ordered[0].alias("least"), F.element_at(ordered, -1).alias("most"), F.array_position("embedding", ordered[0]).alias("place"), F.size(F.filter("embedding", lambda x: x <= F.get("embedding", F.lit(0)))).cast("long").alias("found"))


@query("vec4_add_mul", f"select vec_id,{r(*(f'embedding[{i}]::double+embedding[{i + 4}] a{i}' for i in range(1, 5)), *(f'embedding[{i}]::double*embedding[{i + 4}] m{i}' for i in range(1, 5)))} from embeddings")
def vec4(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    pair = F.slice("e", 1, 4), F.slice("e", 5, 4)
    both = e.select("vec_id", F.zip_with(*pair, lambda a, b: a + b).alias("a"), F.zip_with(*pair, lambda a, b: a * b).alias("m"))
    out = both.select("vec_id", *(F.col(k)[i].alias(f"{k}{i + 1}") for k in "am" for i in range(4)))
    return rounded(out, *(f"{k}{i}" for k in "am" for i in range(1, 5)))
