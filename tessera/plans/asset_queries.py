"""Queries of files, formats, chunks, icons, candidates and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import detect
from tessera.operators import containers, metrics, rules
from tessera.plans import views
from tessera.plans.mesh_queries import nested, r
from tessera.plans.registry import query, rounded
from tessera.sources import assets, files
from tessera.staging import Staging

_IMAGES = ",".join(f"'{e}'" for e in files.IMAGE_EXTENSIONS)
_MESHES = ",".join(f"'{e}'" for e in files.MESH_EXTENSIONS)
_EXT = r"lower(regexp_extract(path,'\.([A-Za-z0-9]+)$',1))"
_NAME = "regexp_extract(path,'([^/]*)$',1)"


def values(rows: tuple, names: str) -> str:
    def one(v: object) -> str:
        return str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"{v}::double" if isinstance(v, float) else f"'{v}'"

    return f"(values {','.join('(' + ','.join(map(one, row)) + ')' for row in rows)}) as k({names})"


@query("src_file_bytes", "select file_id,path,length,case when length=0 then 'empty file' end error from v_files")
def file_bytes(spark: SparkSession, d: str) -> DataFrame:
    return views.files(spark, d).select("file_id", "path", "length", F.when(F.col("length") == 0, "empty file").alias("error"))


@query("src_ext_filter", f"select file_id,path,length from v_files where {_EXT} in ({_IMAGES},{_MESHES})")
def ext_filter(spark: SparkSession, d: str) -> DataFrame:
    return files.accepted(views.files(spark, d))


@query("src_dedup_name", f"select file_id,path,length from (select *,row_number() over (partition by {_NAME} order by file_id) k from v_files) t where k=1")
def dedup_name(spark: SparkSession, d: str) -> DataFrame:
    return files.first_of_name(views.files(spark, d))


@query("src_family_by_ext", f"select case when {_EXT} in ({_IMAGES}) then 'image' when {_EXT} in ({_MESHES}) then 'mesh' else 'unknown' end family,count(*) n,sum(length)::bigint bytes from v_files group by 1")
def family(spark: SparkSession, d: str) -> DataFrame:
    return views.files(spark, d).groupBy(files.family(F.col("path")).alias("family")).agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


_PARTS = "['Wing','Ground PLANE','body','Background_1','plan','backplane','Door']"


@query("src_preview_skip_bg", f"select * from (select p_partkey,{_PARTS}[p_partkey%7+1]||' '||p_name name from part) t where lower(name) not like '%plane%' and lower(name) not like '%background%'")
def skip_background(spark: SparkSession, d: str) -> DataFrame:
    """Parts of a scene but its floor and background."""
    part = F.element_at(F.array(*map(F.lit, ("Wing", "Ground PLANE", "body", "Background_1", "plan", "backplane", "Door"))), (F.col("p_partkey") % 7 + 1).cast("int"))
    named = views.table(spark, d, "part").select("p_partkey", F.concat(part, F.lit(" "), "p_name").alias("name"))
    return named.where(~F.lower("name").rlike("plane|background"))


@query("sink_download", rf"select file_id, regexp_replace({_NAME},'\.[^.]*$','') || '_opt.' || {_EXT} out_name from v_files where length>0")
def download(spark: SparkSession, d: str) -> DataFrame:
    return views.files(spark, d).where("length > 0").select("file_id", files.output_name(F.col("path"), files.extension(F.col("path"))).alias("out_name"))


@query("sink_download_files", f"select t.name,'image:'||kind format,octet_length(content)::bigint length,md5(content) md5 from (select 'part_'||p_partkey||'_opt.bin' name,case p_partkey%3 when 0 then 'Png' when 1 then 'Gif' else 'Bmp' end kind,unhex(case p_partkey%3 when 0 then '89504E470D0A1A0A' when 1 then '474946383961' else '424D' end)||encode(p_name) content from part) t where kind='Png' or kind='Gif' and name<'part_15'")
def download_files(spark: SparkSession, d: str) -> DataFrame:
    """Results written as files under their names by the data source, and those of two formats read again by it: conditions on the format reach the reader."""
    assets.register(spark)
    k = F.col("p_partkey") % 3
    head = F.unhex(F.when(k == 0, "89504E470D0A1A0A").when(k == 1, "474946383961").otherwise("424D"))
    made = views.table(spark, d, "part").select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string"), F.lit("_opt.bin")).alias("name"), F.concat(head, F.encode("p_name", "UTF-8")).alias("content"))
    folder = f"{Staging(spark).root}/files"
    assets.dealt(made).write.format("assets").mode("append").save(folder)
    back = spark.read.format("assets").load(folder).where(F.col("format").isin("image:Png", "image:Gif"))
    return back.where("format = 'image:Png' or name < 'part_15'").select("name", "format", "length", F.md5("content").alias("md5"))


def _formats(rows: tuple, names: str) -> str:
    return values(tuple((n, e, m, a, b) for n, es, m, a, b in rows for e in es.split(",")), f"format,extension,mime,{names}")


@query("sink_ext_mime", f"select file_id,{_EXT} extension,format,mime,lossless,quality from v_files left join {_formats(rules.IMAGE_FORMATS, 'lossless,quality')} on extension={_EXT}")
def ext_mime(spark: SparkSession, d: str) -> DataFrame:
    return files.with_format(views.files(spark, d)).select("file_id", "extension", "format", "mime", "lossless", "quality")


@query("sink_ext_mime_mesh", f"select file_id,{_EXT} extension,format,mime,is_binary,materials from v_files left join {_formats(rules.MESH_FORMATS, 'is_binary,materials')} on extension={_EXT}")
def ext_mime_mesh(spark: SparkSession, d: str) -> DataFrame:
    return files.with_format(views.files(spark, d), rules.MESH_FORMATS).select("file_id", "extension", "format", "mime", "is_binary", "materials")


@query("dim_mesh_info", f"select format,name,textures,materials,animations,typical_ratio,unnest(string_split(ways,'|')) strategy from {values(rules.MESH_INFO, 'format,name,textures,materials,animations,typical_ratio,ways')}")
def mesh_info(spark: SparkSession, d: str) -> DataFrame:
    return rules.mesh_info(spark)


@query("dim_mesh_formats", f"select * from {_formats(rules.MESH_FORMATS, 'is_binary,materials')}")
def mesh_formats(spark: SparkSession, d: str) -> DataFrame:
    return rules.formats(spark, rules.MESH_FORMATS)


# ---- detection: the same rules on hexadecimal text ----

_H = "(select file_id, content, hex(content) h, length(hex(content))//2 n from v_content)"


def _b(i: int) -> str:
    return f"try_cast('0x'||substr(h,{2 * i + 1},2) as bigint)"


_IMG = {
    "Png": f"starts_with(h,'{detect.PNG_MAGIC}')", "Jpeg": "starts_with(h,'FFD8FF')", "WebP": "starts_with(h,'52494646') and substr(h,17,8)='57454250'", "Gif": "substr(h,1,12) in ('474946383761','474946383961')",
    "Bmp": "starts_with(h,'424D')", "Tiff": "substr(h,1,8) in ('49492A00','4D4D002A')", "Ico": "starts_with(h,'00000100')",
    "Tga": f"n>=18 and {_b(1)}<=1 and {_b(2)} in (0,1,2,3,9,10,11) and {_b(12)}+256*{_b(13)}>0 and {_b(14)}+256*{_b(15)}>0 and {_b(16)} in (8,15,16,24,32) and substr(h,9,8)<>'66747970'",
}
_MSH = {
    "Glb": "starts_with(h,'676C5446')", "Stl": "starts_with(h,'736F6C696420')", "Ply": "starts_with(h,'706C790A') or starts_with(h,'706C790D0A')", "Fbx": "starts_with(h,'4B617964617261204642582042696E617279')", "Obj": "starts_with(h,'7620302E30')",
}
_IMAGE = f"case when n<8 then null {' '.join(f'when {c} then {chr(39)}{k}{chr(39)}' for k, c in _IMG.items())} end"
_MESH = f"case when n<8 then null {' '.join(f'when {c} then {chr(39)}{k}{chr(39)}' for k, c in _MSH.items())} end"


@query("det_image", f"select file_id,{_IMAGE} format from {_H} t")
def det_image(spark: SparkSession, d: str) -> DataFrame:
    return views.contents(spark, d).select("file_id", detect.detect_image(F.col("content")).alias("format"))


@query("det_mesh", f"select file_id,{_MESH} format from {_H} t")
def det_mesh(spark: SparkSession, d: str) -> DataFrame:
    return views.contents(spark, d).select("file_id", detect.detect_mesh(F.col("content")).alias("format"))


@query("det_combined", f"select coalesce('image:'||{_IMAGE},'mesh:'||{_MESH},'unknown') format,count(*) n from {_H} t group by 1")
def det_combined(spark: SparkSession, d: str) -> DataFrame:
    return views.contents(spark, d).groupBy(detect.detect_format(F.col("content")).alias("format")).agg(F.count("*").alias("n"))


@query("is_image_formats", "select file_id," + ",".join(f"coalesce({c},false) is_{k.lower()}" for k, c in _IMG.items()) + f" from {_H} t")
def is_formats(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return views.contents(spark, d).select("file_id", *(F.coalesce(f(c), F.lit(False)).alias(f"is_{k.lower()}") for k, f in detect.IMAGES if k != "Svg"))


@query("is_mesh_formats", "select file_id," + ",".join(f"coalesce({c},false) is_{k.lower()}" for k, c in _MSH.items()) + f" from {_H} t")
def is_mesh_formats(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return views.contents(spark, d).select("file_id", *(F.coalesce(f(c), F.lit(False)).alias(f"is_{k.lower()}") for k, f in detect.MESHES if k != "Gltf"))


@query("det_escaped_hex", r"select file_id, hex(unhex(replace(regexp_extract(e,'^(\\x[0-9A-F]{2})+',0),'\x',''))) h from (select file_id, regexp_replace(hex(content),'(..)','\\x\1','g') e from v_content) t")
def escaped_hex(spark: SparkSession, d: str) -> DataFrame:
    escaped = F.regexp_replace(F.hex("content"), "(..)", r"\\x$1")
    return views.contents(spark, d).select("file_id", F.hex(F.unhex(F.replace(F.regexp_extract(escaped, r"^(\\x[0-9A-F]{2})+", 0), F.lit("\\x"), F.lit("")))).alias("h"))


@query("val_image_dims", "select file_id,idx,w*700>0 and w*700<=32768 and h*700<=32768 and w*700*h*700<=1073741824 valid from v_ico")
def image_dims(spark: SparkSession, d: str) -> DataFrame:
    w, h = F.col("w") * 700, F.col("h") * 700
    return views.icons(spark, d).select("file_id", "idx", ((w > 0) & (w <= 32768) & (h <= 32768) & (w * h <= 1 << 30)).alias("valid"))


# ---- chunks, icons, candidates ----


def _kept(container: str, quality: int, least: str = "coalesce(k.q,o.q)") -> str:
    named = values(tuple((t, q) for c, t, q in rules.KEEP if c == container and t != "*"), "tag,q")
    other = next(q for c, t, q in rules.KEEP if c == container and t == "*")
    return f"select c.* from v_chunks c left join {named} using (tag) cross join (select {other} q) o where {least}<={quality}"


@query("chunk_webp_static", f"select file_id,sum(len+8+len%2)::bigint kept_bytes,count(*) kept from ({_kept('webp', 85)}) t group by 1")
def webp_static(spark: SparkSession, d: str) -> DataFrame:
    return containers.container_size(containers.keep_chunks(views.chunks(spark, d), "webp", 85))


@query("chunk_webp_anim", f"select file_id,seq,tag,len from (select *,row_number() over (partition by file_id,tag order by seq) k from v_chunks) c where case when tag='ANMF' and k>20 then 31 when tag in ('ICCP') then 80 when tag in ('EXIF','XMP ') then 90 else 0 end<=30")
def webp_anim(spark: SparkSession, d: str) -> DataFrame:
    return containers.keep_chunks(views.chunks(spark, d), "webp_animated", 30)


@query("chunk_png_critical", "select file_id,seq,case tag when 'VP8 ' then 'IDAT' when 'EXIF' then 'tEXt' else tag end tag,len from v_chunks where tag='VP8 '")
def png_critical(spark: SparkSession, d: str) -> DataFrame:
    renamed = views.chunks(spark, d).withColumn("tag", F.when(F.col("tag") == "VP8 ", "IDAT").when(F.col("tag") == "EXIF", "tEXt").otherwise(F.col("tag")))
    return containers.critical_chunks(renamed)


_JPEG = "(select file_id,seq,case tag when 'VP8 ' then 'SOS' when 'EXIF' then 'APP1' when 'ICCP' then 'APP2' when 'ANMF' then 'COM' else 'APP0' end tag,len from v_chunks)"


@query("chunk_jpeg", f"select tag,count(*) n,sum(len)::bigint bytes from ({_kept('jpeg', 86).replace('v_chunks', _JPEG)}) t group by 1")
def jpeg_chunks(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("tag")
    renamed = views.chunks(spark, d).withColumn("tag", F.when(t == "VP8 ", "SOS").when(t == "EXIF", "APP1").when(t == "ICCP", "APP2").when(t == "ANMF", "COM").otherwise("APP0"))
    return containers.keep_chunks(renamed, "jpeg", 86).groupBy("tag").agg(F.count("*").alias("n"), F.sum("len").alias("bytes"))


@query("chunk_webp_meta_only", f"select file_id,sum(len+8+len%2)::bigint kept_bytes,count(*) kept from ({_kept('webp_meta_only', 50)}) t group by 1")
def webp_meta_only(spark: SparkSession, d: str) -> DataFrame:
    return containers.container_size(containers.keep_chunks(views.chunks(spark, d), "webp_meta_only", 50))


@query("chunk_webp_aggr", f"select file_id,sum(len+8+len%2)::bigint kept_bytes,count(*) kept from ({_kept('webp_aggressive', 50)}) t group by 1")
def webp_aggressive(spark: SparkSession, d: str) -> DataFrame:
    return containers.container_size(containers.keep_chunks(views.chunks(spark, d), "webp_aggressive", 50))


@query("det_anim_webp", "select file_id,bool_or(tag='XMP ') animated from v_chunks group by 1")
def anim_webp(spark: SparkSession, d: str) -> DataFrame:
    named = F.when(F.col("tag") == "XMP ", "ANIM").otherwise(F.col("tag"))
    return containers.is_animated(views.chunks(spark, d).withColumn("tag", named))


@query("gif_merge_frames", "select file_id,min(seq) seq,any_value(hash) hash,sum(delay)::bigint delay,count(*) frames from (select *,sum(fresh) over (partition by file_id order by seq) run from (select file_id,seq,tag hash,len delay,case when lag(tag) over (partition by file_id order by seq)=tag then 0 else 1 end fresh from v_chunks) a) b group by file_id,run")
def merge_frames(spark: SparkSession, d: str) -> DataFrame:
    return containers.merge_equal_frames(views.chunks(spark, d).select("file_id", "seq", F.col("tag").alias("hash"), F.col("len").alias("delay")))


_FIRST = "(select * from (select *,row_number() over (partition by file_id,w,h,bpp order by idx) k from v_ico) t where k=1)"


@query("ico_first", f"select file_id,idx,w,h,bpp from {_FIRST} t")
def ico_first(spark: SparkSession, d: str) -> DataFrame:
    return containers.first_icons(views.icons(spark, d))


@query("ico_dedup", f"select file_id,idx,w,h,bpp from (select *,count(*) over (partition by file_id order by idx)-1 before from {_FIRST} t) u where before<4 or w in (16,24,32,48,64,128,256)")
def ico_dedup(spark: SparkSession, d: str) -> DataFrame:
    return containers.dedup_icons(views.icons(spark, d), 60)


@query("ico_sizes", "select file_id,count(*) entries,count(distinct w) sizes,min(w) least,max(w) most from v_ico group by 1")
def ico_sizes(spark: SparkSession, d: str) -> DataFrame:
    return views.icons(spark, d).groupBy("file_id").agg(F.count("*").alias("entries"), F.count_distinct("w").alias("sizes"), F.min("w").alias("least"), F.max("w").alias("most"))


@query("img_argmin", "select file_id,ordinal,len from (select *,row_number() over (partition by file_id order by len,ordinal) rn from v_cand) t where rn=1")
def argmin(spark: SparkSession, d: str) -> DataFrame:
    return containers.smallest(views.candidates(spark, d))


def _ladder(name: str, q: str) -> str:
    bands, rest = rules.LADDERS[name]
    return f"case {' '.join(f'when {q}<={top} then {v}' for top, v in bands)} else {rest} end"


@query("img_quality_ladders", "select q," + ",".join(f"{_ladder(n, 'q')}::int {n}" for n in rules.LADDERS) + " from (select distinct p_size*2 q from part) t")
def ladders(spark: SparkSession, d: str) -> DataFrame:
    q = views.table(spark, d, "part").select((F.col("p_size") * 2).alias("q")).distinct()
    return q.select("q", *(rules.ladder(F.col("q"), n).cast("int").alias(n) for n in rules.LADDERS))


_MADE = f"(select p_partkey file_id, ['Png','Jpeg','Gif','Bmp','Tiff','WebP'][p_partkey%6+1] format, p_size*2 quality, p_partkey%5=0 lossless from part)"


@query("img_strategies", f"select file_id,f.format,quality,strategy from {_MADE} f join {values(rules.STRATEGIES, 'format,strategy,low,high,ok')} on f.format=k.format where quality between low and high and (ok or not lossless)")
def strategies(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    made = views.table(spark, d, "part").select(k.alias("file_id"), F.element_at(F.array(*map(F.lit, ("Png", "Jpeg", "Gif", "Bmp", "Tiff", "WebP"))), (k % 6 + 1).cast("int")).alias("format"), (F.col("p_size") * 2).alias("quality"), (k % 5 == 0).alias("lossless"))
    return containers.plan_candidates(made)


_KINDS = ("Png", "Jpeg", "Gif", "Bmp", "Tiff", "WebP", "Svg", "Ico", "Tga")
_IMAGES_MADE = f"(select p_partkey file_id, [{','.join(repr(k) for k in _KINDS)}][p_partkey%9+1] format, p_partkey%4=0 animated, (p_size*2)::bigint quality from part)"


def _images(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return views.table(spark, d, "part").select(k.alias("file_id"), F.element_at(F.array(*map(F.lit, _KINDS)), (k % 9 + 1).cast("int")).alias("format"), (k % 4 == 0).alias("animated"), (F.col("p_size") * 2).cast("long").alias("quality"))


@query("img_dispatch", f"select file_id,i.format,i.animated and i.format in ('Gif','WebP') animated,quality,encoder from {_IMAGES_MADE} i join {values(rules.DISPATCH, 'format,animated,encoder,low,high')} on i.format=k.format and (i.animated and i.format in ('Gif','WebP'))=k.animated where quality between low and high")
def img_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return rules.dispatch(_images(spark, d))


@query("img_fast_path", f"select file_id,case when animated and format in ('Gif','WebP') then 'keep' when format='Gif' then 'png' else 'jpeg' end encoder,case when (animated and format in ('Gif','WebP')) or format='Gif' then quality else cast(floor(quality*0.8::double) as bigint) end quality from {_IMAGES_MADE} i")
def img_fast_path(spark: SparkSession, d: str) -> DataFrame:
    encoder, quality = rules.fast_path(F.col("format"), F.col("animated"), F.col("quality"))
    return _images(spark, d).select("file_id", encoder.alias("encoder"), quality.alias("quality"))


_WANTED = ("auto", "png", "JPEG", "webp", "Gif")


@query("ui_route", f"select file_id,case when lower(w)='auto' then 'optimize_auto' when lower(w)=lower(format) then 'optimize_'||lower(format) else 'convert_to_'||lower(w) end act from (select *,[{','.join(repr(w) for w in _WANTED)}][file_id%5+1] w from {_IMAGES_MADE} i) t")
def ui_route(spark: SparkSession, d: str) -> DataFrame:
    wanted = F.element_at(F.array(*map(F.lit, _WANTED)), (F.col("file_id") % 5 + 1).cast("int"))
    return _images(spark, d).select("file_id", rules.action(wanted, F.col("format")).alias("act"))


@query("gate_size", f"select route,count(*) n from (select case when family='mesh' then 'mesh' when length>2097152 then 'aggressive' when length>100000 then 'fast' else 'full' end route from (select *,case when {_EXT} in ({_MESHES}) then 'mesh' else 'image' end family from v_files) a) b group by 1")
def gate(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(files.family(F.col("path")) == "mesh", "mesh").otherwise("image")
    return views.files(spark, d).groupBy(containers.route(kind, F.col("length")).alias("route")).agg(F.count("*").alias("n"))


@query("ui_mesh_ratio", f"select q,{r('greatest((100-q)/100.0::double,0.1) ratio')} from (select distinct p_size*2 q from part) t")
def mesh_ratio(spark: SparkSession, d: str) -> DataFrame:
    q = views.table(spark, d, "part").select((F.col("p_size") * 2).alias("q")).distinct()
    return rounded(q.select("q", F.greatest((100 - F.col("q")) / 100.0, F.lit(0.1)).alias("ratio")), "ratio")


# ---- metrics ----

_V = "(elapsed_ms>case when size<512000 then 100 else 150 end)"


@query(
    "agg_perf_snapshot",
    f"select count(*) filter (family='image') images,count(*) filter (family='mesh') meshes,{r('coalesce(avg(elapsed_ms) filter (family=' + chr(39) + 'image' + chr(39) + '),0) mean_image_ms', 'coalesce(avg(elapsed_ms) filter (family=' + chr(39) + 'mesh' + chr(39) + '),0) mean_mesh_ms')},max(elapsed_ms) filter (family='image') longest_image_ms,max(elapsed_ms) filter (family='mesh') longest_mesh_ms,sum(size)::bigint bytes,count(*) filter {_V} violations,count(*) filter {_V}<0.05*count(*) compliant from v_log",
)
def snapshot(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.snapshot(views.log(spark, d)), "mean_image_ms", "mean_mesh_ms")


@query("agg_compliance", f"select family,count(*) operations,count(*) filter {_V} violations,{r(f'avg({_V}::int) share')} from v_log group by rollup (family)")
def compliance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.compliance_by_family(views.log(spark, d)), "share")


@query("agg_batch_totals", f"select sum(original_size) filter (success)::bigint original,sum(optimized_size) filter (success)::bigint optimized,count(*) filter (success) successes,count(*) filter (not success) failures,{r('(sum(original_size) filter (success)-sum(optimized_size) filter (success))/(sum(original_size) filter (success))::double*100 saved_percent')} from v_results")
def batch_totals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.totals(views.results(spark, d)), "saved_percent")


@query("agg_reduction_pct", f"select file_id,{r('case when original_size=0 then 0 else (original_size-optimized_size)/original_size::double*100 end saved', 'case when original_size=0 then 1 else optimized_size/original_size::double end ratio')} from v_results")
def reduction(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("original_size"), F.col("optimized_size")
    return rounded(views.results(spark, d).select("file_id", metrics.reduction(a, b).alias("saved"), metrics.ratio(a, b).alias("ratio")), "saved", "ratio")


@query("agg_batch_summary", "select count(*) total,count(*) filter (success) processed,count(*) filter (not success) errors,count(*) filter (success and optimized_size>original_size) grown,case when sum(optimized_size) filter (success)<=sum(original_size) filter (success) then 'saved' else 'increased' end outcome from v_results")
def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    t = views.results(spark, d).agg(
        F.count("*").alias("total"), F.count_if("success").alias("processed"), F.count_if(~F.col("success")).alias("errors"), F.count_if(F.col("success") & (F.col("optimized_size") > F.col("original_size"))).alias("grown"),
        F.when(F.coalesce(F.sum(F.when(F.col("success"), F.col("optimized_size"))), F.lit(0)) <= F.coalesce(F.sum(F.when(F.col("success"), F.col("original_size"))), F.lit(0)), "saved").otherwise("increased").alias("outcome"),
    )
    return t
