"""Queries that rewrite or take apart whole GIF, ICO and WebP files, put together from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import containers
from tessera.plans import views
from tessera.plans.codec_queries import _W, _le, whole
from tessera.plans.registry import query
from tessera.sources import chunks, jpegs
from tessera.sources.rasters import little_hex

_GIF_HEAD = "474946383961" + "10001000" + "800000" + "FF00000000FF"
_NETSCAPE = "NETSCAPE2.0".encode("ascii").hex().upper()
_BLOCK = (
    f"case tag when 'VP8 ' then '2C000000001000100000'||'0202'||{_le('seq', 2)}||'00' when 'ICCP' then '21FF0B{_NETSCAPE}03010000'||'00' when 'ANMF' then '21F90400'||{_le('len', 2)}||'0000' else '21FE02'||{_le('len', 2)}||'00' end"
)


def gif_files(spark: SparkSession, d: str) -> DataFrame:
    """path, content: a GIF of two colours for each file of the chunk table, with images, delays, comments and application blocks."""
    t = F.col("tag")
    block = F.when(t == "VP8 ", F.concat(F.lit("2C0000000010001000000202"), little_hex(F.col("seq"), 2), F.lit("00"))).when(t == "ICCP", F.lit(f"21FF0B{_NETSCAPE}0301000000"))
    block = block.when(t == "ANMF", F.concat(F.lit("21F90400"), little_hex(F.col("len"), 2), F.lit("0000"))).otherwise(F.concat(F.lit("21FE02"), little_hex(F.col("len"), 2), F.lit("00")))
    body = F.array_join(F.array_sort(F.collect_list(F.struct("seq", block.alias("s"))))["s"], "")
    whole = views.chunks(spark, d).groupBy("file_id").agg(body.alias("body"))
    return whole.select(F.col("file_id").cast("string").alias("path"), F.unhex(F.concat(F.lit(_GIF_HEAD), F.col("body"), F.lit("3B"))).alias("content"))


def _gif(where: str) -> str:
    return f"select file_id,md5(unhex('{_GIF_HEAD}'||coalesce(string_agg(s,'' order by seq) filter ({where}),'')||'3B')) md5 from (select file_id,seq,tag,{_BLOCK} s from v_chunks) t group by 1"


def _digest(files: DataFrame) -> DataFrame:
    return files.select(F.col("path").cast("long").alias("file_id"), F.md5("content").alias("md5"))


@query("opt_gif", _gif("tag in ('VP8 ','ANMF')"))
def opt_gif(spark: SparkSession, d: str) -> DataFrame:
    return _digest(containers.strip_gif(gif_files(spark, d)))


@query("chunk_gif_app", _gif("tag<>'ICCP'"))
def gif_app(spark: SparkSession, d: str) -> DataFrame:
    return _digest(containers.strip_gif(gif_files(spark, d), ("APP",)))


@query("det_anim_gif", "select file_id,count(*) filter (tag='VP8 ')>1 animated from v_chunks group by 1")
def anim_gif(spark: SparkSession, d: str) -> DataFrame:
    found = chunks.read_chunks(gif_files(spark, d).withColumn("format", F.lit("Gif")), payload=False)
    return containers.is_animated(found.withColumn("file_id", F.col("path").cast("long")), "IMAGE", 2)


_DATA = "repeat(printf('%02X',idx%256),cast(4+idx%5 as integer))"
_ICON = f"printf('%02X',w%256)||printf('%02X',h%256)||'00000100'||{_le('bpp', 2)}||{_le('4+idx%5', 4)}||{_le('6+16*n+before', 4)}"


def icons(spark: SparkSession, d: str) -> DataFrame:
    """The icon table with made-up data."""
    k = F.col("idx")
    return views.icons(spark, d).withColumn("data", F.unhex(F.expr("repeat(lpad(hex(idx % 256), 2, '0'), cast(4 + idx % 5 as int))"))).withColumn("idx", k)


@query("serialize_ico", f"select file_id,md5(unhex('00000100'||{_le('max(n)', 2)}||string_agg({_ICON},'' order by idx)||string_agg({_DATA},'' order by idx))) md5 from (select *,count(*) over (partition by file_id) n,coalesce(sum(4+idx%5) over (partition by file_id order by idx rows between unbounded preceding and 1 preceding),0)::bigint before from v_ico) t group by 1")
def serialize_ico(spark: SparkSession, d: str) -> DataFrame:
    return containers.serialize_icons(icons(spark, d)).select("file_id", F.md5("content").alias("md5"))


@query("parse_ico", f"select file_id,cast(row_number() over (partition by file_id order by idx)-1 as bigint) seq,w,h,bpp,{_DATA} data from v_ico")
def parse_ico(spark: SparkSession, d: str) -> DataFrame:
    made = containers.serialize_icons(icons(spark, d)).withColumnRenamed("file_id", "path")
    return containers.parse_icons(made).select(F.col("path").alias("file_id"), "seq", "w", "h", "bpp", F.hex("data").alias("data"))


_DIB = f"{_le('40', 4)}||{_le('w', 4)}||{{h}}||'0100'||{_le('bpp', 2)}||repeat('00',24)||{_DATA}"


@query("ico_dib_wrap", f"select file_id,idx,md5(unhex('424D'||{_le('14+40+4+idx%5', 4)}||'00000000'||{_le('14+40+case when bpp<=8 then 4*(1<<bpp) else 0 end', 4)}||{_DIB.format(h=_le('h', 4))})) md5 from v_ico")
def dib_wrap(spark: SparkSession, d: str) -> DataFrame:
    def le(c: Column, n: int) -> Column:
        return little_hex(c, n)

    dib = F.unhex(F.concat(le(F.lit(40), 4), le(F.col("w"), 4), le(F.col("h") * 2, 4), F.lit("0100"), le(F.col("bpp"), 2), F.lit("00" * 24), F.hex("data")))
    return icons(spark, d).select("file_id", "idx", F.md5(containers.dib_to_bmp(dib)).alias("md5"))


@query("info_webp_dims", "select p_partkey file_id,case when p_partkey%4=3 then null else p_size+1 end::bigint w,case when p_partkey%4=3 then null else p_partkey%500+1 end::bigint h from part")
def webp_dims(spark: SparkSession, d: str) -> DataFrame:
    """Headers of the three kinds of WebP, and of a kind that there is not."""
    k = F.col("p_partkey")
    w, h = (F.col("p_size") + 1).cast("long"), k % 500 + 1
    riff = F.concat(F.lit("5249464600000000" + "57454250"))
    wide = F.concat(F.lit("565038580A00000000000000"), little_hex(w - 1, 3), little_hex(h - 1, 3))
    lossless = F.concat(F.lit("5650384C050000002F"), little_hex((w - 1) + (h - 1) * 16384, 4))
    lossy = F.concat(F.lit("565038200A000000" + "000000" + "9D012A"), little_hex(w, 2), little_hex(h, 2))
    body = F.when(k % 4 == 0, wide).when(k % 4 == 1, lossless).when(k % 4 == 2, lossy).otherwise(F.lit("414C504800000000" + "00" * 16))
    size = containers.webp_size(F.unhex(F.concat(riff, body)))
    return views.table(spark, d, "part").select(k.alias("file_id"), size[0].alias("w"), size[1].alias("h"))


def riff(chunks: DataFrame) -> DataFrame:
    """chunks (file_id, seq, tag, len) -> path, content: WebP files whose payloads are one byte again and again."""
    one = F.concat(F.hex("tag"), little_hex(F.col("len"), 4), F.repeat(F.lit("AB"), F.col("len").cast("int")), F.repeat(F.lit("00"), (F.col("len") % 2).cast("int")))
    files = chunks.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("seq", one.alias("s")))).alias("p"), F.sum(8 + F.col("len") + F.col("len") % 2).alias("n"))
    return files.select(F.col("file_id").cast("string").alias("path"), F.unhex(F.concat(F.lit("52494646"), little_hex(4 + F.col("n"), 4), F.lit("57454250"), F.array_join("p.s", ""))).alias("content"))


_LE4 = "printf('%02X%02X%02X%02X',({n})%256,({n})//256%256,({n})//65536%256,({n})//16777216)"


@query("opt_webp", f"select file_id,md5(unhex('52494646'||{_LE4.format(n='4+n')}||'57454250'||coalesce(s,''))) md5 from (select file_id,sum(case when keep then 8+len+len%2 else 0 end)::bigint n,string_agg(hex(tag)||{_LE4.format(n='len')}||repeat('AB',len)||repeat('00',len%2),'' order by seq) filter (keep) s from (select *,tag in ('VP8 ','ANMF') or tag='ICCP' keep from v_chunks) c group by 1) t")
def opt_webp(spark: SparkSession, d: str) -> DataFrame:
    """WebP files without what the rules drop at quality 85: bytes, padding and sizes."""
    made = containers.rewritten(riff(views.chunks(spark, d)).withColumn("format", F.lit("WebP")), 85)
    return made.select(F.col("path").cast("long").alias("file_id"), F.md5("content").alias("md5"))


@query("chunk_jpeg_bytes", f"select * from (with {_W} select img_id,true same,true ended,22::bigint dropped from whole group by 1)")
def jpeg_bytes(spark: SparkSession, d: str) -> DataFrame:
    """JPEG files with a comment and two metadata segments put in, and every other one without its end: at quality 50 they become what they were."""
    made = jpegs.write_jpegs(whole(spark, d), 50)
    more = F.unhex(F.lit("FFE10006ABCDABCD" + "FFFE00044142" + "FFE20006FFD8FFD9"))
    cut = F.when(F.col("img_id") % 2 == 0, F.expr("substring(content, 3, length(content) - 4)")).otherwise(F.expr("substring(content, 3)"))
    files = made.select("img_id", "content", F.concat(F.unhex(F.lit("FFD8")), more, cut).alias("longer"))
    kept = containers.rewritten(files.select(F.col("img_id").cast("string").alias("path"), F.lit("Jpeg").alias("format"), F.col("longer").alias("content")), 50)
    both = files.join(kept.select(F.col("path").cast("long").alias("img_id"), F.col("content").alias("made")), "img_id")
    dropped = F.length("longer") - F.length("made") + F.when(F.col("img_id") % 2 == 0, 2).otherwise(0)
    return both.select("img_id", (F.col("made") == F.col("content")).alias("same"), (F.expr("substring(made, length(made) - 1)") == F.unhex(F.lit("FFD9"))).alias("ended"), dropped.cast("long").alias("dropped"))
