"""The whole way of a file: detection, candidates, the shortest of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import sqlfunctions
from tessera.operators import optimize
from tessera.plans import views
from tessera.plans.codec_queries import _W, _sum, checked, whole
from tessera.plans.markup_queries import _svg, svg_files
from tessera.plans.registry import query
from tessera.sources import rasters
from tessera.staging import Staging

#: By p_partkey modulo four: a glTF with empty members, an OBJ with comments, a text that is no asset; modulo four is zero: an SVG.
_GLTF = """'{"asset": {"version": "2.0"}, "meshes": [], "number": '||p_partkey||'}'"""
_OBJ = "'# part '||p_partkey||chr(10)||chr(10)||'v  0 0   '||p_size||chr(10)||'f 1 1 1'||chr(10)"


def files(spark: SparkSession, d: str) -> DataFrame:
    other = views.table(spark, d, "part").select("p_partkey", F.expr(f"case p_partkey % 4 when 1 then {_GLTF} when 2 then {_OBJ} else 'no asset ' || p_partkey end").alias("s"))
    both = other.join(svg_files(spark, d), "p_partkey")
    return both.select(F.col("p_partkey").cast("string").alias("path"), F.when(F.col("p_partkey") % 4 == 0, F.col("content")).otherwise(F.encode("s", "UTF-8")).alias("content"))


_MADE = f"""select p_partkey, case p_partkey%4 when 1 then '{{"asset":{{"version":"2.0"}},"number":'||p_partkey||'}}' when 2 then 'v 0 0 '||p_size||chr(10)||'f 1 1 1' when 3 then 'no asset '||p_partkey else s end made from part join ({_svg('', '')}) v using (p_partkey)"""


@query("opt_auto", f"select p_partkey, case p_partkey%4 when 0 then 'image:Svg' when 1 then 'mesh:Gltf' when 2 then 'mesh:Obj' else 'unknown' end format, case p_partkey%4 when 0 then 'prune-svg' when 1 then 'prune-json' when 2 then 'slim-lines' else 'keep' end strategy, made, strlen(made)::bigint optimized_size from ({_MADE}) t")
def opt_auto(spark: SparkSession, d: str) -> DataFrame:
    out = optimize.optimize(files(spark, d), 50)
    return out.select(F.col("path").cast("long").alias("p_partkey"), "format", "strategy", F.decode("content", "UTF-8").alias("made"), "optimized_size")


@query("opt_image", f"select * from (with {_W} select img_id,54+48*(max(y)+1) original,true as expected,count(*) n,{_sum(a='255')} checksum from whole group by 1)")
def opt_image(spark: SparkSession, d: str) -> DataFrame:
    """BMP files and the shortest form of each, read again in the format that it has.

    Their sizes before; whether a file is a PNG exactly if that is shorter, and
    the BMP as it was if not; and how many pixels it gives, and which.
    """
    files = rasters.write_bmp(whole(spark, d)).select(F.col("img_id").cast("string").alias("path"), "content")
    # Written, since what optimise makes is one large expression, which the steps below would each take apart anew.
    made = Staging(spark).write(optimize.optimize(files), "optimized").withColumn("now", F.when(F.substring("content", 1, 8) == F.unhex(F.lit("89504E470D0A1A0A")), "Png").otherwise("Bmp"))
    size, before = F.col("optimized_size"), F.col("original_size")
    expected = F.when(size < before, (F.col("now") == "Png") & F.col("strategy").like("png-%")).otherwise((F.col("now") == "Bmp") & (F.col("strategy") == "keep") & (size == before))
    # What is known before goes along in the name, so that nothing is made twice.
    named = made.select(F.concat_ws(" ", "path", before.cast("string"), expected.cast("string")).alias("path"), F.col("now").alias("format"), "content")
    back, part = checked(rasters.read_pixels(named)[0], "path"), F.split("path", " ")
    return back.select(part[0].cast("long").alias("img_id"), part[1].cast("long").alias("original"), part[2].cast("boolean").alias("expected"), "n", "checksum")


@query("api_sql_functions", "select file_id, case when h like '676C5446%' then 'mesh:Glb' when h like '4B617964617261%' or h like '3B2046425820%' then 'mesh:Fbx' when h like '706C790A%' or h like '706C790D0A%' then 'mesh:Ply' when h like '762030%' or contains(h,'0A762031') then 'mesh:Obj' else 'unknown' end format, h like '676C5446%' glb from v_samples")
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """Formats by the functions that SQL can call."""
    sqlfunctions.register(spark)
    views.samples(spark, d).createOrReplaceTempView("tessera_samples")
    return spark.sql("select file_id, detect_format(content) format, is_glb(content) glb from tessera_samples")
