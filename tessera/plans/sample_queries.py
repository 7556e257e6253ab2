"""Queries of stricter format rules and validators, on small whole files, each in SQL over their text or hexadecimal digits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import detect
from tessera.plans import views
from tessera.plans.registry import query


def _b(i: int) -> str:
    return f"try_cast('0x'||substr(h,{2 * i + 1},2) as bigint)"


def _hex(s: str) -> str:
    return s.encode("ascii").hex().upper()


_LE80 = f"({_b(80)}+256*{_b(81)}+65536*{_b(82)}+16777216*{_b(83)})"
_SVG = "(starts_with(ltrim(t,' '||chr(10)),'<svg') or (starts_with(ltrim(t),'<?xml') and contains(t,'<svg')))"
_TGA = f"(n>=26 and substr(h,2*(n-26)+1,32)='{_hex(detect.TGA_FOOTER)}') or (n>=18 and {_b(1)}<=1 and {_b(2)} in (0,1,2,3,9,10,11) and {_b(12)}+256*{_b(13)}>0 and {_b(14)}+256*{_b(15)}>0)"
_TGA_STRICT = f"(n>=26 and substr(h,2*(n-18)+1,32)='{_hex(detect.TGA_FOOTER)}') or (n>=18 and {_b(1)}<=1 and {_b(2)} in (0,1,2,3,9,10,11) and {_b(12)}+256*{_b(13)}>0 and {_b(14)}+256*{_b(15)}>0 and {_b(16)} in (8,15,16,24,32) and substr(h,9,8)<>'66747970')"
_FBX = f"(n>=23 and (starts_with(h,'{detect.FBX_SIGNATURE}') or contains(left(h,200),'{_hex('; FBX ')}') or contains(left(h,200),'{_hex('FBX version')}')))"
_LOADED = {
    "Obj": "len(list_filter(string_split(t,chr(10))[1:10],lambda x: regexp_matches(x,'^\\s*(#|v|vn|vt|f|o|g) ')))>0", "Gltf": """starts_with(ltrim(t),'{') and contains(t,'"asset"') and contains(t,'"version"') and (contains(t,'"meshes"') or contains(t,'"scenes"'))""", "Glb": "starts_with(h,'676C5446') and n>=12",
    "Stl": f"starts_with(lower(trim(t)),'solid') or (n>=84 and n>=84+50*{_LE80} and n<=184+50*{_LE80})", "Ply": f"regexp_matches(left(h,8),'^(50|70)(4C|6C)(59|79)') and (n=3 or substr(h,7,2) in ('0A','0D'))", "Fbx": _FBX,
}


def _case(rules: dict[str, str]) -> str:
    return " ".join(f"when coalesce({c},false) then '{k}'" for k, c in rules.items())


def _flags(spark: SparkSession, d: str, **rules: Column) -> DataFrame:
    return views.samples(spark, d).select("file_id", *(F.coalesce(v, F.lit(False)).alias(k) for k, v in rules.items()))


@query("det_mesh_loader", f"select file_id, case when n<4 then null {_case(_LOADED)} end format from v_samples")
def mesh_loader(spark: SparkSession, d: str) -> DataFrame:
    return views.samples(spark, d).select("file_id", detect.detect_mesh_loaded(F.col("content")).alias("format"))


@query("det_image_alt", f"select file_id, case when n<8 then null when coalesce({_SVG},false) then 'Svg' when coalesce({_TGA},false) then 'Tga' end format from v_samples")
def image_alt(spark: SparkSession, d: str) -> DataFrame:
    return views.samples(spark, d).select("file_id", detect.detect_image_plain(F.col("content")).alias("format"))


@query(
    "is_svg_gltf_stl",
    f"""select file_id, coalesce(starts_with(ltrim(t),'<svg') or ((starts_with(ltrim(t),'<?xml') or starts_with(ltrim(t),'<!DOCTYPE')) and contains(t,'<svg')),false) is_svg,
    contains(h,'7B') and contains(h,'{_hex('"asset"')}') and contains(h,'{_hex('"version"')}') is_gltf, coalesce(starts_with(h,'{_hex('solid ')}') or (n>=84 and n=84+50*{_LE80}),false) is_stl from v_samples""",
)
def is_text_formats(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return _flags(spark, d, is_svg=detect.is_svg(c), is_gltf=detect.is_gltf(c), is_stl=detect.is_stl(c))


@query("val_obj", r"select file_id, coalesce(len(list_filter(string_split(t,chr(10))[1:1000],lambda x: regexp_matches(x,'^\s*v ')))>0,false) valid from v_samples")
def valid_obj(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d, valid=detect.valid_obj(F.col("content")))


@query("val_gltf", """select file_id, coalesce(starts_with(trim(t),'{') and ends_with(trim(t),'}') and contains(t,'"asset"'),false) gltf, n>=20 and starts_with(h,'676C544602000000') glb from v_samples""")
def valid_gltf(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return _flags(spark, d, gltf=detect.valid_gltf(c), glb=(F.length(c) >= 20) & detect.is_glb(c) & (detect.little(c, 4, 4) == 2))


@query("val_stl", f"select file_id, n>=84 and coalesce(case when starts_with(lower(ltrim(t)),'solid') then contains(lower(t),'endsolid') else n>=84+50*{_LE80} end,false) valid from v_samples")
def valid_stl(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d, valid=detect.valid_stl(F.col("content")))


@query("val_ply", f"select file_id, regexp_matches(h,'^(70|50)(6C|4C)(79|59)(0D)?0A') and regexp_matches(h,'^([0-9A-F]{{2}})*?0A{_hex('format ')}') valid from v_samples")
def valid_ply(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d, valid=detect.valid_ply(F.col("content")))


@query(
    "val_structure",
    f"select file_id, case when contains(left(h,1000),'{_hex('format binary')}') then starts_with(h,'706C79') and contains(h,'{_hex('end_header')}') else coalesce(starts_with(t,'ply') and contains(t,'format') and contains(t,'end_header'),false) end ply, "
    f"n>=15 and coalesce(case when starts_with(h,'{_hex('solid ')}') then contains(t,'facet normal') and contains(t,'vertex') else n>=84 and n=84+50*{_LE80} end,false) stl, n>=23 and (starts_with(h,'{detect.FBX_SIGNATURE}') or coalesce(starts_with(t,'; FBX ') and (contains(t,'Objects:') or contains(t,'Model:')),false)) fbx from v_samples",
)
def structures(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return _flags(spark, d, ply=detect.sound_ply(c), stl=detect.sound_stl(c), fbx=detect.sound_fbx(c))


@query("val_config", "select p_partkey, array_to_string(list_filter([case when p_size*3-1 not between 1 and 100 then 'jpeg_quality' end, case when p_partkey%103 not between 1 and 100 then 'webp_quality' end, case when p_size%12>9 then 'png_level' end, case when p_partkey%30/20.0-0.1 not between 0 and 1 then 'ratio' end, case when p_partkey%7-1<0 then 'tolerance' end, case when p_size%6>3 then 'verbosity' end],lambda x: x is not null),',') broken from part")
def valid_config(spark: SparkSession, d: str) -> DataFrame:
    """The settings of each row that lie outside their range."""
    k, n = F.col("p_partkey"), F.col("p_size")
    made = views.table(spark, d, "part").select(
        "p_partkey", (n * 3 - 1).alias("jpeg_quality"), (k % 103).alias("webp_quality"), (n % 12).alias("png_level"), (k % 30 / 20.0 - 0.1).alias("ratio"), (k % 7 - 1).alias("tolerance"), (n % 6).alias("verbosity")
    )
    return made.select("p_partkey", broken_settings().alias("broken"))


#: Setting, least and largest value (fixed values).
RANGES = (("jpeg_quality", 1, 100), ("webp_quality", 1, 100), ("png_level", 0, 9), ("ratio", 0, 1), ("tolerance", 0, None), ("verbosity", 0, 3))


def broken_settings() -> Column:
    return F.concat_ws(",", *(F.when((F.col(c) < low) | (F.col(c) > high if high is not None else F.lit(False)), c) for c, low, high in RANGES))
