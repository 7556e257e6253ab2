"""Queries of the raster and colour operators."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import pixels as px
from tessera.operators import raster
from tessera.plans import views
from tessera.plans.mesh_queries import nested, r
from tessera.plans.registry import query, rounded

AT = ("img_id", "y", "x")


def rgb() -> tuple[Column, Column, Column]:
    return F.col("r"), F.col("g"), F.col("b")


def each(spark: SparkSession, d: str, *values: Column) -> DataFrame:
    return views.pixels(spark, d).select(*AT, *values)


def longs(spark: SparkSession, d: str, **values: Column) -> DataFrame:
    return each(spark, d, *(v.cast("long").alias(k) for k, v in values.items()))


_YUV = "least(255,greatest(0,(77*r+150*g+29*b+128)>>8)) yy,least(255,greatest(0,((-43*r-85*g+128*b+128)>>8)+128)) uu,least(255,greatest(0,((128*r-107*g-21*b+128)>>8)+128)) vv"


@query("px_yuv", f"select img_id,y,x,{_YUV} from v_pixels")
def yuv(spark: SparkSession, d: str) -> DataFrame:
    return longs(spark, d, **dict(zip(("yy", "uu", "vv"), px.to_yuv(*rgb()), strict=True)))


@query("px_yuv_roundtrip", f"select img_id,y,x,least(255,greatest(0,yy+((359*(vv-128)+128)>>8))) r2,least(255,greatest(0,yy-((88*(uu-128)+183*(vv-128)+128)>>8))) g2,least(255,greatest(0,yy+((454*(uu-128)+128)>>8))) b2 from (select img_id,y,x,{_YUV} from v_pixels) t")
def yuv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    there = px.to_yuv(*rgb())
    return longs(spark, d, **dict(zip(("r2", "g2", "b2"), px.from_yuv(*there), strict=True)))


@query("px_gray", "select img_id,y,x,cast(floor(0.299::double*r+0.587::double*g+0.114::double*b+0.5::double) as bigint) v from v_pixels")
def gray(spark: SparkSession, d: str) -> DataFrame:
    return longs(spark, d, v=px.gray(*rgb()))


@query("px_bitshift", "select img_id,y,x,r//4*4 r2,g//4*4 g2,b//4*4 b2 from v_pixels")
def bitshift(spark: SparkSession, d: str) -> DataFrame:
    return longs(spark, d, r2=px.drop_bits(F.col("r"), 2), g2=px.drop_bits(F.col("g"), 2), b2=px.drop_bits(F.col("b"), 2))


@query("px_posterize", "select img_id,y,x,r//16*16 r2,g//16*16 g2,b//4*4 b2 from v_pixels")
def posterize(spark: SparkSession, d: str) -> DataFrame:
    return longs(spark, d, r2=px.posterize(F.col("r"), 4), g2=px.posterize(F.col("g"), 4), b2=px.posterize(F.col("b"), 6))


_HSV = "(select *,greatest(r,g,b) mx,greatest(r,g,b)-least(r,g,b) dd from v_pixels)"


@query(
    "px_hsv",
    f"select img_id,y,x,{r('case when h<0 then h+360 else h end h', 'case when mx=0 then 0 else dd/mx::double end s', 'mx/255.0::double v')} from (select *,case when dd=0 then 0 when r=mx then 60*((g-b)/dd::double) when g=mx then 60*((b-r)/dd::double+2) else 60*((r-g)/dd::double+4) end h from {_HSV} t) u",
)
def hsv(spark: SparkSession, d: str) -> DataFrame:
    return rounded(each(spark, d, *(v.alias(k) for k, v in zip("hsv", px.hsv(*rgb()), strict=True))), *"hsv")


@query("px_hsv_inv", "select img_id,y,x,r r2,g g2,b b2 from v_pixels")
def hsv_inverse(spark: SparkSession, d: str) -> DataFrame:
    return longs(spark, d, **dict(zip(("r2", "g2", "b2"), px.from_hsv(*px.hsv(*rgb())), strict=True)))


def _linear(c: str) -> str:
    return f"case when {c}/255.0::double<=0.04045 then {c}/255.0::double/12.92 else power(({c}/255.0::double+0.055)/1.055,2.4) end"


@query("px_linear", f"select img_id,y,x,{r(*(f'{_linear(c)} l{c}' for c in 'rgb'))} from v_pixels")
def linear(spark: SparkSession, d: str) -> DataFrame:
    return rounded(each(spark, d, *(px.linear(F.col(c)).alias(f"l{c}") for c in "rgb")), "lr", "lg", "lb")


@query("px_srgb", "select img_id,y,x,r r2 from v_pixels")
def srgb_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return longs(spark, d, r2=px.srgb(px.linear(F.col("r"))))


def _f(t: str) -> str:
    return f"(case when {t}>0.008856 then cbrt({t}) else 7.787*{t}+16/116::double end)"


@query(
    "px_lab",
    nested(
        f"l as (select img_id,y yy,x xx,{_linear('r')} lr,{_linear('g')} lg,{_linear('b')} lb from v_pixels), q as (select *,(0.4124564::double*lr+0.3575761::double*lg+0.1804375::double*lb)/0.95047::double x,0.2126729::double*lr+0.7151522::double*lg+0.0721750::double*lb y,(0.0193339::double*lr+0.1191920::double*lg+0.9503041::double*lb)/1.08883::double z from l)",
        f"select img_id,yy y,xx x,{r(f'116*{_f("y")}-16 l', f'500*({_f("x")}-{_f("y")}) a', f'200*({_f("y")}-{_f("z")}) b', digits=4)} from q",
    ),
)
def lab(spark: SparkSession, d: str) -> DataFrame:
    return rounded(each(spark, d, *(v.alias(k) for k, v in zip("lab", px.lab(*rgb()), strict=True))), *"lab", digits=4)


@query("px_brightness", "select img_id,y,x,least(255,r+25) r2,least(255,greatest(0,cast(trunc((r-128)*12/10.0) as bigint)+128)) contrast,least(255,cast(floor(r+(r-least(r,g,b))*0.3::double) as bigint)) saturated from v_pixels")
def brightness(spark: SparkSession, d: str) -> DataFrame:
    return longs(spark, d, r2=px.brightness(F.col("r")), contrast=px.contrast(F.col("r")), saturated=px.saturate(F.col("r"), F.least(*rgb())))


@query("px_swizzle", "select img_id,y,x,b c0,g c1,r c2,a c3 from v_pixels")
def swizzle(spark: SparkSession, d: str) -> DataFrame:
    return views.pixels(spark, d).select(*AT, F.col("b").alias("c0"), F.col("g").alias("c1"), F.col("r").alias("c2"), F.col("a").alias("c3"))


@query("px_alpha_colors", "select img_id,max(case when a<255 then 1 else 0 end) has_alpha,count(distinct r*65536+g*256+b) colors from v_pixels group by img_id")
def alpha_colors(spark: SparkSession, d: str) -> DataFrame:
    return raster.distinct_colors(views.pixels(spark, d))


@query("px_has_alpha_sampled", "select img_id,max(case when a<255 then 1 else 0 end) has_alpha from v_pixels where (y*16+x)%7=0 group by 1")
def alpha_sampled(spark: SparkSession, d: str) -> DataFrame:
    return views.pixels(spark, d).where((F.col("y") * 16 + F.col("x")) % 7 == 0).groupBy("img_id").agg(F.max(F.when(F.col("a") < 255, 1).otherwise(0)).alias("has_alpha"))


_NEAREST = "select img_id,y,x,idx from (select p.img_id,p.y,p.x,q.idx,row_number() over (partition by p.img_id,p.y,p.x order by {w},q.idx) rn from v_pixels p cross join v_palette q) t where rn=1"
_PLAIN = "(p.r-q.r)*(p.r-q.r)+(p.g-q.g)*(p.g-q.g)+(p.b-q.b)*(p.b-q.b)"


@query("px_nearest", _NEAREST.format(w=_PLAIN))
def nearest(spark: SparkSession, d: str) -> DataFrame:
    return raster.nearest(views.pixels(spark, d), views.palette(spark, d))


@query("px_nearest_weighted", _NEAREST.format(w="299*(p.r-q.r)*(p.r-q.r)+587*(p.g-q.g)*(p.g-q.g)+114*(p.b-q.b)*(p.b-q.b)"))
def nearest_weighted(spark: SparkSession, d: str) -> DataFrame:
    return raster.nearest(views.pixels(spark, d), views.palette(spark, d), (299, 587, 114))


@query("px_palette_expand", "select img_id,y,x,coalesce(q.r,0) r,coalesce(q.g,0) g,coalesce(q.b,0) b from (select img_id,y,x,r%32 idx from v_pixels) p left join v_palette q on p.idx=q.idx")
def palette_expand(spark: SparkSession, d: str) -> DataFrame:
    return raster.expand(views.pixels(spark, d).select(*AT, (F.col("r") % 32).alias("idx")), views.palette(spark, d))


def _l2(a: str, b: str) -> str:
    return "+".join(f"{w}::double*power({_linear(f'{a}.{c}')}-{_linear(f'{b}.{c}')},2)" for w, c in zip(px.LUMA, "rgb", strict=True))


@query("px_percep_dist", f"select p.idx a,q.idx b,{r(f'{_l2("p", "q")} d')} from v_palette p join v_palette q on p.idx<q.idx")
def perceptual(spark: SparkSession, d: str) -> DataFrame:
    p, q = (views.palette(spark, d).select(F.col("idx").alias(n), *(F.col(c).alias(f"{n}_{c}") for c in "rgb")) for n in "ab")
    pairs = p.join(q, F.col("a") < F.col("b"))
    return rounded(pairs.select("a", "b", px.weighted_distance(*(tuple(F.col(f"{n}_{c}") for c in "rgb") for n in "ab")).alias("d")), "d")


@query("px_closest", f"select a,arg_min(b,struct_pack(d,b)) closest,{r('min(d) least')} from (select p.idx a,q.idx b,round({_l2("p", "q")},9) d from v_palette p join v_palette q on p.idx<>q.idx) t group by 1")
def closest(spark: SparkSession, d: str) -> DataFrame:
    """For each colour of the palette the nearest other one, and how far it is."""
    p, q = (views.palette(spark, d).select(F.col("idx").alias(n), *(F.col(c).alias(f"{n}_{c}") for c in "rgb")) for n in "ab")
    away = F.round(px.weighted_distance(*(tuple(F.col(f"{n}_{c}") for c in "rgb") for n in "ab")), 9)
    pairs = p.join(q, F.col("a") != F.col("b")).select("a", "b", away.alias("d"))
    return rounded(pairs.groupBy("a").agg(F.min_by("b", F.struct("d", "b")).alias("closest"), F.min("d").alias("least")), "least")


_LAG = "coalesce(lag({c}) over (partition by img_id,y order by x),0)"


@query("px_predict_h", "select img_id,y,x," + ",".join(f"({c}-{_LAG.format(c=c)}+256)%256 d{c}" for c in "rgb") + " from v_pixels")
def predict_h(spark: SparkSession, d: str) -> DataFrame:
    return raster.predict_horizontal(views.pixels(spark, d))


@query("px_predict_avg", "select img_id,y,x," + ",".join(f"({c}-({_LAG.format(c=c)}+coalesce(lag({c}) over (partition by img_id,x order by y),0))//2+256)%256 d{c}" for c in "rgb") + " from v_pixels")
def predict_avg(spark: SparkSession, d: str) -> DataFrame:
    return raster.predict_average(views.pixels(spark, d))


_TAPS = [math.exp(-((i - 2) ** 2) / (2 * 0.6**2)) for i in range(5)]


def _blurred(source: str, fixed: str, moving: str) -> str:
    """One pass of the blur in SQL: five taps, the outermost pixel repeated."""
    w = f"(partition by img_id,{fixed} order by {moving})"
    whole = f"(partition by img_id,{fixed} order by {moving} rows between unbounded preceding and unbounded following)"

    def at(c: str, k: int) -> str:
        if not k:
            return c
        near = f"lag({c},{-k}) over {w}" if k < 0 else f"lead({c},{k}) over {w}"
        return f"coalesce({near},{'first' if k < 0 else 'last'}_value({c}) over {whole})"

    total = np.array(_TAPS).sum()
    return f"(select img_id,y,x,{','.join('cast(floor(' + '+'.join(f'{float(t / total)!r}::double*{at(c, i - 2)}' for i, t in enumerate(_TAPS)) + f'+0.5::double) as bigint) {c}' for c in 'rgb')} from {source})"


@query("px_blur_gauss", f"select * from {_blurred(_blurred('v_pixels', 'y', 'x'), 'x', 'y')} t")
def blur(spark: SparkSession, d: str) -> DataFrame:
    return raster.blur(views.pixels(spark, d))


@query("px_convolve", "select img_id,y,x," + ",".join(f"least(255,greatest(0,cast(floor(round({c}s,6)) as bigint))) {c}" for c in "rgb") + " from (select c.img_id,c.y,c.x,count(*) n," + ",".join(f"sum(p.{c}*case when p.x=c.x and p.y=c.y then 5.0 when p.x=c.x or p.y=c.y then -1.0 else 0.0 end) {c}s" for c in "rgb") + " from v_pixels c join v_pixels p on p.img_id=c.img_id and p.y between c.y-1 and c.y+1 and p.x between c.x-1 and c.x+1 group by 1,2,3) t where n=9")
def convolve(spark: SparkSession, d: str) -> DataFrame:
    return raster.convolve(views.pixels(spark, d), [[0, -1, 0], [-1, 5, -1], [0, -1, 0]])


@query("px_downscale", "select p.img_id,ty y,tx x,p.r,p.g,p.b from (select *,unnest(range(0,8)) tx from (select img_id,max(x)+1 sw,max(y)+1 sh,unnest(range(0,8)) ty from v_pixels group by 1) s) g join v_pixels p on p.img_id=g.img_id and p.y=ty*sh//8 and p.x=tx*sw//8")
def downscale(spark: SparkSession, d: str) -> DataFrame:
    return raster.downscale(views.pixels(spark, d), 8, 8)


def _cut(depth: int) -> str:
    """Median cut in SQL: colours and their buckets, halved `depth` times."""
    if not depth:
        return "(select img_id,r,g,b,count(*) n,0 bucket from v_pixels group by 1,2,3,4)"
    spread = {c: f"round(var_pop({c}) over (partition by img_id,bucket),6) v{c}" for c in "rgb"}
    wide = f"(select *,case when vr>=vg and vr>=vb then r when vg>=vb then g else b end widest from (select *,{','.join(spread.values())} from {_cut(depth - 1)}))"
    return f"(select img_id,r,g,b,n,bucket*2+ntile(2) over (partition by img_id,bucket order by widest,r,g,b)-1 bucket from {wide})"


_BUCKETS = f"(select img_id,bucket::bigint idx,sum(n)::bigint n,{','.join(f'cast(floor(sum({c}*n)/sum(n)) as bigint) {c}' for c in 'rgb')} from {_cut(4)} group by 1,2)"


def _own(palettes: str, weights: tuple[int, int, int]) -> str:
    d = "+".join(f"{w}*(p.{c}-q.{c})*(p.{c}-q.{c})" for w, c in zip(weights, "rgb", strict=True))
    return f"select img_id,y,x,r,g,b from (select p.img_id,p.y,p.x,q.r,q.g,q.b,row_number() over (partition by p.img_id,p.y,p.x order by {d},q.idx) k from v_pixels p join {palettes} q on p.img_id=q.img_id) t where k=1"


@query("px_quant_mediancut", f"select img_id,idx bucket,n,r,g,b from {_BUCKETS} t")
def median_cut(spark: SparkSession, d: str) -> DataFrame:
    return raster.median_cut(views.pixels(spark, d)).withColumn("bucket", F.col("bucket").cast("long"))


@query("px_map_mediancut", _own(_BUCKETS, (1, 1, 1)))
def map_median_cut(spark: SparkSession, d: str) -> DataFrame:
    """Every pixel in the nearest colour of its image's median cut."""
    p = views.pixels(spark, d)
    return raster.map_to_own(p, raster.median_cut(p).withColumnRenamed("bucket", "idx"))


def _rounds(n: int) -> str:
    """Palettes p1 ... pn after each round, from that of the median cut, and errors e1 ... en, in SQL."""
    parts = [f"colors as (select img_id,r,g,b,count(*) n from v_pixels group by 1,2,3,4), p0 as (select img_id,idx,r,g,b from {_BUCKETS} q)"]
    for k in range(1, n + 1):
        d = "+".join(f"(c.{x}-p.{x})*(c.{x}-p.{x})" for x in "rgb")
        # Colours that got nothing before are gone, and places count anew.
        parts.append(f"o{k} as (select *,row_number() over (partition by img_id order by idx)-1 place from p{k - 1})")
        parts.append(f"g{k} as (select c.img_id,p.place,c.r,c.g,c.b,c.n,{d} d from colors c join o{k} p using (img_id) qualify row_number() over (partition by c.img_id,c.r,c.g,c.b order by {d},p.place)=1)")
        parts.append(f"e{k} as (select img_id,{k} round,sum(d*n)::bigint error from g{k} group by 1)")
        parts.append(f"p{k} as (select img_id,place::bigint idx,sum(n)::bigint n,{','.join(f'((2*sum({x}*n)+sum(n))//(2*sum(n)))::bigint {x}' for x in 'rgb')} from g{k} group by 1,2)")
    return ", ".join(parts)


#: Rounds of the learned palettes.
ROUNDS = 3


@query("png_palette_rounds", f"select * from (with {_rounds(ROUNDS)} {' union all '.join(f'select img_id,{k} round,idx,n,r,g,b from p{k}' for k in range(1, ROUNDS + 1))})")
def palette_rounds(spark: SparkSession, d: str) -> DataFrame:
    """The palette that each image learns, after every round."""
    p = views.pixels(spark, d)
    return raster.learned_palettes(p, raster.median_cut(p).withColumnRenamed("bucket", "idx"), ROUNDS)[0]


@query("png_palette_error", f"select * from (with {_rounds(ROUNDS)} select img_id,e1.error first,e{ROUNDS}.error last,e{ROUNDS}.error<=e1.error falls from e1 join e{ROUNDS} using (img_id))")
def palette_error(spark: SparkSession, d: str) -> DataFrame:
    """The squared error of an image in its palette, in the first and in the last round."""
    p = views.pixels(spark, d)
    errors = raster.learned_palettes(p, raster.median_cut(p).withColumnRenamed("bucket", "idx"), ROUNDS)[1]
    at = {name: F.max(F.when(F.col("round") == k, F.col("error"))).alias(name) for name, k in (("first", 1), ("last", ROUNDS))}
    return errors.groupBy("img_id").agg(*at.values()).withColumn("falls", F.col("last") <= F.col("first"))


_CELLS = "(select img_id,level,r>>(8-level) kr,g>>(8-level) kg,b>>(8-level) kb,count(*) n,cast(floor(sum(r)/count(*)) as bigint) r,cast(floor(sum(g)/count(*)) as bigint) g,cast(floor(sum(b)/count(*)) as bigint) b from (select *,unnest(range(0,9)) level from v_pixels) q group by 1,2,3,4,5)"
_LEAVES = (
    f"(with cells as {_CELLS}, best as (select img_id,max(level) base,arg_max(m,level) m from (select img_id,level,count(*) m from cells group by 1,2) s where m<=64 group by 1), own as (select c.*,m from cells c join best b on b.img_id=c.img_id and c.level=base), below as (select c.* from cells c join best b on b.img_id=c.img_id and c.level=base+1), "
    "kids as (select img_id,kr//2 kr,kg//2 kg,kb//2 kb,count(*) children from below group by 1,2,3,4), judged as (select o.*,children,sum(coalesce(children,1)-1) over (partition by o.img_id order by o.n desc,o.kr,o.kg,o.kb rows between unbounded preceding and current row) more from own o left join kids k using (img_id,kr,kg,kb)), "
    "open as (select * from judged where children is not null and m+more<=64), leaves as (select img_id,level,kr,kg,kb,n,r,g,b from judged where not (children is not null and m+more<=64) union all select w.img_id,w.level,w.kr,w.kg,w.kb,w.n,w.r,w.g,w.b from below w semi join open o on o.img_id=w.img_id and o.kr=w.kr//2 and o.kg=w.kg//2 and o.kb=w.kb//2) "
    "select img_id,cast(row_number() over (partition by img_id order by level,kr,kg,kb)-1 as bigint) idx,level,n,r,g,b from leaves)"
)
_SQUARED = (299 * 299, 587 * 587, 114 * 114)


@query("px_octree_leaves", f"select * from {_LEAVES} t")
def octree_leaves(spark: SparkSession, d: str) -> DataFrame:
    return raster.octree(views.pixels(spark, d))


@query("px_quant_octree", _own(_LEAVES, _SQUARED))
def octree(spark: SparkSession, d: str) -> DataFrame:
    """Every pixel in the nearest of at most 64 colours of its image's octree."""
    p = views.pixels(spark, d)
    return raster.map_to_own(p, raster.octree(p), _SQUARED)


@query("px_dither_fs")
def dither(spark: SparkSession, d: str) -> DataFrame:
    return raster.dither(views.pixels(spark, d), views.palette(spark, d))


@query("px_dither_squares", "select img_id,count(*) n,sum(y*16+x)::bigint places,true known from v_pixels group by 1")
def dither_squares(spark: SparkSession, d: str) -> DataFrame:
    """Errors diffused in squares of eight: every pixel once, and only values that the palette has in its channel."""
    palette = views.palette(spark, d)
    made = raster.dither(views.pixels(spark, d), palette, 8)
    values = palette.agg(*(F.collect_set(c).alias(c) for c in "rgb")).first()
    known = F.every(F.col("r").isin(values.r) & F.col("g").isin(values.g) & F.col("b").isin(values.b))
    return made.groupBy("img_id").agg(F.count("*").alias("n"), F.sum(F.col("y") * 16 + F.col("x")).alias("places"), known.alias("known"))


@query("px_histogram", "select channel,value,count(*) n from (select unnest(['r','g','b']) channel,unnest([r,g,b]) value from v_pixels) t group by 1,2")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return raster.histogram(views.pixels(spark, d))
