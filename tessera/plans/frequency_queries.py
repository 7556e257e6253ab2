"""Queries of resizing and of blocks in the frequency domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import blocks, containers, resampling
from tessera.plans import views
from tessera.plans.codec_queries import _W, _sum, checked, read, whole
from tessera.plans.raster_queries import _YUV
from tessera.plans.registry import query
from tessera.sources import jpegs

#: Name, quality, and whether the strong ladder is meant.
STEPS = (("gentle-30", 30, False), ("gentle-50", 50, False), ("strong-20", 20, True), ("strong-40", 40, True), ("strong-60", 60, True), ("strong-90", 90, True))
#: The quality whose blocks the queries look at.
QUALITY = 50


def _taps(axis: str, n: str) -> str:
    """What source row or column i gives to row or column o, in SQL."""
    at = f"select kind,img_id,{axis} n,o,(o+0.5::double)*({axis}/{n}) a,greatest({axis}/{n},1::double) s from (select *,unnest(range({n})) o from sized)"
    near = f"select *,greatest(0,cast(floor(round(a-s,9)) as bigint)) lo,cast(ceil(round(a+s,9)) as bigint) hi from ({at})"
    return f"select kind,img_id,o,i,wt from (select kind,img_id,o,i,greatest(0::double,1-abs((i+0.5::double-a)/s)) wt from (select *,unnest(range(lo,least(n,greatest(lo+1,hi)))) i from ({near}))) where wt>0"


_MODES = ",".join(f"('{name}',{percent},{resampling.STRONG_LEAST if strong else resampling.GENTLE_LEAST},{bits})" for name, q, strong in STEPS for percent, bits in [resampling.step_of(q, resampling.STRONG if strong else resampling.GENTLE)])
_SIZED = "select kind,bits,img_id,w,h,greatest(1,cast(floor(round(w*f,9)+0.5::double) as bigint)) nw,greatest(1,cast(floor(round(h*f,9)+0.5::double) as bigint)) nh from (select *,least(greatest(w*pct//100,low)/w,greatest(h*pct//100,low)/h) f from (select img_id,max(x)+1 w,max(y)+1 h from whole group by 1) s cross join (values {m}) m(kind,pct,low,bits)) t"


def _mixed(axis: str, other: str, taps: str, source: str, keys: str) -> str:
    return f"select t.kind,t.img_id,p.{other},t.o {axis},sum(p.r*wt)/sum(wt) r,sum(p.g*wt)/sum(wt) g,sum(p.b*wt)/sum(wt) b from {source} p join {taps} t on {keys} and p.{axis}=t.i group by 1,2,3,4"


_DROP = "((cast(floor(least(255,greatest(0,round({c},6)))+0.5::double) as bigint)>>bits)<<bits)"
_RESIZED = f"""select * from (with {_W}, sized as ({_SIZED.format(m=_MODES)}), ty as ({_taps('h', 'nh')}), tx as ({_taps('w', 'nw')}),
  tall as ({_mixed('y', 'x', 'ty', 'whole', 'p.img_id=t.img_id')}), made as ({_mixed('x', 'y', 'tx', 'tall', 'p.img_id=t.img_id and p.kind=t.kind')})
  select m.kind,m.img_id,nw w,nh h,count(*) n,sum((y*16+x+1)*({_DROP.format(c='r')}+256*({_DROP.format(c='g')})+65536*({_DROP.format(c='b')})))::bigint checksum from made m join sized s using (kind,img_id) group by 1,2,3,4)"""


@query("webp_quality_resize", _RESIZED)
def webp_quality_resize(spark: SparkSession, d: str) -> DataFrame:
    """Every image on every step of both ladders: its new size, and a sum that tells which colour stands where."""
    all_ = resampling.for_qualities(whole(spark, d), list(STEPS))
    value = (F.col("y") * 16 + F.col("x") + 1) * (F.col("r") + 256 * F.col("g") + 65536 * F.col("b"))
    return all_.groupBy("kind", "img_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"), F.count("*").alias("n"), F.sum(value).cast("long").alias("checksum"))


_FILE_Q = blocks.file_quality(QUALITY)
_DIV = [str(blocks.divisors(_FILE_Q, t)) for t in (blocks.LUMINANCE, blocks.CHROMINANCE)]
#: z: block, place in zigzag order, quantised coefficient.
_BLOCKS = f"""{_W}, yuv as (select img_id,y,x,{_YUV} from whole), side as (select img_id,max(x)+1 w,max(y)+1 h from whole group by 1),
  plane as (select img_id,unnest([0,1,2]) channel,unnest([yy,uu,vv]) value,y,x from yuv),
  tall as (select p.img_id,channel,value,x,w,unnest(case when y=h-1 then range(y,(h+7)//8*8) else [y] end) y from plane p join side using (img_id)),
  full_ as (select img_id,channel,value-128 value,y,unnest(case when x=w-1 then range(x,(w+7)//8*8) else [x] end) x from tall),
  basis as (select k,i,sqrt((case when k=0 then 1 else 2 end)/8::double)*cos((2*i+1)*k*pi()/16) c from (select unnest(range(8)) k), (select unnest(range(8)) i)),
  place as (select v,u,row_number() over (order by v+u,case when (v+u)%2=1 then v else u end)-1 k from (select unnest(range(8)) v), (select unnest(range(8)) u)),
  rows_ as (select img_id,channel,y//8 sy,x//8 sx,y%8 vy,k u,sum(value*c) f from full_ join basis on i=x%8 group by all),
  freq as (select img_id,channel,sy,sx,k v,u,sum(f*c) f from rows_ join basis on i=vy group by all),
  quant as (select img_id,channel,sy,sx,p.k,round(f/(case when channel=0 then {_DIV[0]} else {_DIV[1]} end)[v*8+u+1],6) s from freq join place p using (v,u)),
  z as (select img_id,channel,sy,sx,k,cast(sign(s)*floor(abs(s)+0.5::double) as bigint) z from quant)"""


def _quantised(spark: SparkSession, d: str) -> DataFrame:
    return blocks.transformed(whole(spark, d), _FILE_Q)


@query("jpeg_coefficients", f'select * from (with {_BLOCKS} select img_id,channel,sy "by",sx bx,sum(case when k=0 then z else 0 end)::bigint "first",sum((z<>0)::int)::bigint there,sum(z*(k+1))::bigint checksum from z group by 1,2,3,4)')
def coefficients(spark: SparkSession, d: str) -> DataFrame:
    """Quantised blocks: the first coefficient, how many are not zero, and a sum that tells which stands where."""
    weighted = F.aggregate(F.transform("z", lambda v, k: v * (k + 1)), F.lit(0).cast("long"), lambda a, v: a + v)
    there = F.size(F.filter("z", lambda v: v != 0)).cast("long")
    return _quantised(spark, d).select("img_id", "channel", "by", "bx", F.get("z", F.lit(0)).alias("first"), there.alias("there"), weighted.alias("checksum"))


_BITS = "case when {v}=0 then 0 else length(bin(abs({v}))) end"
_SYMBOLS = f"""{_BLOCKS}, wide as (select img_id,max(sx)+1 bw from z group by 1),
  firsts as (select img_id,channel,z-coalesce(lag(z) over (partition by img_id,channel order by sy*bw+sx),0) d from z join wide using (img_id) where k=0),
  there as (select img_id,channel,sy,sx,k,z,k-coalesce(lag(k) over (partition by img_id,channel,sy,sx order by k),0)-1 run from z where k>0 and z<>0),
  ends as (select img_id,channel,sy,sx from z group by all having coalesce(max(case when z<>0 and k>0 then k end),0)<63),
  written as (select img_id,channel,0 kind,{_BITS.format(v='d')} symbol,{_BITS.format(v='d')} extra from firsts union all select img_id,channel,1,run%16*16+{_BITS.format(v='z')},{_BITS.format(v='z')} from there
    union all select img_id,channel,1,240,0 from (select *,unnest(range(run//16)) from there) union all select img_id,channel,1,0,0 from ends)"""


@query("jpeg_symbols", f"select * from (with {_SYMBOLS} select img_id,channel,kind,symbol,count(*) n,sum(extra)::bigint extra from written group by 1,2,3,4)")
def symbols(spark: SparkSession, d: str) -> DataFrame:
    """How often each symbol is written, and the bits that follow it."""
    written = blocks.symbols(_quantised(spark, d))
    return written.groupBy("img_id", "channel", "kind", "symbol").agg(F.count("*").alias("n"), F.sum("extra").cast("long").alias("extra"))


#: Bits of each image and way: optimal codes merge the two least counts again and again.
_OPT_JPEG = f"""select * from (with recursive {_SYMBOLS}, ways as (select 1 ordinal,'jpeg-color-{_FILE_Q}' strategy,* from written union all select 2,'jpeg-gray-{_FILE_Q}',* from written where channel=0),
  counts as (select img_id,ordinal,strategy,channel>0 color,kind,symbol,count(*) n,sum(extra) extra from ways group by 1,2,3,4,5,6),
  merge_ as (select img_id,ordinal,strategy,color,kind,list_sort(list(n)) l,sum(extra)::bigint cost from counts group by 1,2,3,4,5 union all select img_id,ordinal,strategy,color,kind,list_sort(list_append(l[3:],l[1]+l[2])),cost+l[1]+l[2] from merge_ where len(l)>1),
  sizes as (select img_id,ordinal,strategy,cast(ceil(sum(cost)/8) as bigint) len from merge_ where len(l)=1 group by 1,2,3)
  select img_id,strategy,len from sizes qualify row_number() over (partition by img_id order by len,ordinal)=1)"""


@query("opt_jpeg", _OPT_JPEG)
def opt_jpeg(spark: SparkSession, d: str) -> DataFrame:
    """The way to write each image as JPEG that takes the fewest bytes of scan."""
    best = containers.smallest(blocks.jpeg_candidates(whole(spark, d), QUALITY).withColumnRenamed("img_id", "file_id"))
    return best.select(F.col("file_id").alias("img_id"), "strategy", "len")


@query("jpeg_kernel_pre", f"select img_id,y,x,least(255,greatest(0,yy+((359*(vv-128)+128)>>8))) r,least(255,greatest(0,yy-((88*(uu-128)+183*(vv-128)+128)>>8))) g,least(255,greatest(0,yy+((454*(uu-128)+128)>>8))) b from (select img_id,y,x,{_YUV} from v_pixels where img_id in (select img_id from v_pixels group by 1 having count(*)>500)) t union all select img_id,y,x,r,g,b from v_pixels where img_id not in (select img_id from v_pixels group by 1 having count(*)>500)")
def kernel(spark: SparkSession, d: str) -> DataFrame:
    """What a JPEG of quality 75 is made of, where 500 pixels count as large."""
    return blocks.prepared(views.pixels(spark, d), 75, 500)


#: Pixels that the quantised blocks give when they are transformed back.
_BACK = f"""{_BLOCKS}, deq as (select img_id,channel,sy,sx,p.v,p.u,z*(case when channel=0 then {_DIV[0]} else {_DIV[1]} end)[v*8+u+1] f from z join place p using (k)),
  half as (select img_id,channel,sy,sx,u,b.i yy,sum(f*c) f from deq join basis b on b.k=v group by all),
  back as (select img_id,channel,sy*8+yy y,sx*8+b.i x,least(255,greatest(0,cast(floor(round(sum(f*c),6)+0.5::double) as bigint)+128)) value from half join basis b on b.k=u group by img_id,channel,sy,sx,yy,b.i),
  wide as (select img_id,y,x,max(value) filter (channel=0) yy,max(value) filter (channel=1)-128 u,max(value) filter (channel=2)-128 v from back join side using (img_id) where y<h and x<w group by 1,2,3),
  rgb as (select img_id,y,x,least(255,greatest(0,yy+((359*v+128)>>8))) r,least(255,greatest(0,yy-((88*u+183*v+128)>>8))) g,least(255,greatest(0,yy+((454*u+128)>>8))) b from wide)"""


@query("conv_jpeg", f"select * from (with {_BACK} select img_id,count(*) n,{_sum(a='255')} checksum from rgb group by 1)")
def conv_jpeg(spark: SparkSession, d: str) -> DataFrame:
    """Images as baseline JPEG, read back: the pixels that the quantised blocks stand for."""
    return checked(read(jpegs.write_jpegs(whole(spark, d), _FILE_Q), "Jpeg"), "img_id")
