"""Queries of the text, markup, JSON, hash and number functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import hashing, numbers, text
from tessera.operators import entropy as codes
from tessera.plans import views
from tessera.plans.mesh_queries import r
from tessera.plans.registry import query, rounded


@query("txt_normalize", r"select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text,chr(13),''),'[ \t]+',' ','g'),' *, *',',','g'),'(?m)^ +| +$','','g'),'\s+$','') s from documents")
def normalize(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "documents").select("doc_id", text.normalize(F.col("text")).alias("s"))


@query("txt_squeeze", r"select doc_id, trim(regexp_replace(text,'[ \t\n\x0B\f\r]+',' ','g')) s from documents")
def squeeze(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "documents").select("doc_id", text.squeeze(F.col("text")).alias("s"))


@query("txt_strip_comments", "select doc_id, array_to_string(list_filter(string_split(text,chr(10)), lambda x: trim(x)<>'' and not starts_with(ltrim(x),'#')),chr(10)) s from documents")
def strip_comments(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "documents").select("doc_id", text.strip_comments(F.col("text")).alias("s"))


@query("txt_round_number", r"select event_id, regexp_replace(regexp_replace(printf('%.6f',value),'(\.[0-9]*?)0+$','\1'),'\.$','') s, printf('%.3f',value) fixed from events")
def round_number(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "events").select("event_id", text.shorten_number(F.col("value")).alias("s"), text.fixed_precision(F.col("value"), 3).alias("fixed"))


@query("txt_find_header", "select page_id, case when instr(html,'</head>')>0 then instr(html,'</head>')+6 else 0 end::bigint place from pages")
def find_header(spark: SparkSession, d: str) -> DataFrame:
    """The place after the mark that ends a head; 0 if there is none."""
    at = F.instr("html", "</head>")
    return views.table(spark, d, "pages").select("page_id", F.when(at > 0, at + 6).otherwise(0).cast("long").alias("place"))


@query("svg_hex_shorten", "select p_partkey, case when substr(h,1,1)=substr(h,2,1) and substr(h,3,1)=substr(h,4,1) and substr(h,5,1)=substr(h,6,1) then '#'||substr(h,1,1)||substr(h,3,1)||substr(h,5,1) else '#'||h end s from (select p_partkey, lower(repeat(printf('%X',(p_partkey%16)::int),2)||repeat(printf('%X',(p_partkey//16%16)::int),2)||printf('%X',(p_partkey%16)::int)||printf('%X',(p_partkey//3%16)::int)) h from part) t")
def hex_shorten(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    color = F.concat(F.lit("#"), F.repeat(F.hex(k % 16), 2), F.repeat(F.hex(F.floor(k / 16) % 16), 2), F.hex(k % 16), F.hex(F.floor(k / 3) % 16))
    return views.table(spark, d, "part").select("p_partkey", text.shorten_hex(color).alias("s"))


@query("svg_strip_comments", "select page_id, regexp_replace(html,'<!--.*?-->','','gs') s from pages")
def strip_markup(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "pages").select("page_id", text.strip_markup_comments(F.col("html")).alias("s"))


_SPACES = r"""regexp_replace({s},'("[^"]*"|''[^'']*'')|[ \t\r\n]+','\1 ','g')"""
_TIDY = _SPACES.format(s=_SPACES.format(s="regexp_replace(html,'<!--.*?-->','','gs')"))


@query("svg_minify", rf"select page_id, trim(regexp_replace(regexp_replace({_TIDY},' ?([<>=]) ?','\1','g'),' +',' ','g')) s, length(html)::bigint before from pages")
def minify(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "pages").select("page_id", text.minify_markup(F.col("html")).alias("s"), F.length("html").cast("long").alias("before"))


@query("json_prune_flat", """select event_id, case when cast(json_extract_string(props,'$.k') as bigint)%5=0 then '{}' else '{"k":"'||json_extract_string(props,'$.k')||'"}' end s from events""")
def json_prune(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    made = F.to_json(F.create_map(F.lit("k"), F.when(k.cast("long") % 5 == 0, "").otherwise(k), F.lit("extras"), F.lit("dropped")))
    return views.table(spark, d, "events").select("event_id", text.prune_flat_json(made, ("extras", "name", "copyright", "generator")).alias("s"))


_ITEMS = "(select doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text,''))),'..'), lambda x: ('0x'||x)::bigint) bytes from documents)"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "documents")


@query("hash_djb2", f"select doc_id, list_reduce(list_prepend(5381::bigint,bytes), lambda h,b: (h*33+b)%4294967296) h from {_ITEMS} t")
def djb2(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", hashing.djb2(F.encode("text", "UTF-8")).alias("h"))


@query("hash_fnv1a", f"select doc_id, list_reduce(list_prepend(2166136261::bigint,bytes), lambda h,b: (xor(h,b)*16777619)%4294967296) h from {_ITEMS} t")
def fnv1a(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", hashing.fnv1a(F.encode("text", "UTF-8")).alias("h"))


@query("hash_frame", f"select doc_id, cast(list_reduce(list_prepend(0::hugeint,list_transform(bytes,lambda b,i: (b+i-1)::hugeint)), lambda h,b: (h*31+b)%18446744073709551616::hugeint) as varchar) h from {_ITEMS} t")
def frame_hash(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", hashing.frame_hash(F.encode("text", "UTF-8")).alias("h"))


_CRC_TABLE = "(select list_transform(range(0,256), lambda n: list_reduce(list_prepend(n,[0,0,0,0,0,0,0,0]::bigint[]), lambda c,z: case when c&1=1 then xor(c>>1,3988292384) else c>>1 end)) crcs)"


@query("hash_crc32", f"select doc_id, xor(list_reduce(list_prepend(4294967295::bigint,bytes), lambda c,b: xor(c>>8,crcs[(xor(c,b)&255)+1])),4294967295) h from {_ITEMS} t cross join {_CRC_TABLE} k")
def crc32(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("h"))


def _rot(x: str, bits: int) -> str:
    return f"((({x})*{1 << bits})%4294967296+(({x})//{1 << (32 - bits)}))"


def _word(at: str) -> str:
    return f"(bytes[{at}+1]+256*bytes[{at}+2]+65536*bytes[{at}+3]+16777216*bytes[{at}+4])::hugeint"


_M32 = "%4294967296"
_LANE = _rot(f"(l[k]+s[k]*{hashing.P2}){_M32}", 13)
#: The lanes of each text over its stripes, what is left folded on, and the last mixing, step by step.
_XX32 = f"""select * from (with b as (select doc_id,bytes,len(bytes)::hugeint n from {_ITEMS} t),
  lanes as (select *,list_reduce(list_prepend([{(hashing.P1 + hashing.P2) % 2**32},{hashing.P2},0,{-hashing.P1 % 2**32}]::hugeint[],list_transform(range(0,(n//16)::bigint),lambda i: list_transform(range(0,4),lambda k: {_word('16*i+4*k')}))),lambda l,s: list_transform(range(1,5),lambda k: ({_LANE})*{hashing.P1}{_M32})) v from b),
  whole as (select *,((case when n>=16 then {'+'.join(_rot(f'v[{k + 1}]', r) for k, r in enumerate((1, 7, 12, 18)))} else {hashing.P5} end)+n){_M32} h0,case when n>=16 then (n//16*16)::bigint else 0 end done from lanes),
  words as (select *,list_reduce(list_prepend(h0,list_transform(range(0,((n-done)//4)::bigint),lambda i: {_word('done+4*i')})),lambda h,w: ({_rot(f'(h+w*{hashing.P3}){_M32}', 17)})*{hashing.P4}{_M32}) h1 from whole),
  tail as (select *,list_reduce(list_prepend(h1,list_transform(bytes[(n//4*4)::bigint+1:],lambda x: x::hugeint)),lambda h,w: ({_rot(f'(h+w*{hashing.P5}){_M32}', 11)})*{hashing.P1}{_M32}) h2 from words),
  mix1 as (select doc_id,xor(h2,h2//32768)*{hashing.P2}{_M32} h from tail), mix2 as (select doc_id,xor(h,h//8192)*{hashing.P3}{_M32} h from mix1) select doc_id,xor(h,h//65536)::bigint h from mix2)"""


@query("hash_xx32", _XX32)
def xx32(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", hashing.xx32(F.encode("text", "UTF-8")).alias("h"))


@query("cmp_byte_histogram", f"select b byte, count(*) n from (select unnest(bytes) b from {_ITEMS} t) u group by 1")
def byte_histogram(spark: SparkSession, d: str) -> DataFrame:
    counts = _docs(spark, d).select(F.explode(codes.byte_counts(F.encode("text", "UTF-8"))).alias("c"))
    return counts.groupBy(F.col("c.byte").cast("long").alias("byte")).agg(F.sum("c.n").alias("n"))


@query("cmp_entropy", f"select doc_id, {r('-sum(n/t::double*log2(n/t::double)) bits')} from (select doc_id,b,count(*) n,sum(count(*)) over (partition by doc_id) t from (select doc_id,unnest(bytes) b from {_ITEMS} q) u group by 1,2) w group by 1")
def entropy(spark: SparkSession, d: str) -> DataFrame:
    bits = codes.entropy_bits(codes.byte_counts(F.encode("text", "UTF-8")))
    return rounded(_docs(spark, d).select("doc_id", bits.alias("bits")).where("bits is not null"), "bits")


@query("cmp_choose", f"select doc_id, case when len(bytes)=0 then 'NONE' when len(list_distinct(list_slice(bytes,1,4096)))<=16 then 'HUFFMAN' when len(bytes)>1024 then 'LZ4' else 'HUFFMAN' end codec from {_ITEMS} t")
def choose(spark: SparkSession, d: str) -> DataFrame:
    content = F.encode("text", "UTF-8")
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    few = F.size(codes.byte_counts(F.substring(content, 1, 4096))) <= 16
    codec = F.when(size == 0, "NONE").when(few, "HUFFMAN").when(size > 1024, "LZ4").otherwise("HUFFMAN")
    return _docs(spark, d).select("doc_id", codec.alias("codec"))


@query(
    "cmp_huffman",
    f"with recursive h as (select doc_id, list_sort(list(n)) l, 0::bigint cost from (select doc_id,b,count(*) n from (select doc_id,unnest(bytes) b from {_ITEMS} t) u group by 1,2) c group by 1 union all select doc_id, list_sort(list_append(l[3:],l[1]+l[2])), cost+l[1]+l[2] from h where len(l)>1) select doc_id, cost bits from h where len(l)=1 union all select doc_id, 0 from {_ITEMS} t where len(bytes)=0",
)
def huffman(spark: SparkSession, d: str) -> DataFrame:
    coded = codes.with_lengths(_docs(spark, d).select("doc_id", "text"), F.encode("text", "UTF-8"))
    return coded.select("doc_id", codes.huffman_bits(F.col("counts"), F.col("lengths")).alias("bits"))


_CODED = f"(select doc_id,b,count(*) n from (select doc_id,unnest(bytes) b from {_ITEMS} t) u group by 1,2)"


@query("cmp_huffman_codes", f"select doc_id, count(*) symbols, (count(*)>1)::bigint whole, sum(n)::bigint n from {_CODED} c group by 1")
def huffman_codes(spark: SparkSession, d: str) -> DataFrame:
    """The code table of each text: its symbols, the sum of 2^-length over them (one where there are two or more), and how often they occur."""
    texts = _docs(spark, d).select("doc_id", F.encode("text", "UTF-8").alias("content"))
    table = codes.code_table(texts, "doc_id")
    share = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(codes.MOST) - F.col("length"))
    whole = F.when(F.count("*") > 1, F.sum(share) / (1 << codes.MOST)).otherwise(0).cast("long")
    return table.groupBy("doc_id").agg(F.count("*").alias("symbols"), whole.alias("whole"), F.sum("n").alias("n"))


@query("cmp_huffman_stream", "select doc_id, strlen(text)::bigint n, md5(text) md5, true fits from documents")
def huffman_stream(spark: SparkSession, d: str) -> DataFrame:
    """Every text as a bit stream of its own code, and read back: its bytes, their digest, and whether the stream has the bits that the code promises, padded to a byte."""
    texts = _docs(spark, d).select("doc_id", F.encode("text", "UTF-8").alias("content"))
    back = codes.decoded(codes.encoded(texts.withColumn("table", codes.code_tables("content")), "doc_id"))
    fits = F.length("stream") == F.ceil(F.col("bits") / 8)
    return back.select("doc_id", "n", F.md5("content").alias("md5"), fits.alias("fits"))


@query("bit_tools", "select event_id, bit_count(event_id)::bigint ones, case when event_id=0 then -1 else bit_count((event_id & -event_id)-1)::bigint end::bigint first, case when event_id<=1 then 1 else 1<<length(bin(event_id-1)) end::bigint power from events")
def bit_tools(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    return views.table(spark, d, "events").select("event_id", F.bit_count(k).cast("long").alias("ones"), numbers.first_set(k).alias("first"), numbers.next_power(k).alias("power"))


@query("bit_reverse", "select event_id, list_reduce(list_prepend(0::bigint,list_transform(range(0,32), lambda i: ((event_id>>i)&1)::bigint)), lambda a,b: a*2+b) reversed from events")
def bit_reverse(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "events").select("event_id", numbers.reversed_bits(F.col("event_id")).alias("reversed"))


@query("safe_arith", "select event_id, case when event_id+9223372036854770000::hugeint<=9223372036854775807 then (event_id+9223372036854770000::hugeint)::bigint end total, case when event_id*977000000000000::hugeint between -9223372036854775808 and 9223372036854775807 then (event_id*977000000000000::hugeint)::bigint end product from events")
def safe_arith(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    return views.table(spark, d, "events").select("event_id", F.try_add(k, F.lit(9223372036854770000)).alias("total"), F.try_multiply(k, F.lit(977000000000000)).alias("product"))


@query("math_scalars", f"select event_id,{r('least(greatest(value,10.0),90.0) clamped', '10+(90-10.0)*value/200 lerped', 't*t*(3-2*t) smooth')},round(value-50)::bigint nearest from (select *,greatest(0.0,least(1.0,(value-20)/100)) t from events) e")
def math_scalars(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    out = views.table(spark, d, "events").select("event_id", numbers.clamp(v, 10.0, 90.0).alias("clamped"), numbers.lerp(F.lit(10.0), F.lit(90.0), v / 200).alias("lerped"), numbers.smoothstep(20.0, 120.0, v).alias("smooth"), F.round(v - 50).cast("long").alias("nearest"))
    return rounded(out, "clamped", "lerped", "smooth")


@query("vec_dot", f"select vec_id,{r('list_dot_product(embedding::double[],list_reverse(embedding::double[])) d', 'sqrt(list_dot_product(embedding::double[],embedding::double[])) n')} from embeddings")
def vec_dot(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return rounded(views.table(spark, d, "embeddings").select("vec_id", numbers.dot(e, F.reverse(e)).alias("d"), numbers.norm(e).alias("n")), "d", "n")


@query("mat_mul", f"select vec_id i,j,{r('sum(a*((k*7+j*3)%11-5)) v')} from (select vec_id,unnest(range(1,len(embedding)+1)) k,unnest(embedding)::double a from embeddings) p cross join range(0,8) q(j) group by 1,2")
def mat_mul(spark: SparkSession, d: str) -> DataFrame:
    """All vectors, as rows, times a matrix of eight columns; the cell (k, j), k from one, is (7k + 3j) mod 11 - 5."""
    a = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("k", "a"))
    cells = a.select("i", F.explode(F.array(*(F.struct(F.lit(j).cast("long").alias("j"), (((F.col("k") + 1) * 7 + j * 3) % 11 - 5).alias("b")) for j in range(8)))).alias("c"), "a")
    return rounded(cells.groupBy("i", "c.j").agg(F.sum(F.col("a").cast("double") * F.col("c.b")).alias("v")), "v")


_CELL = "+".join(f"embedding[i*4+{k + 1}]::double*embedding[j*4+{k + 1}]" for k in range(4))


@query("mat4", f"select vec_id,i*4+j cell,{r(f'{_CELL} v', 'embedding[j*4+i+1]::double turned', 'embedding[i*4+j+1]::double same')} from embeddings cross join (select unnest(range(0,4)) i) a cross join (select unnest(range(0,4)) j) b")
def mat4(spark: SparkSession, d: str) -> DataFrame:
    """Of the first sixteen components as a matrix: its product with its transpose, the transpose, and its product with the identity."""
    m = F.col("embedding")
    made = views.table(spark, d, "embeddings").select("vec_id", F.arrays_zip(numbers.product4(m, numbers.transposed4(m)).alias("v"), numbers.transposed4(m).alias("turned"), numbers.product4(m, numbers.identity4()).alias("same")).alias("z"))
    each = made.select("vec_id", F.posexplode("z").alias("cell", "e"))
    return rounded(each.select("vec_id", F.col("cell").cast("long").alias("cell"), "e.v", "e.turned", "e.same"), "v", "turned", "same")


@query("fmt_bytes", "select file_id, case when n<1024 then n||' B' when n<1048576 then printf('%.1f',round(n/1024.0::double,1))||' KB' when n<1073741824 then printf('%.1f',round(n/1048576.0::double,1))||' MB' else printf('%.1f',round(n/1073741824.0::double,1))||' GB' end s from (select file_id, length*(file_id%700) n from v_files) t")
def fmt_bytes(spark: SparkSession, d: str) -> DataFrame:
    return views.files(spark, d).select("file_id", text.human_bytes(F.col("length") * (F.col("file_id") % 700)).alias("s"))
