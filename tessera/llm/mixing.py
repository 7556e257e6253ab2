"""Operator 2: mixing sources to target weights by a low-discrepancy schedule.

Slots of equally many tokens are dealt to sources by the points of a
golden-ratio sequence, mapped through the cumulative target shares: every run
of slots holds each source nearly in proportion. A source's slots are ranked,
and slot r takes block r of the source's shuffled documents, laid end to end
for two epochs. What a block takes of a document is the part of the document
that lies in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, running_total, table, unused

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, EPOCHS = 1.5, 2
#: Tokens of a block. A source's share is met within a few blocks, whatever its size.
BLOCK = 64
#: Parts in which a source's documents are ordered, and slots that are ranked together.
PARTS, RANKED = 1024, 1 << 12
WORD = r"[^\x20\x09-\x0D]+"
_SCALE = 1 << 32
_GOLDEN = 2_654_435_769  # 2^32 divided by the golden ratio


def source_targets(sized: DataFrame, share: float = SHARE, epochs: int = EPOCHS, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """sized (source, size) -> sid, source, source_size, target: one row per source, null counting as one.

    Sources share `share` times all sizes by weight, each up to `epochs` times
    its size; what exceeds goes to the others by weight. That is target =
    min(cap, level x weight) with one level for all, found by sorting sources
    by cap / weight. One row per source passes through one task.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    totals = totals.withColumn("sid", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod("sid", F.lit(len(weights))) + 1).cast("int"))
    totals = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * epochs)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    everywhere = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everywhere).cast("double") * share - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(
        by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    )
    # The first source, in this order, whose cap the level does not reach sets the level for all; from there on levels only fall.
    leveled = totals.withColumn("level", level)
    own = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everywhere)
    return leveled.withColumn("target", F.least("cap", F.coalesce(own * F.col("weight"), F.col("cap")))).select("sid", "source", "source_size", "target")


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 42, scratch: Scratch | None = None, row: str | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, and the column `row` if one is named: one row per row of docs.

    size counts words; a null text has none, and a document of none takes none.
    The order of a source's documents is a hash of their ids and the seed, so
    reruns agree. taken is at most EPOCHS times size. A slot takes `block`
    tokens, so a source takes its target within a few blocks. Repeated rows
    count each; equal ids go by size, then by row. An empty table gives none.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0)).alias("size"), F.col(row).alias("row") if row else F.lit(None).cast("long").alias("row"))
    sized = scratch.write(sized, "mix-sized")
    targets = scratch.write(source_targets(sized), "mix-targets")
    wanted = targets.agg(F.sum("target")).first()[0] or 0.0
    slots = _slots(spark, targets, -int(-wanted // block), wanted)

    rows = sized.join(targets, sized.source.eqNullSafe(targets.source)).drop(targets.source)
    rows = rows.withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("part", F.pmod("h", F.lit(PARTS)))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("sid", "part").orderBy("h", "doc_id", "size", "row")))
    placed = running_total(rows, ["sid"], "part", ["n"], "size", "pos")
    start = F.col("pos") + F.col("epoch") * F.col("source_size")
    epochs = placed.withColumn("epoch", F.explode(F.array(*(F.lit(e) for e in range(EPOCHS)))))
    first, last = F.floor(start / block), F.floor((start + F.col("size") - 1) / block)
    pieces = epochs.withColumn("start", start).withColumn("rank", F.explode(F.when(F.col("size") > 0, F.sequence(first, last)).otherwise(F.array(F.lit(-1).cast("long")))))
    held = F.when(F.col("slot").isNotNull(), F.least(F.col("start") + F.col("size"), (F.col("rank") + 1) * block) - F.greatest(F.col("start"), F.col("rank") * block)).otherwise(0)
    got = pieces.join(slots, ["sid", "rank"], "left")
    by_row = got.groupBy("sid", "part", "n", "doc_id", "source", "size", "source_size", "target", "row").agg(F.sum(held).cast("long").alias("taken"))
    return by_row.select("doc_id", "source", "size", "source_size", "target", "taken", *([F.col("row").alias(row)] if row else []))


def mixed(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """docs as the mix has them: each row as often as the mix takes its words, rounded; rows of which it takes less than half, or no word, go.

    Documents are kept whole; a part is taken only where a source's last block
    ends, once for each source and epoch.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    row = unused(docs) + "row"
    numbered = scratch.write(docs.withColumn(row, F.monotonically_increasing_id()), "mix-numbered")
    taken = mix(numbered, scratch=scratch, row=row)
    copies = F.round(F.col("taken") / F.col("size")).cast("int")
    often = taken.where("size > 0").select(row, copies.alias(f"{row}_copies")).where(F.col(f"{row}_copies") > 0)
    return numbered.join(often, row).withColumn(row, F.explode(F.array_repeat(F.lit(0), F.col(f"{row}_copies")))).select(*docs.columns)


def _slots(spark: SparkSession, targets: DataFrame, count: int, wanted: float) -> DataFrame:
    """slot, sid, rank: the schedule. Cells of the unit interval lead a point to the sources that they touch."""
    ends = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    share = targets.where("target > 0").withColumn("hi", F.round(F.sum("target").over(ends) / F.lit(wanted or 1.0) * _SCALE).cast("long"))
    share = share.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("sid")), F.lit(0))).where("lo < hi")
    cells = share.select("sid", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", 16), F.shiftright(F.col("hi") - 1, 16))).alias("cell"))
    i = F.col("slot")
    # slot x GOLDEN modulo 2^32, in two steps that stay within 63 bits.
    high, low = F.shiftright(i, 16), i.bitwiseAND(0xFFFF)
    point = F.pmod(F.pmod(high * F.lit((_GOLDEN << 16) % _SCALE), F.lit(_SCALE)) + low * F.lit(_GOLDEN), F.lit(_SCALE))
    dealt = spark.range(count).withColumnRenamed("id", "slot").withColumn("u", point).withColumn("cell", F.shiftright("u", 16))
    dealt = dealt.join(cells, "cell").where("u >= lo and u < hi").select("slot", "sid", F.floor(i / RANKED).alias("run"), F.lit(1).cast("long").alias("one"))
    return running_total(dealt, ["sid"], "run", ["slot"], "one", "rank").select("slot", "sid", "rank")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all `documents` by `mix`: what it takes of each."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")
