"""Near-duplicates by word-shingle similarity, for the corpus pipeline.

Three bits of a SimHash find copies that are nearly the same, but of texts that
share 80 % of their five-word shingles only a few. So the Golay keys of the
fingerprints get company: bands of a minimum sketch of the same shingles, whose
places are independent however short the text is. All keys only propose. A
pair links if its sets of shingles, compared one by one, are similar enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, partitions, those_of, unused, values_of
from tessera.llm.components import connected_components
from tessera.llm.simhash import bits_of, keys_of, shingle_hashes

WIDTH, SIMILARITY = 5, 0.8
#: Places of a sketch; places of a band and bands. At 80 % a band agrees with one chance in six, some band with 99.7 %.
PLACES, BAND, BANDS = 256, 8, 32
#: A pair is compared if its sketches agree in the wanted share of places less this: 2.4 standard deviations at 80 %.
ALLOWANCE = 0.06
#: Partners that a member is held against first, and how many times as many in each turn after.
PARTNERS = 16
#: Members of a key that one task compares with each other; larger groups are cut into parts.
GROUP = 8192
#: Bands whose centres every text is held against; components of more members are asked as a whole.
STARS, BIG = 8, 64
#: Shingles that are hashed to places at once.
AT_ONCE = 512

_TURNS = np.random.default_rng(5).integers(0, 1 << 32, PLACES, np.uint64).astype(np.uint32) | np.uint32(1)


def set_of(hashes: list[np.ndarray]) -> np.ndarray:
    """The distinct shingles of a text, as ascending numbers of 32 bits."""
    parts = [(h >> np.uint64(32)).astype(np.uint32) for h in hashes] or [np.zeros(0, np.uint32)]
    return np.unique(parts[0] if len(parts) == 1 else np.concatenate(parts))


def sketch_of(shingles: np.ndarray) -> np.ndarray:
    """For each place, the least of the shingles as its odd factor turns them. All ones for no shingle."""
    least = np.full(PLACES, np.iinfo(np.uint32).max, np.uint32)
    mixed = (shingles ^ (shingles >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    mixed ^= mixed >> np.uint32(12)
    for i in range(0, len(mixed), AT_ONCE):
        np.minimum(least, (mixed[i : i + AT_ONCE, None] * _TURNS).min(axis=0), out=least)
    return least


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def bands_of(least: np.ndarray) -> np.ndarray:
    """Keys of the bands of one sketch, or of the rows of several."""
    band = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(BAND):
        band = _mixed(band * np.uint64(31) + least[..., i * BANDS : (i + 1) * BANDS])
    return ((band & np.uint64((1 << 62) - 1)) | np.uint64(1 << 62)).astype(np.int64)


def octets_of(least: np.ndarray) -> np.ndarray:
    """One byte for each place of a sketch, by which sketches are compared."""
    return (_mixed(least.astype(np.uint64)) & np.uint64(0xFF)).astype(np.uint8)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["row", "sig", "fp", "bands", "sketch", "shingles"]
    for b in _slices(batches):
        sigs, fps, least, sets = [], [], np.empty((b.num_rows, PLACES), np.uint32), []
        for k, text in enumerate(values_of(b.column(1))):
            hashes = list(shingle_hashes(text, WIDTH))
            own = set_of(hashes)
            least[k] = sketch_of(own)
            spread = _mixed(own.astype(np.uint64) + np.uint64(1 << 33))
            sigs.append(np.array([spread.sum(dtype=np.uint64), np.bitwise_xor.reduce(spread), len(own)], np.uint64).tobytes())
            fps.append(bits_of(hashes))
            sets.append(own.tobytes())
        bands, sketches = [x.tobytes() for x in bands_of(least)], [x.tobytes() for x in octets_of(least)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sigs, pa.binary()), pa.array(fps, pa.int64()), *(pa.array(x, pa.binary()) for x in (bands, sketches, sets))], names)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows at most: what a task makes of a batch is far larger than the batch."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rep, fp, bands, ...) -> key, rep, ... for each distinct key of a text."""
    for b in _slices(batches):
        rep, fp = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        line = np.arange(len(rep))
        order = np.argsort(fp, kind="stable")
        key, owner = keys_of(np.unique(fp))
        first, last = np.searchsorted(fp[order], owner, "left"), np.searchsorted(fp[order], owner, "right")
        n = last - first
        at = np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)
        bands = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int64)
        key, line = np.concatenate([np.repeat(key, n), bands]), np.concatenate([line[order][at], np.repeat(line, BANDS)])
        by = np.lexsort((key, line))
        key, line = key[by], line[by]
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
        rows = pa.array(line[fresh])
        yield pa.RecordBatch.from_arrays([pa.array(key[fresh]), *(c.take(rows) for i, c in enumerate(b.columns) if i not in (1, 2))], ["key", "rep", *b.schema.names[3:]])


def _first_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rep, bands) -> key, rep for the first STARS bands."""
    for b in batches:
        bands = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64).reshape(-1, BANDS)[:, :STARS]
        yield pa.RecordBatch.from_arrays([pa.array(bands.reshape(-1)), b.column(0).take(pa.array(np.repeat(np.arange(len(bands)), STARS)))], ["key", "rep"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """Whole groups of the first column, which is sorted: all columns of complete groups, batch by batch."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        kept.append(b)
        key = b.column(0).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield pa.Table.from_batches([*kept[:-1], b.slice(0, cut)]).combine_chunks().columns
            kept = [b.slice(cut)]
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks().columns


def _agreeing(least: float):
    """Rows (a, b, x, y) with the sketches of two texts -> the pairs (a, b) whose sketches agree often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, PLACES) for i in (2, 3))
            yield b.select([0, 1]).filter(pa.array((x == y).sum(axis=1) >= least * PLACES))

    return run


def _nearest(least: float, low: int, high: int):
    """Rows (group, gid, after, rep, label, ask, member, sketch), sorted by group -> for each rep that asks, the members of another label among its nearest `low` to `high`.

    Where `after` is set only members with a larger number count, so that a pair
    comes up once. Members are ranked by agreement, then number, whatever their
    label, so that ranks stay as labels grow together. A row without b, but
    with the gid, says that members of another label come later.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, gid, after, rep, label, ask, member, sketch in _groups(batches):
            group, gid, rep, label = (c.to_numpy() for c in (group, gid, rep, label))
            after, ask, member = (c.to_numpy(zero_copy_only=False) for c in (after, ask, member))
            places = np.frombuffer(b"".join(sketch.to_pylist()), np.uint8).reshape(-1, PLACES)
            a, b, more = [], [], []
            edge = [*np.flatnonzero(np.r_[True, group[1:] != group[:-1]]).tolist(), len(group)]
            for s, e in zip(edge, edge[1:], strict=False):
                there = s + np.flatnonzero(member[s:e])
                table, numbers = places[there], rep[there]
                for i in (s + np.flatnonzero(ask[s:e])).tolist():
                    near = np.flatnonzero(numbers > rep[i] if after[i] else numbers != rep[i])
                    agree = (table[near] == places[i]).sum(axis=1)
                    fit = agree >= least * PLACES
                    near, agree = near[fit], agree[fit]
                    near = there[near[np.lexsort((numbers[near], -agree))]]
                    other = label[near] != label[i]
                    own = near[low:high][other[low:high]]
                    a += [int(rep[i])] * len(own)
                    b += rep[own].tolist()
                    more += [None] * len(own)
                    if other[high:].any():
                        a.append(int(rep[i]))
                        b.append(None)
                        more.append(int(gid[i]))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, more)], ["a", "b", "gid"])

    return run


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two ascending arrays of distinct numbers; of two empty ones, one."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pairs = zip(values_of(b.column(2)), values_of(b.column(3)), strict=True)
        got = [similarity_of(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) for x, y in pairs]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.float64())], ["a", "b", "j"])


def _to_ask(reps: DataFrame, label: DataFrame, scratch: Scratch) -> DataFrame:
    """Who is held against whom: gid, after, rep, ask, member, size.

    Only keys whose members have more than one label count. Members of small
    components meet within their key. A component of more than BIG members is
    one group of its own, whatever keys its members share: those who share a
    key with it ask the whole of it, once.
    """
    sizes = label.groupBy("label").agg(F.count("*").alias("size")).where(F.col("size") > BIG)
    known = label.join(F.broadcast(sizes) if sizes.count() <= 1_000_000 else sizes, "label", "left").select(F.col("node").alias("rep"), "label", F.col("size").isNotNull().alias("big"))
    base = reps.select("rep", "fp", "bands").join(known, "rep", "left").select("rep", "fp", "bands", F.coalesce("label", "rep").alias("label"), F.coalesce("big", F.lit(False)).alias("big"))
    base = scratch.write(base, "dedup-base")
    # Keys are dealt once, and of a large component once for each of its keys; what else is asked of keys is asked of those with more than one label.
    kinds = "key bigint, rep bigint, label bigint, big boolean"
    keyed_big = base.where("big").mapInArrow(_keys, kinds)
    keyed = base.where("not big").mapInArrow(_keys, kinds).unionByName(keyed_big.groupBy("key", "label").agg(F.lit(None).cast("long").alias("rep"), F.lit(True).alias("big")))
    of_key = Window.partitionBy("key")
    keyed = keyed.withColumn("x", F.min("label").over(of_key)).withColumn("y", F.max("label").over(of_key)).where("x <> y").drop("x", "y")
    keyed = scratch.write(keyed, "dedup-keyed")
    open_ = scratch.write(keyed.groupBy("key").agg(F.count_if(~F.col("big")).alias("small"), F.collect_set(F.when(F.col("big"), F.col("label"))).alias("bigs")), "dedup-open")
    small = keyed.where("not big")
    within = small.join(open_.where("small > 1").select("key", F.col("small").alias("size")), "key").select(F.col("key").alias("gid"), F.lit(True).alias("after"), "rep", F.lit(True).alias("ask"), F.lit(True).alias("member"), "size")
    # Of two large components the one with the smaller label asks.
    some = small.join(open_.where("size(bigs) > 0").select("key", "bigs"), "key")
    some = some.unionByName(keyed_big.join(open_.where("size(bigs) > 1").select("key", "bigs"), "key"))
    asked = some.select("rep", "label", "big", F.explode("bigs").alias("gid")).where("gid <> label and (not big or label < gid)").select("gid", "rep").distinct()
    asked = scratch.write(asked, "dedup-asked")
    of = asked.select("gid").distinct().join(sizes, F.col("gid") == F.col("label")).select("gid", "size")
    # Numbers of components and keys must not meet.
    number = (-1 - F.col("gid")).alias("gid")
    ask = asked.join(of, "gid").select(number, F.lit(False).alias("after"), "rep", F.lit(True).alias("ask"), F.lit(False).alias("member"), "size")
    members = label.join(of, F.col("gid") == F.col("label")).select(number, F.lit(False).alias("after"), F.col("node").alias("rep"), F.lit(False).alias("ask"), F.lit(True).alias("member"), "size")
    return scratch.write(within.unionByName(ask).unionByName(members), "dedup-groups")


def similar_components(reps: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """reps (rep, fp, bands, sketch, shingles), of different texts -> (node, label) for those that a link reaches.

    First every text is held against the centres of its first STARS bands: of a
    band's texts the one whose bands have most texts. In a family of copies that
    is the text of which the others are copies, and the same for all bands, so
    a family becomes one component at one comparison for each of its members.
    Then all keys are looked at. Those whose texts all have one label are done,
    however many these are. In the others what has different labels is held
    against each other, nearest first, a few at a time, until nothing is left
    (`_to_ask`, `_nearest`): of two texts that share a key, and whose sketches
    agree, either the pair is compared exactly, or they have the same label
    already. Groups of more than GROUP members are cut into parts, and what
    asks goes to all of them.
    """
    n, least = partitions(reps.sparkSession), similarity - ALLOWANCE
    held = reps.select("rep", "sketch")
    compared, label, step = None, None, 0

    def compare(pairs: DataFrame) -> DataFrame:
        """Exact similarity of pairs that have not been compared before."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if compared is not None:
            pairs = pairs.join(compared.select("a", "b"), ["a", "b"], "left_anti")
        pairs = scratch.write(pairs, f"dedup-pairs-{step}")
        # Sets of shingles are read for the members of pairs alone.
        met = scratch.write(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), f"dedup-met-{step}")
        sets = scratch.write(those_of(reps.select("rep", "shingles"), met, "rep"), f"dedup-sets-{step}")
        one, two = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))
        got = scratch.write(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(_compare, "a bigint, b bigint, j double"), f"dedup-compared-{step}")
        scratch.drop(f"dedup-sets-{step}", f"dedup-met-{step}", f"dedup-pairs-{step}")
        return got

    def labels() -> DataFrame:
        return connected_components(compared.where(F.col("j") >= similarity).select("a", "b"), scratch, f"dedup-cc-{step}")

    banded = scratch.write(reps.select("rep", "bands").mapInArrow(_first_bands, "key bigint, rep bigint"), "dedup-banded")
    counted = banded.join(banded.groupBy("key").agg(F.count("*").alias("n")), "key")
    weight = counted.groupBy("rep").agg(F.sum("n").alias("weight"))
    centres = banded.join(weight, "rep").groupBy("key").agg(F.max(F.struct("weight", "rep"))["rep"].alias("b"))
    stars = scratch.write(banded.join(centres, "key").where("rep <> b").select(F.col("rep").alias("a"), "b").distinct(), "dedup-stars")
    sketched = stars.join(held.select(F.col("rep").alias("a"), F.col("sketch").alias("x")), "a").join(held.select(F.col("rep").alias("b"), F.col("sketch").alias("y")), "b")
    compared = compare(sketched.select("a", "b", "x", "y").mapInArrow(_agreeing(least), "a bigint, b bigint"))
    label = labels()
    groups = _to_ask(reps, label, scratch)
    scratch.drop("dedup-banded", "dedup-stars", "dedup-base", "dedup-keyed", "dedup-open", "dedup-asked")
    low, high, asking = 0, PARTNERS, None
    while True:
        step += 1
        now = groups
        if asking is not None:
            now = groups.join(asking.select("gid").distinct(), "gid", "left_semi").drop("ask").join(asking.withColumn("ask", F.lit(True)), ["gid", "rep"], "left").withColumn("ask", F.coalesce("ask", F.lit(False)))
        parts = F.ceil(F.col("size") / GROUP).cast("int")
        own = F.pmod(F.xxhash64("rep"), parts).cast("int")
        dealt = now.where("ask or member").withColumn("own", own).withColumn("part", F.explode(F.when(F.col("ask"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array("own"))))
        rows = dealt.select(F.xxhash64("gid", "part").alias("group"), "gid", "after", "rep", "ask", (F.col("member") & (F.col("own") == F.col("part"))).alias("member"))
        rows = rows.join(held, "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left").select("group", "gid", "after", "rep", F.coalesce("label", "rep").alias("label"), "ask", "member", "sketch")
        near = rows.repartition(n, "group").sortWithinPartitions("group", "gid", "rep").mapInArrow(_nearest(least, low, high), "a bigint, b bigint, gid bigint")
        near = scratch.write(near, f"dedup-near-{step}")
        got = compare(near.where("b is not null").select("a", "b"))
        linked = not got.where(F.col("j") >= similarity).isEmpty()
        compared = compared.unionByName(got)
        if linked:
            label = labels()
        asking = scratch.write(near.where("b is null").select("gid", F.col("a").alias("rep")).distinct(), f"dedup-asking-{step}")
        scratch.drop(f"dedup-near-{step}")
        if asking.isEmpty():
            return label
        low, high = high, high * PARTNERS


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, scratch: Scratch | None = None) -> DataFrame:
    """docs without near-duplicates: of each component of linked texts the row with the smallest doc_id stays (nulls last).

    Texts with the same shingles are copies, with or without words, and have
    one representative before any pair is looked at. A null text is empty; of
    repeated rows one stays; an empty table stays empty.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    row = unused(docs) + "row"
    numbered = scratch.write(docs.withColumn(row, F.monotonically_increasing_id()), "dedup-numbered")
    made = numbered.select(F.col(row).alias("row"), "text").mapInArrow(_sketches, "row bigint, sig binary, fp bigint, bands binary, sketch binary, shingles binary")
    made = scratch.write(made, "dedup-sketches")
    copies = scratch.write(made.groupBy("sig").agg(F.min("row").alias("rep")), "dedup-copies")
    # Copies are fewer than texts: what is no representative goes.
    more = scratch.write(made.select("row", "sig").join(copies, "sig").where("row <> rep").select(F.col("row").alias("rep")), "dedup-more")
    reps = made.select(F.col("row").alias("rep"), "fp", "bands", "sketch", "shingles")
    reps = those_of(reps, more, "rep", "left_anti")
    label = similar_components(reps, similarity, scratch)
    known = copies.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("sig", F.coalesce("label", "rep").alias("label"))
    ids = numbered.select(F.col(row).alias("row"), "doc_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    kept = made.select("row", "sig").join(known, "sig").join(ids, "row").groupBy("label").agg(F.min(order).alias("first")).select(F.col("first.row").alias(row))
    kept = scratch.write(kept, "dedup-kept")
    # Of most corpora less goes than stays; texts stay where they are.
    gone = scratch.write(made.select(F.col("row").alias(row)).join(kept, row, "left_anti"), "dedup-gone")
    scratch.drop_but("dedup-", "dedup-numbered", "dedup-kept", "dedup-gone")
    if gone.count() < kept.count():
        return those_of(numbered, gone, row, "left_anti").drop(row)
    return those_of(numbered, kept, row).drop(row)
