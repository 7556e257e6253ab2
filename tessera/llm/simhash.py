"""Operator 3: near-duplicates by SimHash, found through Golay-code fuzzy hashing.

A fingerprint has 64 bits. Two fingerprints link at a Hamming distance of
three or less. Cut in four segments of 16 bits, three errors leave either two
segments without an error (then the pair of segments is a common key), or one
segment without and one error in each other segment. In the second case the
next segment, as a word of the (23, 12) Golay code, is decoded to nearby
codewords: words that differ in one bit always share one of their keys (see
`nearby`). So every linking pair shares a key, and a pair that shares one is
verified by counting bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, partitions, schema_with, table, values_of, word_pieces
from tessera.llm.components import connected_components

RADIUS = 3
SEED = 42
#: Generator of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (fixed value).
GENERATOR = 0b110001110101
#: Groups of more members are searched breadth first, smaller ones pair by pair; groups of more than LARGE_GROUP are split by their bytes first.
SMALL_GROUP, LARGE_GROUP = 8, 4096


# ---- fingerprints ----


def shingle_hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """XXH64 of all shingles of a text, repeats included, for pieces of it. Only A-Z are lower-cased; words stand between ASCII white space."""
    data, whole = (text or "").encode("utf-8", "surrogatepass").lower(), True
    for words in word_pieces(data, width - 1):
        if len(words) >= width:
            shingles = list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))
        else:
            shingles = [b" ".join(words)] if words and whole else []
        whole = False
        if shingles:
            yield np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))


def bits_of(hashes: Iterable[np.ndarray]) -> int:
    """The fingerprint, as a signed long: a bit is set if it is in more than half of the hashes; zero for none."""
    ones, n = np.zeros(64, np.int64), 0
    for h in hashes:
        n += len(h)
        for i in range(0, len(h), 4096):
            octets = h[i : i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return _signed(int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little"))


def fingerprint(text: str | None, width: int = 3) -> int:
    return bits_of(shingle_hashes(text, width))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def with_fingerprint(docs: DataFrame, width: int = 3, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns and `fp`, the fingerprint as a signed long."""
    source = docs.select(*keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([fingerprint(t, width) for t in values_of(b.column(len(keep)))], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], fp], [*keep, "fp"])

    return source.mapInArrow(run, schema_with(docs.select(*keep), fp="long"))


# ---- Golay keys ----


@lru_cache(1)
def nearby() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of the 2048 syndromes, the error patterns to decode with: starts, counts, patterns.

    Of weight three at most there is one, e. If it has weight three, there are
    five more of weight four. The codewords v ^ e are the keys of v. Let v and w
    differ in one bit, and c be nearest to v. If c is within two of v, it is
    within three of w, hence nearest to w. If not, and w's nearest is another,
    that one lies at distance four from v, so is a key of v.
    """
    by: list[list[int]] = [[] for _ in range(2048)]
    weight = [9] * 2048
    for w in range(5):
        for bits in combinations(range(23), w):
            e = sum(1 << b for b in bits)
            s = int(syndrome(np.array([e], np.int64))[0])
            if w <= 3:
                by[s].append(e)
                weight[s] = w
            elif weight[s] == 3:
                by[s].append(e)
    counts = np.array([len(x) for x in by], np.int64)
    return np.cumsum(counts) - counts, counts, np.array([e for x in by for e in x], np.int64)


def syndrome(v: np.ndarray) -> np.ndarray:
    """Remainder of the 23-bit words modulo the generator."""
    r = v.copy()
    for bit in range(22, 10, -1):
        r = np.where((r >> bit) & 1, r ^ (GENERATOR << (bit - 11)), r)
    return r


def codeword_keys(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and 12-bit codeword indices; one or six for each 23-bit word."""
    starts, counts, patterns = nearby()
    s = syndrome(v)
    n = counts[s]
    row = np.repeat(np.arange(len(v)), n)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, (v[row] ^ patterns[starts[s][row] + offset]) >> 11


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """fp: signed longs. Keys and the fingerprints that have them: six exact ones, and four times one or six with a codeword."""
    u = fp.view(np.uint64)
    seg = [((u >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64) for k in range(4)]
    keys, owners = [], []
    for tag, (i, j) in enumerate(combinations(range(4), 2)):
        keys.append((tag << 48) | (seg[i] << 16) | seg[j])
        owners.append(fp)
    for i in range(4):
        row, index = codeword_keys(seg[(i + 1) % 4])
        keys.append(((6 + i) << 48) | (seg[i][row] << 16) | index)
        owners.append(fp[row])
    return np.concatenate(keys), np.concatenate(owners)


# ---- verified links ----


def links(fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the components of the distinct fingerprints fp: one less than each component has members."""
    a, b, left = [], [], fp
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = np.bitwise_count((left ^ x).view(np.uint64)) <= radius
            if near.any():
                found, left = left[near], left[~near]
                a.append(np.full(len(found), x))
                b.append(found)
                frontier.extend(found)
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def split_links(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """As links, for many fingerprints: of any radius + 1 bytes a linking pair has one in common, so members are compared within equal bytes, of those that vary most."""
    octets = np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8)
    kinds = [len(np.unique(octets[:, k])) for k in range(8)]
    a, b = [fp[:0]], [fp[:0]]
    for k in np.argsort(kinds)[::-1][: radius + 1]:
        order = np.argsort(octets[:, k], kind="stable")
        edge = np.flatnonzero(np.diff(octets[order, k].astype(np.int64), prepend=-1, append=256))
        for s, e in zip(edge, edge[1:], strict=False):
            x, y = links(fp[order[s:e]], radius)
            a.append(x)
            b.append(y)
    return np.concatenate(a), np.concatenate(b)


def _grouped_links(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """key and fp sorted by both."""
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])
    key, fp = key[fresh], fp[fresh]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, len(key)])
    a, b = [], []
    small = np.repeat(size <= SMALL_GROUP, size)
    k, f = key[small], fp[small]
    for d in range(1, SMALL_GROUP):
        if len(k) <= d:
            break
        hit = (k[d:] == k[:-d]) & (np.bitwise_count((f[d:] ^ f[:-d]).view(np.uint64)) <= radius)
        a.append(f[:-d][hit])
        b.append(f[d:][hit])
    for s, n in zip(start[size > SMALL_GROUP].tolist(), size[size > SMALL_GROUP].tolist(), strict=True):
        x, y = (split_links if n > LARGE_GROUP else links)(fp[s : s + n], radius)
        a.append(x)
        b.append(y)
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def fingerprint_edges(distinct: DataFrame, radius: int = RADIUS, width: int | None = None) -> DataFrame:
    """distinct (fp) -> edges (a, b) that connect what the radius links. Within a key's group only spanning edges leave the task."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, fp = keys_of(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp)], ["key", "fp"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = fp = np.zeros(0, np.int64)
        for b in batches:
            key = np.concatenate([key, b.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, b.column(1).to_numpy(zero_copy_only=False)])
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last group may go on
            if cut:
                x, y = _grouped_links(key[:cut], fp[:cut], radius)
                key, fp = key[cut:], fp[cut:]
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])
        x, y = _grouped_links(key, fp, radius)
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    keyed = distinct.select("fp").mapInArrow(spread, "key bigint, fp bigint")
    n = width or partitions(distinct.sparkSession)
    return keyed.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(gather, "a bigint, b bigint").distinct()


def _labelled(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """prints (fp) -> fp, label: the components of the distinct fingerprints."""
    distinct = scratch.write(prints.select("fp").distinct(), "distinct")
    label = connected_components(fingerprint_edges(distinct), scratch)
    return scratch.write(distinct.join(label.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("label", "fp").alias("label")), "labelled")


def simhash_components(docs: DataFrame, width: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fp (signed long), component_id: the smallest doc_id that links of three bits or fewer reach.

    A null text counts as empty; fingerprint zero links like any other. Rows
    with the same doc_id are kept, each with its own fingerprint. Null ids give
    way to others as component_id. Copies share a fingerprint and cost one
    representative; they are never paired. Other columns are not looked at; an
    empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    prints = scratch.write(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), width), "prints")
    labelled = _labelled(prints, scratch)
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    known = scratch.write(labelled.join(first, "fp"), "known")
    smallest = known.groupBy("label").agg(F.min("first_id").alias("component_id"))
    component = scratch.write(known.join(smallest, "label").select("fp", "component_id"), "component")
    return prints.join(component, "fp").select("doc_id", "fp", "component_id")


def op3_simhash_golay(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every whole text of `documents`, by `simhash_components`."""
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
