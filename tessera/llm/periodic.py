"""Operator 11: periodic runs of words, found on harmonic grids.

A run of period p and of 2 p words or more holds two neighbouring points of the
grid 0, p, 2 p, ... So only the pairs (j p, (j + 1) p) of equal words can lie
in one: n / p tests for each p, n log n for all of them. Pairs that pass are
extended to both sides by comparing chunks of the array with itself p words
on, and the chunks double. A run of period q is one of 2 q, 3 q, ... as well:
grid points of such multiples inside a found run are skipped, and no other
multiple has a stretch with the same ends (two periods of a stretch that is
long enough have their greatest common divisor as a period too).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import schema_with, table, unused, values_of

#: Words of a run at least, if its period is short; periods that it must hold at least.
SHORTEST, PERIODS = 12, 2
#: Grid points that are tested together; words that are compared to either side before a pair is extended.
TOGETHER, NEAR = 1 << 20, 8
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

Arrange = Callable[[int | None, int], np.ndarray | None]


def _extent(w: np.ndarray, i: int, p: int) -> tuple[int, int]:
    """The stretch [start, end) of period p around the equal words i and i + p."""
    n, low, high = len(w), i, i + p + 1
    chunk = 32
    while high < n:
        end = min(n, high + chunk)
        differ = np.flatnonzero(w[high:end] != w[high - p : end - p])
        if len(differ):
            high += int(differ[0])
            break
        high, chunk = end, 2 * chunk
    chunk = 32
    while low > 0:
        start = max(0, low - chunk)
        differ = np.flatnonzero(w[start:low] != w[start + p : low + p])
        if len(differ):
            low = start + int(differ[-1]) + 1
            break
        low, chunk = start, 2 * chunk
    return low, high


def _grid(n: int, first: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Points i = j p with i + p < n and their p, for p = first and on, about TOGETHER of them; the first p that is left out."""
    most, p, total = n // PERIODS, first, 0
    if n * (1 + np.log(most / first)) <= TOGETHER:
        p = most + 1
    else:
        while p <= most and (total := total + (n - 1) // p) <= TOGETHER:
            p += 1
        p = max(p, first + 1)
    periods = np.arange(first, p, dtype=np.int64)
    count = (n - 1) // periods
    of = np.repeat(periods, count)
    j = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    return j * of, of, p


def _worth(w: np.ndarray, i: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Of pairs of equal words those whose stretch may be long enough, by NEAR words to either side."""
    n, left, right = len(w), np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for count, sign in ((right, 1), (left, -1)):
        on = np.arange(len(i))
        for step in range(1, NEAR + 1):
            at = i[on] + sign * step
            inside = (at >= 0) & (at + p[on] < n)
            on, at = on[inside], at[inside]
            on = on[w[at] == w[at + p[on]]]
            if not len(on):
                break
            count[on] = step
    return (left + right + 1 >= np.maximum(SHORTEST - p, p)) | (left == NEAR) | (right == NEAR)


def find_runs(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of an array of word numbers, by start, then period."""
    n, found, first = len(w), {}, 1
    if n < SHORTEST:
        return []
    while first <= n // PERIODS:
        i, p, after = _grid(n, first)
        equal = w[i] == w[i + p]
        i, p = i[equal], p[equal]
        worth = _worth(w, i, p)
        i, p = i[worth], p[worth]
        open_, place = np.ones(len(i), bool), p * (n + 1) + i

        def skip(start: int, end: int, q: int, low: int = first, high: int = after, open_: np.ndarray = open_, place: np.ndarray = place) -> None:
            """Grid points of the multiples of q, both of whose words lie in the run."""
            multiples = np.arange(-(-low // q) * q, min(end - start, high), q, dtype=np.int64)
            for a, b in zip(np.searchsorted(place, multiples * (n + 1) + start).tolist(), np.searchsorted(place, multiples * (n + 1) + end - multiples).tolist(), strict=True):
                open_[a:b] = False

        for (start, end), q in found.items():
            if end - start > first:
                skip(start, end, q)
        for k in range(len(i)):
            if not open_[k]:
                continue
            q = int(p[k])
            start, end = _extent(w, int(i[k]), q)
            a, b = np.searchsorted(place, (q * (n + 1) + start, q * (n + 1) + end - q)).tolist()
            open_[a:b] = False
            if end - start >= max(SHORTEST, PERIODS * q) and (start, end) not in found:
                found[start, end] = q
                skip(start, end, q)
        first = after
    return sorted((start, end - start, q) for (start, end), q in found.items())


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether each word stays: those of a run after its first period go."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def periodic_runs(docs: DataFrame, prefix: str = "", arrange: Arrange | None = None) -> DataFrame:
    """docs (doc_id, text, ...) with `runs`, every periodic run of the text's words, and `collapsed`, its words without the repetitions.

    A run is (start, length, period), by start, then period; words are what
    stands between ASCII white space. `collapsed` has the kept words with a
    space between them. A null, empty or blank text has no runs and collapses
    to the empty text; rows that repeat are treated alike. The new columns'
    names begin with the prefix, so that no column of docs clashes. Texts are
    taken whole, in one pass without a shuffle; a task holds the words of one
    text at a time. `arrange` gives, for (doc_id, number of words), the numbers
    of the words to read in place of the text's own order, or None.
    """
    schema = schema_with(docs, **{f"{prefix}runs": "array<struct<start: bigint, length: bigint, period: bigint>>", f"{prefix}collapsed": "string"})
    at_id, at_text = docs.columns.index("doc_id"), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                runs, collapsed = [], []
                for key, text in zip(part.column(at_id).to_pylist(), values_of(part.column(at_text).cast(pa.binary())), strict=True):
                    words = (text or b"").split()
                    order = arrange(key, len(words)) if arrange else None
                    if order is not None:
                        words = [words[x] for x in order.tolist()]
                    numbers: dict[bytes, int] = {}
                    w = np.fromiter((numbers.setdefault(x, len(numbers)) for x in words), np.int32, len(words))
                    own = find_runs(w) if len(numbers) < len(w) else []
                    if own:
                        words = [words[x] for x in np.flatnonzero(kept_words(len(w), own)).tolist()]
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                    collapsed.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(runs, RUNS), pa.array(collapsed, pa.binary()).cast(pa.string())], [*part.schema.names, f"{prefix}runs", f"{prefix}collapsed"])

    return docs.mapInArrow(run, schema)


def planted_order(key: int | None, n: int) -> np.ndarray | None:
    """The order of words of the query's contract: one document in ten, by the crc32 of its id, ends in a periodic stretch; a null id has none."""
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, longest and digest of the runs of every document, and the digest of what is left without repetitions, by `periodic_runs`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    prefix = unused(docs)
    runs, text = F.col(f"{prefix}runs"), F.col(f"{prefix}collapsed")
    longest = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform(runs, lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size(runs) > 0, "\n").otherwise(""))
    found = periodic_runs(docs, prefix, planted_order).withColumn(f"{prefix}best", longest)
    best = F.col(f"{prefix}best")
    return found.select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        (-best["start"]).alias("start"),
        best["length"].alias("length"),
        (-best["period"]).alias("period"),
        F.expr(f"1000 * {prefix}best.length div -{prefix}best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2(text, 256).alias("collapsed_sha256"),
    )
