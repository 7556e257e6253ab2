"""Operator 12: phrases whose words belong together, counted by suffix arrays of word numbers.

A task gathers words in shards of a bounded size, one language in each. Prefix
doubling sorts the places of a shard by the next 1, 2, 4, 8 words; neighbours
in that order share a prefix, and each interval of neighbours that share m
words is a phrase of m words with its number of occurrences. Counts of shards
are merged by phrase.

A phrase can't be more frequent than any pair of words in it. So a first pass
counts words, and pairs by a hash; the second cuts texts at pairs whose hash is
not frequent. Of the runs of words that are left each place gives the words that
follow it, LONGEST at most: equal ones of a shard are one line with its number.
Lines are dealt by their first three words, pairs by both, so that all
occurrences of a phrase meet in one place, where they are counted once and only
what is frequent is told. Lines are never more than places of the texts. Equal
hashes only let more pairs through, and what they let through is counted exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import PIECE, Scratch, partitions, table, values_of

#: Occurrences of a phrase at least; words of a phrase; phrases of a language that are reported.
LEAST, LONGEST, BEST = 100, 5, 2000
#: Words of a shard (a shard ends with the text that passes this).
SHARD = 2_000_000
#: Bits of a part of the filter for each frequent pair, and of all parts: what every task gets is at most MOST_BITS / 8 bytes.
BITS, LEAST_BITS, MOST_BITS = 32, 1 << 16, 1 << 30
#: What passes has its bit in each part; a part's bit is that of the hash shifted by so much.
SHIFTS = (0, 18, 36)
#: Words, or lines, that are dealt together at most.
DEALT = 50_000
#: Words of a line for which a task has room; parts that a task gets.
LINE, SPREAD = 3, 4
#: Parts in which a language's phrases are ranked before they are ranked together.
PARTS = 64

_BOUNDS = re.compile(rb"[.,;:!?\n-\r]+")
_TO_SPACE = bytes.maketrans(b"\t", b" ")


def _pieces_of(text: bytes) -> Iterator[bytes]:
    """Stretches of about PIECE bytes that end before a space or a bound of pieces."""
    start = 0
    while start < len(text):
        stop = min(len(text), start + PIECE)
        while stop < len(text) and text[stop] not in b" \t.,;:!?\n\x0b\x0c\r":
            stop += 1
        yield text[start:stop]
        start = stop


class _Words(dict):
    """A number for each word, 1 and on; 0 stands for the bound between pieces, -1 for nothing."""

    def __init__(self) -> None:
        super().__init__({b"\n": 0, b"": -1})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) - 1
        return number


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _pair_hashes(first: np.ndarray, second: np.ndarray, lang: bytes) -> np.ndarray:
    return _mixed(_mixed(first + np.uint64(xxhash.xxh3_64_intdigest(lang))) + second)


def _triple_hashes(first: np.ndarray, second: np.ndarray, third: np.ndarray, lang: bytes) -> np.ndarray:
    return _mixed(_pair_hashes(first, second, lang) + third)


def _passes(mask: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether every part of the filter (a row; one part may come as it is) has a hash's bit."""
    good = np.ones(len(hashes), bool)
    for part, shift in zip(np.atleast_2d(mask), SHIFTS, strict=False):
        # As in the JVM: the remainder of a negative number counts up from zero, here of a power of two.
        at = ((hashes >> np.uint64(shift)) & np.uint64(64 * len(part) - 1)).astype(np.int64)
        good &= (part[at >> 6] >> (at & 63)) & 1 == 1
    return good


def _ranks(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Numbers in the order of (high, low), equal for equal pairs."""
    return np.unique(high * (int(low.max(initial=0)) + 1) + low, return_inverse=True)[1]


def _ahead(x: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate([x[k:], np.zeros(min(k, len(x)), x.dtype)])


def _runs(ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The words of each run of neighbouring places `at`, at which k words begin, with a bound after it.

    A word that ends a run and begins the next stands in both, with a bound
    between: so the k words from any place that is not in `at` never meet.
    """
    first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    size = np.diff(np.append(first, len(at))) + k  # k - 1 words more than places, and the bound
    end = np.cumsum(size)
    place = np.arange(int(size.sum())) + np.repeat(at[first] - (end - size), size)
    line = ids[np.minimum(place, len(ids) - 1)]
    line[end - 1] = 0
    return line


class Shard:
    """The words of some texts of one language. What is pruned is kept apart, as it will be sorted."""

    def __init__(self) -> None:
        self.numbers, self.parts, self.size = _Words(), [], 0
        self.hashes, self.line, self.kept = _word_hashes([b""]), [], 0

    def add(self, text: bytes) -> None:
        for piece in _pieces_of(text):
            found = _BOUNDS.sub(b" \n ", piece.lower().translate(_TO_SPACE)).split(b" ")
            ids = np.fromiter(map(self.numbers.__getitem__, found), np.int64, len(found))
            ids = ids[ids >= 0]
            self.parts.append(ids)
            self.size += len(ids)
        self.parts.append(np.zeros(1, np.int64))
        self.size += 1

    def ids(self) -> np.ndarray:
        return np.concatenate([*self.parts, np.zeros(LONGEST, np.int64)])

    def words(self) -> list[bytes]:
        """Each word at its number."""
        return [b"", *islice(self.numbers, 2, None)]

    def prune(self, lang: bytes, masks: list[np.ndarray]) -> None:
        """Of the words added since, the runs of pairs that pass the first mask or, if there are two, of triples that pass the second and whose pairs pass the first."""
        if not self.parts:
            return
        ids = np.concatenate(self.parts)
        self.parts, self.size = [], 0
        self.hashes = np.concatenate([self.hashes, _word_hashes(list(islice(self.numbers, 1 + len(self.hashes), None)))])
        own = self.hashes[ids]
        good = _passes(masks[0], _pair_hashes(own, _ahead(own, 1), lang)) & (ids > 0) & (_ahead(ids, 1) > 0)
        if len(masks) > 1:
            triple = np.flatnonzero(good & _ahead(good, 1))
            triple = triple[_passes(masks[1], _triple_hashes(own[triple], own[triple + 1], own[triple + 2], lang))]
            line = _runs(ids, triple, 3)
        else:
            line = _runs(ids, np.flatnonzero(good), 2)
        self.line.append(line)
        self.kept += len(line)


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the `depth` words from each on, by prefix doubling."""
    rank, known = ids, 1
    while known < depth:
        rank = _ranks(rank, _ahead(rank, known))
        known *= 2
    return np.argsort(rank, kind="stable")


def phrase_counts(ids: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For m = 1 to depth: m, a place of each phrase of m words without a bound, and its number of occurrences, from the intervals of common prefixes."""
    order = suffix_array(ids, depth)
    lasts = len(ids)
    room, common = np.zeros(lasts, np.int64), np.zeros(lasts, np.int64)  # words before a bound; words in common with the place before
    here, same = np.ones(lasts, bool), np.ones(lasts, bool)
    for m in range(depth):
        word = _ahead(ids, m)
        here &= word > 0
        room += here
        sorted_ = word[order]
        same[1:] &= (sorted_[1:] == sorted_[:-1]) & (sorted_[1:] > 0)
        common += same
    common[:1] = 0
    room = room[order]
    for m in range(1, depth + 1):
        start = np.flatnonzero(common < m)
        size = np.diff(np.append(start, lasts))
        whole = room[start] >= m
        yield m, order[start[whole]], size[whole]


def _shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[bytes, Shard]]:
    """Batches of (lang, text) as shards; all languages together hold about `size` words at most."""
    open_: dict[bytes, Shard] = {}
    for b in batches:
        for lang, text in zip(values_of(b.column(0).cast(pa.binary())), values_of(b.column(1).cast(pa.binary())), strict=True):
            if text:
                open_.setdefault(lang, Shard()).add(text)
                if sum(x.size for x in open_.values()) >= size:
                    yield from open_.items()
                    open_.clear()
    yield from open_.items()


def _words_and_pairs(size: int):
    """Rows of a shard: (lang, word, null, count), (null, null, hash of a pair, count), and (lang, null, null, number of words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "word", "pair", "a"]
        for lang, shard in _shards(batches, size):
            ids, words = shard.ids(), shard.words()
            hashes = _word_hashes(words)
            for m, place, count in phrase_counts(ids, 2):
                n, none = len(place), pa.nulls(len(place), pa.string())
                if m == 1:
                    named = pa.array([words[x] for x in ids[place].tolist()], pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.binary()).cast(pa.string()), named, pa.nulls(n, pa.int64()), pa.array(count)], names)
                    yield pa.RecordBatch.from_arrays([pa.array([lang], pa.binary()).cast(pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([int(count.sum())], pa.int64())], names)
                else:
                    key = _pair_hashes(hashes[ids[place]], hashes[ids[place + 1]], lang).view(np.int64)
                    yield pa.RecordBatch.from_arrays([none, none, pa.array(key), pa.array(count)], names)

    return run


def _bit(key: Column, bits: int) -> Column:
    return F.pmod(key, F.lit(bits).cast("long"))


def _filter(pairs: DataFrame, number: int) -> np.ndarray:
    """In each part one bit for each frequent hash in the column `pair`; the driver gets one row for each 64 bits at most."""
    bits = min(max(64, MOST_BITS // 4), max(LEAST_BITS, 1 << int(BITS * number).bit_length()))
    out = np.zeros((len(SHIFTS), bits // 64), np.int64)
    for part, shift in zip(out, SHIFTS, strict=True):
        at = _bit(F.shiftrightunsigned("pair", shift), bits)
        rows = pairs.select(F.shiftright(at, 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int")).alias("bit"))
        got = rows.groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
        part[got.column("at").to_numpy()] = got.column("bit").to_numpy()
    return out


def _pruned_shards(batches: Iterator[pa.RecordBatch], size: int, masks: list[np.ndarray]) -> Iterator[tuple[bytes, Shard]]:
    """As _shards, but what counts are the words that pass, of which there are far fewer: a shard holds more texts, and phrases that they share are counted together."""
    open_: dict[bytes, Shard] = {}

    def prune() -> int:
        for lang, x in open_.items():
            x.prune(lang, masks)
        return max(sum(x.kept for x in open_.values()), sum(len(x.numbers) for x in open_.values()))

    for b in batches:
        for lang, text in zip(values_of(b.column(0).cast(pa.binary())), values_of(b.column(1).cast(pa.binary())), strict=True):
            if text:
                open_.setdefault(lang, Shard()).add(text)
                if sum(x.size for x in open_.values()) >= size // 4 and prune() >= size:
                    yield from open_.items()
                    open_.clear()
    prune()
    yield from open_.items()


def _named(lang: bytes, words: list[bytes], line: np.ndarray, place: np.ndarray, count: np.ndarray, m: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, phrase, words, a) of phrases of m words at the places; further names stay null."""
    for k in range(0, len(place), 100_000):
        some = place[k : k + 100_000]
        parts = [[words[x] for x in line[some + j].tolist()] for j in range(m)]
        phrase = pa.array([b" ".join(x) for x in zip(*parts, strict=True)], pa.binary()).cast(pa.string())
        columns = [pa.array([lang] * len(some), pa.binary()).cast(pa.string()), phrase, pa.array(np.full(len(some), m, np.int32)), pa.array(count[k : k + 100_000])]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(some), pa.int64()) for _ in names[4:])], names)


# The next three count by shards of texts, a row for each phrase of each shard; tests hold them against brute force. `phrases` does not use them.


def _pairs_and_triples(size: int, passing, totals: dict[bytes, int] | None = None, least: int = LEAST):
    """Rows of a shard: (lang, phrase, 2, a, null) of pairs that pass the filter, and (lang, null, 3, a - s, hash) of triples both of whose pairs do, where they occur a > s times; (lang, null, 0, s, null) tells s.

    s is less than the shard's share of `least` by its share of the language's
    words, `totals`: zero for a language of very many shards, or without a total.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "phrase", "words", "a", "pair"]
        for lang, shard in _pruned_shards(batches, size, [passing.value]):
            line, words, hashes = np.concatenate([*shard.line, np.zeros(3, np.int64)]), shard.words(), shard.hashes
            rare = max(0, -(-least * shard.kept // totals[lang]) - 1) if totals and totals.get(lang) else 0

            def numbered(m: int, a: np.ndarray, key: pa.Array) -> pa.RecordBatch:
                n = len(a)
                return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.binary()).cast(pa.string()), pa.nulls(n, pa.string()), pa.array(np.full(n, m, np.int32)), pa.array(a), key], names)  # noqa: B023

            if rare:
                yield numbered(0, np.array([rare]), pa.nulls(1, pa.int64()))
            for m, place, count in phrase_counts(line, 3):
                if m == 2:
                    yield from _named(lang, words, line, place, count, 2, names)
                elif m == 3:
                    place, count = place[count > rare], count[count > rare]
                    yield numbered(3, count - rare, pa.array(_triple_hashes(*(hashes[line[place + j]] for j in range(3)), lang).view(np.int64)))

    return run


def _frequent_runs(size: int, *passing):
    """Rows (lang, words, text): the runs of pairs, or of triples, that pass the filters, a line each, about DEALT words together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, shard in _pruned_shards(batches, size, [p.value for p in passing]):
            line, words, start = np.concatenate([np.zeros(0, np.int64), *shard.line]), [b"\n", *shard.words()[1:]], 0
            ends = np.flatnonzero(line == 0) + 1
            while start < len(line):
                stop = int(ends[min(len(ends) - 1, int(np.searchsorted(ends, start + DEALT)))])
                text = b" ".join(map(words.__getitem__, line[start:stop].tolist()))
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.binary()).cast(pa.string()), pa.array([stop - start]), pa.array([text], pa.binary()).cast(pa.string())], ["lang", "words", "text"])
                start = stop

    return run


def _phrases(size: int, depth: int, passing, passing3):
    """Rows (lang, phrase, words, a) of a shard: phrases of three words and more, all of whose pairs and triples pass the filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, shard in _pruned_shards(batches, size, [passing.value, passing3.value]):
            line = np.concatenate([*shard.line, np.zeros(depth, np.int64)])
            words = shard.words()
            for m, place, count in phrase_counts(line, depth):
                if m > 2:
                    yield from _named(lang, words, line, place, count, m, ["lang", "phrase", "words", "a"])

    return run


# What `phrases` uses: lines are dealt by their words.


def _lines(size: int, depth: int, passing, parts: int):
    """Rows (part, lang, text, a) of a shard: lines of two words, the pairs that pass the filter, and of three to `depth`, what follows a place of its runs; a: how often each line is there.

    The part goes by the first three words, of pairs by both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, shard in _pruned_shards(batches, size, [passing.value]):
            line, words, hashes = np.concatenate([*shard.line, np.zeros(depth, np.int64)]), [b"\n", *shard.words()[1:]], shard.hashes
            shard.line.clear()
            room = np.zeros(len(line), np.int8)  # words before a bound, `depth` at most
            here = np.ones(len(line), bool)
            for m in range(depth):
                here &= _ahead(line, m) > 0
                room += here
            order = suffix_array(line, depth)
            order = order[room[order] > 1]
            fresh = np.zeros(len(order), bool)  # whether a place's line is another than that of the place before
            fresh[:1] = True
            found = []
            for m in range(depth):
                word = np.where(room[order] > m, line[order + m], 0)
                fresh[1:] |= word[1:] != word[:-1]
                if m == 1:
                    start = np.flatnonzero(fresh)
                    first = order[start]
                    found.append((first, np.full(len(first), 2), np.diff(np.append(start, len(order))), _pair_hashes(hashes[line[first]], hashes[line[first + 1]], lang)))
            start = np.flatnonzero(fresh)
            first, count = order[start], np.diff(np.append(start, len(order)))
            long = room[first] > 2
            first, count = first[long], count[long]
            found.append((first, room[first], count, _triple_hashes(*(hashes[line[first + j]] for j in range(3)), lang)))
            del order, fresh, here, word
            place, length, a, key = (np.concatenate(x) for x in zip(*found, strict=True))
            part = (key % np.uint64(parts)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            edge = [*np.flatnonzero(np.diff(part[by], prepend=-1)).tolist(), len(by)]
            for s, e in zip(edge, edge[1:], strict=False):
                for k in range(s, e, DEALT):
                    own = by[k : min(e, k + DEALT)]
                    end = np.cumsum(length[own] + 1)
                    at = np.arange(int(end[-1])) + np.repeat(place[own] - (end - length[own] - 1), length[own] + 1)
                    flat = line[at]
                    flat[end - 1] = 0
                    text = b" ".join(map(words.__getitem__, flat.tolist()))
                    columns = pa.array([int(part[own[0]])]), pa.array([lang], pa.binary()).cast(pa.string()), pa.array([text], pa.binary()).cast(pa.string()), pa.array([a[own]], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([*columns], ["part", "lang", "text", "a"])

    return run


def _frequent(shard: Shard, often: np.ndarray, depth: int, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """m, the words' numbers, a place and the number of each phrase of m words that the shard's lines, each there so often, begin with at least `least` times."""
    ids = shard.ids()
    end = np.flatnonzero(ids == 0)
    start = np.concatenate([[0], end[:-1] + 1])
    start, length = start[end > start], (end - start)[end > start]
    rows = np.flatnonzero(length == 2)
    key = ids[start]
    for m in range(2, depth + 1):
        if m == 3:
            rows = np.flatnonzero(length > 2)
            key = _ranks(ids[start], ids[start + 1])
        rows = rows[length[rows] >= m]
        if not len(rows):
            continue
        rank = _ranks(key[rows], ids[start[rows] + m - 1])
        key = np.zeros(len(start), np.int64)
        key[rows] = rank
        total = np.zeros(int(rank.max()) + 1, np.int64)
        np.add.at(total, rank, often[rows])
        place = np.zeros(len(total), np.int64)
        place[rank] = start[rows]
        good = total >= least
        yield m, ids, place[good], total[good]


def _counted(depth: int, least: int):
    """Rows (part, lang, text, a) of whole parts, sorted by part and lang -> (lang, phrase, words, a) of the phrases of two words and more with at least `least` occurrences."""
    names = ["lang", "phrase", "words", "a"]

    def told(lang: bytes, shard: Shard, often: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for m, ids, place, count in _frequent(shard, np.concatenate(often), depth, least):
            yield from _named(lang, shard.words(), ids, place, count, m, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard, often = None, Shard(), []
        for b in batches:
            for k in range(b.num_rows):
                part, lang, text = (b.column(c)[k].as_py() for c in range(3))
                if (part, lang) != key:
                    if often:
                        yield from told(key[1].encode(), shard, often)
                    key, shard, often = (part, lang), Shard(), []
                shard.add(text.encode())
                often.append(b.column(3)[k].values.to_numpy())
        if often:
            yield from told(key[1].encode(), shard, often)

    return run


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shard: int = SHARD, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """docs (lang, text, ...) -> (lang, phrase, words, a), phrases of 1 to `longest` words with a >= least occurrences, and (lang, n), the words of each language.

    Letters A to Z count as a to z; a text is cut at `.,;:!?` and line ends,
    its pieces at spaces and tabs; no phrase crosses a bound of pieces. A null
    language is `und`; null and empty texts add nothing. Rows that repeat count
    again. Other columns are not looked at. An empty table has no phrases.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    singles = texts.mapInArrow(_words_and_pairs(shard), "lang string, word string, pair bigint, a bigint")
    singles = singles.groupBy("lang", "word", "pair").agg(F.sum("a").alias("a")).where((F.col("a") >= least) | F.col("word").isNull() & F.col("pair").isNull())
    singles = scratch.write(singles, "phrase-singles")
    pairs = singles.where("pair is not null")
    words = singles.where("word is not null").select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), "a")
    if longest > 1:
        number, places = pairs.agg(F.count("*"), F.coalesce(F.sum("a"), F.lit(0))).first()
        passing = spark.sparkContext.broadcast(_filter(pairs, number))
        # Lines are no more than places of pairs that pass: tasks for as many as fill a shard each, and some parts for each, so that tasks get about the same.
        tasks = max(partitions(spark), min(number, -(-LINE * places // shard)))
        lines = texts.mapInArrow(_lines(shard, longest, passing, SPREAD * tasks), "part bigint, lang string, text string, a array<bigint>")
        lines = lines.repartition(tasks, "part").sortWithinPartitions("part", "lang")
        words = words.unionByName(lines.mapInArrow(_counted(longest, least), "lang string, phrase string, words int, a bigint"))
    found = scratch.write(words, "phrase-counts")
    return found, singles.where("word is null and pair is null").select("lang", F.col("a").alias("n"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, best: int = BEST, shard: int = SHARD, scratch: Scratch | None = None) -> DataFrame:
    """docs (lang, text, ...) -> lang, rank, phrase, a, l, r, n, score: the `best` phrases of two words and more of each language.

    A phrase's score is floor(1000 a n / (l r)) of its worst cut into two
    parts, which occur l and r times (ties: the first cut). A phrase that lies
    in a longer one as often as anywhere is left out. Order: score and a
    descending, then the phrase's bytes. Arithmetic is exact up to 38 digits.
    See `phrases` for what counts as a word and for awkward rows.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    counts, totals = phrases(docs, least, longest, shard, scratch)
    long = counts.where("words > 1")
    # A phrase as frequent as a longer one around it is as frequent as one that is longer by one word.
    around = counts.where("words > 2").select("lang", F.explode(F.array(F.regexp_extract("phrase", r"\A(?s)(.*) [^ ]*\z", 1), F.regexp_extract("phrase", r"\A(?s)[^ ]* (.*)\z", 1))).alias("phrase"), "a").distinct()
    own = long.join(around, ["lang", "phrase", "a"], "left_anti")
    part = F.split("phrase", " ", -1)
    cuts = own.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice(part, F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice(part, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right"))
    for side, into in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("a").alias(into)), ["lang", side])
    cuts = cuts.join(F.broadcast(totals) if totals.count() <= 100_000 else totals, "lang")
    score = F.expr("(cast(1000 as decimal(38, 0)) * a * n) div (cast(l as decimal(38, 0)) * r)")
    worst = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("w")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(worst).select("lang", "phrase", "a", F.col("w.l").alias("l"), F.col("w.r").alias("r"), "n", F.col("w.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    scored = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= best)
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    return scored.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The BEST collocations of each language of `documents`, by `collocations`."""
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP12_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, doc, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
listed AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM pieces),
totals AS (SELECT lang, sum(len(words))::BIGINT AS n FROM listed GROUP BY lang),
grams AS (SELECT lang, m, unnest(list_transform(range(1, len(words) - m + 2), lambda i: array_to_string(words[i:i + m - 1], ' '))) AS phrase FROM listed, (SELECT unnest(range(1, 6)) AS m) WHERE len(words) >= m),
f AS (SELECT lang, m, phrase, count(*)::BIGINT AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT * FROM f WHERE m > 1),
kept AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM cand o WHERE o.lang = c.lang AND o.m > c.m AND o.a >= c.a AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (SELECT lang, phrase, a, unnest(range(1, m)) AS k, string_split(phrase, ' ') AS words FROM kept),
scored AS (SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, t.n, (1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a) AS score FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(words[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(words[k + 1:], ' ') JOIN totals t ON t.lang = c.lang),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
