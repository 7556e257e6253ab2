"""Operator 10: benchmark decontamination by latent semantic retrieval.

Words are hashed to terms and weighted by inverse document frequency over all
documents. A distributed randomised SVD of the TF-IDF passages of the whole
benchmark gives a latent space. Windows of
every document are projected to it; those whose cosine with a benchmark
passage is high enough become candidates. The cosine is that of the whole
window, so it falls as the benchmark outgrows the rank; hence candidates come
from an index of the passages' word pairs as well (see `PairIndex`), which
knows passages however many documents hold them. A candidate counts if the
longest common subsequence of words covers enough of the passage, or less of
it together with the passage's answer (its last words): so paraphrases that
keep the order of most words, or the answer, are found.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, schema_with, table, unused, values_of, word_pieces

#: Hashed terms, latent dimensions, extra dimensions of the random projection.
TERMS, RANK, EXTRA = 1 << 15, 128, 8
#: Tasks of the fit, each of which sums TERMS x (RANK + EXTRA) numbers at most.
FIT_TASKS = 4
#: Words of a block; windows are two blocks (for passages of fewer words than that) or four.
BLOCK = 16
#: Benchmark passages have at most LONG words; longer items are cut in overlapping ones.
SHORT, LONG = 2 * BLOCK, 4 * BLOCK
#: Least cosine of a candidate; least share of the passage in common; the same if the answer is in common too.
COSINE, COMMON, COMMON_WITH_ANSWER, ANSWER = 0.3, 0.7, 0.5, 0.8
#: Words of the answer: the last part of a passage. Terms in more than this share of documents carry little weight, but some:
#: a passage that many documents hold consists of such terms.
ANSWER_WORDS, FREQUENT, FAINT = 6, 0.2, 0.25
#: Benchmark passages that are held against all documents in one pass; more are done in several.
PASSAGES_AT_ONCE = 20_000
#: Up to so many passages stand in one cell, beyond in as many as the root of their number.
CELLS_FROM = 2048
#: Pairs of words that a stretch shares with a passage, as a share of the passage's words.
LEAST_PAIRS = 1 / 6
#: Words whose terms a task keeps; words that are projected at once.
CACHE, AT_ONCE = 200_000, 200_000
#: Pairs of words and the passages that have them, and windows with passages, that are held at once.
PAIRS, CELLS = 1_000_000, 4_000_000

FOUND = ("item_id", "common", "answer", "cosine")

_APART = bytes.maketrans(bytes(c for c in range(128) if not chr(c).isalnum()), b" " * sum(not chr(c).isalnum() for c in range(128)))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    return [w for piece in word_pieces((text or "").lower().encode("utf-8", "surrogatepass").translate(_APART)) for w in piece]


class Terms(dict):
    """word -> term, kept for the words of a task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        term = self[word] = zlib.crc32(word) % TERMS
        return term

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def passages_of(words: list[bytes]) -> list[list[bytes]]:
    """Whole items of at most LONG words, else overlapping parts whose last one ends the item."""
    if len(words) <= LONG:
        return [words] if words else []
    starts = [*range(0, len(words) - LONG, LONG // 2), len(words) - LONG]
    return [words[s : s + LONG] for s in starts]


def longest_common(passage: list[bytes], words: list[bytes]) -> int:
    """Length of the longest common subsequence, by the bits of whole numbers."""
    masks: dict[bytes, int] = {}
    for i, w in enumerate(passage):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(passage)) - 1
    v = full
    for w in words:
        if m := masks.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(passage) - v.bit_count()


@dataclass
class LatentSpace:
    idf: np.ndarray  # by term; FAINT for frequent ones
    project: np.ndarray  # terms x rank, without the idf

    def vector(self, terms: np.ndarray) -> np.ndarray:
        v = np.bincount(terms, minlength=TERMS) * self.idf
        return v[v > 0] @ self.project[v > 0]


@dataclass
class PairIndex:
    """Pairs of words next to each other, or with one word between them -> passages that have them.

    A stretch is a candidate if enough of its pairs, LEAST_PAIRS of a passage's
    words in number, are the passage's: half of the words in place, or all of
    them with a word put in after each, give several times as many. Frequent
    words do no harm, for pairs of them are rare. A stretch has half as many
    words again as the passage: wider ones, in which common words alone line
    up by chance, are left to the latent search.
    """

    maybe: np.ndarray  # by the hash of a pair: whether any passage may have it
    key: np.ndarray  # pairs of passages, ascending
    owner: np.ndarray  # their passages
    least: np.ndarray  # by passage: pairs that a candidate has
    reach: np.ndarray  # by passage: words that it may stretch over

    @staticmethod
    def pairs(flat: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs within each text, by where their first word is; texts of one word have that word."""
        keys, at = [], []
        for gap in (1, 2):
            some = np.flatnonzero(doc[gap:] == doc[:-gap]) if len(doc) > gap else np.zeros(0, np.int64)
            keys.append(flat[some] * TERMS + flat[some + gap])
            at.append(some)
        return np.concatenate(keys), np.concatenate(at)

    @staticmethod
    def single(flat: np.ndarray) -> np.ndarray:
        return flat + TERMS * TERMS

    @staticmethod
    def hashed(key: np.ndarray, size: int) -> np.ndarray:
        return (key * 0x9E3779B1 >> 7) & (size - 1)

    @staticmethod
    def of(passages: list[np.ndarray]) -> PairIndex:
        """passages: the terms of each."""
        size = np.array([len(p) for p in passages], np.int64)
        flat, doc = np.concatenate([np.zeros(0, np.int64), *passages]), np.repeat(np.arange(len(passages)), size)
        key, at = PairIndex.pairs(flat, doc)
        alone = size[doc] == 1
        key, owner = np.concatenate([key, PairIndex.single(flat[alone])]), np.concatenate([doc[at], doc[alone]])
        both = np.unique(np.stack([key, owner]), axis=1) if len(key) else np.zeros((2, 0), np.int64)
        maybe = np.zeros(1 << max(16, (64 * len(both[0])).bit_length()), bool)
        maybe[PairIndex.hashed(both[0], len(maybe))] = True
        return PairIndex(maybe, both[0], both[1], np.maximum(1, (size * LEAST_PAIRS).astype(np.int64)), np.maximum(2, size + size // 2))

    def candidates(self, flat: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """flat, doc: the terms of some texts and the texts' numbers, ascending. Passages and where in flat a stretch with enough of one begins, in order of passage, then place."""
        key, at = self.pairs(flat, doc)
        if len(self.key) and self.key[-1] >= TERMS * TERMS:
            key, at = np.concatenate([key, self.single(flat)]), np.concatenate([at, np.arange(len(flat))])
        some = self.maybe[self.hashed(key, len(self.maybe))]
        key, at = key[some], at[some]
        low, high = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        order = np.argsort(at, kind="stable")
        low, n, at = low[order], (high - low)[order], at[order]
        apart = 2 * LONG  # more than any reach
        total, cut = np.cumsum(n), 0
        while cut < len(at):
            first_row = cut
            cut = max(cut + 1, int(np.searchsorted(total, (total[cut - 1] if cut else 0) + PAIRS)))
            end = max(cut, int(np.searchsorted(at, at[cut - 1] + apart)))  # what begins before the cut ends within
            part = slice(first_row, end)
            row = np.repeat(np.arange(first_row, end), n[part])
            owner = self.owner[low[row] + np.arange(len(row)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])]
            by = np.argsort(owner, kind="stable")
            owner, row = owner[by], row[by]
            place = at[row] + (doc[at[row]] - doc[at[first_row]]) * apart
            last = np.arange(len(owner)) + self.least[owner] - 1
            first = np.flatnonzero(last < len(owner))
            last = last[first]
            enough = (owner[last] == owner[first]) & (place[last] - place[first] < self.reach[owner[first]]) & (row[first] < cut)
            yield owner[first[enough]], at[row[first[enough]]]


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Number of documents with each term, over all of them, and their number. TERMS rows at most reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, count, n = Terms(), np.zeros(TERMS + 1, np.int64), 0
        place = np.zeros(TERMS, np.int64)
        for b in batches:
            for text in values_of(b.column(0)):
                n += 1
                own = terms.of(words_of(text))
                order = np.arange(len(own))
                place[own] = order
                count[own[place[own] == order]] += 1  # each term of the document once, where it stands last
        count[TERMS] = n
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(count[seen])], ["term", "n"])

    found = docs.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    count = np.zeros(TERMS + 1, np.int64)
    count[found.term.to_numpy(np.int64)] = found.n.to_numpy(np.int64)
    return count[:TERMS], int(count[TERMS])


def fit_space(docs: DataFrame, benchmark: DataFrame, seed: int = 42) -> LatentSpace:
    """Inverse frequencies from all documents; the SVD from all passages of the benchmark.

    Randomised SVD: with A the passages, A'A is applied to a random basis three
    times, passages staying where they are; TERMS x (RANK + EXTRA) numbers go
    to the tasks and come back summed.
    """
    spark = docs.sparkSession
    count, n = document_frequencies(docs)
    idf = np.where(count <= max(1, FREQUENT * n), np.log((n + 1) / (count + 1)) + 1, FAINT) if n else np.ones(TERMS)
    rows = Scratch(spark).write(benchmark.where("text is not null").select("text").repartition(FIT_TASKS), "svd-rows")
    shared_idf = spark.sparkContext.broadcast(idf)

    def apply(basis: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(basis.astype(np.float32))
        width = basis.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms, idf, q = Terms(), shared_idf.value, shared.value
            out = np.zeros((TERMS, width), np.float32)
            for b in batches:
                for text in b.column(0).to_pylist():
                    for part in passages_of(words_of(text)):
                        t, k = np.unique(terms.of(part), return_counts=True)
                        x = (k * idf[t]).astype(np.float32)
                        x /= max(1e-9, float(np.linalg.norm(x)))
                        out[t] += np.outer(x, x @ q[t])
            seen = np.flatnonzero(out.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array([x.tobytes() for x in out[seen]], pa.binary())], ["term", "x"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    total[t] = total.get(t, 0) + np.frombuffer(x, np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.astype(np.float32).tobytes() for x in total.values()], pa.binary())], ["term", "x"])

        found = rows.mapInArrow(run, "term bigint, x binary").repartition(FIT_TASKS, "term").mapInArrow(add, "term bigint, x binary").toArrow()
        y = np.zeros((TERMS, width), np.float32)
        for b in found.to_batches():
            y[b.column(0).to_numpy()] = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(-1, width)
        shared.destroy()
        return y

    q = np.random.default_rng(seed).standard_normal((TERMS, RANK + EXTRA), np.float32)
    for _ in range(2):
        q = _orthonormal(apply(q))
    m = _inner(q, apply(q))
    value, turn = np.linalg.eigh((m + m.T) / 2)
    best = np.argsort(value)[::-1][:RANK]
    return LatentSpace(idf, q @ turn[:, best].astype(np.float32))


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a'b in double precision, some rows at a time: the driver holds no second copy of either."""
    return sum(a[i : i + 2048].astype(np.float64).T @ b[i : i + 2048].astype(np.float64) for i in range(0, len(a), 2048))


def _orthonormal(y: np.ndarray) -> np.ndarray:
    """A basis of what the columns span; directions that rounding drowns become zero."""
    value, turn = np.linalg.eigh(_inner(y, y))
    sound = value > 1e-9 * value.max(initial=0.0)
    return y @ np.where(sound, turn / np.sqrt(np.where(sound, value, 1.0)), 0.0).astype(np.float32)


def _block_sums(project: np.ndarray, terms: np.ndarray, place: np.ndarray, blocks: int) -> np.ndarray:
    """The sum of the projected terms of each block; place: the terms' blocks, ascending.

    Blocks stand in descending order of their numbers of terms, so that the
    k-th terms of all that have one are added to the first rows at once.
    """
    count = np.bincount(place, minlength=blocks)
    order = np.argsort(-count, kind="stable")
    start, count = (np.cumsum(count) - count)[order], count[order]
    added = np.zeros((blocks, project.shape[1]), project.dtype)
    for k in range(int(count[0]) if blocks else 0):
        n = int(np.searchsorted(-count, -k))
        added[:n] += project[terms[start[:n] + k]]
    sums = np.empty_like(added)
    sums[order] = added
    return sums


class Cells:
    """Passages by their latent vectors, in cells around some of them: whichever cells a window leaves out hold nothing that it is near to.

    A passage of a cell with centre c and radius r has a product with a window
    w of at most w.c + |w| r. Where that over the window's length stays below
    COSINE, so do all cosines. What is found does not depend on the cells.
    """

    def __init__(self, own: list[int], unit: np.ndarray):
        self.own, self.unit = np.array(own, np.int64), unit
        self.centres = unit[:: max(1, int(len(unit) ** 0.5))] if len(unit) > CELLS_FROM else unit[:1]
        cell = np.concatenate([np.zeros(0, np.int64), *((unit[i : i + 4096] @ self.centres.T).argmax(axis=1) for i in range(0, len(unit), 4096))])
        self.members = [np.flatnonzero(cell == c) for c in range(len(self.centres))]
        self.radius = np.array([float(np.linalg.norm(unit[m] - c, axis=1).max(initial=0.0)) for m, c in zip(self.members, self.centres, strict=True)], np.float32)

    def near(self, window: np.ndarray, length: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """Row of the window, passage and cosine, where the cosine reaches COSINE."""
        if len(self.centres) > 1:
            norm = np.linalg.norm(window, axis=1)
            # Single precision: what rounding may hide counts as near.
            may = window @ self.centres.T + norm[:, None] * (self.radius + 1e-4) >= COSINE * length[:, None]
            meet = [np.flatnonzero(m) for m in may.T]
        else:
            meet = [np.arange(len(window))] * len(self.centres)
        for rows, members in zip(meet, self.members, strict=True):
            if len(rows) and len(members):
                cosine = (window[rows] @ self.unit[members].T) / length[rows, None]
                for b, c in zip(*(x.tolist() for x in np.nonzero(cosine >= COSINE)), strict=True):
                    yield int(rows[b]), int(self.own[members[c]]), float(cosine[b, c])


def _matches(docs: DataFrame, listed: list[tuple[int, list[bytes]]], space: LatentSpace, prefix: str) -> DataFrame:
    """docs, then item_id, common, answer, cosine of the best match (null if none), behind the prefix. listed: items and their passages."""
    spark = docs.sparkSession
    terms = Terms()
    vectors = [space.vector(terms.of(p)) for _, p in listed]
    sized = []
    for low, high in ((0, SHORT), (SHORT, LONG + 1)):
        own = [j for j, (_, p) in enumerate(listed) if low <= len(p) < high and np.linalg.norm(vectors[j]) > 0]
        sized.append(Cells(own, np.array([vectors[j] / np.linalg.norm(vectors[j]) for j in own], np.float32).reshape(len(own), RANK)))
    weighted = (space.idf[:, None] * space.project).astype(np.float32)
    strength = np.linalg.norm(weighted, axis=1)
    heavy = strength > 0.01 * strength.max(initial=0.0)
    latent = np.array([v / max(1e-9, float(np.linalg.norm(v))) for v in vectors], np.float32).reshape(len(listed), RANK)
    index = PairIndex.of([terms.of(p) for _, p in listed])
    shared = spark.sparkContext.broadcast((weighted, heavy, (space.idf**2).astype(np.float32), sized, listed, latent, index))
    at, added = docs.columns.index("text"), [prefix + c for c in FOUND]
    names = [*docs.columns, *added]

    def verdict(region: list[bytes], j: int, listed: list) -> tuple[float, float]:
        passage = listed[j][1]
        known = set(region)
        if sum(w in known for w in passage) < COMMON_WITH_ANSWER * len(passage):
            return 0.0, 0.0
        tail = passage[-ANSWER_WORDS:]
        return longest_common(passage, region) / len(passage), longest_common(tail, region) / len(tail)

    def best_of(texts: list[list[bytes]], terms: Terms) -> list[tuple | None]:
        project, heavy, idf2, sized, listed, latent, index = shared.value
        best: list[tuple | None] = [None] * len(texts)
        sizes = np.array([len(w) for w in texts], np.int64)
        blocks = -(-sizes // BLOCK)
        first = np.cumsum(blocks) - blocks
        total = int(blocks.sum())
        if not total or not listed:
            return best
        flat = np.concatenate([terms.of(w) for w in texts])
        place = np.repeat(first, sizes) + (np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) // BLOCK
        weight = np.bincount(place, idf2[flat], total)
        loud = heavy[flat]
        sums = _block_sums(project, flat[loud], place[loud], total)
        doc = np.repeat(np.arange(len(texts)), blocks)
        windows = {}

        def judge(d: int, j: int, region: list[bytes], cosine: float) -> None:
            common, answer = verdict(region, j, listed)
            if common >= COMMON or (common >= COMMON_WITH_ANSWER and answer >= ANSWER):
                got = (-common, listed[j][0], -answer, -cosine)
                best[d] = got if best[d] is None else min(best[d], got)

        for cells, span in zip(sized, (2, 4), strict=True):
            window, norm = sums.copy(), weight.copy()
            for k in range(1, span):  # blocks of the next document don't count
                same = np.flatnonzero(doc[k:] == doc[:-k]) if total > k else np.zeros(0, np.int64)
                window[same] += sums[same + k]
                norm[same] += weight[same + k]
            length = np.sqrt(np.maximum(norm, 1e-9)).astype(np.float32)
            windows[span] = window, length
            rows = max(1, CELLS // max(1, min(CELLS_FROM, len(cells.own))))
            for i in range(0, total if len(cells.own) else 0, rows):
                for b, j, cosine in cells.near(window[i : i + rows], length[i : i + rows]):
                    d = int(doc[i + b])
                    start, extra = int(i + b - first[d]) * BLOCK, len(listed[j][1])
                    judge(d, j, texts[d][max(0, start - extra) : start + span * BLOCK + extra], cosine)
        word = np.cumsum(sizes) - sizes
        text = np.repeat(np.arange(len(texts)), sizes)
        for owner, at in index.candidates(flat, text):
            # Of the stretches of one passage that begin near each other, the first stands for all.
            near = np.maximum(4, index.reach[owner] // 6)
            part = np.stack([owner, text[at], at // near])
            for i in np.flatnonzero(np.r_[True, (part[:, 1:] != part[:, :-1]).any(axis=0)]).tolist() if len(at) else []:
                j, d = int(owner[i]), int(text[at[i]])
                passage, start = listed[j][1], int(at[i] - word[d])
                region = texts[d][max(0, start - len(passage) // 4) : start + int(index.reach[j])]
                window, length = windows[2 if len(passage) < SHORT else 4]
                b = int(first[d]) + start // BLOCK
                judge(d, j, region, float(window[b] @ latent[j] / length[b]))
        return best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for b in batches:
            found: list[tuple | None] = []
            group: list[list[bytes]] = []
            for text in values_of(b.column(at)):
                group.append(words_of(text))
                if sum(map(len, group[-64:])) >= AT_ONCE or len(group) >= 256:
                    found += best_of(group, terms)
                    group = []
            found += best_of(group, terms)
            extra = [
                pa.array([x and x[1] for x in found], pa.int64()), pa.array([x and -x[0] for x in found], pa.float64()),
                pa.array([x and -x[2] for x in found], pa.float64()), pa.array([x and -x[3] for x in found], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names)

    return docs.mapInArrow(run, schema_with(docs, **dict(zip(added, ("bigint", "double", "double", "double"), strict=True))))


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cut = [(i, b" ".join(p)) for i, text in zip(b.column(0).to_pylist(), values_of(b.column(1)), strict=True) for p in passages_of(words_of(text))]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in cut], pa.int64()), pa.array([p for _, p in cut], pa.binary())], ["item_id", "passage"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, prefix: str = "") -> DataFrame:
    """All columns of docs (with doc_id and text), then item_id, common, answer, cosine of the best match, null where there is none.

    The names of the added columns stand behind the prefix. Best: most of the
    passage in common, then the smallest item_id. A null or empty text matches
    nothing, nor does an item without words or id; repeated documents and items
    count like others. Passages, not items, are what a pass holds at most
    PASSAGES_AT_ONCE of.
    """
    space = fit_space(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))
    items = benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    passages = items.mapInArrow(_passages, "item_id bigint, passage binary").distinct()
    passes = -(-passages.count() // PASSAGES_AT_ONCE)
    # A benchmark too large for one broadcast: parts of it, one after another, each adding to what is known of a document.
    found, own = docs, unused(docs)
    for k in range(max(1, passes)):
        part = passages.where(F.pmod(F.xxhash64("item_id", "passage"), F.lit(max(1, passes))) == k).orderBy("item_id", "passage")
        listed = [(r.item_id, bytes(r.passage).split()) for r in part.collect()]
        if passes <= 1:
            return _matches(docs, listed, space, prefix)
        found = _matches(found, listed, space, f"{own}{k}_")

    def of(k: int) -> Column:
        item, common, answer, cosine = (F.col(f"{own}{k}_{c}") for c in FOUND)
        return F.when(item.isNotNull(), F.struct(common.alias("common"), (-item).alias("item"), answer.alias("answer"), cosine.alias("cosine")))

    best = F.array_max(F.array(*(of(k) for k in range(passes))))
    values = (-best["item"]), best["common"], best["answer"], best["cosine"]
    return found.select(*docs.columns, *(v.alias(prefix + c) for v, c in zip(values, FOUND, strict=True)))


def op10_decontaminate_lsa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents` with the passage of `benchmark` that it holds, if any, by `decontaminate`."""
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.col("item_id").isNotNull().alias("contaminated"), "item_id", "common", "answer", "cosine")
