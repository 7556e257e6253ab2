"""Operator 5: toxicity by maximum-scoring segments.

Words get log-odds between toxic and other labelled documents, under Dirichlet
priors that follow the words' overall frequencies. Words whose log-odds are
significant score them; every other word costs a small drift, so that the
expected score is negative. A linear scan (Ruzzo and Tompa) finds all
maximal-scoring segments of a text. By the extreme-value law of such segments
a text of n words has K n exp(-lambda S) segments of score S by chance; their
surprises are added up over a text and mapped to the share of label 1 among
the labelled documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, bounded, held_out, schema_with, table, values_of, word_pieces

#: Labelled documents that the model is fitted on, at most (a sample by hash of the id).
FIT_DOCUMENTS = 20_000
#: A word counts as evidence from this many toxic documents, this z score and these log-odds on.
LEAST_DOCUMENTS, LEAST_Z, LEAST_ODDS = 5, 3.0, 1.5
#: Weight of the Dirichlet prior, in words, and the least of any word; cost of a word that is no evidence; expected chance segments up to which a passage is significant.
PRIOR_WEIGHT, PRIOR_LEAST, DRIFT, SIGNIFICANT = 500.0, 0.5, 0.05, 0.05
THRESHOLD = 0.3

#: Words also count by their first bytes, so that unseen words with a known beginning score. Words whose scores a task keeps.
BEGINNINGS, CACHE = (6, 8), 200_000

_APART = bytes.maketrans(bytes(c for c in range(128) if not chr(c).isalnum()), b" " * sum(not chr(c).isalnum() for c in range(128)))


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[bytes, float]
    decay: float  # lambda
    k: float
    intercept: float
    slopes: tuple[float, float]
    memo: dict[bytes, float] = field(default_factory=dict, compare=False)

    def statistics(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words; all maximal-scoring segments as first word, end, score."""
        n, hits = 0, []
        memo = self.memo
        if len(memo) > CACHE:
            memo.clear()
        for words in word_pieces((text or "").lower().encode("utf-8", "surrogatepass").translate(_APART)):
            for w in set(words).difference(memo):
                memo[w] = max((self.weights.get(f, 0.0) for f in features(w)), default=0.0)
            hits += [(n + i, s) for i, s in enumerate(map(memo.__getitem__, words)) if s]
            n += len(words)
        return n, maximal_segments(hits)

    def surprises(self, n: int, segments: list[tuple[int, int, float]]) -> list[float]:
        """-ln of the number of segments that chance would bring; not below zero."""
        return [max(0.0, self.decay * s - math.log(self.k * n)) for _, _, s in segments]

    def score(self, surprises: list[float]) -> float:
        x = self.intercept + self.slopes[0] * math.log1p(max(surprises, default=0.0)) + self.slopes[1] * math.log1p(sum(surprises))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def features(word: bytes) -> list[bytes]:
    """The word, and its beginnings, marked by an end that no word has."""
    return [word, *(word[:k] + b"*" for k in BEGINNINGS if len(word) >= k)]


def maximal_segments(hits: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments, where position i scores s for (i, s) in hits and -drift elsewhere; linear in the hits."""
    found: list[list[float]] = []  # first, end, sum before the first, sum at the end
    total, at = 0.0, 0
    for i, s in hits:
        total -= drift * (i - at)
        at = i + 1
        seg = [i, i + 1, total, total + s]
        total += s
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= seg[2]:
                j -= 1
            if j < 0 or found[j][3] >= seg[3]:
                found.append(seg)
                break
            seg = [found[j][0], seg[1], found[j][2], seg[3]]
            del found[j:]
    return [(int(a), int(b), hi - lo) for a, b, lo, hi in found]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for b in batches:
        for text, toxic in zip(values_of(b.column(0)), b.column(1).to_pylist(), strict=True):
            words: set[bytes] = set()
            for piece in word_pieces((text or "").lower().encode("utf-8", "surrogatepass").translate(_APART)):
                words.update(piece)
            counts[toxic].update({f for w in words for f in features(w)})
    words = list(counts[0].keys() | counts[1].keys())
    yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([counts[1][w] for w in words], pa.int64()), pa.array([counts[0][w] for w in words], pa.int64())], ["word", "toxic", "other"])


def fit(docs: DataFrame, labels: DataFrame, documents: int = FIT_DOCUMENTS) -> ToxicityModel:
    """docs (doc_id, text), labels (doc_id, toxic): rows to learn from; at most `documents` of them are read.

    With no label of either kind every score is the share of label 1. Of
    several labels of an id the largest counts; rows of a repeated id all count.
    Words that are equally telling all weigh; a word takes its best feature.
    """
    scratch = Scratch(docs.sparkSession)
    labels = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    sample = scratch.write(bounded(labels, documents, "doc_id"), "toxic-labels")
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")
    counts = rows.mapInArrow(_word_counts, "word binary, toxic bigint, other bigint").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    counts = scratch.write(counts, "toxic-counts")
    n1, n0 = (x or 0 for x in counts.agg(F.sum("toxic"), F.sum("other")).first())
    prior = F.lit(PRIOR_LEAST) + F.lit(PRIOR_WEIGHT / max(1, n1 + n0)) * (F.col("toxic") + F.col("other"))
    a, b = F.col("toxic") + prior, F.col("other") + prior
    odds = F.log(a / (F.lit(n1 + PRIOR_WEIGHT) - a)) - F.log(b / (F.lit(n0 + PRIOR_WEIGHT) - b))
    scored = counts.where(F.col("toxic") >= LEAST_DOCUMENTS).select("word", odds.alias("odds"), (odds / F.sqrt(1 / a + 1 / b)).alias("z"), "other") if n1 and n0 else None
    weights = {bytes(r.word): r.odds for r in scored.where((F.col("z") >= LEAST_Z) & (F.col("odds") > LEAST_ODDS)).collect()} if scored is not None else {}
    model = ToxicityModel(weights, 1.0, 1.0, 0.0, (0.0, 0.0))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.statistics(t) for t in values_of(b.column(0))]
            scores = [[s for _, _, s in seg] for _, seg in got]
            yield pa.RecordBatch.from_arrays([b.column(1).cast(pa.int32()), pa.array([n for n, _ in got], pa.int64()), pa.array(scores, pa.list_(pa.float64()))], ["toxic", "n", "scores"])

    model = _calibrated(model, scratch.write(rows.mapInArrow(scan, "toxic int, n bigint, scores array<double>"), "toxic-seen"))
    scratch.drop("toxic-counts", "toxic-seen", "toxic-labels")
    return model


def _calibrated(model: ToxicityModel, seen: DataFrame) -> ToxicityModel:
    """seen (toxic, n, scores): label, words and segment scores of each fitted document. Only sums, and pairs of rounded features with their number, reach the driver."""
    total = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x)
    words, chances, summed = seen.where("toxic = 0").agg(F.sum("n"), F.sum(F.size("scores")), F.sum(total)).first()
    words, chances, summed = 1 + (words or 0), chances or 0, summed or 0.0
    # The density of positive scores among words of clean documents; lambda solves E[exp(lambda score)] = 1.
    share, mean = (chances + 0.5) / words, (summed + 1.0) / (chances + 0.5)
    lo, hi = 1e-6, 20.0
    for _ in range(80):
        mid = (lo + hi) / 2
        value = math.log(share) + mid * mean if mid * mean > 500 else math.log(share * math.exp(mid * mean) + (1 - share) * math.exp(-mid * DRIFT))
        lo, hi = (lo, mid) if value > 0 else (mid, hi)
    decay = lo
    # K makes the expected number of chance segments that reach the mean score equal to what was seen.
    k = max(1e-9, share * math.exp(decay * mean))
    up = F.transform("scores", lambda x: F.greatest(F.lit(0.0), F.lit(decay) * x - F.log(F.lit(k) * F.col("n"))))
    most, every = F.coalesce(F.array_max("up"), F.lit(0.0)), F.aggregate("up", F.lit(0.0), lambda a, x: a + x)
    rounded = seen.withColumn("up", up).groupBy("toxic", F.round(F.log1p(most), 3).alias("most"), F.round(F.log1p(every), 3).alias("every")).agg(F.count("*").alias("often"))
    met = rounded.orderBy("toxic", "most", "every").toArrow()
    y, often = met.column("toxic").to_numpy().astype(np.float64), met.column("often").to_numpy().astype(np.float64)
    x = np.stack([np.ones(len(y)), met.column("most").to_numpy(), met.column("every").to_numpy()], axis=1)
    ridge = np.array([1e-6, 0.1, 0.1])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(often @ (np.logaddexp(0, z) - y * z) + ridge @ (w * w) / 2)

    ones, all_of = float(often @ y), float(often.sum())
    w = np.array([math.log((ones + 0.5) / (all_of - ones + 0.5)), 0.0, 0.0])
    for _ in range(30):  # damped Newton steps of a logistic regression with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step, size = np.linalg.solve((x * (often * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (often * (y - p)) - ridge * w), 1.0
        while size > 1e-4 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
    return ToxicityModel(model.weights, decay, k, float(w[0]), (float(w[1]), float(w[2])))


def score(docs: DataFrame, model: ToxicityModel, prefix: str = "") -> DataFrame:
    """All columns of docs (with a column text), then toxic_score, toxic_passages, toxic_words, behind the prefix.

    A null or empty text has no passage and the score that this has. Passages
    are those that chance brings less than SIGNIFICANT times into a text of
    that length; toxic_words counts their words.
    """
    at = docs.columns.index("text")
    names = [*docs.columns, *(prefix + c for c in ("toxic_score", "toxic_passages", "toxic_words"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = -math.log(SIGNIFICANT)
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for text in values_of(b.column(at)):
                n, segments = model.statistics(text)
                up = model.surprises(n, segments)
                passages = [s for s, u in zip(segments, up, strict=True) if u >= least]
                for column, value in zip(out, (model.score(up), len(passages), sum(e - a for a, e, _ in passages)), strict=True):
                    column.append(value)
            extra = [pa.array(out[0], pa.float64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names)

    return docs.mapInArrow(run, schema_with(docs, **dict(zip(names[-3:], ("double", "long", "long"), strict=True))))


def fit_on_tables(spark: SparkSession, docs: DataFrame, sf_dir: str) -> ToxicityModel:
    """Labels of held-out ids are not read into the model."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out())
    return fit(docs, labels)


def op5_toxicity_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every whole text of `documents`, by `score` with a model fitted on labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, fit_on_tables(spark, docs, sf_dir))
    return found.select("doc_id", held_out().alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"), "toxic_passages", "toxic_words")
