"""Operator 4: language identification of mixed-language text.

Scripts, by ranges of code points, narrow the languages that a word can be in.
Each word has a score by language, from character trigrams with word ends. A
Viterbi pass with a penalty for switching labels spans of words; the language
with most letters is the document's.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import held_out, schema_with, table, values_of, word_pieces

#: Documents of a language that the model is fitted on, at most (a sample by hash of the id); trigrams kept for a language.
FIT_DOCUMENTS, FIT_GRAMS = 2_000, 50_000
#: The sample is taken in so many parts of a language, so that no task sorts all its ids.
SALTS = 200
#: A word's score for a language lies at most SPREAD below its best; a change of language costs SWITCH.
SPREAD, SWITCH = 6.0, 14.0
#: A language uses a script if this share of its letters is in it.
SCRIPT_SHARE = 0.01
#: Words whose scores a task keeps; documents that it labels together.
CACHE, TOGETHER = 400_000, 256

#: Script ranges (fixed values of the Unicode blocks).
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F),
    ("gujarati", 0x0A80, 0x0AFF), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("sinhala", 0x0D80, 0x0DFF),
    ("thai", 0x0E00, 0x0E7F), ("lao", 0x0E80, 0x0EFF), ("tibetan", 0x0F00, 0x0FFF), ("myanmar", 0x1000, 0x109F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("ethiopic", 0x1200, 0x137F), ("khmer", 0x1780, 0x17FF), ("mongolian", 0x1800, 0x18AF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)


def script_of(char: str) -> str:
    c = ord(char)
    return next((name for name, lo, hi in SCRIPTS if lo <= c <= hi), "other")


def letters_of(word: str) -> str:
    return "".join(c for c in word if c.isalpha())


def trigrams(letters: str) -> list[str]:
    w = f" {letters} "
    return [w[i : i + 3] for i in range(len(w) - 2)]


@lru_cache(1)
def _code_points() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter; a bit for its script."""
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    names = sorted({name for name, _, _ in SCRIPTS})
    bit = np.full(0x110000, 1 << len(names), np.int64)  # any other script
    for name, lo, hi in reversed(SCRIPTS):
        bit[lo : hi + 1] = 1 << names.index(name)
    return letter, bit


@dataclass
class LanguageModel:
    languages: list[str]
    scripts: np.ndarray  # bits of the scripts that each language uses
    alphabet: np.ndarray  # code points of the trigrams, ascending
    grams: np.ndarray  # trigrams as numbers in the base of the alphabet, ascending
    weights: np.ndarray  # log-probabilities: a row for each trigram, a last one for any other
    rows: dict[bytes, int] = field(default_factory=dict)
    matrix: np.ndarray | None = None

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row of scores by language, none above zero, and the number of letters of each word; no letter or no language with its scripts: zeros."""
        letter, bit = _code_points()
        at = np.frombuffer(f" {' '.join(words)} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        at = at[letter[at] | (at == 32)]
        inside = np.flatnonzero(at != 32)
        word = np.cumsum(at == 32)[inside] - 1
        letters = np.bincount(word, minlength=len(words))
        base = len(self.alphabet) + 1
        digit = np.searchsorted(self.alphabet, at)
        digit = np.where(self.alphabet[np.minimum(digit, base - 2)] == at, digit, base - 1) if base > 1 else np.zeros(len(at), np.int64)
        gram = (digit[inside - 1] * base + digit[inside]) * base + digit[inside + 1]
        row = np.searchsorted(self.grams, gram)
        row = np.where(self.grams[np.minimum(row, len(self.grams) - 1)] == gram, row, len(self.grams)) if len(self.grams) else np.zeros(len(gram), np.int64)
        scores = np.zeros((len(words), len(self.languages)))
        used = np.zeros(len(words), np.int64)
        if len(inside):
            edge = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            scores[word[edge]] = np.add.reduceat(self.weights[row], edge, axis=0)
            used[word[edge]] = np.bitwise_or.reduceat(bit[at[inside]], edge)
        fit = (used[:, None] & ~self.scripts[None, :]) == 0
        known = fit.any(axis=1) & (letters > 0)
        best = np.where(fit, scores, -np.inf).max(axis=1, initial=-np.inf)
        best[~known] = 0.0
        scores = np.where(fit, np.maximum(scores - best[:, None], -SPREAD), -SPREAD)
        scores[~known] = 0.0
        return scores, letters

    def learn(self, words: set[bytes]) -> None:
        """Scores words that the task has not met."""
        if self.matrix is None or len(self.rows) > CACHE:
            self.rows, self.matrix = {}, np.zeros((1024, len(self.languages) + 1))
        new = list(words.difference(self.rows))
        if not new:
            return
        scores, letters = self.word_scores([w.decode("utf-8", "surrogatepass") for w in new])
        start = len(self.rows)
        while start + len(new) > len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
        self.matrix[start : start + len(new), :-1], self.matrix[start : start + len(new), -1] = scores, letters
        self.rows.update(zip(new, range(start, start + len(new)), strict=True))

    def label(self, words: list[bytes], parts: list[tuple[int, int, str]] | None = None) -> tuple[str, float, int]:
        """Language with most letters, its share of the letters, number of spans; und, 0, 0 without letters. The words have been learnt; first word, end and language of each span are added to `parts`."""
        if not words or not self.languages:
            return "und", 0.0, 0
        got = self.matrix[np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))]
        n = got[:, -1]
        letters = n.sum()
        if not letters:
            return "und", 0.0, 0
        path, spans = viterbi(got[:, :-1], SWITCH)
        if parts is not None:
            edge = [*np.flatnonzero(np.r_[True, path[1:] != path[:-1]]).tolist(), len(path)]
            parts += [(s, e, self.languages[path[s]]) for s, e in zip(edge, edge[1:], strict=False)]
        if spans == 1:
            return self.languages[path[0]], 1.0, 1
        share = np.bincount(path, weights=n, minlength=len(self.languages)) / letters
        best = int(share.argmax())
        return self.languages[best], float(share[best]), spans

    def labels(self, texts: list[str | None]) -> list[tuple[str, float, int]]:
        out: list[tuple[str, float, int]] = []
        for i in range(0, len(texts), TOGETHER):
            lists = list(map(words_of, texts[i : i + TOGETHER]))
            self.learn(set().union(*lists))
            out += map(self.label, lists)
        return out


def words_of(text: str | None) -> list[bytes]:
    return [w for piece in word_pieces((text or "").encode("utf-8", "surrogatepass")) for w in piece]


def viterbi(s: np.ndarray, switch: float) -> tuple[np.ndarray, int]:
    """Best labels of the rows of s, where a change costs `switch`, and the number of spans; ties go to the first language.

    One label is best throughout if no run of words gains more than the
    penalty by leaving it: leaving for j runs costs j changes at least.
    """
    total = s.sum(axis=0)
    best = int(total.argmax())
    gain = np.cumsum(s - s[:, [best]], axis=0)
    floor = np.minimum(np.minimum.accumulate(gain, axis=0), 0)
    floor = np.vstack([np.zeros((1, s.shape[1])), floor[:-1]])
    if float((gain - floor).max(initial=0.0)) <= switch:
        return np.full(len(s), best), 1
    n, k = s.shape
    back = np.empty((n, k), np.int32)
    stay = np.arange(k)
    d = s[0].copy()
    for t in range(1, n):
        m = int(d.argmax())
        move = d < d[m] - switch
        back[t] = np.where(move, m, stay)
        d = np.where(move, d[m] - switch, d) + s[t]
    path = np.empty(n, np.int64)
    path[-1] = int(d.argmax())
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path, 1 + int((path[1:] != path[:-1]).sum())


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams: Counter = Counter()
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words: Counter = Counter()
            for piece in word_pieces((text or "").lower().encode("utf-8", "surrogatepass")):
                words.update(piece)
            for w, n in words.items():
                if letters := letters_of(w.decode("utf-8", "surrogatepass")):
                    for g in trigrams(letters):
                        grams[lang, "g", g] += n
                    for c in letters:
                        grams[lang, "s", script_of(c)] += n
    keys = list(grams)
    yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(3)), pa.array([grams[k] for k in keys], pa.int64())], ["lang", "kind", "gram", "n"])


def fit(docs: DataFrame, documents: int = FIT_DOCUMENTS) -> LanguageModel:
    """docs (doc_id, text, lang): rows to learn from, at most `documents` of a language; rows without a language are left out."""
    ids = docs.where("lang is not null").select("lang", "doc_id", F.xxhash64("doc_id").alias("_h"))
    order = Window.partitionBy("lang", F.pmod("_h", F.lit(SALTS))).orderBy("_h", "doc_id")
    sample = ids.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max(1, documents // SALTS)).select("doc_id").distinct()
    rows = docs.where("lang is not null").join(F.broadcast(sample), "doc_id", "left_semi").select("lang", "text")
    counts = rows.mapInArrow(_gram_counts, "lang string, kind string, gram string, n bigint").groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "gram")
    got = counts.withColumn("_n", F.row_number().over(top)).where(F.col("_n") <= FIT_GRAMS).select("lang", "kind", "gram", "n").collect()
    languages = sorted({r.lang for r in got})
    at = {x: i for i, x in enumerate(languages)}
    total, letters = [0.0] * len(languages), [0.0] * len(languages)
    for r in got:
        (total if r.kind == "g" else letters)[at[r.lang]] += r.n
    grams = sorted({r.gram for r in got if r.kind == "g"})
    alphabet = np.array(sorted({ord(c) for g in grams for c in g}), np.int64)
    base, digit = len(alphabet) + 1, {int(c): i for i, c in enumerate(alphabet)}
    number = {g: (digit[ord(g[0])] * base + digit[ord(g[1])]) * base + digit[ord(g[2])] for g in grams}  # in the order of grams
    place = {g: i for i, g in enumerate(grams)}
    size = 0.5 * (len(grams) + 1)
    weights = np.tile([math.log(0.5 / (t + size)) for t in total], (len(grams) + 1, 1))
    scripts, names = np.zeros(len(languages), np.int64), [*sorted({name for name, _, _ in SCRIPTS}), "other"]
    for r in got:
        i = at[r.lang]
        if r.kind == "g":
            weights[place[r.gram], i] = math.log((r.n + 0.5) / (total[i] + size))
        elif r.n >= SCRIPT_SHARE * letters[i]:
            scripts[i] |= 1 << names.index(r.gram)
    return LanguageModel(languages, scripts, alphabet, np.array([number[g] for g in grams], np.int64), weights)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score (share of the letters that spans of lang_pred hold), spans. Only the text is looked at.

    A null text, one without letters, and any text under a model of no
    documents are `und` with score 0; of languages with equal letters the first
    by name is taken. Each row is labelled by itself, repeated or not; an empty
    table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [x for i in range(0, b.num_rows, TOGETHER) for x in model.labels(b.column(1).slice(i, TOGETHER).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array([x[2] for x in got], pa.int64())], ["doc_id", "lang_pred", "score", "spans"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema_with(docs.select("doc_id"), lang_pred="string", score="double", spans="long"))


def language_spans(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, first_word, end_word, lang: the labelled spans of each text, in words between white space; no row for a text that is `und`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[int] = []
            found: list[tuple[int, int, str]] = []
            for i, text in enumerate(values_of(b.column(1))):
                words, own = words_of(text), []
                model.learn(set(words))
                model.label(words, own)
                rows += [i] * len(own)
                found += own
            spans = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *spans], ["doc_id", "first_word", "end_word", "lang"])

    return docs.select("doc_id", "text").mapInArrow(run, schema_with(docs.select("doc_id"), first_word="long", end_word="long", lang="string"))


def op4_language_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of `documents`, by `identify` with a model of those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    found = identify(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "spans")
