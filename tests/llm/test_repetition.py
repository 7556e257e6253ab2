"""Periodic runs and collocations against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from tessera.llm import collocations, periodic
from tessera.llm.common import table

from .helpers import awkward, nothing


def brute_runs(words):
    """By every period, every maximal stretch; a stretch counts for its smallest period."""
    n, seen, out = len(words), set(), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i > start:
                end = i + p
                if end - start >= max(12, 2 * p) and (start, end) not in seen:
                    seen.add((start, end))
                    out.append((start, end - start, p))
            else:
                i += 1
    return sorted(out)


def periodic_words(rnd, n, kinds, stretches):
    words = [rnd.randrange(kinds) for _ in range(n)]
    for _ in range(stretches):
        a, p, e = rnd.randrange(n), rnd.randrange(1, max(2, n // 3)), rnd.randrange(1, n + 1)
        for i in range(a, e):
            words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize("together", [1 << 20, 50])
def test_runs_match_brute_force(monkeypatch, together):
    monkeypatch.setattr(periodic, "TOGETHER", together)
    rnd = random.Random(together)
    for _ in range(1500):
        words = periodic_words(rnd, rnd.choice([1, 11, 12, 13, 40, 90, 200]), rnd.choice([1, 2, 3, 5, 50]), rnd.randrange(4))
        assert periodic.find_runs(np.array(words, np.int32)) == brute_runs(words)


def test_runs_of_long_arrays():
    assert periodic.find_runs(np.zeros(300_000, np.int32)) == [(0, 300_000, 1)]
    assert periodic.find_runs(np.arange(200_000, dtype=np.int32) % 77) == [(0, 200_000, 77)]
    assert periodic.find_runs(np.arange(200_000, dtype=np.int32)) == []
    many = np.concatenate([np.arange(1000) + 1000 * k if k % 2 else np.full(1000, -1) for k in range(100)]).astype(np.int32)
    assert periodic.find_runs(many) == [(1000 * k, 1000, 1) for k in range(0, 100, 2)]


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    s, m, q = best or (None, None, None)
    digests = ("".join(f"{a},{b},{c}\n" for a, b, c in runs), " ".join(w for i, w in enumerate(words) if i not in gone))
    return (doc_id, len(runs), s, m, q, 1000 * m // q if best else None, *(hashlib.sha256(x.encode()).hexdigest() for x in digests))


def test_op11_matches_brute_force(spark, sf):
    docs = table(spark, sf, "documents").toPandas()
    want = sorted(brute_row(d, t) for d, t in zip(docs.doc_id, docs.text, strict=True) if len(t.split()) < 1500)
    ids = {r[0] for r in want}
    got = sorted(tuple(r) for r in periodic.op11_periodic_runs(spark, sf).collect() if r.doc_id in ids)
    assert got == want and sum(r[1] > 0 for r in want) >= 10


def test_runs_awkward(spark):
    docs = awkward(spark).withColumnRenamed("fp", "runs")
    extra = spark.createDataFrame([(40, "ab " * 40, *[None] * 6), (41, "x y " * 6, *[None] * 6), (42, "x y " * 5, *[None] * 6)], docs.schema)
    docs = docs.unionByName(extra)
    out = periodic.periodic_runs(docs, "_")
    assert out.columns == [*docs.columns, "_runs", "_collapsed"] and out.count() == docs.count()
    rows = {r.doc_id: r for r in out.where("doc_id >= 20").collect()}
    assert [tuple(x) for x in rows[40]["_runs"]] == [(0, 40, 1)] and rows[40]["_collapsed"] == "ab"
    assert [tuple(x) for x in rows[41]["_runs"]] == [(0, 12, 2)] and rows[42]["_collapsed"] == "x y x y x y x y x y"
    assert all(rows[k]["_collapsed"] == "" and rows[k]["_runs"] == [] for k in (21, 22, 23))
    assert rows[24]["_collapsed"] == "word" and len(rows[25]["_collapsed"].split()) == 30_000 and "\U0001f600" in rows[26]["_collapsed"]
    assert periodic.periodic_runs(nothing(spark)).count() == 0


def brute_phrases(rows, least, longest=5):
    """lang, text rows -> (phrases of a language with their counts, number of words of each language)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang, " ".join(words[i : i + m])] += 1
    return {k: a for k, a in f.items() if a >= least}, n


def brute_collocations(rows, least, best):
    f, n = brute_phrases(rows, least)
    out = []
    for (lang, phrase), a in f.items():
        words = phrase.split(" ")
        if len(words) < 2 or any(l == lang and len(p.split(" ")) > len(words) and f" {phrase} " in f" {p} " and b >= a for (l, p), b in f.items()):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, " ".join(words[:k])], f[lang, " ".join(words[k:])]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, phrase, a, left, right, n[lang], score))
    ranked = []
    for lang in n:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:best]
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(own)]
    return sorted(ranked)


@pytest.mark.parametrize(("shard", "best"), [(1, 2000), (300, 7), (2_000_000, 2000)])
def test_collocations_match_brute_force(spark, shard, best):
    rnd = random.Random(shard)
    words = ["New", "YORK", "of", "the", "a", "b", "c", "é", "İ", "x\x00", "\x85y", "漢字", "end."]
    rows = [(rnd.choice(["en", "en", "de", None, "und", ""]), "".join(rnd.choice(words) + rnd.choice([" ", " ", "\t", ", ", "\n", "  "]) for _ in range(rnd.randrange(120)))) for _ in range(60)]
    rows += [("en", None), ("fr", ""), ("fr", " . "), ("xx", "only once"), ("en", rows[0][1]), ("en", "a b " * 300)]
    docs = spark.createDataFrame([(*r, i, "p", 1) for i, r in enumerate(rows)], "lang string, text string, a long, phrase string, words int")
    got = collocations.collocations(docs, least=5, best=best, shard=shard)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows, 5, best)


def test_phrases_whose_hashes_collide(spark, monkeypatch):
    """A filter of few bits lets all pairs through; counts stay exact."""
    monkeypatch.setattr(collocations, "LEAST_BITS", 64)
    monkeypatch.setattr(collocations, "MOST_BITS", 64)
    rnd = random.Random(3)
    rows = [("en", " ".join(rnd.choice("abcdefgh") for _ in range(50))) for _ in range(40)]
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), least=4)
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows, 4, 2000)


def test_products_beyond_64_bits(spark, monkeypatch):
    """Counts as of a corpus of 10^13 words: 1000 a n and l r pass 64 bits."""
    big = 10**13
    counts = spark.createDataFrame([("en", "a b", 2, big // 9), ("en", "a", 1, big // 7), ("en", "b", 1, big // 3)], "lang string, phrase string, words int, a long")
    totals = spark.createDataFrame([("en", big)], "lang string, n long")
    monkeypatch.setattr(collocations, "phrases", lambda *_: (counts, totals))
    row = collocations.collocations(counts).first()
    assert row.score == 1000 * (big // 9) * big // ((big // 7) * (big // 3))


def test_longer_phrases_are_cut_at_triples_that_are_not_frequent():
    """All pairs of 12 words are frequent here, hardly any triple is: what is left to count are the planted phrase and its neighbours, not every place."""
    rnd = random.Random(6)
    texts = [" ".join(["p q r s", *(rnd.choice("abcdefghijkl") for _ in range(40))]) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], ["lang", "text"])
    passing = SimpleNamespace(value=np.full(1024, -1, np.int64))
    twos = pa.Table.from_batches(collocations._pairs_and_triples(10**6, passing)(iter([batch])))
    triples = twos.filter(pc.and_(pc.equal(twos["words"], 3), pc.greater_equal(twos["a"], 100)))
    mask = np.zeros(1024, np.int64)
    for h in triples["pair"].to_pylist():
        mask[h % 65536 >> 6] |= np.uint64(1 << h % 64).astype(np.int64)
    left = pa.Table.from_batches(collocations._phrases(10**6, 5, passing, SimpleNamespace(value=mask))(iter([batch]))).to_pylist()
    got = {r["phrase"]: r["a"] for r in left}
    assert (got["p q r"], got["q r s"], got["p q r s"]) == (200, 200, 200)
    assert len(left) < 100 < twos.num_rows


def test_triples_between_frequent_ones_are_cut():
    """The triples at places 0 and 2 pass, that at 1 does not: no phrase has it. A frequent run is the same when it is dealt and cut again."""
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 3), pa.array(["a b c d e", "p Q r s, p q r", "c d e"])], ["lang", "text"])
    passing, mask = SimpleNamespace(value=np.full(1024, -1, np.int64)), np.zeros(1024, np.int64)
    for triple in ("abc", "cde", "pqr", "qrs"):
        h = int(collocations._triple_hashes(*(collocations._word_hashes([w.encode()]) for w in triple), b"en")[0])
        mask[h % 65536 >> 6] |= np.uint64(1 << h % 64).astype(np.int64)
    masks = passing, SimpleNamespace(value=mask)
    dealt = pa.Table.from_batches(collocations._frequent_runs(10**6, *masks)(iter([batch])))
    assert [r["text"].split("\n") for r in dealt.to_pylist()] == [["a b c ", " c d e ", " p q r s ", " p q r ", " c d e ", ""]]
    for rows in ([batch], dealt.select(["lang", "text"]).to_batches()):
        got = {r["phrase"]: r["a"] for r in pa.Table.from_batches(collocations._phrases(10**6, 5, *masks)(iter(rows))).to_pylist()}
        assert got == {"a b c": 1, "c d e": 2, "p q r": 2, "q r s": 1, "p q r s": 1}


def test_shards_leave_out_rare_triples_but_no_frequent_one(spark):
    """A shard of half a language's words tells of the triples that occur there as often as half of `least`; a phrase just frequent enough, in parts in both, is found."""
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 60), pa.array(["a b c"] * 50 + ["c b a"] * 10)], ["lang", "text"])
    passing = SimpleNamespace(value=np.full(1024, -1, np.int64))
    rows = pa.Table.from_batches(collocations._pairs_and_triples(10**6, passing, {b"en": 480})(iter([batch]))).to_pylist()
    assert [(r["words"], r["a"]) for r in rows if r["words"] != 2] == [(0, 49), (3, 1)]
    rnd = random.Random(8)
    rows = [("en", " ".join(["x y z w" if i % 3 else "x y z", *(rnd.choice("abcdefgh") for _ in range(30))])) for i in range(90)]
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), least=20, shard=400)
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows, 20, 2000)


@pytest.mark.parametrize("shard", [400, 2_000_000])
def test_a_phrase_is_told_once_however_many_shards_hold_it(spark, monkeypatch, shard):
    """Rows of phrases are the frequent phrases, not those of each shard; so they don't grow with the number of shards."""
    told, kind = spark.sparkContext.accumulator(0), type(spark.range(1))
    made = kind.mapInArrow

    def counting(self, run, schema):
        def counted(batches):
            for b in run(batches):
                told.add(b.num_rows)
                yield b

        return made(self, counted if "phrase" in schema else run, schema)

    monkeypatch.setattr(kind, "mapInArrow", counting)
    rnd = random.Random(9)
    rows = [(rnd.choice(["en", "de"]), " ".join(["x y z w v u", *(rnd.choice("abcdef") for _ in range(30)), "x y z"])) for _ in range(120)]
    f, n = collocations.phrases(spark.createDataFrame(rows, "lang string, text string"), least=30, shard=shard)
    expected, words = brute_phrases(rows, 30)
    assert {(r.lang, r.phrase): r.a for r in f.collect()} == expected
    assert {r.lang: r.n for r in n.collect()} == words
    assert told.value == sum(" " in phrase for _, phrase in expected)


def test_filter_lets_few_others_through(spark):
    """Of hashes that are not in the filter, fewer than one in a thousand passes; of those in it, all do."""
    hashes = np.random.default_rng(4).integers(-(1 << 63), 1 << 63, 120_000, np.int64)
    pairs = spark.createDataFrame(pa.table({"pair": hashes[:20_000]}))
    good = collocations._passes(collocations._filter(pairs, 20_000), hashes.view(np.uint64))
    assert good[:20_000].all() and good[20_000:].sum() < 100


def test_phrases_of_a_hot_and_a_long_text(spark):
    """A third of all words are one pair, and one text without a bound is longer than a piece that is cut at once."""
    rows = [("en", "hot pair " * 600_000)] + [("en", f"w{i} z{i % 3} hot pair") for i in range(300)]
    f, n = collocations.phrases(spark.createDataFrame(rows, "lang string, text string"))
    got = {r.phrase: r.a for r in f.collect()}
    assert got["hot pair"] == 600_300 and got["pair hot"] == 599_999 and got["hot pair hot pair hot"] == 599_998 and got["z1"] == 100 and got["z1 hot"] == 100
    assert n.collect()[0].n == 1_200_000 + 1200


def test_collocations_of_nothing(spark):
    assert collocations.collocations(nothing(spark)).count() == 0
    rows = [(r.lang, r.text) for r in awkward(spark).collect()]
    assert sorted(map(tuple, collocations.collocations(awkward(spark), least=3).collect())) == brute_collocations(rows, 3, 2000)
