"""Near-duplicates of the pipeline against brute force over sets of shingles."""

import random

import numpy as np
import pytest

from tessera.llm import similar
from tessera.llm.common import Scratch
from tessera.llm.simhash import bits_of, keys_of, shingle_hashes

from .helpers import awkward, nothing


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


@pytest.mark.parametrize(("n", "share"), [(30, 0.8), (60, 0.8), (200, 0.8), (1000, 0.8), (60, 0.85), (200, 0.75)])
def test_recall_by_length(n, share):
    """Random pairs of shingle sets at a similarity just at the threshold: proposed by a key and near enough to be compared; exactness decides the rest."""
    rnd, found = np.random.default_rng(n), 0
    common = int(np.ceil(share * 2 * n / (1 + share)))
    for _ in range(300):
        both = rnd.integers(0, 1 << 63, common).astype(np.uint64) * np.uint64(2) + rnd.integers(0, 2, common).astype(np.uint64)
        keys, sketches = [], []
        for _ in range(2):
            h = [np.concatenate([both, rnd.integers(0, 1 << 63, n - common).astype(np.uint64)])]
            least = similar.sketch_of(similar.set_of(h))
            keys.append({*similar.bands_of(least).tolist(), *keys_of(np.array([bits_of(h)]))[0].tolist()})
            sketches.append(similar.octets_of(least))
        found += bool(keys[0] & keys[1]) and (sketches[0] == sketches[1]).mean() >= similar.SIMILARITY - similar.ALLOWANCE
    assert found >= (0.95 if share >= 0.8 else 0.1) * 300


def family(rnd, words, size, edits):
    base = [rnd.choice(words) for _ in range(size)]
    yield base
    for n in edits:
        own = list(base)
        for at in rnd.sample(range(size), n):
            own[at] = rnd.choice(words)
        yield own


def brute_components(texts, least=0.8):
    own, label = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(own[i], own[j]) >= least:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("group", [8192, 16])
def test_components_match_brute_force(spark, monkeypatch, group):
    """Families whose members are near the first text but not near each other; small groups are dealt to several tasks."""
    monkeypatch.setattr(similar, "GROUP", group)
    monkeypatch.setattr(similar, "BIG", 64 if group == 8192 else 4)
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(4000)]
    texts = []
    for size, edits in ((200, [3] * 60), (200, [1, 2, 3, 4, 5, 6, 7] * 3), (60, [1, 1, 2, 2]), (1000, [20, 21, 22]), (400, [])):
        texts += [" ".join(t) for t in family(rnd, words, size, edits)]
    texts += ["one two three", "one two three", "ONE two three", "", None, "one two four"]
    order = list(range(len(texts)))
    rnd.shuffle(order)
    docs = spark.createDataFrame([(i, texts[i]) for i in order], "doc_id long, text string")
    kept = {r.doc_id for r in similar.one_of_each(docs).collect()}
    assert kept == set(brute_components(texts))


def test_bridges_between_components(spark, monkeypatch):
    """Chains whose ends are far apart, and families that meet only through one text, with groups, parts and turns as small as they can be."""
    monkeypatch.setattr(similar, "GROUP", 4)
    monkeypatch.setattr(similar, "BIG", 3)
    monkeypatch.setattr(similar, "PARTNERS", 2)
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    texts = []
    for _ in range(4):
        chain = [rnd.choice(words) for _ in range(300)]
        for k in range(25):  # each text has a stretch of ten other words than the one before
            chain = list(chain)
            chain[k * 12 : k * 12 + 10] = rnd.sample(words, 10)
            texts.append(" ".join(chain))
    for _ in range(3):
        left = [rnd.choice(words) for _ in range(240)]
        right = list(left)
        right[100:140] = rnd.sample(words, 40)
        middle = left[:120] + right[120:]
        texts += [" ".join(middle)]
        for side in (left, right):
            for _ in range(12):
                own = list(side)
                own[rnd.randrange(90)] = rnd.choice(words)
                texts.append(" ".join(own))
    order = list(range(len(texts)))
    rnd.shuffle(order)
    docs = spark.createDataFrame([(i, texts[i]) for i in order], "doc_id long, text string")
    assert {r.doc_id for r in similar.one_of_each(docs).collect()} == set(brute_components(texts))


def test_one_of_each_awkward(spark):
    docs = awkward(spark)
    out = similar.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == [*range(12), 21, 24, 25, 26]
    assert similar.one_of_each(nothing(spark), scratch=Scratch(spark)).count() == 0


def test_keys_are_made_once_and_texts_stay_where_they_are(spark, monkeypatch):
    """Each text's keys are made and dealt once, whatever the sizes of tables; what is left of the texts is told by a broadcast, without a shuffle of texts."""
    rnd, read, keys_of = random.Random(12), spark.sparkContext.accumulator(0), similar._keys

    def counted(batches):
        def seen():
            for b in batches:
                read.add(b.num_rows)
                yield b

        yield from keys_of(seen())

    monkeypatch.setattr(similar, "_keys", counted)
    texts = [" ".join(f"w{rnd.randrange(200)}" for _ in range(40)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate([*texts, *texts[:20], *(t + " more" for t in texts[40:50])])]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = similar.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
        plan = got._jdf.queryExecution().executedPlan().toString()
        ids = sorted(r.doc_id for r in got.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert ids == list(range(60))
    assert read.value == 70
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
