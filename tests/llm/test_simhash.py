import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import simhash, similar
from tessera.llm.common import Scratch
from tessera.llm.components import connected_components

from .helpers import awkward, nothing

WORDS = st.integers(0, 2**16 - 1)


def brute_fingerprint(text, width=3):
    words = [w for w in (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(rows):
            for j, (_, b) in enumerate(rows):
                if (a ^ b).bit_count() <= 3 and label[j] > label[i]:
                    label[j], changed = label[i], True
    return [min((d for (d, _), k in zip(rows, label, strict=True) if k == own and d is not None), default=None) for own in label]


def test_components_match_brute_force(spark):
    docs = awkward(spark)
    got = simhash.simhash_components(docs).collect()
    assert len(got) == docs.count()
    text = {}
    for r in docs.collect():
        text.setdefault(r.doc_id, brute_fingerprint(r.text))
    rows = [(r.doc_id, r.fp % (1 << 64)) for r in got]
    assert all(fp == text[d] for d, fp in rows)
    assert [r.component_id for r in got] == brute_components(rows)


def test_empty(spark):
    assert simhash.simhash_components(nothing(spark)).count() == 0
    assert similar.one_of_each(nothing(spark)).count() == 0


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(random.Random(1).choice(["a", "bb", "ccc", "dd"]) for _ in range(3000))
    want = brute_fingerprint(text)
    monkeypatch.setattr("tessera.llm.common.PIECE", 100)
    assert simhash.fingerprint(text) % (1 << 64) == want


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=3))
def test_linking_fingerprints_share_a_key(x, bits):
    y = x
    for b in bits:
        y ^= 1 << b
    pair = np.array([x, y], np.uint64).view(np.int64)
    keys, owner = simhash.keys_of(pair[:1])[0], simhash.keys_of(pair[1:])[0]
    assert set(keys.tolist()) & set(owner.tolist())


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**23 - 1), st.integers(0, 22))
def test_words_one_bit_apart_share_a_codeword(v, bit):
    a, b = (simhash.codeword_keys(np.array([w], np.int64))[1] for w in (v, v ^ (1 << bit)))
    assert set(a.tolist()) & set(b.tolist())


def test_fingerprint_edges_span_what_brute_force_links(spark):
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(30)]
    fps = sorted({b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(6))) & (2**64 - 1) for b in base for _ in range(12)})
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    label = {r.node: r.label for r in connected_components(simhash.fingerprint_edges(df), Scratch(spark)).collect()}
    groups = {}
    for f in fps:
        groups.setdefault(label.get(simhash._signed(f), f), set()).add(f)
    want = brute_components([(f, f) for f in fps])
    truth = {}
    for f, k in zip(fps, want, strict=True):
        truth.setdefault(k, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, truth.values()))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (400, 500), (7, 7)], "a long, b long")
    found = {r.node: r.label for r in connected_components(edges, Scratch(spark)).collect()}
    assert len({found[i] for i in range(201)}) == 1 and found[400] == found[500] != found[0]


def test_one_of_each(spark):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    rows, groups = [], []
    for g in range(25):
        text = [rnd.choice(words) for _ in range(200)]
        rows.append((10 * g, " ".join(text)))
        for k in range(1, 4):
            copy = list(text)
            copy[rnd.randrange(200)] = "changed"
            rows.append((10 * g + k, " ".join(copy)))
        groups.append(10 * g)
    rows += [(900, None), (901, ""), (None, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in similar.one_of_each(docs).collect()) == [*groups, 900]


def test_one_of_each_keeps_columns_and_distinct_texts(spark):
    docs = awkward(spark)
    kept = similar.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(3) == 1 and 20 not in ids and None not in ids and {0, 1, 2, 4, 24, 25, 26} <= set(ids)


def test_large_groups_lose_no_link():
    rnd = np.random.default_rng(12)
    base = rnd.integers(-(1 << 63), 1 << 63, 60)
    fp = np.unique(np.concatenate([base, *(base ^ (1 << rnd.integers(0, 62, 60)) for _ in range(20)), *(base ^ (1 << rnd.integers(0, 62, 60)) ^ (1 << rnd.integers(0, 62, 60)) for _ in range(20))]))

    def parts(edges):
        label = {x: x for x in fp.tolist()}

        def root(x):
            while label[x] != x:
                x = label[x]
            return x

        for x, y in zip(*(e.tolist() for e in edges), strict=True):
            low, high = sorted((root(x), root(y)))
            label[high] = low
        return [root(x) for x in fp.tolist()]

    assert parts(simhash.split_links(fp, 3)) == parts(simhash.links(fp, 3))
