"""Exact top-k over postings against brute force."""

import math

import numpy as np
import pytest

from tessera.llm import maxscore
from tessera.llm.common import table

SCHEMA = "vec_id long, embedding array<double>, score long, shard int, rank int, index string"


def brute_top(vectors, queries, k=5, scale=256):
    own = {(i, tuple(math.floor(scale * x) if abs(x) < 2**60 else scale * int(x) for x in v)) for i, v in vectors}
    out = []
    for q, v in {(i, tuple(v)) for i, v in queries}:
        ask = [math.floor(scale * x) if abs(x) < 2**60 else scale * int(x) for x in v]
        scored = sorted((-max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(ask, w, strict=True)))), i) for i, w in own if i != q)[:k]
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("shard", [7, 64, None])
@pytest.mark.parametrize("kind", ["normal", "sparse", "ties", "negative"])
def test_matches_brute_force(spark, monkeypatch, shard, kind):
    monkeypatch.setattr(maxscore, "BLOCK", 16)
    monkeypatch.setattr(maxscore, "PART", 5)
    rnd = np.random.default_rng(len(kind))
    x = {
        "normal": lambda: rnd.normal(size=(300, 12)),
        "sparse": lambda: rnd.normal(size=(300, 40)) * (rnd.random((300, 40)) < 0.1),
        "ties": lambda: rnd.integers(-1, 2, (300, 3)).astype(float),
        "negative": lambda: -np.abs(rnd.normal(size=(300, 6))) * np.where(np.arange(300) % 10 == 0, -1, 1)[:, None],
    }[kind]()
    rows = list(enumerate(x.tolist()))
    vectors = spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], SCHEMA)
    got = maxscore.top_scores(vectors, vectors.where("vec_id % 10 = 0"), shard=shard)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, [r for r in rows if r[0] % 10 == 0])


def test_postings_are_left_out():
    """On sparse vectors of uneven length few postings are read, and the answer stays exact."""
    rnd = np.random.default_rng(4)
    x = (rnd.integers(1, 100, (4000, 60)) * (rnd.random((4000, 60)) < 0.08) * rnd.integers(1, 30, (4000, 1))).astype(np.int64)
    shard = maxscore.Shard(np.arange(4000), x)
    for q in range(20):
        score, ids, read = shard.best(x[q], 5)
        want = np.lexsort((np.arange(4000), -(x @ x[q])))[:5]
        assert ids.tolist() == want.tolist() and score.tolist() == (x @ x[q])[want].tolist()
        assert read < 0.5 * x.size


def test_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(10, [1.0, 0.5]), (10, [1.0, 0.5]), (1, [0.0, 0.0]), (2, [-1.0, 2.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [1.0, 1.0]), (7, [0.003, -0.003]), (8, [0.003, -0.003])]
    vectors = spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], SCHEMA)
    fine = [r for r in rows if r[0] in (10, 1, 2, 7, 8)]
    got = maxscore.top_scores(vectors, vectors.where("vec_id in (10, 1, 3, 5)"))
    assert sorted(map(tuple, got.collect())) == brute_top(fine, [r for r in fine if r[0] in (10, 1)])
    assert maxscore.top_scores(vectors.limit(0), vectors).count() == 0
    assert maxscore.top_scores(vectors, vectors.limit(0)).count() == 0
    assert maxscore.top_scores(vectors.where("vec_id = 10"), vectors.where("vec_id = 10")).count() == 0


def test_numbers_that_pass_64_bits(spark):
    rows = [(0, [1e8, -1e8]), (1, [3e8, 1e-3]), (2, [1e25, 1e25]), (3, [-2.5e9, 4e9])]
    vectors = spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], SCHEMA)
    assert sorted(map(tuple, maxscore.top_scores(vectors, vectors).collect())) == brute_top(rows, rows)


def test_op13_on_the_table(spark, sf):
    e = table(spark, sf, "embeddings").toPandas()
    ids, x = e.vec_id.to_numpy(), np.floor(256 * np.array(e.embedding.tolist(), np.float64)).astype(np.int64)
    got = maxscore.op13_maxscore_search(spark, sf).toPandas()
    for q, g in got.groupby("query_id"):
        score = x @ x[ids == q][0]
        want = [i for i in np.lexsort((ids, -score)).tolist() if ids[i] != q][:5]
        g = g.sort_values("rank")
        assert g.vec_id.tolist() == ids[want].tolist() and g.score.tolist() == score[want].tolist() and g["rank"].tolist() == [1, 2, 3, 4, 5]
    assert set(got.query_id) == {i for i in ids.tolist() if i % 50 == 0}
