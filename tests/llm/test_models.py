"""Operators that learn: held-out accuracy and awkward rows."""

import math
import random
import time
import zlib

import numpy as np
import pytest

from tessera.llm import boosting, decontam, langid, mixing, pii, resample, toxicity
from tessera.llm.common import held_out, table

from .helpers import awkward, nothing

SMALL = "/root/testdata/sf0.01"


def test_language_accuracy(spark):
    docs = table(spark, SMALL, "documents")
    rows = langid.op4_language_viterbi(spark, SMALL).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_awkward(spark):
    docs = awkward(spark)
    model = langid.fit(docs.where(~held_out()))
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert {got[i].lang_pred for i in (21, 22, 23)} == {"und"} and got[22].score == 0
    empty = langid.fit(nothing(spark))
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}
    assert langid.identify(nothing(spark), model).count() == 0


def test_language_spans(spark):
    docs = table(spark, SMALL, "documents").where("lang is not null")
    model = langid.fit(docs.where(~held_out()))
    one, two = (docs.where(held_out()).where(f"lang = '{lang}' and length(text) > 300").orderBy("doc_id").first() for lang in model.languages[:2])
    words = [one.text.split()[:40], two.text.split()[:30]]
    mixed = spark.createDataFrame([(1, " ".join(words[0] + words[1])), (2, None), (3, "12 34")], "doc_id long, text string")
    got = langid.language_spans(mixed, model).orderBy("first_word").collect()
    assert [(r.doc_id, r.lang) for r in got] == [(1, one.lang), (1, two.lang)]
    assert abs(got[0].end_word - 40) <= 3 and got[0].end_word == got[1].first_word and got[1].end_word == 70


def test_viterbi_matches_every_path():
    rnd = np.random.default_rng(3)
    for _ in range(300):
        n, k = rnd.integers(1, 7), rnd.integers(1, 4)
        s, switch = rnd.normal(size=(n, k)) * 3, float(rnd.uniform(0, 6))
        paths = np.indices((k,) * n).reshape(n, -1).T
        worth = [s[np.arange(n), p].sum() - switch * (p[1:] != p[:-1]).sum() for p in paths]
        path, spans = langid.viterbi(s, switch)
        own = s[np.arange(n), path].sum() - switch * (path[1:] != path[:-1]).sum()
        assert math.isclose(own, max(worth), abs_tol=1e-9) and spans == 1 + (path[1:] != path[:-1]).sum()


def test_scripts_narrow_candidates(spark):
    rows = [(i, "привет как дела друзья сегодня", "ru") for i in range(5)] + [(10 + i, "hello how are you friends today", "en") for i in range(5)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.labels(["вода hello are you today friends how", "вода", "漢字"])[:2] == [("en", pytest.approx(1 - 4 / 31, abs=0.2), 2), ("ru", 1.0, 1)] or model.labels(["вода"])[0][0] == "ru"


def test_toxicity_accuracy(spark):
    labels = table(spark, SMALL, "labels")
    rows = toxicity.op5_toxicity_segments(spark, SMALL).join(labels, "doc_id").where("held_out").collect()
    y, s = np.array([r.toxic for r in rows]), np.array([r.score for r in rows])
    rank = s.argsort().argsort()
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit >= 0.85 * sum(r.predicted for r in rows) and hit >= 0.6 * y.sum()
    assert auc > 0.75 and all(r.predicted == (r.score >= 0.3) for r in rows)


def test_maximal_segments_match_definition():
    rnd = random.Random(7)

    def brute(scores, lo, hi):
        best = max(((sum(scores[a:b]), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        a, b = best[3], best[4]
        return brute(scores, lo, a) + [(a, b, best[0])] + brute(scores, b, hi)

    for _ in range(300):
        scores = [rnd.choice([-1.0, -1.0, -1.0, 1.5, 2.25, 3.125]) for _ in range(rnd.randrange(1, 14))]
        got = toxicity.maximal_segments([(i, s) for i, s in enumerate(scores) if s > 0], drift=1.0)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute(scores, 0, len(scores))]


def test_toxicity_awkward(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, None), (None, 1), (3, 0), (3, 0)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        model = toxicity.fit(docs.select("doc_id", "text"), known)
        out = toxicity.score(docs, model, "_x_")
        assert out.columns[:-3] == docs.columns and out.count() == docs.count()
        assert all(0 <= r["_x_toxic_score"] <= 1 for r in out.collect())
    assert toxicity.score(nothing(spark), model, "_x_").count() == 0


def test_decontamination_finds_planted_passages(spark):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    pick = lambda n: [rnd.choice(words) for _ in range(n)]
    items = [(i, " ".join(pick(n))) for i, n in enumerate((15, 20, 40, 60, 150))] + [(90, None), (91, ""), (None, "w1 w2 w3")]
    rows = [(i, " ".join(pick(200))) for i in range(60)]
    for i, n in enumerate((15, 20, 40, 60, 150)):
        rows.append((100 + i, " ".join(pick(33 + i)) + " " + items[i][1].upper() + ". " + " ".join(pick(100))))
        near = items[i][1].split()
        near[3], near[9] = "other", "words"  # a paraphrase in the same order
        rows.append((200 + i, " ".join(pick(50) + near + pick(40))))
    rows += [(300, None), (301, ""), (302, "w1")]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {r.doc_id: r.item_id for r in decontam.decontaminate(docs, benchmark).collect() if r.item_id is not None}
    assert found == {**{100 + i: i for i in range(5)}, **{200 + i: i for i in range(5)}}
    assert {r.item_id for r in decontam.decontaminate(docs, benchmark.limit(0)).collect()} == {None}


@pytest.mark.parametrize("n", [1_000, 20_000])
def test_decontamination_finds_copies_whatever_the_size_of_the_benchmark(spark, n):
    rnd = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(20_000)])
    share = 1 / np.arange(1, len(words) + 1)
    pick = lambda k: rnd.choice(words, k, p=share / share.sum()).tolist()
    items = [pick(k) for k in rnd.integers(16, 60, n).tolist()]
    rows, want = [], {}
    for i in range(0, n, n // 100):
        near = [w if k % 6 else "other" for k, w in enumerate(items[i])]  # five words of six in the same order
        for doc, own in ((i, items[i]), (n + i, near)):
            rows.append((doc, " ".join(pick(int(rnd.integers(5, 80))) + own + pick(60))))
            want[doc] = i
    rows += [(2 * n + i, " ".join(pick(150))) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    found = {r.doc_id: r.item_id for r in decontam.decontaminate(docs, benchmark).collect() if r.item_id is not None}
    assert {d: i for d, i in found.items() if d < 2 * n} == want
    assert len(found) - len(want) <= 3  # an item of common words alone can line up with a clean document


@pytest.mark.parametrize(("clean", "copies"), [(40, 20), (4, 2)])
def test_decontamination_of_a_passage_that_a_third_of_all_documents_hold(spark, clean, copies):
    rnd = random.Random(12)
    pick = lambda n: [f"w{rnd.randrange(3000)}" for _ in range(n)]
    item = pick(35)
    rows = [(i, " ".join(pick(150))) for i in range(clean)]
    rows += [(100 + i, " ".join(pick(40 + i) + item + pick(50))) for i in range(copies)]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item)), (8, " ".join(pick(35)))], "item_id long, text string")
    found = {r.doc_id: r for r in decontam.decontaminate(docs, benchmark).collect() if r.item_id is not None}
    assert {d: r.item_id for d, r in found.items()} == {100 + i: 7 for i in range(copies)}
    assert all(r.common == 1 and r.cosine > 0 for r in found.values())


def test_pair_index_against_all_stretches(monkeypatch):
    """Of the stretches in which brute force finds half of a passage in order, with other words between or instead, at least nine in ten are proposed."""
    monkeypatch.setattr(decontam, "PAIRS", 500)
    rnd = np.random.default_rng(6)
    passages = [rnd.integers(0, 400, k) for k in rnd.integers(8, 65, 60).tolist()]
    index = decontam.PairIndex.of(passages)
    texts = []
    for p in passages:
        kept = np.sort(rnd.choice(len(p), int(np.ceil(rnd.uniform(0.5, 1) * len(p))), replace=False))
        own = np.where(np.isin(np.arange(len(p)), kept), p, rnd.integers(1000, 1400, len(p))) if rnd.random() < 0.5 else p[kept]
        texts.append(np.concatenate([rnd.integers(1000, 1400, rnd.integers(0, 90)), own, rnd.integers(1000, 1400, 9)]))
    flat, doc = np.concatenate(texts), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    found = {(j, int(doc[w])) for owner, at in index.candidates(flat, doc) for j, w in zip(owner.tolist(), at.tolist(), strict=True)}
    assert sum((j, j) in found for j in range(len(passages))) >= 0.9 * len(passages)
    assert len(found) < 2 * len(passages)


@pytest.mark.parametrize("copies", [1, 30, 100])
def test_decontamination_however_many_documents_hold_the_passage(spark, copies):
    rnd = random.Random(14)
    pick = lambda n: [f"w{rnd.randrange(2000)}" for _ in range(n)]
    item = pick(40)
    rows = [(i, " ".join(pick(90) + (item if i < copies else []) + pick(40))) for i in range(100)]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item)), (8, " ".join(pick(35)))], "item_id long, text string")
    found = {r.doc_id for r in decontam.decontaminate(docs, benchmark).collect() if r.item_id == 7}
    assert found == set(range(copies))


def test_decontamination_in_several_passes(spark, monkeypatch):
    docs = awkward(spark)
    items = spark.createDataFrame([(i, r.text) for i, r in enumerate(docs.where("doc_id < 6").select("text").distinct().collect())], "item_id long, text string")
    once = decontam.decontaminate(docs, items, "_d_")
    monkeypatch.setattr(decontam, "PASSAGES_AT_ONCE", 2)
    twice = decontam.decontaminate(docs, items, "_d_")
    assert once.columns == twice.columns == [*docs.columns, "_d_item_id", "_d_common", "_d_answer", "_d_cosine"]
    key = lambda r: (str(r.doc_id), str(r.text))
    assert [r["_d_item_id"] is None for r in sorted(once.collect(), key=key)] == [r["_d_item_id"] is None for r in sorted(twice.collect(), key=key)]


def test_longest_common():
    def brute(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rnd = random.Random(3)
    for _ in range(300):
        a, b = ([rnd.choice(b"abcd") for _ in range(rnd.randrange(0, 70))] for _ in range(2))
        assert decontam.longest_common(a, b) == brute(a, b)


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, epochs=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in target]
        rest = total - sum(target.values())
        give = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if give[s] > epochs * sizes[s]]
        if not over:
            return target | give
        target |= {s: epochs * sizes[s] for s in over}


@pytest.mark.parametrize("folder", [None, "/root/testdata/sf0.001"])
def test_mixing(spark, folder):
    docs = table(spark, folder, "documents") if folder else awkward(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.taken <= 2 * r.size for r in rows)
    sizes, taken = {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    want = brute_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-6)
    assert all(abs(taken[s] - want[s]) <= 0.01 * sum(sizes.values()) for s in sizes)
    again = {(r.doc_id, r.size, r.taken) for r in mixing.mix(docs).collect()}
    assert again == {(r.doc_id, r.size, r.taken) for r in rows}


def test_mixed_documents(spark):
    docs = awkward(spark)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert mixing.mix(nothing(spark)).count() == 0 and mixing.mixed(nothing(spark)).count() == 0


def test_resampling_prefers_the_target(spark):
    labels = table(spark, SMALL, "labels").select("doc_id", "quality")
    rows = resample.op1_importance_resampling(spark, SMALL).join(labels, "doc_id", "left").collect()
    chosen = [r for r in rows if r.selected]
    assert len(chosen) == round(0.8 * len(rows)) and min(r.key for r in chosen) >= max(r.key for r in rows if not r.selected)
    share = {q: np.mean([r.selected for r in rows if r.quality == q]) for q in (0, 1)}
    assert share[1] > 0.9 and share[0] < 0.1


def test_resampling_weights_match_brute_force(spark):
    docs = awkward(spark)
    target = docs.where("doc_id < 5")
    model = resample.bag_model(target) - resample.bag_model(docs)
    got = resample.resample(docs, target, keep=0.5).collect()
    assert len(got) == docs.count()
    for r, text in zip(sorted(got, key=lambda r: (r.n_grams, str(r.doc_id))), sorted(docs.collect(), key=lambda r: (max(0, 2 * len((r.text or "").split()) - 1), str(r.doc_id))), strict=True):
        n = len((text.text or "").encode().split())
        assert r.n_grams == max(0, 2 * n - 1)
        assert math.isclose(r.log_weight, sum(model[k].sum() for k in resample.WordHash().buckets(text.text)), abs_tol=1e-6)
    assert resample.resample(nothing(spark), target).count() == 0


def test_buckets_against_plain_sums():
    """Buckets from their definition: CRC-32 of lower-case words, and a product of two of them for a pair."""
    words = "The quick THE fox the quick".lower().split()
    h = [zlib.crc32(w.encode()) for w in words]
    pairs = [((a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) % (1 << 64)) >> 50 for a, b in zip(h, h[1:], strict=False)]
    want = sorted([x % resample.BUCKETS for x in h] + [p % resample.BUCKETS for p in pairs])
    assert sorted(np.concatenate(list(resample.WordHash().buckets("The quick THE\n fox the  quick"))).tolist()) == want


def test_texts_in_pieces(monkeypatch):
    """What is computed of a text does not depend on the length of the pieces that it is cut into."""
    rnd = random.Random(4)
    text = " ".join(rnd.choice(["alpha", "Beta", "gamma,", "delta", "été", "x1"]) for _ in range(2000))
    model = toxicity.ToxicityModel({b"beta": 2.0, b"gamma": 1.5}, 1.0, 0.1, 0.0, (1.0, 1.0))

    def all_of():
        return (
            sorted(np.concatenate(list(resample.WordHash().buckets(text))).tolist()), langid.words_of(text), decontam.words_of(text),
            toxicity.ToxicityModel(model.weights, 1.0, 0.1, 0.0, (1.0, 1.0)).statistics(text),
        )

    whole = all_of()
    monkeypatch.setattr("tessera.llm.common.PIECE", 150)
    assert all_of() == whole


def test_nth_largest(spark, monkeypatch):
    monkeypatch.setattr(resample, "LAST", 5)
    values = [float(x) for x in [1, 5, 5, 5, 2, 9, 9, 3, 3, 3, 3, 3, 3, 0.5, -7]]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for n in range(1, len(values) + 1):
        least, above = resample.nth_largest(df, "v", n)
        assert least == sorted(values, reverse=True)[n - 1] and above == sum(v > least for v in values)


def test_personal_data_matches_plain_patterns(spark):
    import re

    kinds = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]

    def digits(s):
        return [c for c in s if c in "0123456789"]

    def good(k, s):
        n = len(digits(s))
        return [True, all(int(x) <= 255 for x in s.split(".")) if k == 1 else True, 16 <= n <= 19 and pii.luhn("".join(digits(s))), 8 <= n <= 15][k]

    rnd = random.Random(11)
    texts = [r.text or "" for r in table(spark, SMALL, "documents").select("text").limit(300).collect()]
    texts += ["".join(rnd.choice("0123456789" * 2 + "..+  ()-@aé-") for _ in range(rnd.randint(5, 60))) for _ in range(3000)] + ["4111 1111 1111 1111", "a@b.c@d.e", "1.2.3.4.5.6.7.8"]
    for t in texts:
        assert pii.base_spans(t) == [(k, m.start(), m.end()) for k, p in enumerate(kinds) for m in p.finditer(t) if good(k, m[0])]


def test_personal_data_awkward(spark):
    docs = awkward(spark)
    model = pii.fit(docs)
    rows = pii.find_personal_data(docs, model).collect()
    assert len(rows) == docs.count() and all(r.n_email == 0 for r in rows)
    assert pii.find_personal_data(nothing(spark), pii.fit(nothing(spark))).count() == 0
    assert pii.redact("mail a@b.co or +1 234 567 89", pii.base_spans("mail a@b.co or +1 234 567 89")) == "mail [email] or [phone]"


def test_personal_data_planted_loose_forms(spark):
    """Loose forms planted with other seeds into documents that the trees did not see are found, look-alikes stay."""
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    model = pii.fit(docs.where("doc_id % 2 = 0"))
    right, missed, wrong = [0] * 5, [0] * 5, 0
    for r in docs.where("doc_id % 2 = 1 and text is not null").collect():
        for shown, want, met in pii.lessons(r.text, r.doc_id + 1_000_000):
            base = pii.base_spans(shown)
            added = [c for c in model.spans([shown], [base])[0] if c not in base]
            if want is not None and want not in base:
                (right if want in added else missed)[want[0]] += 1
            wrong += sum(c in met and c != want for c in added)
    assert sum(right) / (sum(right) + wrong) >= 0.95
    assert all(x / (x + y) >= 0.9 for x, y in zip(right, missed, strict=True))


def test_personal_data_adds_spans(spark):
    """What the method adds on the given table: numbers of cards that stand together, and secrets, which are no kind of the base patterns."""
    text = {r.doc_id: r.text for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()}
    rows = pii.op9_personal_data(spark, SMALL).collect()
    secrets = [text[r.doc_id][int(s) : int(e)] for r in rows for _, s, e in (x.split(":") for x in r.secrets.split(",") if x)]
    assert len(secrets) >= 10 and all(len(s) == 40 for s in secrets)
    added = [text[r.doc_id][int(s) : int(e)] for r in rows if r.n_added for k, s, e in (x.split(":") for x in r.spans.split(",")) if k == "card"]
    assert added and all(pii.luhn("".join(c for c in a if c.isdigit())) for a in added)
    assert all(r.n_found >= r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows)


def test_boosted_trees_learn():
    rnd = np.random.default_rng(1)
    x = rnd.integers(0, 32, (2000, 4))
    y = ((x[:, 0] > 15) ^ (x[:, 2] > 7)).astype(float)
    model = boosting.fit_trees(x[:1000], y[:1000])
    assert ((model.probability(x[1000:]) > 0.5) == y[1000:]).mean() > 0.97


@pytest.mark.parametrize("text", ["a" * 1_000_000, "a" * 1_000_000 + " x@y.com", "(" * 1_000_000, "+1" * 500_000, "1" * 1_000_000, "1 " * 500_000, "a@" * 300_000, "a at " * 200_000, "x@y.z " * 100_000, ". " * 400_000])
def test_long_texts_take_time_in_proportion(text):
    """One token, or one sign again and again, of a million characters: what a quadratic scan would not end on."""
    start = time.perf_counter()
    base = pii.base_spans(text)
    found = pii.candidates(text, base)
    list(filter(pii._apart(base), found))
    assert time.perf_counter() - start < 10
    assert set(base) <= set(found) and all(text[s:e].strip() == text[s:e] for _, s, e in base[:1000])


def test_wide_addresses_where_signs_meet():
    assert [t[s:e] for t in ("x at at y.com", "mail a.b(at)c (dot) org now", "a at b at c.d", "(at) x.y", "a @ b", "é_1 [at] ü.de") for _, s, e in pii._wide_emails(t)] == ["at at y.com", "a.b(at)c (dot) org", "b at c.d", "é_1 [at] ü.de"]


def test_overlaps_by_bisection():
    rnd = random.Random(5)
    for _ in range(300):
        spans = [(rnd.randrange(4), s, s + rnd.randrange(1, 9)) for s in (rnd.randrange(60) for _ in range(rnd.randrange(8)))]
        apart = pii._apart(spans)
        for s in range(60):
            for e in range(s + 1, min(60, s + 6)):
                assert apart((0, s, e)) == (not any(s < b and a < e for _, a, b in spans))


@pytest.mark.parametrize("n", [1000, 20_000])
def test_cells_leave_out_nothing_that_is_near(monkeypatch, n):
    """Latent search against all products, with and without cells: paraphrases share a direction with their passage and no pair of words has a part in it."""
    monkeypatch.setattr(decontam, "CELLS_FROM", 500)
    rnd = np.random.default_rng(n)
    centres = rnd.normal(size=(40, decontam.RANK))
    unit = (centres[rnd.integers(0, 40, n)] + 0.7 * rnd.normal(size=(n, decontam.RANK))).astype(np.float32)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    target = rnd.integers(0, n, 200)
    window = (unit[target] * rnd.uniform(0.2, 1, (200, 1)) + 0.05 * rnd.normal(size=(200, decontam.RANK))).astype(np.float32)
    length = np.ones(200, np.float32)
    cells = decontam.Cells(list(range(n)), unit)
    assert len(cells.centres) > 20
    got = {(b, j) for b, j, _ in cells.near(window, length)}
    cosine = window @ unit.T
    sure, perhaps = np.argwhere(cosine >= decontam.COSINE + 1e-5), np.argwhere(cosine >= decontam.COSINE - 1e-5)
    assert {tuple(x) for x in sure.tolist()} <= got <= {tuple(x) for x in perhaps.tolist()}
    assert len(sure) > 200


def test_latent_space_takes_nothing_but_frequencies_from_documents(spark):
    from tessera.llm import decontam

    bench = spark.createDataFrame([(k, " ".join(f"w{(k * 7 + i * i) % 40}" for i in range(30))) for k in range(20)], "item_id long, text string")

    def fitted(texts):
        return decontam.fit_space(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench)

    one, other = fitted(["w1 w2", "w3 w4", "w5 w6"]), fitted(["w1 w3", "w2 w5", "w4 w6"])
    assert (one.idf == other.idf).all()
    assert abs(one.project @ one.project[decontam.Terms().of([b"w1", b"w2"])].T - other.project @ other.project[decontam.Terms().of([b"w1", b"w2"])].T).max() < 1e-3
