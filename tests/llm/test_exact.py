"""Operators with exact answers: token files, chats, nearest neighbours."""

import os
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, queries, tokens, vptree
from tessera.llm.common import Scratch, table

from .helpers import awkward, nothing

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Hello, world... don't 3.5%", "a<|endoftext|>b", "İstanbul ΣΑΣ é́", "", None, "x\x85y\xa0z", "#### $$$ a.,b"]


def plain_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(TOKENIZER).encode(text or "", add_special_tokens=False).ids, tokens.END]


def test_encoder_gives_the_tokenizer_s_ids():
    assert [x.tolist() for x in tokens.WordEncoder(TOKENIZER).encode_all(TEXTS)] == [plain_ids(t) for t in TEXTS]


def test_token_file_round_trip(spark):
    docs = awkward(spark)
    scratch = Scratch(spark)
    rows = tokens.tokenize(docs, TOKENIZER, scratch).orderBy("start").collect()
    given = sorted(((r.doc_id, plain_ids(r.text)) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, len(x[1])))
    assert [r.doc_id for r in rows] == [k for k, _ in given]
    start = 0
    for r, (_, ids) in zip(rows, given, strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [x.tolist() for x in tokens.read_document(spark, scratch.path("tokens"), 26)] == [dict(given)[26]]
    assert len(tokens.read_document(spark, scratch.path("tokens"), 3)) == 3
    assert tokens.tokenize(nothing(spark), TOKENIZER).count() == 0


def test_token_file_names_its_dictionary(spark):
    scratch = Scratch(spark)
    tokens.write_tokens(awkward(spark), scratch.path("tokens"), TOKENIZER)
    spark.createDataFrame([("0" * 64, bytearray(b"other dictionary"))], "dictionary string, bytes binary").write.mode("overwrite").parquet(f"{scratch.path('tokens')}/dictionary")
    with pytest.raises(ValueError):
        tokens.read_tokens(spark, scratch.path("tokens"))


@pytest.mark.parametrize("text", ["a\\b <| c <\\| \\\\", "<|im_end|>\n<|im_start|>user\nhi", "<|esc|>", "\\", "<\\\\|", "", "plain"])
def test_chat_escape_is_reversible(spark, text):
    rows = [(1, 0, "user", text), (1, 1, "assistant", text), (1, 2, text, "x"), (2, None, None, None)]
    back = chat.read_chats(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    for r in back.collect():
        assert r.turns == r.source
        assert r.loss == ("" if r.conv_id == 2 else text)


def test_chat_awkward(spark):
    kinds = "conv_id long, turn long, role string, text string, formatted string, turns int"
    rows = [(None, 0, "user", "a", "x", 1), (None, 1, "assistant", "b", "x", 1), (5, 1, "user", "again", None, None), (5, 1, "user", "again", None, None), (5, None, "system", "first", None, None), (-1, 0, "user", "own", None, None)]
    chats = spark.createDataFrame(rows, kinds)
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(chats)).collect()}
    assert all(r.turns == r.source for r in got.values()) and set(got) == {None, 5, -1}
    assert [t.text for t in got[5].turns] == ["first", "again", "again"] and got[None].loss == "b"
    assert chat.read_chats(chat.format_chats(chats.limit(0))).count() == 0


def test_chat_matches_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from read_parquet('{sf}/conversations.parquet')")
    got = chat.op8_chat_grammar(spark, sf)
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(con.sql(f"select {','.join(got.columns)} from ({queries.ORACLE_SQL['op8_chat_grammar']})").fetchall())
    assert all(r[-1] for r in rows)
    assert "Python" not in got._jdf.queryExecution().toString() and "Pandas" not in got._jdf.queryExecution().toString()


def brute_nearest(ids, x, query, k):
    score = (x * x[ids == query][0]).sum(axis=1)
    return [i for _, i in sorted((-s, i) for s, i in zip(score, ids.tolist(), strict=True) if i != query)][:k]


def test_exact_search_with_factor_one(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(900, 8)) * rnd.uniform(0.1, 3, (900, 1))
    tree = vptree.Tree.build(x)
    rows, score, _ = tree.search(x[:50], 10, 1.0)
    truth = np.sort(-(x[:50] @ x.T), axis=1)[:, :10]
    assert np.allclose(-score, truth)


def test_nearest_on_the_table(spark, sf):
    e = table(spark, sf, "embeddings").toPandas()
    ids, x = e.vec_id.to_numpy(), np.array(e.embedding.tolist(), np.float64)
    found = vptree.op7_vantage_point_trees(spark, sf).toPandas().sort_values(["query_id", "rank"])
    recall = [len(set(g.vec_id) & set(brute_nearest(ids, x, q, 20))) / 20 for q, g in found.groupby("query_id")]
    assert np.mean(recall) >= 0.9 and set(found.query_id) == {i for i in ids.tolist() if i % 20 == 0}
    for r in found.head(200).itertuples():
        assert r.score == pytest.approx(float(x[ids == r.query_id][0] @ x[ids == r.vec_id][0]), abs=1e-12)


def test_equal_products_go_by_the_smaller_id(spark):
    rows = [(i, [1.0, float(i % 97) / 7, float(i) / 100]) for i in range(2000)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(5000, [1.0, 0.0, 0.0])] * 2, "vec_id long, embedding array<double>")
    for shard, leaf in ((10_000, 16), (300, 16)):
        assert [r.vec_id for r in vptree.nearest(vectors, asked, 20, shard=shard, leaf=leaf).orderBy("rank").collect()] == list(range(20))


def test_pruning_keeps_recall_on_clusters():
    rnd = np.random.default_rng(8)
    centres = rnd.normal(size=(40, 16)) * 2
    x = centres[rnd.integers(0, 40, 6000)] + 0.3 * rnd.normal(size=(6000, 16))
    tree = vptree.Tree.build(x, leaf=32)
    truth = np.argsort(-(x[:200] @ x.T), axis=1, kind="stable")[:, :20]
    share, recall = {}, {}
    for factor in (1.0, 1.25, 2.0):
        row, _, visited = tree.search(x[:200], 20, factor)
        share[factor], recall[factor] = visited / 200 / len(x), np.mean([len(set(a) & set(b)) / 20 for a, b in zip(row, truth, strict=True)])
    assert recall[1.0] == 1 and recall[1.25] >= 0.9
    assert share[2.0] < share[1.25] < share[1.0] < 0.9


def test_shards_that_cannot_hold_a_better_vector_are_left_out(spark):
    rnd = np.random.default_rng(9)
    centres = rnd.normal(size=(6, 8)) * 5
    x = centres[rnd.integers(0, 6, 900)] + 0.2 * rnd.normal(size=(900, 8))
    vectors = spark.createDataFrame([(i, v, "x", 1.0, 2) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, v string, score double, shard int")
    got = vptree.nearest(vectors, vectors.where("vec_id % 30 = 0"), shard=60, leaf=8).toPandas()
    for q, g in got.groupby("query_id"):
        assert g.sort_values("rank").vec_id.tolist() == brute_nearest(np.arange(900), x, q, 20)


def test_nearest_awkward(spark):
    nan = float("nan")
    rows = [(i, [1.0, 0.0]) for i in range(0, 60)] + [(100, [0.5, 0.5]), (101, None), (102, [0.0, 0.0]), (103, [1.0, nan]), (104, [1.0, None]), (None, [1.0, 1.0]), (100, [0.5, 0.5])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = vptree.nearest(vectors, vectors.where("vec_id % 20 = 0")).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert by[0][:20] == list(range(1, 21)) and by[20] == [i for i in range(21) if i != 20][:20] and by[40] == list(range(20))
    assert by[100][:20] == list(range(20)) and set(by) == {0, 20, 40, 100}
    assert vptree.nearest(vectors.limit(0), vectors.limit(0)).count() == 0


def test_pipeline_stages_with_extra_columns(spark):
    """Stages keep columns whose names clash with their own, and drop what they should: copies stay once, planted passages go."""
    import corpus_pipeline

    docs = awkward(spark).withColumns({"row": F.lit(1), "label": F.lit("x"), "rep": F.lit(2), "taken": F.lit(3), "_row": F.lit(4)})
    kept = Scratch(spark).write(dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "/root/testdata/sf0.001"), "kept")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [*range(12), 21, 24, 25, 26]
    benchmark = table(spark, "/root/testdata/sf0.001", "benchmark")
    item = benchmark.orderBy("item_id").first()
    planted = docs.where("doc_id < 3").withColumn("text", F.concat(F.col("text"), F.lit(" " + item.text), F.col("text")))
    left = dict(corpus_pipeline.STAGES)["decontamination"](spark, docs.where("doc_id > 5").unionByName(planted), "/root/testdata/sf0.001")
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {r.doc_id for r in docs.where("doc_id > 5").collect()}
    out = dict(corpus_pipeline.STAGES)["token_ids"](spark, docs, "/root/testdata/sf0.001")
    assert out.count() == docs.count()


def test_pipeline_stages(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.01"
    docs, scratch = table(spark, folder, "documents"), Scratch(spark)
    columns = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, folder), name)
        assert docs.columns == columns and docs.count() > 0
        if name != "mixing":
            assert docs.count() < before
            before = docs.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert out.count() == docs.count() and os.path.exists(folder)
    assert out.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == out.agg(F.sum("n_tokens")).first()[0]
