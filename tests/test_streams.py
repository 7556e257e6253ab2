"""Streams that are stopped and started again, and the data source of files."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import optimize
from tessera.plans import views
from tessera.sources import assets
from tessera.streaming import optimizing, running


def put(folder, files):
    os.makedirs(folder, exist_ok=True)
    for name, data in files.items():
        (folder / name).write_bytes(data)


def made(k):
    return {f"a{k}.svg": f"<svg><!-- {k} --><g  id='x'></g></svg>".encode(), f"b{k}.gltf": b'{"asset": {"version": "2.0"}, "meshes": [] }', f"c{k}.txt": b"no asset"}


def rows(df):
    return sorted((os.path.basename(r.path), r.format, r.strategy, bytes(r.content)) for r in df.collect())


def test_optimised_stream_stops_and_starts(spark, tmp_path):
    source, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")

    def turn():
        optimizing.optimize_stream(optimizing.arriving(spark, str(source), most_files=2), out, check, 50, once=True).awaitTermination()

    put(source, made(0))
    turn()
    put(source, made(1))
    turn()
    turn()  # nothing new
    whole = spark.read.format("binaryFile").load(str(source)).select("path", "content")
    assert rows(optimizing.results(spark, out)) == rows(optimize.optimize(whole, 50))
    # As if the query had been stopped after its last batch was written, but before it was noted.
    last = max(int(n) for n in os.listdir(f"{check}/commits") if n.isdigit())
    os.remove(f"{check}/commits/{last}")
    crc = f"{check}/commits/.{last}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    turn()
    assert rows(optimizing.results(spark, out)) == rows(optimize.optimize(whole, 50))


def test_running_metrics_outlive_batches(spark, sf, tmp_path):
    log = views.log(spark, sf)
    want = {r.event_id: r for r in running.running_table(log).collect()}
    folder, check, out = str(tmp_path / "log"), str(tmp_path / "check"), str(tmp_path / "out")
    schema = log.schema
    for k in range(3):
        log.where(F.floor(F.col("event_id") / 400) == k).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        query = running.running_stream(stream).writeStream.format("parquet").option("checkpointLocation", check).option("path", out).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    got = {r.event_id: r for r in spark.read.parquet(out).collect()}
    assert set(got) == {i for i in want if i < 1200} and len(got) >= 900
    for i, r in got.items():
        w = want[i]
        assert (r.family, r.n, r.bytes, r.violations, r.longest) == (w.family, w.n, w.bytes, w.violations, w.longest) and r.total_ms == pytest.approx(w.total_ms)


def test_late_rows_count_when_they_come(spark, tmp_path):
    schema = "event_id long, family string, elapsed_ms double, size long"
    folder, check, out = str(tmp_path / "log"), str(tmp_path / "check"), str(tmp_path / "out")
    for rows_ in ([(5, "image", 10.0, 1), (3, "image", 200.0, 1)], [(1, "image", 50.0, 1), (9, "mesh", 1.0, 1)]):
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        running.running_stream(stream).writeStream.format("parquet").option("checkpointLocation", check).option("path", out).trigger(availableNow=True).start().awaitTermination()
    got = {r.event_id: (r.n, r.violations, r.longest, r.total_ms) for r in spark.read.parquet(out).collect()}
    assert got == {3: (1, 1, 200.0, 200.0), 5: (2, 1, 200.0, 210.0), 1: (3, 1, 200.0, 260.0), 9: (1, 0, 1.0, 1.0)}


def test_files_are_written_under_their_names_and_read_by_conditions(spark, tmp_path):
    assets.register(spark)
    files = [("a.png", b"\x89PNG\r\n\x1a\nxx"), ("b.gif", b"GIF89a.."), ("c.bin", b""), ("d.png", b"\x89PNG\r\n\x1a\n" + b"y" * 100_000)]
    df = spark.createDataFrame(files, "name string, content binary").repartition(3)
    df.write.format("assets").mode("append").save(str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["a.png", "b.gif", "c.bin", "d.png"]
    back = spark.read.format("assets").load(str(tmp_path / "out"))
    assert sorted((r.name, bytes(r.content)) for r in back.collect()) == files
    assert {r.name for r in back.where("format = 'image:Png'").collect()} == {"a.png", "d.png"}
    assert {r.name for r in back.where("format in ('image:Png', 'image:Gif') and name like 'b%'").collect()} == {"b.gif"}
    assert back.where("length > 1000").count() == 1
    spark.createDataFrame([("z.bin", b"1")], df.schema).write.format("assets").mode("overwrite").save(str(tmp_path / "out"))
    assert os.listdir(tmp_path / "out") == ["z.bin"]


def test_reader_opens_only_what_is_wanted(tmp_path):
    put(tmp_path, {"a.png": b"\x89PNG\r\n\x1a\n", "b.gif": b"GIF89a"})
    reader = assets.AssetReader(f"file://{tmp_path}")
    left = list(reader.pushFilters([assets.EqualTo(("name",), "b.gif"), assets.EqualTo(("length",), 3)]))
    assert [f.attribute for f in left] == [("length",)]
    assert [[os.path.basename(p) for p, _ in part.paths] for part in reader.partitions()] == [["b.gif"]]
    reader.format.add(assets.In(("format",), ("image:Png",)))
    assert [list(reader.read(p)) for p in reader.partitions()] == [[]]


@pytest.mark.parametrize("bad", [("x/y.png", b"1"), (None, b"1"), ("c.bin", None), ("a.png", b"twice")])
def test_a_failed_task_leaves_nothing(spark, tmp_path, bad):
    assets.register(spark)
    df = spark.createDataFrame([("a.png", b"1"), ("b.png", b"2"), bad], "name string, content binary").repartition(3)
    with pytest.raises(Exception):  # noqa: B017, PT011
        df.write.format("assets").mode("append").save(str(tmp_path / "out"))
    out = tmp_path / "out"
    assert not out.exists() or all(n.startswith(assets.STAGED) for n in os.listdir(out))
    os.makedirs(out, exist_ok=True)
    assert spark.read.format("assets").load(str(out)).count() == 0


def test_the_driver_sees_folders_where_files_are_many(tmp_path, monkeypatch):
    import pickle
    from types import SimpleNamespace

    monkeypatch.setattr(assets, "ENOUGH", 4)
    names = [f"part_{k}.bin" for k in range(400)]
    writer = assets.AssetWriter(f"file://{tmp_path}", False)
    # Folder 0 comes from both tasks.
    sent = [writer.write(SimpleNamespace(name=n, content=b"GIF89a" + n.encode(), folder=str(k % 8)) for k, n in enumerate(names) if k % 8 and k % 2 == t or k % 16 == 8 * t) for t in range(2)]
    moved = []
    monkeypatch.setattr(assets, "_put", lambda where, part, folder, put=assets._put: (moved.append(folder), put(where, part, folder)))
    writer.commit(sent)
    assert len(moved) == 9 and sorted(os.listdir(tmp_path)) == sorted(map(str, range(8)))
    reader = assets.AssetReader(f"file://{tmp_path}")
    parts = reader.partitions()
    assert len(parts) == 8 and b"part_" not in pickle.dumps(parts)
    assert sorted(n for p in parts for b in reader.read(p) for n in b.column(1).to_pylist()) == sorted(names)
    reader.name.add(assets.EqualTo(("name",), "part_17.bin"))
    assert [b.column(4).to_pylist() for p in reader.partitions() for b in reader.read(p)] == [[b"GIF89apart_17.bin"]]


def test_files_are_dealt_to_folders_by_their_names(spark, tmp_path, monkeypatch):
    assets.register(spark)
    monkeypatch.setattr(assets, "FOLDER", 16)
    out = tmp_path / "out"

    def back():
        return sorted((r.name, bytes(r.content)) for r in spark.read.format("assets").load(str(out)).collect())

    df = spark.range(100).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), F.encode(F.col("id").cast("string"), "UTF-8").alias("content")).repartition(3)
    assets.dealt(df).write.format("assets").mode("append").save(str(out))
    assert sorted(os.listdir(out)) == [str(k) for k in range(7)]
    assert back() == sorted((f"n{k}", str(k).encode()) for k in range(100))
    # Files of names that are there are replaced, as in one folder.
    assets.dealt(df.withColumn("content", F.encode(F.lit("new"), "UTF-8"))).write.format("assets").mode("append").save(str(out))
    assert back() == sorted((f"n{k}", b"new") for k in range(100))
    with pytest.raises(Exception, match="two files of one name"):
        assets.dealt(df.union(df.where("name = 'n7'"))).write.format("assets").mode("append").save(str(out))
    with pytest.raises(Exception, match="two files of one name"):  # in two tasks
        df.where("name = 'n7'").union(df.where("name = 'n7'")).withColumn("folder", F.lit("f")).write.format("assets").mode("append").save(str(out))
    assert len(back()) == 100
    df.limit(1).write.format("assets").mode("overwrite").save(str(out))
    assert len(os.listdir(out)) == len(back()) == 1
