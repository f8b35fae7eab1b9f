import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempera.operators.store import SampleStore
from tempera.plans.settings import RunSettings
from tempera.sources import blocks, config, record, results, text
from tempera.streaming.deposit import stream_deposits


@pytest.fixture(scope="module")
def samples(spark):
    return spark.range(250).select(
        F.array((F.col("id") / 3.0), -F.col("id").cast("double"), F.lit(0.1)).alias("data"),
        F.col("id").cast("int").alias("id"),
        (-F.col("id") / 7.0).alias("weight"),
        (F.col("id") % 2 == 0).alias("calculated"),
    )


def rows(df):
    return sorted((r["id"], list(r["data"]), r["weight"], r["calculated"]) for r in df.collect())


def test_record_layout(tmp_path, spark):
    spark.dataSource.register(record.SampleRecordSource)
    raw = b"".join(
        struct.pack("<i21did?", 21, *[float(k + i) for k in range(21)], i, -1.5 * i, i % 2 == 0) for i in range(3)
    )
    assert len(raw) == 3 * 185
    (tmp_path / "0.0.0.1.record").write_bytes(raw)
    got = rows(spark.read.format("sample_record").load(str(tmp_path)))
    assert got[2] == (2, [float(k + 2) for k in range(21)], -3.0, True)
    (tmp_path / "0.0.1.1.record").write_bytes(raw[:-1])
    with pytest.raises(Exception, match="whole number"):
        spark.read.format("sample_record").load(str(tmp_path)).collect()


def test_record_roundtrip_in_slices(tmp_path, spark, samples, monkeypatch):
    spark.dataSource.register(record.SampleRecordSource)
    path = str(tmp_path / "run")
    samples.repartition(3).write.format("sample_record").mode("append").save(path)
    assert rows(spark.read.format("sample_record").load(path)) == rows(samples)
    monkeypatch.setattr(record, "SLICE_BYTES", 200)
    reader = record._Reader({"path": path})
    parts = reader.partitions()
    assert len(parts) > 20
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 250
    samples.limit(5).write.format("sample_record").mode("overwrite").save(path)
    assert spark.read.format("sample_record").load(path).count() == 5


def test_text_and_binary_convert_both_ways(tmp_path, spark, samples):
    spark.dataSource.register(record.SampleRecordSource)
    text.write_samples(samples, str(tmp_path / "t"))
    assert rows(text.read_samples(spark, str(tmp_path / "t"))) == rows(samples)
    text.text_to_binary(spark, str(tmp_path / "t"), str(tmp_path / "b"))
    text.run_to_text(spark, str(tmp_path / "b"), str(tmp_path / "t2"))
    assert rows(text.read_samples(spark, str(tmp_path / "t2"))) == rows(samples)


def test_posterior_draw_lines(tmp_path, spark):
    (tmp_path / "p.txt").write_text("-1.5 -9.0 0.1 0.2 0.3\n\n 2.5\t1.0  4 5 6 \n")
    got = text.read_posterior_draws(spark, str(tmp_path / "p.txt")).orderBy("weight").collect()
    assert [(r["weight"], r["data"]) for r in got] == [(-1.5, [0.1, 0.2, 0.3]), (2.5, [4.0, 5.0, 6.0])]
    short = text.read_posterior_draws(spark, str(tmp_path / "p.txt"), dim=2).orderBy("weight").first()
    assert short["data"] == [0.1, 0.2]


def test_draw_ids_are_line_numbers(tmp_path, spark):
    folder = tmp_path / "draws"
    folder.mkdir()
    (folder / "b.txt").write_text("".join(f"-{i} 0 {i}\n" for i in range(40, 70)))
    (folder / "a.txt").write_text("".join(f"-{i} 0 {i}\n" + ("\n" if i % 3 == 0 else "") for i in range(40)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("64", "134217728"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = {r["id"]: r["data"] for r in text.read_posterior_draws(spark, str(folder)).collect()}
            few = {r["id"]: r["data"] for r in text.read_posterior_draws(spark, str(folder), draws=45).collect()}
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", was)
        assert got == {i: [float(i)] for i in range(70)} and few == {i: [float(i)] for i in range(45)}
    with pytest.raises(ValueError, match="fewer than 71"):
        text.read_posterior_draws(spark, str(folder), draws=71)


def test_run_files_carry_level_and_bin(tmp_path, spark, samples):
    placed = samples.select("*", (F.col("id") % 3).cast("int").alias("level"), (F.col("id") % 2).cast("int").alias("bin")).repartition(3)
    record.write_records(placed, str(tmp_path / "run"))
    names = sorted(p.name for p in (tmp_path / "run").iterdir())
    assert len({n.split(".")[0] + "." + n.split(".")[1] for n in names}) == 6 and all(record.RUN_FILE.fullmatch(n) for n in names)
    record.write_records(samples.limit(4), str(tmp_path / "run"))
    back = record.read_records(spark, str(tmp_path / "run"), placed=True)
    assert {(r["id"], r["level"], r["bin"]) for r in back.where("level >= 0").collect()} == {(i, i % 3, i % 2) for i in range(250)}
    assert back.where("level = -1 AND bin = -1").count() == 4 and record.read_records(spark, str(tmp_path / "run")).count() == 254
    text.run_to_text(spark, str(tmp_path / "run"), str(tmp_path / "lines"))
    lines = text.from_lines(spark.read.text(str(tmp_path / "lines")), "level", "bin")
    assert sorted((r["level"], r["bin"], r["id"]) for r in lines.where("level >= 0").collect()) == sorted((i % 3, i % 2, i) for i in range(250))


SECTIONS = """//*** heading ***//
//== switch ==//   // comment 12
203

//  //== switch ==//
//   99
//== ratio ==//  %5
0.75   %only this, not 0.55
//== picks_iv ==//
3
 1 5
 7   // 8 9
//== switch ==//
4
//== panel ==//  dates and two series
2 3
1975.25 1.0e+003 -2.5D
1975.50 3 4 trailing words 5
"""


def test_tagged_sections(tmp_path, spark):
    (tmp_path / "in.prn").write_text(SECTIONS.replace("-2.5D", "-2.5"))
    sections = config.read_sections(spark, str(tmp_path / "in.prn")).drop("file").cache()
    got = {}
    for r in sections.orderBy("section", "ordinal").collect():
        got.setdefault(r["section"], []).append(r["value"])
    assert got["switch"] == [203.0] and got["ratio"] == [0.75]
    assert got["picks_iv"] == [3.0, 1.0, 5.0, 7.0]
    full = config.read_sections(spark, str(tmp_path / "in.prn"))
    vector = config.vector_section(full, "picks_iv").orderBy("pos").collect()
    assert [r["value"] for r in vector] == [1.0, 5.0, 7.0]
    panel = config.panel_section(full, "panel", ["a", "b"]).drop("file").orderBy("dt").collect()
    assert [tuple(r) for r in panel] == [(1975.25, 1000.0, -2.5), (1975.5, 3.0, 4.0)]


def test_blocks_and_scheme(tmp_path, spark):
    made = [np.arange(6.0).reshape(3, 2), np.ones((3, 1))]
    (tmp_path / "blocks").write_bytes(blocks.encode_blocks(made))
    back = blocks.read_blocks(spark, str(tmp_path / "blocks"))
    assert all((a == b).all() for a, b in zip(made, back)) and len(back) == 2
    assert blocks.encode_blocks(made)[:24] == struct.pack("<QQQ", 2, 3, 2)
    assert blocks.encode_blocks(made)[24:48] == struct.pack("<ddd", 0.0, 2.0, 4.0)
    (tmp_path / "scheme").write_bytes(blocks.encode_scheme([[0, 2], [1]]))
    assert blocks.read_scheme(spark, str(tmp_path / "scheme")) == [[0, 2], [1]]
    assert blocks.read_scheme(spark, str(tmp_path / "missing")) == []
    table = blocks.blocks_from_table(blocks.blocks_table(spark, {4: made}))
    assert all((a == b).all() for a, b in zip(made, table[4]))


def test_store_life_cycle(tmp_path, spark, samples):
    store = SampleStore(spark, str(tmp_path / "s"), capacity=30)
    put = samples.select(
        F.col("id").cast("long").alias("id"), "data", "weight",
        (F.col("id") % 2).cast("int").alias("level"), F.when(F.col("id") < 200, 0).otherwise(1).alias("bin"),
    )
    for part in range(5):
        store.deposit(put.where(F.col("id") % 5 == part))
    assert store.scan().count() == 250 and store.number_of_bins(1) == 2
    before = sorted(tuple(r) for r in store.counts().collect())
    store.compact(0)
    assert sorted(tuple(r) for r in store.counts().collect()) == before
    files = store.files().where("level = 0").toPandas()
    assert (files["n"] <= 30).all() and (~files["full"]).groupby(files["bin"]).sum().max() <= 1
    bounds = spark.createDataFrame([(0, 0, -100.0), (0, 1, 10.0)], "level int, bin int, lo double")
    store.rebin(0, bounds)
    moved = store.scan(0, 1).agg(F.min(-F.col("weight"))).first()[0]
    assert moved >= 10.0 and store.scan(0).count() == 125
    store.drop_level(1)
    assert store.is_empty(1) and not store.is_empty(0) and store.scan().count() == 125


def test_scan_prunes_partitions(tmp_path, spark, samples):
    store = SampleStore(spark, str(tmp_path / "s"))
    store.deposit(samples.select(F.col("id").cast("long").alias("id"), "data", "weight", F.lit(2).alias("level"), F.lit(0).alias("bin")))
    plan = store.scan(2, 0).select("weight")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(level" in plan and "data" not in plan.split("ReadSchema")[1]


def test_streamed_files_are_deposited_once(tmp_path, spark, samples):
    source = str(tmp_path / "in")
    frame = samples.select(F.col("id").cast("long").alias("id"), "data", "weight", F.lit(0).alias("level"))
    frame.limit(100).write.parquet(source)
    bounds = spark.createDataFrame([(0, 0, 0.0), (0, 1, 5.0)], "level int, bin int, lo double")
    store = SampleStore(spark, str(tmp_path / "store"))

    def run():
        stream = spark.readStream.schema(frame.schema).parquet(source)
        stream_deposits(stream, bounds, store, str(tmp_path / "cp")).awaitTermination()

    run()
    assert store.scan().count() == 100
    run()
    assert store.scan().count() == 100
    frame.where("id >= 200").write.mode("append").parquet(source)
    run()
    assert store.scan().count() == 150


def _binned(spark, n):
    bins = F.when(F.col("id") % 3 == 0, 1).otherwise(0).cast("int")
    return spark.range(n).select(
        "id", F.array(F.col("id").cast("double")).alias("data"), (-F.col("id") / 7.0).alias("weight"),
        (F.col("id") % 2).cast("int").alias("level"), bins.alias("bin"),
    )


@pytest.mark.parametrize("dies", ["before the rows", "after half of the rows", "before the commit", "after the commit"])
def test_an_epoch_that_breaks_off_counts_once(tmp_path, spark, monkeypatch, dies):
    frame = _binned(spark, 120).select("level", "id", "data", "weight")
    source = str(tmp_path / "in")
    frame.write.parquet(source)
    bounds = spark.createDataFrame([(0, 0, 0.0), (0, 1, 5.0), (1, 0, 0.0)], "level int, bin int, lo double")
    store = SampleStore(spark, str(tmp_path / "store"))
    write, commit = store.write_attempt, store.commit_attempt

    def failing_write(samples, writer, epoch):
        if dies == "after half of the rows":
            write(samples.where("id < 60"), writer, epoch)
        if dies.startswith(("after half", "before the rows")):
            raise RuntimeError("executor lost")
        return write(samples, writer, epoch)

    def failing_commit(writer, epoch, attempt):
        if dies == "after the commit":
            commit(writer, epoch, attempt)
        raise RuntimeError("driver lost")

    def run():
        stream = spark.readStream.schema(frame.schema).parquet(source)
        stream_deposits(stream, bounds, store, str(tmp_path / "cp")).awaitTermination()

    monkeypatch.setattr(store, "write_attempt", failing_write)
    monkeypatch.setattr(store, "commit_attempt", failing_commit)
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.undo()
    for _ in range(2):
        run()
        assert sorted(r["id"] for r in store.scan().collect()) == list(range(120))
    assert store.counts().groupBy().sum("n").first()[0] == 120
    for level in (0, 1):
        store.compact(level)
    stored = spark.read.parquet(store.path)
    assert stored.count() == 120 and stored.where("deposit IS NOT NULL").count() == 0


def test_only_one_of_two_attempts_counts(tmp_path, spark):
    store = SampleStore(spark, str(tmp_path / "store"))
    store.deposit(_binned(spark, 10))
    first, second = (store.write_attempt(_binned(spark, 30).where("id >= 10"), "w", 0) for _ in range(2))
    assert store.scan().count() == 10 and not store.is_committed("w", 0)
    assert store.commit_attempt("w", 0, second) and not store.commit_attempt("w", 0, first)
    assert sorted(r["id"] for r in store.scan().collect()) == list(range(30))
    store.deposit_once(_binned(spark, 40).where("id >= 30"), "other", 0)
    assert store.scan().count() == 40
    pool = store.draw_pool(200, 3)
    assert pool.count() == 800 and set(r["id"] for r in pool.collect()) <= set(range(40))


def test_pool_reads_rows_by_place(tmp_path, spark):
    from tempera.functions.counter_rng import uniform

    store = SampleStore(spark, str(tmp_path / "store"), capacity=7)
    store.deposit_in_order(_binned(spark, 101).repartition(5), "id")
    assert store.files().count() > 10
    pool = store.draw_pool(60, 5)
    plan = pool._jdf.queryExecution().executedPlan().toString()  # the samples, and the places they are picked at
    assert plan.count("FileScan parquet") == 2 and "Sort " not in plan and "SortMergeJoin" not in plan
    got = {(r["level"], r["bin"], r["pick"]): r["id"] for r in pool.collect()}
    for level in (0, 1):
        for b in (0, 1):
            ids = [i for i in range(101) if i % 2 == level and (i % 3 == 0) == (b == 1)]
            u = uniform(np.full(60, (level << 32) | b), np.arange(60), 5)
            assert [got[level, b, k] for k in range(60)] == [ids[int(x * len(ids))] for x in u]


def test_settings_and_results(tmp_path, spark):
    made = RunSettings(run_id="abc", levels=4, draws=77)
    results.save_settings(spark, made, str(tmp_path / "settings"))
    assert results.load_settings(spark, str(tmp_path / "settings")) == made
    summary = {r["name"]: r["value"] for r in results.run_summary(spark, made).collect()}
    assert summary["draws"] == "77" and len(summary["temperatures"].split()) == 5
    long = spark.createDataFrame([(1.0, "a", 2.0), (1.0, "b", 3.0)], "dt double, var string, value double")
    wide = results.wide_result(long, ["dt"], "var", "value", ["a", "b"])
    results.write_result(wide, str(tmp_path / "wide"))
    assert [tuple(r) for r in wide.collect()] == [(1.0, 2.0, 3.0)]


def test_bare_paths_follow_the_default_file_system(tmp_path, spark, samples):
    folder = tmp_path / "deep folder"
    record.write_records(samples.limit(7), str(folder))
    assert record.qualified(spark, str(folder)).startswith("file:/")
    assert record.read_records(spark, str(folder)).count() == 7 and list(folder.glob("*.record"))
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "viewfs://elsewhere/")
    conf.set("fs.viewfs.mounttable.elsewhere.link./data", f"file://{tmp_path}")
    try:
        assert record.qualified(spark, "/data/x") == "viewfs://elsewhere/data/x"
    finally:
        conf.set("fs.defaultFS", before)


def test_files_of_different_dimension(tmp_path, spark):
    for name, dim in (("0.0.0.0.record", 2), ("0.0.1.0.record", 3)):
        raw = np.zeros(4, record.record_type(dim))
        raw["dim"], raw["id"] = dim, range(4)
        (tmp_path / name).write_bytes(raw.tobytes())
    got = record.read_records(spark, str(tmp_path)).groupBy(F.size("data").alias("d")).count().collect()
    assert sorted((r.d, r["count"]) for r in got) == [(2, 4), (3, 4)]


def test_run_as_text_keeps_level_and_bin(tmp_path, spark):
    for name, ident in (("0.1.0.0.record", 5), ("0.1.1.3.record", 6), ("2.0.0.0.record", 7)):
        raw = np.zeros(1, record.record_type(2))
        raw["dim"], raw["id"] = 2, ident
        (tmp_path / name).write_bytes(raw.tobytes())
    text.run_to_text(spark, str(tmp_path), str(tmp_path / "out"))
    ids = lambda place: sorted(r["id"] for r in text.read_samples(spark, str(tmp_path / "out" / place)).collect())
    assert ids("level=0/bin=1") == [5, 6] and ids("level=2/bin=0") == [7]


def test_block_files_are_all_read(tmp_path, spark):
    for k in range(3):
        (tmp_path / f"b{k}").write_bytes(blocks.encode_blocks([np.full((2, 2), float(k)), np.ones((2, 1))]))
    got = blocks.block_files(spark, str(tmp_path)).collect()
    assert len(got) == 9 and sorted({v for r in got for v in r["vec"]}) == [0.0, 1.0, 2.0]
    with pytest.raises(ValueError, match="several files"):
        blocks.read_blocks(spark, str(tmp_path))


def test_posterior_draws_have_ids_of_their_own(tmp_path, spark):
    (tmp_path / "p.txt").write_text("".join(f"-{i} 0 1 2\n" for i in range(50)))
    assert text.read_posterior_draws(spark, str(tmp_path / "p.txt")).select("id").distinct().count() == 50


def test_store_without_capacity_compacts_by_bytes(tmp_path, spark, samples):
    store = SampleStore(spark, str(tmp_path / "s"))
    put = samples.select(F.col("id").cast("long").alias("id"), "data", "weight", F.lit(0).alias("level"), F.lit(0).alias("bin"))
    for part in range(4):
        store.deposit(put.where(F.col("id") % 4 == part))
    store.compact(0)
    assert store.files().count() == 1 and store.scan().select("id").distinct().count() == 250
