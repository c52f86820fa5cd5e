from pyspark.sql import functions as F

from loomstone.streaming import changes, windows

ROW = "a string, n long"


def change(seq, cid, row, op, hlc, n=None, device="d1"):
    return (seq, cid, "notes", row, op, None if op == "delete" else f'{{"a":"{row}","n":{n}}}', hlc, device, seq)


def test_clock_is_monotone_and_sorts():
    now = iter([5, 5, 3, 20])
    c = changes.HybridClock(lambda: next(now))
    seen = [c.tick(), c.tick(), c.tick(), c.observe(f"{50:016x}-{7:08x}")]
    assert seen == sorted(seen) and changes.parse(seen[-1]) == (50, 8)


def test_last_writer_wins(spark):
    h = lambda ms: f"{ms:016x}-00000000"
    df = spark.createDataFrame([change(1, "c1", "r", "upsert", h(10), 1), change(2, "c2", "r", "upsert", h(30), 3), change(3, "c3", "r", "upsert", h(20), 2), change(4, "c4", "q", "upsert", h(10), 9), change(5, "c5", "q", "delete", h(15)), change(6, "c1", "r", "upsert", h(10), 1)], changes.SCHEMA)
    empty = spark.createDataFrame([], changes.SCHEMA)
    merged, report = changes.apply_changes(empty, df)
    assert [tuple(r) for r in changes.rows(merged, "notes", ROW).collect()] == [("r", 3)]
    assert dict(report.collect()) == {"applied": 2, "ignored": 3, "duplicate": 1}
    late, _ = changes.apply_changes(merged, spark.createDataFrame([change(7, "c7", "q", "upsert", h(12), 5)], changes.SCHEMA))
    assert changes.rows(late, "notes", ROW).count() == 1


def test_validation(spark):
    df = spark.createDataFrame([change(1, "c1", "r", "upsert", f"{10:016x}-00000000", 1), change(2, "c2", "r", "upsert", f"{10**12:016x}-00000000", 1), change(3, "c3", "r", "rename", f"{10:016x}-00000000", 1), change(4, "c4", "r", "upsert", "zz", 1)], changes.SCHEMA)
    ok, bad = changes.validate(df, now_ms=1000)
    assert ok.count() == 1 and {r.change_id: r.reason for r in bad.collect()} == {"c2": "from the future", "c3": "unknown operation", "c4": "malformed clock"}
    assert changes.conflicts(df.union(spark.createDataFrame([change(9, "c1", "r", "upsert", "x", 2)], changes.SCHEMA))).count() == 1


def test_capture_and_backfill(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k long, s string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (4, "w")], "k long, s string")
    assert sorted((r.row_id, r.operation) for r in changes.capture(a, b, "k", "t").collect()) == [("2", "upsert"), ("3", "delete"), ("4", "upsert")]
    assert changes.backfill(a, "k", "t").count() == 3


def test_stream_of_changes(spark, tmp_path):
    h = lambda ms: f"{ms:016x}-00000000"
    source = str(tmp_path / "in")
    spark.createDataFrame([change(1, "c1", "r", "upsert", h(10), 1)], changes.SCHEMA).write.mode("append").json(source)
    stream = lambda: spark.readStream.schema(changes.SCHEMA).json(source)
    changes.apply_stream(stream(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([change(2, "c2", "r", "upsert", h(20), 2), change(3, "c3", "s", "upsert", h(5), 7)], changes.SCHEMA).write.mode("append").json(source)
    changes.apply_stream(stream(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    last = spark.read.schema(changes.SCHEMA).parquet(str(tmp_path / "out" / "generation=1"))
    assert sorted(map(tuple, changes.rows(last, "notes", ROW).collect())) == [("r", 2), ("s", 7)]


def test_windowed_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01 00:10:00"), (2, "2024-01-01 00:50:00"), (3, "2024-01-01 01:10:00")], "id long, t string").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(str(tmp_path / "w"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "w"))
    out = windows.tumbling(stream, "t", "1 hour", [], [F.count(F.lit(1)).alias("n")], late="10 minutes")
    out.writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.n for r in spark.table("windowed").collect()) == [1, 2]
    assert windows.sessions(df, "t", "30 minutes", [], [F.count(F.lit(1)).alias("n")]).count() == 2
