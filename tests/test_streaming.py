import datetime as dt

from pagewright.streaming import events as E


def test_window_counts_equal_batch(spark, folder, tmp_path):
    src = spark.read.parquet(f"{folder}/events.parquet")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema)
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = E.window_counts(E.event_stream(spark, str(tmp_path / "in"), schema), "ts", "event_type", "1 day", "1 hour")
    E.drain(stream, "counts", "complete", str(tmp_path / "cp"))
    assert spark.sql("select sum(n) from counts").first()[0] == src.count()


def test_late_rows_are_left_out(spark, tmp_path):
    t = dt.datetime(2024, 1, 10)
    first = spark.createDataFrame([(t, "a", 1.0), (t + dt.timedelta(days=3), "a", 1.0)], "ts timestamp, event_type string, value double")
    first.coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = "ts timestamp, event_type string, value double"
    stream = E.window_counts(E.event_stream(spark, str(tmp_path / "in"), schema), "ts", "event_type", "1 day", "1 hour")
    E.drain_to(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    spark.createDataFrame([(t, "a", 9.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    E.drain_to(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert [r["total"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] in ([1.0], [])


def test_sessions(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(t + dt.timedelta(minutes=m), "u") for m in (0, 5, 60, 62)]
    spark.createDataFrame(rows, "ts timestamp, who string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = E.sessions(E.event_stream(spark, str(tmp_path / "in"), "ts timestamp, who string"), "ts", "who", "10 minutes", "1 hour")
    E.drain(stream, "sess", "complete", str(tmp_path / "cp"))
    assert sorted(r["n"] for r in spark.sql("select n from sess").collect()) == [2, 2]
