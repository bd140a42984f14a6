"""Operators on hand-made rows that the test tables don't hold: nulls, ties, hot keys, late events."""

import datetime as dt

from pyspark.sql import functions as F

from sparkloom.functions import vectors
from sparkloom.operators import aggregates, joins
from sparkloom.sources import tables
from sparkloom.sources.json_lines import json_lines
from sparkloom.streaming import windows


def day(n, hour=0):
    return dt.datetime(2024, 1, n, hour)


def test_as_of_join_crosses_buckets_and_keeps_unmatched(spark):
    left = spark.createDataFrame([(1, "a", day(1, 5)), (2, "a", day(9)), (3, "b", day(2)), (4, None, day(2)), (5, "a", None)], "id long, k string, t timestamp_ntz")
    right = spark.createDataFrame([("a", day(1, 5), 10), ("a", day(3), 30), ("a", day(10), 99), ("b", day(3), 7), (None, day(1), 5)], "k string, u timestamp_ntz, v int")
    found = {r.id: r.v for r in joins.as_of_join(left, right, "k", "t", "u", ["v"]).collect()}
    assert found == {1: 10, 2: 30, 3: None, 4: None, 5: None}


def test_range_join_equals_nested_loop(spark):
    points = spark.createDataFrame([(float(x),) for x in (-3, 0, 4, 5, 5, 9.5, 100)] + [(None,)], "x double")
    ranges = spark.createDataFrame([(1, -5.0, 0.0), (2, 0.0, 5.0), (3, 4.5, 50.0), (4, 7.0, 7.0), (5, None, 3.0)], "r int, low double, high double")
    want = sorted(map(tuple, points.join(ranges, (F.col("x") >= F.col("low")) & (F.col("x") < F.col("high"))).select("x", "r").collect()))
    assert sorted(map(tuple, joins.range_join(points, ranges, "x", "low", "high", 3.0).select("x", "r").collect())) == want


def test_salted_joins_equal_plain_ones(spark):
    big = spark.range(500).select(F.when(F.col("id") < 400, 1).otherwise(F.col("id")).alias("k"), "id")
    small = spark.createDataFrame([(1, "x"), (1, "y"), (450, "z")], "k long, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain, salted = (sorted(map(str, rows.collect())) for rows in (big.join(small, "k", how), joins.salted_join(big, small, "k", 7, how)))
        assert plain == salted


def test_top_k_and_distinct(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") % 50).alias("v"), "id")
    top = aggregates.top_k(rows, ["g"], [F.desc("v"), F.asc("id")], 2)
    assert sorted(map(tuple, top.collect())) == sorted((g, v, i) for g in range(3) for v, i in sorted(((i % 50, i) for i in range(1000) if i % 3 == g), key=lambda x: (-x[0], x[1]))[:2])
    assert {tuple(r) for r in aggregates.exact_distinct(rows, ["g"], "v", "n").collect()} == {(0, 50), (1, 50), (2, 50)}


def test_vectors(spark):
    row = spark.createDataFrame([([1.0, 2.0], [3.0, -1.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>").select(vectors.dot("a", "b"), vectors.l2_distance("a", "b"), vectors.cosine("a", "z")).first()
    assert row[0] == 1.0 and abs(row[1] - 13**0.5) < 1e-12 and row[2] is None


def test_formats_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 0.5), (2, "b", None)], "k long, s string, x double")
    for kind in ("parquet", "orc", "json", "csv"):
        tables.write(rows, str(tmp_path / kind), kind, ("s",))
        back = tables.read(spark, str(tmp_path / kind), kind, "k long, x double, s string")
        assert sorted(map(tuple, back.select("k", "s", "x").collect())) == [(1, "a", 0.5), (2, "b", None)]


def test_late_events_are_dropped(spark, tmp_path):
    schema = "ts timestamp_ntz, k string"
    for rows in ([(day(1, 1), "a"), (day(5), "a")], [(day(5, 1), "a")], [(day(1, 2), "late"), (day(9), "a")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = windows.event_time(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "ts", "1 hour")
    found = windows.run_to_files(windows.tumbling(events, "ts", "1 day", ["k"]))
    assert {(r.started, r.k, r.n) for r in found.collect()} == {(day(1), "a", 1), (day(5), "a", 2)}


def test_streams_read_files_and_directories(spark, tmp_path):
    rows = spark.range(100).select("id", (F.col("id") % 3).alias("day"))
    rows.repartition(4).write.parquet(f"{tmp_path}/parts.parquet")
    rows.write.partitionBy("day").parquet(f"{tmp_path}/days.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/one")
    next((tmp_path / "one").glob("part-*")).rename(tmp_path / "file.parquet")
    rows.limit(7).write.parquet(f"{tmp_path}/file.parquet.old")
    for name in ("parts", "days", "file"):
        found = windows.run_to_files(tables.stream(spark, str(tmp_path), name)).select("id", "day")
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, tables.table(spark, str(tmp_path), name).select("id", "day").collect())) == [(i, i % 3) for i in range(100)], name


def test_salted_joins_broadcast_no_side(spark, tmp_path):
    spark.range(1000).withColumnRenamed("id", "k").write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        joined = joins.salted_join(rows, rows, "k", how=how)
        joined.collect()
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString(), how


def test_streamed_json_lines_take_all_files_and_go_on(spark, tmp_path):
    folder, log = str(tmp_path / "in"), str(tmp_path / "log")
    rows = spark.range(50).selectExpr("id", "repeat('x', 20) AS s")
    rows.repartition(5).write.json(folder)
    limited = lambda: json_lines(spark, folder, "id long, s string", stream=True, maxFilesPerTrigger="2", splitBytes="100")
    assert sorted(r.id for r in windows.run_limited_to_files(limited()).collect()) == list(range(50))
    assert sorted(r.id for r in windows.run_to_files(json_lines(spark, folder, "id long, s string", stream=True)).collect()) == list(range(50))
    for _ in range(2):  # a second run of the stream takes only what is new
        query = limited().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", log).start()
        query.processAllAvailable()
        query.stop()
        rows.selectExpr("id + 50 AS id", "s").repartition(3).write.mode("append").json(folder)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(100))


def test_not_in_follows_sql(spark):
    rows = spark.createDataFrame([(1,), (2,), (None,), (2,)], "k int")
    for others in ([], [(2,)], [(2,), (2,), (9,)], [(2,), (None,)], [(None,)]):
        table = spark.createDataFrame(others, "o int")
        rows.createOrReplaceTempView("rows_")
        table.createOrReplaceTempView("others_")
        want = sorted(map(str, spark.sql("SELECT k FROM rows_ WHERE k NOT IN (SELECT o FROM others_)").collect()))
        assert sorted(map(str, joins.not_in(rows, "k", table, "o").collect())) == want, others


def test_range_counts_equal_a_range_frame(spark):
    rng = __import__("random").Random(5)
    rows = [(i, rng.choice("ab"), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(600))) for i in range(400)] + [(900, "a", None), (901, None, day(1))]
    events = spark.createDataFrame(rows, "id long, k string, t timestamp_ntz")
    events.createOrReplaceTempView("events_")
    want = spark.sql("SELECT id, count(*) OVER (PARTITION BY k ORDER BY t RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events_ WHERE t IS NOT NULL").collect()
    found = joins.range_counts(events, "k", "t", 3600).select("id", "n").collect()
    assert {r.id: r.n for r in found} == {**{r.id: r.n for r in want}, 900: 0}


def test_exact_median(spark):
    rows = [("a", float(x % 7)) for x in range(50)] + [("b", 3.0)] * 4 + [("c", None), ("d", -1.5), ("d", 9.0), ("e", 1.0), ("e", 2.0), ("e", 50.0)]
    values = spark.createDataFrame(rows, "g string, v double")
    want = {r.g: r.m for r in values.groupBy("g").agg(F.median("v").alias("m")).collect() if r.m is not None}
    assert {r.g: r.m for r in aggregates.exact_median(values, "g", "v", "m").collect()} == want


def test_text_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("one line",), ("",), ("zwei é",)], "value string")
    tables.write(rows, str(tmp_path / "text"), "text")
    assert sorted(r.value for r in tables.read(spark, str(tmp_path / "text"), "text").collect()) == ["", "one line", "zwei é"]
