"""Sketches within their error, joins on both sides of their limit, frequent values and exact neighbours."""

import numpy as np
from pyspark.sql import functions as F

from sparkloom.operators import frequent, joins, nearest, sketching


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_join_strategy_follows_measured_sizes(spark, tmp_path):
    big, small = str(tmp_path / "big"), str(tmp_path / "small")
    spark.range(50_000).selectExpr("id % 100 AS k", "uuid() AS filling").write.parquet(big)
    spark.range(100).selectExpr("id AS k", "id * 2 AS twice").write.parquet(small)
    left, right = spark.read.parquet(big), spark.read.parquet(small)
    under = joins.sized_join(left, right, "k")
    assert "BroadcastHashJoin" in plan(under)
    hashed = joins.sized_join(left, right, "k", limit=0)
    assert "ShuffledHashJoin" in plan(hashed) and "Broadcast" not in plan(hashed)
    counted = joins.sized_join(left, right, "k", rows_limit=99)  # small files may hold many rows
    assert "Broadcast" not in plan(counted)
    alike = joins.sized_join(left, spark.read.parquet(big).select("k").distinct(), "k", limit=0)
    assert "SortMergeJoin" in plan(alike)
    assert "Broadcast" not in plan(joins.sized_join(left, right, "k", "full"))
    for found in (under, hashed, counted):
        assert found.count() == 50_000 and found.where("twice <> 2 * k").isEmpty()


def test_sketches_are_near_exact_numbers(spark):
    rows = spark.range(60_000).selectExpr("id % 3 AS g", "id % 20000 AS v", "CAST(id AS DOUBLE) AS m")
    found = sketching.summaries(rows, ["g"], "v", "m")
    whole = sketching.merged_summaries(found.withColumn("all", F.lit(1)), ["all"])
    one = whole.select(sketching.about("theta").alias("n"), sketching.rows_seen("kll").alias("rows"), sketching.quantiles("kll", [0.1, 0.5, 0.9]).alias("q")).first()
    assert abs(one["n"] - 20_000) < 0.03 * 20_000 and one["rows"] == 60_000
    assert np.allclose(one["q"], [6_000, 30_000, 54_000], atol=0.02 * 60_000)


def test_bitmap_counts_are_exact_when_merged(spark):
    rows = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (1, "b", 5), (1, "b", 70_000), (2, "a", None), (2, "a", 0)], "g int, part string, v long")
    maps = sketching.bitmaps(rows, ["g", "part"], "v")
    counts = sketching.bitmap_counts(sketching.merged_bitmaps(maps, ["g"]), ["g"], "n").collect()
    assert {r["g"]: r["n"] for r in counts} == {1: 2, 2: 1}


def test_heavy_hitters_are_exact(spark):
    rows = spark.range(10_000).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS v").repartition(7)
    assert [tuple(r) for r in frequent.heavy_hitters(rows, "v", 0.1).collect()] == [(-1, 3_334)]


def test_exact_neighbours_of_several_lengths_in_small_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(0, 4, size=3 if i % 4 else 2).astype(float).tolist()) for i in range(120)] + [(7, [0.0, 0.0, 0.0]), (200, None), (201, [float("nan")])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest.exact_nearest(table.where("vec_id % 10 = 3"), table, 5, block_bytes=200, grid=(2, 3)).toPandas().sort_values(["query_id", "rank"])
    for q in range(3, 120, 10):
        (mine,) = (v for i, v in rows if i == q)
        best = {}
        for i, v in rows:
            if v and i != q and len(v) == len(mine):
                d = float(np.sqrt(((np.array(v) - np.array(mine)) ** 2).sum()))
                best[i] = min(d, best.get(i, d))
        assert got[got.query_id == q].vec_id.tolist() == [i for _, i in sorted((d, i) for i, d in best.items())[:5]]
