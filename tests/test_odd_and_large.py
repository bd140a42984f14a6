"""Queries on tables of their own: odd keys, and the size of what a task holds."""

import tracemalloc
from types import SimpleNamespace

import __spark_entry__ as entry
import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq

from sparkloom.llm import pieces
from sparkloom.operators import nearest
from sparkloom.sources import tables
from sparkloom.streaming import visits


def _equals_sql(spark, name, folder):
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(entry.oracle_sql()[name]).fetchall()
    names = [c[0] for c in con.description]
    found = [tuple(r[n] for n in names) for r in entry.queries()[name](spark, str(folder)).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    return found


def test_cogrouped_orders_with_null_and_repeated_customers(spark, tmp_path):
    customers = [(1, 10.0), (1, 30.0), (2, 5.0), (3, 1.0), (None, 0.0), (None, 1.0), (4, None)]
    orders = [(1, 20.0), (1, 40.0), (2, 5.0), (None, 9.0), (4, 7.0), (5, 7.0)]
    spark.createDataFrame(customers, "c_custkey long, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(i, *o) for i, o in enumerate(orders)], "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    assert (1, 3) in _equals_sql(spark, "cogrouped_orders", tmp_path)


def test_meeting_blocks_are_neither_copied_nor_multiplied_whole():
    rng = np.random.default_rng(1)
    queries, others, n = rng.random((256, 64)), rng.random((8192, 64)), 12
    one = {"dim": 64, "query_ids": np.arange(256).tobytes(), "query_vectors": queries.tobytes(), "ids": np.arange(8192).tobytes(), "vectors": others.tobytes()}
    batch = pa.RecordBatch.from_pylist([one] * n, pa.schema([("dim", pa.int32()), *((c, pa.binary()) for c in list(one)[1:])]))
    tracemalloc.start()
    rows = sum(b.num_rows for b in nearest._meeting(10)(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == n * 256 * 10 and most < 40 << 20


def test_rows_of_one_partition_value_are_written_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "PIECE_ROWS", 100, raising=False)
    rows = spark.range(1000).selectExpr("id", "CASE WHEN id < 700 THEN 'hot' WHEN id < 900 THEN 'b' WHEN id < 950 THEN 'c' END AS s")
    tables.write(rows, str(tmp_path / "out"), "parquet", ("s",))
    sizes = {str(f): pq.ParquetFile(f).metadata.num_rows for f in tmp_path.glob("out/*/*.parquet")}
    found = tables.read(spark, str(tmp_path / "out"), "parquet", "id long, s string")
    assert sorted(map(str, found.collect())) == sorted(map(str, rows.collect()))
    assert max(sizes.values()) <= 400 and sum("s=hot" in f for f in sizes) > 1 and sum("s=c" in f for f in sizes) == 1


class _Counted:
    """A state that counts the calls on it."""

    calls = 0

    def _state(self, *_args, **_more):
        return _CountedState()

    getListState = getValueState = getMapState = _state

    def registerTimer(self, at):
        _Counted.calls += 1

    deleteTimer = registerTimer


class _CountedState:
    def __init__(self):
        self.rows, self.map = [], {}

    def __getattribute__(self, name):
        if name not in ("rows", "map"):
            _Counted.calls += 1
        return object.__getattribute__(self, name)

    def get(self):
        return self.rows if isinstance(self.rows, list) and self.rows else None if isinstance(self.rows, list) else self.rows

    def exists(self):
        return bool(self.rows)

    def update(self, row):
        self.rows = row

    def put(self, rows):
        self.rows = list(rows)

    def appendList(self, rows):
        self.rows = self.rows + list(rows)

    def clear(self):
        self.rows = []

    def containsKey(self, key):
        return key in self.map

    def getValue(self, key):
        return self.map.get(key)

    def updateValue(self, key, value):
        self.map[key] = value


def test_a_users_visits_take_few_calls_on_the_state():
    minutes = [0, 5, 10, 100, 101, 200]
    day = np.datetime64("2024-01-01", "us")
    rows = pd.DataFrame({"at": [day + np.timedelta64(m, "m") for m in minutes], "kind": list("abcdea")})
    made = visits.Visits(1800)
    made.init(_Counted())
    _Counted.calls = 0
    assert not list(made.handleInputRows((7,), iter([rows]), None))
    watermark = SimpleNamespace(getCurrentWatermarkInMs=lambda: int((day + np.timedelta64(150, "m")).astype("int64") // 1000))
    (found,) = made.handleExpiredTimer((7,), watermark, None)
    assert found[["n", "kinds", "nth"]].to_numpy().tolist() == [[3, 3, 1], [2, 2, 2]]
    assert found["ended"].tolist() == [pd.Timestamp("2024-01-01 00:10"), pd.Timestamp("2024-01-01 01:41")]
    assert _Counted.calls <= 10


def test_words_hash_alone_as_together():
    words = ["a", "▁the", "ünïcode", "𝄞x", "a"]
    found = pieces._hashes(words)
    assert found.tolist() == [int(pieces._hashes([w])[0]) for w in words] and len(set(found.tolist())) == 4
