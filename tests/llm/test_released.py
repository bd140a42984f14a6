"""Loops of small steps free what they no longer need."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from sparkloom.llm import graph  # noqa: E402


def test_every_round_of_a_loop_lets_dead_files_go(spark, monkeypatch):
    freed = []
    monkeypatch.setattr(graph, "released", freed.append, raising=False)
    chain = spark.createDataFrame([(i + 1, i) for i in range(5)], "node long, parent long")
    assert {r.component for r in graph.tree_roots(chain).collect()} == {0} and len(freed) >= 2
    freed.clear()
    assert {r.component for r in graph.connected_components(chain.toDF("a", "b")).collect()} == {0} and len(freed) >= 2
