"""Nearest neighbours where ids stand on many vectors and vectors have several lengths, against brute force."""

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from sparkloom.llm import neighbours  # noqa: E402


def brute_force(rows, asked, k):
    """``rows`` of (id, vector); a query asks with its smallest vector, an id counts by its nearest."""
    out = {}
    for q in asked:
        mine = min(v for i, v in rows if i == q)
        best = {}
        for i, v in rows:
            if i != q and len(v) == len(mine):
                d = float(np.sqrt(((np.array(v) - np.array(mine)) ** 2).sum()))
                best[i] = min(d, best.get(i, d))
        out[q] = [i for _, i in sorted((d, i) for i, d in best.items())[:k]]
    return out


def found(spark, rows, asked, **options):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.search(neighbours.build_index(table), table.where(table.vec_id.isin(asked)), **options).toPandas()
    got = got.sort_values(["query_id", "rank"])
    assert [*got.columns] == ["query_id", "rank", "vec_id", "score"]
    return {q: g.vec_id.tolist() for q, g in got.groupby("query_id")}


def test_an_id_on_many_vectors_takes_one_place(spark):
    rng = np.random.default_rng(3)
    rows = [(0, [1.0, 1.0])] + [(1, (1 + rng.normal(size=2) / 1000).tolist()) for _ in range(40)]
    rows += [(2 + i, rng.normal(size=2).tolist()) for i in range(15)]
    assert found(spark, rows, [0]) == brute_force(rows, [0], 10)


def test_an_id_that_fills_the_search_is_left_to_the_exact_way(spark):
    rng = np.random.default_rng(4)
    rows = [(0, [1.0, 1.0])] + [(1, (1 + rng.normal(size=2) / 1000).tolist()) for _ in range(60)]
    rows += [(2 + i, rng.normal(size=2).tolist()) for i in range(15)]
    assert found(spark, rows, [0, 5], width=16, entries=2) == brute_force(rows, [0, 5], 10)


def test_vectors_of_every_length_take_part(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4 if i % 11 < 6 else 3).tolist()) for i in range(220)]
    asked = list(range(0, 220, 10))
    assert found(spark, rows, asked) == brute_force(rows, asked, 10)


def test_fewer_ids_than_asked_for(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, [1.0])]
    assert found(spark, rows, [1, 3, 5]) == brute_force([r for r in rows if r[0] != 4], [1, 3], 10)
