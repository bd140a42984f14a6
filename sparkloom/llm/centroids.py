"""Centroid clustering by sort-means, exact in integers.

Vectors become integers, floor(1024 * x). Each round orders, for every centroid, the others
by their distance from it. A vector is scanned from the centroid of its previous assignment
outwards and stops at the first centroid that lies strictly beyond twice the vector's distance
to that previous one: it and all after it are farther away than the previous centroid is.

A round is one narrow pass over the vectors: tasks write each vector with its new assignment,
and their own sums per centroid in the same files. Sums are written as digits in base 2**40, so
that adding them up in Spark is exact for integers of any size; a few rows per centroid and
component reach the driver, however many vectors there are. A round's table takes the place of
the one before, which is deleted.

Defined cases: vectors that are null, of another length than ``COMPONENTS`` or hold null or
non-finite components take no part and get no row; fewer kept vectors than ``k`` give as many
centroids; no kept vectors, or an empty table, give no rows; rows with a null id are clustered
but are no seeds, so a table of only such rows gives none; repeated rows count each, also as seeds,
and equal hashes of one id on several vectors are ordered by the vectors; ties between centroids go
to the smaller number; a centroid without vectors stays; distances and inertias that a long can't
hold are null; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import placed, removed

COMPONENTS = 64
SCALE = 1024
#: Components up to this size give squared distances that 64 bits hold.
NARROW = 1 << 27
DIGIT_BITS = 40
#: Places of a centroid's sums beside those of its components: number of vectors and sum of distances.
COUNT, SPREAD = COMPONENTS, COMPONENTS + 1


def _wide(x: float) -> int:
    """floor(SCALE * x) for any finite x; from 2**53 on x is an integer itself, and the product could overflow."""
    return int(x) * SCALE if abs(x) >= 2.0**53 else math.floor(x * SCALE)


def integers(vectors: np.ndarray) -> np.ndarray:
    """The vectors' integers, as Python's own where 64 bits could overflow later."""
    vectors = vectors.astype(np.float64)
    if not vectors.size or np.abs(vectors).max() < NARROW // SCALE:
        return np.floor(vectors * SCALE).astype(np.int64)
    return np.array([[_wide(x) for x in row] for row in vectors.tolist()], dtype=object)


def _centroid_array(centroids: list[list[int]]) -> np.ndarray:
    narrow = all(abs(x) <= NARROW for c in centroids for x in c)
    return np.array(centroids, dtype=np.int64 if narrow else object)


def assigned(points: np.ndarray, previous: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's nearest centroid and its squared distance, by sort-means from ``previous``."""
    kind = np.int64 if points.dtype == centroids.dtype == np.int64 else object
    points, centroids = points.astype(kind), centroids.astype(kind)
    between = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    found, best = previous.astype(np.int64), np.zeros(len(points), dtype=kind)
    for start in np.unique(previous).tolist():
        rows = np.flatnonzero(previous == start)
        mine = points[rows]
        own = ((mine - centroids[start]) ** 2).sum(axis=1)
        near, at = own.copy(), np.full(len(rows), start)
        scanning = np.arange(len(rows))
        for other in sorted((c for c in range(len(centroids)) if c != start), key=lambda c: (between[start, c], c)):
            # Squared: beyond twice the distance.
            scanning = scanning[(between[start, other] <= 4 * own[scanning]).astype(bool)]
            if not len(scanning):
                break
            there = ((mine[scanning] - centroids[other]) ** 2).sum(axis=1)
            closer = ((there < near[scanning]) | ((there == near[scanning]) & (other < at[scanning]))).astype(bool)
            near[scanning[closer]], at[scanning[closer]] = there[closer], other
        found[rows], best[rows] = at, near
    return found, best


def _digits(totals: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int]]:
    """(centroid, place, position, digit) of every sum."""
    rows = []
    for (cluster, place), total in totals.items():
        sign, size, position = -1 if total < 0 else 1, abs(total), 0
        while size:
            rows.append((cluster, place, position, sign * (size & ((1 << DIGIT_BITS) - 1))))
            size, position = size >> DIGIT_BITS, position + 1
    return rows


def _assigning(centroids: list[list[int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = _centroid_array(centroids)
        totals: dict[tuple[int, int], int] = defaultdict(int)
        schema = None
        for batch in batches:
            ids, vectors, previous = batch.columns
            schema = schema or (ids.type, vectors.type)
            points = integers(vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, COMPONENTS))
            found, best = assigned(points, previous.to_numpy(), middle)
            for cluster in np.unique(found).tolist():
                own = found == cluster
                for place, total in enumerate(points[own].sum(axis=0).tolist()):
                    totals[cluster, place] += total
                totals[cluster, COUNT] += int(own.sum())
                totals[cluster, SPREAD] += sum(best[own].tolist())
            distances = [d if d < 1 << 63 else None for d in best.tolist()]
            none = [pa.nulls(batch.num_rows, t) for t in (pa.int32(), pa.int32(), pa.int64())]
            yield pa.RecordBatch.from_arrays([ids, vectors, pa.array(found, pa.int32()), pa.array(distances, pa.int64()), *none], names=_NAMES)
        if rows := _digits(totals):
            cluster, place, position, digit = zip(*rows)
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, schema[0]), pa.nulls(n, schema[1]), pa.array(cluster, pa.int32()), pa.nulls(n, pa.int64()), pa.array(place, pa.int32()), pa.array(position, pa.int32()), pa.array(digit, pa.int64())],
                names=_NAMES,
            )

    return run


_NAMES = ["id", "vector", "cluster", "distance", "place", "position", "digit"]


def _sums(table: DataFrame, k: int) -> list[list[int]]:
    """Sums of each centroid by place; at most a few digits for each reach the driver."""
    digits = table.where("place is not null").groupBy("cluster", "place", "position").agg(F.sum("digit").alias("digit")).collect()
    out = [[0] * (COMPONENTS + 2) for _ in range(k)]
    for row in digits:
        out[row["cluster"]][row["place"]] += row["digit"] << (DIGIT_BITS * row["position"])
    return out


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for each kept vector.

    Centroids start as the ``k`` vectors whose ``seed:id`` has the smallest SHA-256.
    """
    spark = vectors.sparkSession
    kinds = dict(vectors.dtypes)
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x) < F.lit(math.inf), F.lit(False)))
    kept = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).where((F.size("vector") == COMPONENTS) & finite)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    starts = kept.where("id is not null").select("vector", order.alias("order")).orderBy("order", "vector").limit(k).collect()
    centroids = [[_wide(x) for x in row["vector"]] for row in starts]
    if not centroids:
        kept = kept.where(F.lit(False))
    schema = f"id {kinds[id_col]}, vector {kinds[vector_col]}, cluster int, distance long, place int, position int, digit long"
    table, folder = kept.select("id", "vector", F.lit(0).alias("cluster")), None
    sums: list[list[int]] = []
    for nth in range(rounds + 1):
        last = folder
        table, folder = placed(table.select("id", "vector", "cluster").mapInArrow(_assigning(centroids), schema))
        if last:
            removed(spark, last)
        sums = _sums(table, len(centroids))
        table = table.where("place is null")
        if nth < rounds:
            centroids = [[x // s[COUNT] for x in s[:COMPONENTS]] if s[COUNT] else c for c, s in zip(centroids, sums)]

    def by_cluster(values: list, kind: str) -> F.Column:
        if not values:
            return F.lit(None).cast(kind)
        return F.array(*[F.lit(v).cast(kind) for v in values])[F.col("cluster")]

    spread = [s[SPREAD] if s[SPREAD] < 1 << 63 else None for s in sums]
    inertia = sum(s[SPREAD] for s in sums)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return table.select(
        F.col("id").alias(id_col), "cluster", "distance", by_cluster(spread, "long").alias("cluster_inertia"),
        F.lit(inertia if inertia < 1 << 63 else None).cast("long").alias("inertia"), by_cluster(digests, "string").alias("centroid_sha256"),
    )
