"""Approximate nearest neighbours: NN-descent graph, greedy graph search.

Index. Equal vectors are one node, named by their smallest id. The first graph
comes from blocks of neighbours along random projections. Each round of NN-descent
joins every node's neighbours (forward and reverse) with their vectors, compares
the neighbours of one node with each other, and offers each of them the nearest
others; the ``degree`` nearest stay. Rounds go on until at most ``settled`` of the
edges are new in one. All of it is Spark joins and exchanges; a node's list is
bounded by twice the degree, as the method has it. Vectors are exchanged in their
own precision; distances are taken in double precision from differences to the
middle of what is compared, so neither the scale nor an offset of the data matters
(squares must fit doubles: parts up to 1e150).

Search. Every query begins at its own node and at ``entries`` fixed ones, and keeps
the ``width`` nearest nodes found. In each step it expands all that are not yet
expanded, and it stops when none is left. Pairs of query and node are exchanged, not
vectors; the query vectors are sent to all tasks, ``block_bytes`` of them at a time.
Distances are taken in double precision on the original vectors. Kept nodes are opened
into the ids of their equal vectors at the end, and each query's ids are cut to ``k`` only
then. A query that is left with fewer ids than there are (one id may hold more vectors near
it than ``width``), and one whose vector has not the most common length, is answered by the
exact blocked search instead; so no vector is left out for its length. Tables of rounds and
steps are deleted as soon as the next ones are written.

Defined cases: vectors that are null, all zero, or hold null or non-finite parts
take no part; vectors are compared with those of their own length; equal
distances go to the smaller id; repeated rows count once; an id with several vectors
is one candidate, by its nearest one, and asks with its smallest; fewer candidates
than ``k`` are all returned; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.nearest import exact_nearest

from .common import placed, removed, written

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


@dataclass
class Index:
    """``nodes(node, v)``, ``members(node, id, nth)`` and ``graph(node, near)`` of vectors of ``length``; ``rows(id, v)`` of every length."""

    nodes: DataFrame
    members: DataFrame
    graph: DataFrame
    rows: DataFrame
    length: int
    most_members: int


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of equal length as a matrix."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def _unpacked(column: pa.Array, kind: type) -> np.ndarray:
    """A column of vectors as bytes, as a matrix of doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(float)


def _square_distances(rows: np.ndarray) -> np.ndarray:
    rows = rows - rows.mean(axis=0)
    norms = (rows**2).sum(axis=1)
    out = norms[:, None] + norms - 2 * rows @ rows.T
    np.fill_diagonal(out, np.inf)
    return np.maximum(out, 0)


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v`` of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    return vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(
        "id is not null and v is not null and exists(v, x -> x <> 0) and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf'))"
    )


def common_length(valid: DataFrame) -> int:
    """The length that most vectors have, the smaller one of two; 0 without vectors."""
    common = valid.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    return common["n"] if common else 0


def _projecting(n: int, seed: int, kind: type) -> Run:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = _matrix(batch.column(1))
                sides = rows @ np.random.default_rng(seed).normal(size=(rows.shape[1], n))
                packed = pa.array([r.tobytes() for r in rows.astype(kind)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), packed, pa.array(list(sides), pa.list_(pa.float64()))], names=["node", "packed", "sides"])

    return run


def _edges(a: list, b: list, d: list) -> pa.RecordBatch:
    arrays = [np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((a, np.int64), (b, np.int64), (d, float))]
    return pa.RecordBatch.from_arrays([*map(pa.array, arrays)], names=["a", "b", "d"])


def _nearest_in(rows: np.ndarray, names: np.ndarray, most: int, radius: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """For each row its ``most`` nearest among the others, if nearer than its radius."""
    d = _square_distances(rows)
    k = min(most, len(rows) - 1)
    top = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(rows) - 1 else np.argsort(d, axis=1)[:, :k]
    near = np.take_along_axis(d, top, axis=1)
    keep = np.isfinite(near) if radius is None else near < radius[:, None]
    return np.repeat(names, keep.sum(axis=1)), names[top[keep]], near[keep]


def _block_neighbours(block: int, most: int, kind: type) -> Run:
    """Nearest neighbours within runs of ``block`` rows in the given order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, rows = batch.column(0).to_numpy(), _unpacked(batch.column(1), kind) if batch.num_rows else None
            out = [_nearest_in(rows[k : k + block], names[k : k + block], most) for k in range(0, batch.num_rows, block) if batch.num_rows - k > 1]
            yield _edges(*map(list, zip(*out))) if out else _edges([], [], [])

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that hold whole groups of equal first column, with the group bounds. Input is sorted by it."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        keys = table.column(0).to_numpy()
        last = int(np.searchsorted(keys, keys[-1], "left"))
        rest = table.slice(last)
        if last:
            whole = table.slice(0, last).combine_chunks().to_batches()[0]
            yield whole, np.append(np.flatnonzero(np.diff(keys[:last], prepend=keys[0] - 1)), last)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks().to_batches()[0], np.array([0, rest.num_rows])


def _local_join(most: int, kind: type) -> Run:
    """Compares the neighbours of each node with each other; offers each its nearest others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in _groups(batches):
            names, rows = batch.column(1).to_numpy(), _unpacked(batch.column(2), kind)
            radius = batch.column(3).to_numpy()
            out = [_nearest_in(rows[i:j], names[i:j], most, radius[i:j]) for i, j in zip(bounds, bounds[1:]) if j - i > 1]
            yield _edges(*map(list, zip(*out))) if out else _edges([], [], [])

    return run


def _keep_nearest(degree: int) -> Run:
    """The first ``degree`` distinct neighbours of each node; input is sorted by node, distance, neighbour and whether the edge is fresh."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in _groups(batches):
            b, keep = batch.column(1).to_numpy(), []
            for i, j in zip(bounds.tolist(), bounds[1:].tolist()):
                _, first = np.unique(b[i:j], return_index=True)
                first.sort()
                keep.append(i + first[:degree])
            yield batch.take(pa.array(np.concatenate(keep)))

    return run


def _top(edges: DataFrame, degree: int) -> DataFrame:
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = edges.repartition(parts, "a").sortWithinPartitions("a", "d", "b", "fresh")
    return spread.mapInArrow(_keep_nearest(degree), "a long, b long, d double, fresh boolean")


def _both_ways(graph: DataFrame, degree: int) -> DataFrame:
    """``u, x``: neighbours of u and, of the nodes that have u as one, the ``degree`` nearest."""
    nth = Window.partitionBy("b").orderBy("d", "a")
    back = graph.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= degree)
    return graph.select(F.col("a").alias("u"), F.col("b").alias("x")).union(back.select("b", "a")).distinct()


def build_index(
    vectors: DataFrame,
    k: int = 10,
    degree: int = 24,
    settled: float = 0.02,
    projections: int = 4,
    block: int = 256,
    offers: int = 5,
    seed: int = 11,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> Index:
    """A neighbour graph over the valid rows of the most common length; answers up to ``k`` neighbours."""
    every = valid_vectors(vectors, id_col, vector_col)
    length = common_length(every)
    valid = every.where(F.size("v") == length).distinct()
    kind = np.float32 if dict(vectors.dtypes)[vector_col] == "array<float>" else np.float64
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Of equal vectors only the k + 1 smallest ids can ever be answers; the rank limit applies before the exchange.
    nth = Window.partitionBy("v").orderBy("id")
    ranked = valid.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= k + 1)
    ranked = written(ranked.withColumn("node", F.min("id").over(Window.partitionBy("v"))))
    nodes = ranked.where("nth = 1").select("node", "v")
    sided, sides_folder = placed(nodes.mapInArrow(_projecting(projections, seed, kind), "node long, packed binary, sides array<double>"))
    packed = sided.select("node", "packed")

    first = None
    for p in range(projections):
        line = sided.select("node", "packed", F.col("sides")[p].alias("side")).repartitionByRange(parts, "side", "node").sortWithinPartitions("side", "node")
        edges = line.select("node", "packed").mapInArrow(_block_neighbours(block, max(degree // 2, k), kind), "a long, b long, d double")
        first = edges if first is None else first.union(edges)
    graph, folder = placed(_top(first.withColumn("fresh", F.lit(True)), degree))

    while True:
        # A node with a short list takes any offer.
        reach = graph.groupBy("a").agg(F.when(F.count("*") < degree, F.lit(float("inf"))).otherwise(F.max("d")).alias("radius"))
        known = packed.join(reach, F.col("node") == F.col("a"), "left").select("node", "packed", F.coalesce("radius", F.lit(float("inf"))).alias("radius"))
        pairs = _both_ways(graph, degree).join(known, F.col("x") == F.col("node")).select("u", "x", "packed", "radius")
        offered = pairs.repartition(parts, "u").sortWithinPartitions("u").mapInArrow(_local_join(offers, kind), "a long, b long, d double")
        last = folder
        graph, folder = placed(_top(graph.withColumn("fresh", F.lit(False)).union(offered.withColumn("fresh", F.lit(True))), degree))
        removed(graph.sparkSession, last)
        edges = graph.agg(F.count("*").alias("n"), F.count_if("fresh").alias("fresh")).first()
        if edges["fresh"] <= settled * edges["n"]:
            break

    links = written(_both_ways(graph, degree).select(F.col("u").alias("node"), F.col("x").alias("near")))
    removed(graph.sparkSession, folder, sides_folder)
    return Index(nodes, ranked.select("node", "id", "nth"), links, every, length, k + 1)


def _measuring(handle) -> Run:
    """Distances of candidate pairs to their queries, kept if nearer than the query's farthest kept node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = handle.value
        for batch in batches:
            if not batch.num_rows:
                continue
            q, node, worst = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            d = ((_matrix(batch.column(3)) - rows[np.searchsorted(ids, q)]) ** 2).sum(axis=1)
            keep = d < worst
            yield pa.RecordBatch.from_arrays([pa.array(q[keep]), pa.array(node[keep]), pa.array(d[keep])], names=["q", "node", "d"])

    return run


def search(
    index: Index,
    queries: DataFrame,
    k: int = 10,
    width: int = 400,
    entries: int = 32,
    block_bytes: int = 128 << 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found, a query's own id left out."""
    if k + 1 > index.most_members:
        raise ValueError("the index was built for fewer neighbours")
    asked = written(valid_vectors(queries, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v")))
    usual = asked.where(F.size("v") == index.length)
    n_bytes = usual.agg(F.sum(F.size("v") * 8)).first()[0] or 0
    n_blocks = max(1, -(-n_bytes // block_bytes))
    found = None
    for b in range(n_blocks):
        part = usual.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b) if n_blocks > 1 else usual
        answers = _search_block(index, part, k, width, entries)
        found = answers if found is None else found.union(answers)

    # Queries with fewer answers than there are other ids, and those of other lengths, are searched exactly.
    ids = [r["id"] for r in index.members.select("id").distinct().limit(k + 1).collect()]
    due = F.lit(k) if len(ids) > k else F.lit(len(ids)) - F.col("id").isin(ids).cast("int")
    counts = found.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n"))
    lacking = (F.size("v") != index.length) | (F.coalesce("n", F.lit(0)) < due)
    rest = asked.join(counts, "id", "left").where(lacking).select("id", "v")
    if not rest.isEmpty():
        rest = written(rest)
        exact = exact_nearest(rest, index.rows.distinct(), k, "id", "v")
        found = found.join(rest.select(F.col("id").alias("query_id")), "query_id", "left_anti").union(exact.select("query_id", F.col("rank").cast("int"), "id", "score"))
    return found.withColumnRenamed("id", id_col)


def _search_block(index: Index, asked: DataFrame, k: int, width: int, entries: int) -> DataFrame:
    spark = asked.sparkSession
    rows = asked.toPandas().sort_values("id")  # about block_bytes of vectors
    vectors = np.stack(rows["v"].tolist()) if len(rows) else np.zeros((0, 0))
    handle = spark.sparkContext.broadcast((rows["id"].to_numpy(np.int64), vectors))

    # A query starts at its own node, if it is indexed, and at a fixed number of entry nodes, the same for all.
    own = asked.join(index.nodes, "v").select(F.col("id").alias("q"), "node")
    gates = [r["node"] for r in index.nodes.select("node").orderBy(F.xxhash64("node"), "node").limit(entries).collect()]
    entry = asked.select(F.col("id").alias("q"), F.explode(F.lit(gates).cast("array<long>")).alias("node"))
    start = own.union(entry).distinct()
    far = F.lit(float("inf"))
    beam, folder = placed(
        start.withColumn("worst", far).join(index.nodes, "node").select("q", "node", "worst", "v")
        .mapInArrow(_measuring(handle), "q long, node long, d double").withColumn("done", F.lit(False))
    )
    best = Window.partitionBy("q").orderBy("d", "node")
    # A node is expanded once for a query at most, so the loop ends by itself.
    while True:
        limit = beam.groupBy("q").agg(F.when(F.count("*") < width, far).otherwise(F.max("d")).alias("worst"))
        fresh = (
            beam.where("not done").join(index.graph, "node").select("q", F.col("near").alias("node")).distinct()
            .join(beam.select("q", "node"), ["q", "node"], "left_anti")
            .join(limit, "q")
            .join(index.nodes, "node").select("q", "node", "worst", "v")
            .mapInArrow(_measuring(handle), "q long, node long, d double")
        )
        both = beam.select("q", "node", "d", F.lit(True).alias("done")).union(fresh.withColumn("done", F.lit(False)))
        last = folder
        beam, folder = placed(both.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= width).drop("nth"))
        removed(spark, last)
        if beam.where("not done").isEmpty():
            break

    # Kept nodes opened into the ids of their equal vectors; an id counts by its nearest one.
    opened = beam.join(index.members, "node").where("id <> q").groupBy("q", "id").agg(F.min("d").alias("d"))
    ranked = opened.withColumn("score", F.sqrt("d")).withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("score", "id")))
    found = written(ranked.where(F.col("rank") <= k).select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), "id", "score"))
    removed(spark, folder)
    return found
