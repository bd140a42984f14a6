"""Exact nearest neighbours of a query set, by a blocked distance join.

Both sides are packed into blocks of vectors of one length. Query blocks and candidate blocks are
dealt over a grid (fragment and replicate): a candidate block goes to every row of the grid, a
query block to every column, and each pair of blocks meets in exactly one cell. A cell is one key,
so a few blocks of each side are in a task at a time, never a side as a whole, and neither side is
broadcast or collected.

For two blocks, distances are first taken from one matrix product. Its rounding error is bounded,
so only candidates within that bound of the k-th smallest are measured exactly, as sums of squared
differences. A pair of blocks leaves k rows for each query, which are merged by query; Spark cuts each task's
rows to k before that exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_BLOCK_FIELDS = "dim int, ids binary, vectors binary"
#: Of one matrix of distances between some queries and a block of candidates; about six of them are held.
_MATRIX_BYTES = 2 << 20


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _packing(block_bytes: int):
    """Rows of id and vector to blocks of each vector length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        sizes: dict[int, int] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, vectors = (np.concatenate(x) for x in zip(*held.pop(dim)))
            sizes.pop(dim)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary())], names=["dim", "ids", "vectors"])

        for batch in batches:
            lengths = batch.column(1).value_lengths().to_numpy()
            for dim in np.unique(lengths).tolist():
                own = batch.filter(pa.array(lengths == dim))
                ids, vectors = own.column(0).to_numpy().astype(np.int64), _flat(own.column(1)).astype(np.float64)
                step = max(1, block_bytes // (8 * dim))
                for at in range(0, len(ids), step):
                    held.setdefault(dim, []).append((ids[at : at + step], vectors[at * dim : (at + step) * dim]))
                    sizes[dim] = sizes.get(dim, 0) + len(ids[at : at + step])
                    if sizes[dim] >= step:
                        yield block(dim)
        for dim in list(held):
            yield block(dim)

    return run


def closest(queries: np.ndarray, others: np.ndarray, k: int, skip: np.ndarray, other_ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query, the places of its ``k`` nearest among ``others`` and their distances; ``skip[i]`` is an id that does not count."""
    order = np.argsort(other_ids, kind="stable")
    others, other_ids = others[order], other_ids[order]
    firsts = np.flatnonzero(np.diff(other_ids, prepend=other_ids[:1] - 1))  # of each id; an id may stand on several vectors
    lengths = (others**2).sum(axis=1)
    step = max(1, _MATRIX_BYTES // (8 * max(1, len(others))))
    for at in range(0, len(queries), step):
        part = queries[at : at + step]
        own = (part**2).sum(axis=1)
        with np.errstate(over="ignore", invalid="ignore"):
            rough = own[:, None] + lengths[None, :] - 2 * (part @ others.T)
            # Of each of the three sums, and of the terms they are made of.
            slack = 8 * (part.shape[1] + 4) * np.finfo(float).eps * (own[:, None] + lengths[None, :])
            low, high = rough - slack, rough + slack
        for i in range(len(part)):
            allowed = other_ids != skip[at + i]
            bounds = np.minimum.reduceat(np.where(allowed, high[i], np.inf), firsts)
            reach = np.partition(bounds, k - 1)[k - 1] if len(bounds) > k else np.inf
            near = np.flatnonzero(allowed & ~(low[i] > reach))  # where sums overflow, all are measured
            with np.errstate(over="ignore"):
                exact = np.sqrt(((others[near] - part[i]) ** 2).sum(axis=1))
            best = np.lexsort((other_ids[near], exact))
            best = best[np.sort(np.unique(other_ids[near[best]], return_index=True)[1])][:k]  # the nearest of each id
            yield order[near[best]], exact[best]


def _meeting(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch["dim"][i].as_py()
                # Views: a batch holds up to 64 MB of blocks, which are not copied.
                query_ids, other_ids = (np.frombuffer(batch[c][i].as_buffer(), np.int64) for c in ("query_ids", "ids"))
                queries, others = (np.frombuffer(batch[c][i].as_buffer(), np.float64).reshape(-1, dim) for c in ("query_vectors", "vectors"))
                asked, found, scores = [], [], []
                for query, (places, distances) in zip(query_ids.tolist(), closest(queries, others, k, query_ids, other_ids)):
                    asked.append(np.full(len(places), query))
                    found.append(other_ids[places])
                    scores.append(distances)
                columns = [np.concatenate(x) if x else np.zeros(0) for x in (asked, found, scores)]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "id", "score"])
                del query_ids, other_ids, queries, others
            del batch  # before the next one is read

    return run


def exact_nearest(
    queries: DataFrame,
    candidates: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_bytes: int = 4 << 20,
    grid: tuple[int, int] = (4, 16),
) -> DataFrame:
    """``query_id, rank, id_col, score``: each query's ``k`` nearest candidates by Euclidean distance, nearest first, ties to smaller ids.

    Ids are integers. A candidate with the query's own id doesn't count; an id on several vectors
    counts once, by its nearest; a query's id on several vectors asks with all of them. ``grid`` is the number of rows and columns over which blocks of
    queries and candidates are dealt: a candidate is sent to each row, a query to each column.
    Vectors are compared with those of their own length. Null ids, and vectors that are null,
    empty or hold null or non-finite components, take no part. Fewer candidates than ``k`` give as many
    rows; empty tables give none.
    """
    rows, columns = grid

    def packed(table: DataFrame) -> DataFrame:
        sound = F.forall(vector_col, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
        kept = table.where(F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & sound)
        return kept.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).mapInArrow(_packing(block_bytes), _BLOCK_FIELDS)

    place = F.monotonically_increasing_id()

    def numbers(n: int) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def dealt(blocks: DataFrame, own: str, own_n: int, every: str, n: int) -> DataFrame:
        # The block's own place is fixed before it is repeated: beside a generator it would be drawn for each copy.
        return blocks.withColumn(own, F.pmod(F.xxhash64(place), F.lit(own_n)).cast("int")).withColumn(every, numbers(n))

    asked = dealt(packed(queries).withColumnsRenamed({"ids": "query_ids", "vectors": "query_vectors"}), "_row", rows, "_column", columns)
    offered = dealt(packed(candidates), "_column", columns, "_row", rows)
    met = asked.join(offered.hint("merge"), ["dim", "_row", "_column"]).select("dim", "query_ids", "query_vectors", "ids", "vectors")
    found = met.mapInArrow(_meeting(k), "query_id long, id long, score double")
    once = found.groupBy("query_id", "id").agg(F.min("score").alias("score"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return once.withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
