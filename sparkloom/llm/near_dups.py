"""Near duplicates by circulant MinHash, banding and exact Jaccard confirmation.

Signatures. Shingle hashes are placed on a circle of 2**32 positions by one
permutation; a second permutation, circularly shifted k times, gives the k-th
coordinate: min over the set of pi(sigma(x) + k * stride). No further hash
functions are drawn. Bands of ``rows`` coordinates are hashed to bucket keys.
With 32 bands of 4 a pair at Jaccard 0.8 shares no bucket with probability 5e-8.

Links without all pairs of a bucket. Texts of equal shingle sets are one class
and only its smallest id goes on. The smallest id of a bucket is its pivot. Each
class is compared with the smallest of its pivots first, which gives trees, then
with its other pivots where these are not in its tree yet. Only buckets that still
hold several components are looked at again: a class whose shingles occur too
rarely among those classes can have no partner and leaves (an exact bound), and
the rest are joined across components with the exact test inside the join
condition, so only true links leave the join.

Defined cases: a null or wordless text has no shingles, links with nothing and
is its own component; a text of fewer words than the shingle width is one
shingle; repeated rows share their component and are all kept if theirs is the
component's smallest id; ids are meant to be unique: an id on several texts ties those
of its classes together of which it is the smallest id, and its rows in other classes have
the component of their own class; very long texts are handled whole, one at a time; an empty table gives no rows;
further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pieces, released
from .graph import connected_components, tree_roots
from .shingles import mix64, shingle_sets

STRIDE = np.uint32(0x9E3779B1)  # odd, so the shifts of the circle are all different
BLOCK = 1 << 14


def _permute(x: np.ndarray, first: int, second: int) -> np.ndarray:
    """A bijection of 32-bit values, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(first)
    x ^= x >> np.uint32(13)
    x *= np.uint32(second)
    x ^= x >> np.uint32(16)
    return x


def circulant_signature(shingles: np.ndarray, n_coordinates: int) -> np.ndarray:
    """All coordinates of one shingle set."""
    places = _permute((shingles >> np.uint64(32)).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    shifts = np.arange(n_coordinates, dtype=np.uint32)[:, None] * STRIDE
    best = np.full(n_coordinates, 0xFFFFFFFF, np.uint32)
    for begin in range(0, len(places), BLOCK):
        part = _permute(places[None, begin : begin + BLOCK] + shifts, 0x85EBCA6B, 0xC2B2AE35)
        np.minimum(best, part.min(axis=1), out=best)
    return best


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket key for each band; the band's number is part of it."""
    values = signature.reshape(bands, rows).astype(np.uint64)
    keys = np.arange(bands, dtype=np.uint64)
    for column in values.T:
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys


def _signing(width: int, bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1, 1 << 20):
            sets = shingle_sets(batch.column(1).to_pylist(), width)
            keys = [band_keys(circulant_signature(s, bands * rows), bands, rows).view(np.int64) if len(s) else None for s in sets]
            sums = np.array([(s.sum(dtype=np.uint64), mix64(s + np.uint64(1)).sum(dtype=np.uint64)) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sums[:, 0]), pa.array(sums[:, 1]), pa.array(keys, pa.list_(pa.int64())), *batch.columns[2:]],
                names=["id", "n", "set_a", "set_b", "bands", *batch.schema.names[2:]],
            )

    return run


def _sets(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1, 1 << 20):
            sets = shingle_sets(batch.column(1).to_pylist(), width)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), *batch.columns[2:]],
                names=["rep", "n", "shingles", *batch.schema.names[2:]],
            )

    return run


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    bands: int = 32,
    rows: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_hash: bool = False,
) -> DataFrame:
    """``id_col, n_shingles, component_id, kept``, one row for each row of ``docs``.

    Texts are linked when ``100 * |A & B| >= percent * |A | B|`` on their full
    sets of ``width``-word shingles; ``kept`` marks the smallest id of a component.
    With ``keep_hash`` also ``text_hash``, Spark's 64-bit hash of the text.
    """
    kind = dict(docs.dtypes)[id_col]
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    more = [F.xxhash64("text").alias("text_hash")] if keep_hash else []
    fields = ", text_hash long" if keep_hash else ""
    signed = cut(slim.select("id", "text", *more).mapInArrow(_signing(width, bands, rows), f"id {kind}, n long, set_a long, set_b long, bands array<long>{fields}"))
    same_set = ["n", "set_a", "set_b"]
    classes = signed.where("n > 0 and id is not null").groupBy(*same_set).agg(F.min("id").alias("rep"), F.any_value("bands").alias("bands"))

    members = classes.select("rep", "n", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("_size")).where("_size > 1")
    live = cut(members.join(buckets.drop("_size"), "key"))
    released(docs.sparkSession)

    # Not cut, so that the adaptive join with the texts sees its measured size.
    heads = (
        live.groupBy("rep").agg(F.min(F.struct("pivot", "n")).alias("_least"), F.max(F.col("rep") == F.col("pivot")).alias("leads"))
        .select("rep", F.col("_least.pivot").alias("first"), F.col("_least.n").alias("n_first"), "leads")
    )
    sets = slim.join(heads, F.col("id") == F.col("rep")).select("rep", "text", "first", "n_first", "leads").mapInArrow(
        _sets(width), f"rep {kind}, n long, shingles array<long>, first {kind}, n_first long, leads boolean"
    )
    # Only a table with repeated ids pays for an exchange of the sets that leaves one of equal ones.
    repeated = not signed.where("n > 0").groupBy("id").count().where("count > 1").isEmpty()
    sets = cut(sets.distinct() if repeated else sets)
    released(docs.sparkSession)
    pivot_sets = sets.where("leads").select(F.col("rep").alias("pivot"), F.col("n").alias("n_pivot"), F.col("shingles").alias("others"))

    def linked(a: str, b: str, n_a: str, n_b: str) -> F.Column:
        common = F.size(F.array_intersect(a, b)).cast("long")
        return (100 + percent) * common >= percent * (F.col(n_a) + F.col(n_b))

    def near_size(n_a: str, n_b: str) -> F.Column:
        return 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)

    def with_pivot(rows: DataFrame) -> DataFrame:
        return rows.join(pivot_sets, "pivot").where(near_size("n", "n_pivot") & linked("shingles", "others", "n", "n_pivot"))

    trees = with_pivot(sets.where("n = n_first and first < rep").select("rep", "n", "shingles", F.col("first").alias("pivot")))
    roots = tree_roots(trees.select(F.col("rep").alias("node"), F.col("pivot").alias("parent")).distinct())
    known = cut(heads.join(roots, F.col("rep") == F.col("node"), "left").select("rep", "first", "n_first", F.coalesce("component", "rep").alias("comp")))

    # Classes that are not in the tree of one of their pivots. All else of a bucket is one component.
    apart = cut(
        live.where("pivot < rep").join(known, "rep")
        .join(known.select(F.col("rep").alias("pivot"), F.col("comp").alias("comp_pivot")), "pivot")
        .where("comp <> comp_pivot")
        .select("key", "rep", "n", "pivot", "comp", "comp_pivot", F.expr("pivot = first and n = n_first").alias("tested"))
    )
    released(docs.sparkSession)
    pairs = apart.where("not tested").select("rep", "n", "pivot", "comp", "comp_pivot").distinct()
    star_links = cut(with_pivot(pairs.join(sets.select("rep", "n", "shingles"), ["rep", "n"])).select(F.col("comp").alias("a"), F.col("comp_pivot").alias("b")).distinct())
    merged = connected_components(star_links)

    def renamed(rows: DataFrame, comp: str) -> DataFrame:
        onward = merged.select(F.col("node").alias(comp), F.col("component").alias("_onward"))
        return rows.join(onward, comp, "left").withColumn(comp, F.coalesce("_onward", comp)).drop("_onward")

    mixed = renamed(renamed(apart.select("key", "comp", "comp_pivot"), "comp"), "comp_pivot").where("comp <> comp_pivot").select("key").distinct()
    open_ = cut(renamed(live.join(mixed, "key", "left_semi").join(known.select("rep", "comp"), "rep"), "comp").select("key", "rep", "n", "comp"))
    # A partner must hold percent/100 of a class's shingles, so at least so many of them occur in another class here.
    own = ["rep", "n"]
    open_sets = sets.select(*own, "shingles").join(open_.select(*own).distinct(), own, "left_semi")
    tokens = open_sets.select(*own, F.explode("shingles").alias("shingle"))
    shared = tokens.groupBy("shingle").agg(F.count("*").alias("_in")).where("_in > 1").select("shingle")
    common = tokens.join(shared, "shingle", "left_semi").groupBy(*own).agg(F.count("*").alias("c"))
    rest = cut(open_.join(common, own).where(100 * F.col("c") >= percent * F.col("n")))
    released(docs.sparkSession)
    still = rest.groupBy("key").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high")).where("_low < _high").select("key")
    rest = rest.join(still, "key", "left_semi").join(sets.select(*own, "shingles"), own)
    left = rest.select("key", *(F.col(c).alias(f"{c}_a") for c in ("rep", "n", "comp", "c", "shingles")))
    right = rest.select("key", *(F.col(c).alias(f"{c}_b") for c in ("rep", "n", "comp", "c", "shingles")))
    bound = (100 + percent) * F.least("c_a", "c_b") >= percent * (F.col("n_a") + F.col("n_b"))
    cross_links = (
        left.join(
            right,
            (left.key == right.key) & (F.col("comp_a") < F.col("comp_b")) & near_size("n_a", "n_b") & bound & linked("shingles_a", "shingles_b", "n_a", "n_b"),
        )
        .select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))
        .distinct()
    )
    cross_links = cut(cross_links)
    released(docs.sparkSession)
    if not cross_links.isEmpty():
        merged = connected_components(star_links.union(cross_links))
    final = renamed(roots.select("node", F.col("component").alias("comp")), "comp").unionByName(
        merged.join(roots, "node", "left_anti").select("node", F.col("component").alias("comp"))
    )

    joined = (
        signed.drop("bands")
        .join(classes.drop("bands"), same_set, "left")
        .join(final, F.col("rep") == F.col("node"), "left")
    )
    return joined.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("comp", "rep", "id").alias("component_id"),
        *(["text_hash"] if keep_hash else []),
    ).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
