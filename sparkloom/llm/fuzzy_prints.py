"""SimHash near duplicates by fuzzy hashing with the Golay code.

Fingerprints link at four or fewer differing bits. A fingerprint is cut into three
segments, each short enough for a 23-bit Golay word. Pigeonhole: of two fingerprints
that link, either some segment has no error, or two segments have one error each (three
segments with an error each leave one more error to spend). So the keys are

- each segment as it is (an error-free segment), and
- for each two segments, the pair of codeword indices. Of two words with one error between
  them, each is within four errors of the other's codeword. So side A takes all codewords
  within four errors of the first segment (one or six) and the nearest one of the second,
  side B the nearest of the first and all of the second, and A meets B.

Links without all pairs of a bucket. Equal fingerprints are one node. A bucket has four heads
(the smallest and the largest fingerprint, by value and by hash), which are compared with each
other where the bucket is aggregated. That is all of most buckets; only a bucket with further
members is joined with them, to compare these with its heads. Components of these links are
found. Only buckets with several further members that still hold several components are joined
again: those outside of the bucket's largest component with all of the bucket. There the
rest of the fingerprint is cut once more into one block more than it can have errors, of which
one must be equal. The distance is tested inside the join condition, so only links leave the join.

Defined cases: null, empty and wordless texts have fingerprint zero and are linked like any
other; a text of fewer words than the shingle width is one shingle; a bit that is set in exactly
half of the shingles is 0; very long texts are hashed block by block; repeated rows share their
component; an id on several texts gives one row for each, and each has the component of its own
text; a null id counts only where a component has no other, whose id is then null; an empty
table gives no rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, placed, removed, written
from .golay import indices
from .graph import connected_components

BITS, MOST_ERRORS = 64, 4
#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Sides of a bucket: A meets B, BOTH meets all others.
SIDE_A, SIDE_B, BOTH = 1, 2, 3
HASH_SEED = 42
BLOCK = 1 << 16


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of the words' shingles by XXH64, 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < width:
        return xxhash.xxh64_intdigest(line, HASH_SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1]
    ends = ends[width - 1 :]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(ends), BLOCK):
        spans = zip(begins[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist())
        hashes = np.array([xxhash.xxh64_intdigest(line[b:e], HASH_SEED) for b, e in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(ends), bitorder="little").view("<u8")[0])


def _printing(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            prints = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["id", "print"])

    return run


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, sides and the number of the fingerprint for each."""
    parts = [(prints.view(np.uint64) >> np.uint64(first)).astype(np.int64) & ((1 << width) - 1) for first, width in SEGMENTS]
    rows = np.arange(len(prints))
    found = [((s << 24) | part, BOTH, rows) for s, part in enumerate(parts)]
    nearest, further = zip(*(indices(p) for p in parts))
    for nth, (i, j) in enumerate(PAIRS, len(SEGMENTS)):
        own = [(nearest[i], nearest[j], BOTH)]
        own += [(index, nearest[j], SIDE_A) for index in further[i].T]
        own += [(nearest[i], index, SIDE_B) for index in further[j].T]
        for first, second, side in own:
            there = (first >= 0) & (second >= 0)
            found.append((((nth << 24) | (first << 12) | second)[there], side, rows[there]))
    return (
        np.concatenate([k for k, _, _ in found]),
        np.concatenate([np.full(len(k), side, np.int8) for k, side, _ in found]),
        np.concatenate([r for _, _, r in found]),
    )


def _keying(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy()
        key, side, row = keys(prints)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(side), pa.array(prints[row])], names=["key", "side", "print"])


def _rest_blocks(kind: Column, fingerprint: Column) -> Column:
    """Blocks of what a key leaves out, one more than it can have errors; one of them is equal if the key's pigeonhole case holds.

    A whole segment leaves all errors to the other two, two segments with an error each leave
    ``MOST_ERRORS - 2`` to the third.
    """

    def cut(first: int, width: int, n: int) -> list[Column]:
        bounds = [first + width * i // n for i in range(n + 1)]
        return [F.shiftrightunsigned(fingerprint, b).bitwiseAND(F.lit((1 << (e - b)) - 1)) for b, e in zip(bounds, bounds[1:])]

    cases = []
    for own in range(len(SEGMENTS)):
        others = [s for k, s in enumerate(SEGMENTS) if k != own]
        cases.append(cut(*others[0], 3) + cut(*others[1], 2))
    for pair in PAIRS:
        (other,) = (s for k, s in enumerate(SEGMENTS) if k not in pair)
        cases.append(cut(*other, MOST_ERRORS - 1))
    return F.array(*[F.array(*c) for c in cases])[kind]


def _linked(a: Column, b: Column) -> Column:
    """Whether two different fingerprints link."""
    return (a != b) & (F.bit_count(a.bitwiseXOR(b)) <= MOST_ERRORS)


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """``node, component`` of every fingerprint of ``prints(print)`` (distinct) that links with another; the rest are alone."""
    spark = prints.sparkSession
    members, members_in = placed(prints.select("print").mapInArrow(_keying, "key long, side byte, print long"))
    tell = F.struct(F.xxhash64("print").alias("h"), "print")
    ends = members.groupBy("key").agg(
        F.count("*").alias("n"), F.bit_or("side").alias("sides"), F.min("print").alias("p0"), F.max("print").alias("p1"), F.min(tell).alias("t2"), F.max(tell).alias("t3")
    )
    heads = [F.col(c) for c in ("p0", "p1", "t2.print", "t3.print")]
    among = F.filter(F.array(*[F.struct(a.alias("a"), b.alias("b")) for a, b in combinations(heads, 2)]), lambda pair: _linked(pair["a"], pair["b"]))
    buckets, buckets_in = placed(
        ends.where((F.col("n") > 1) & (F.col("sides") == BOTH))
        .select("key", "n", F.array_distinct(F.array(*heads)).alias("heads"), among.alias("among"))
        .where((F.col("n") > F.size("heads")) | (F.size("among") > 0))
    )
    further = buckets.where(F.col("n") > F.size("heads")).select("key", "heads", (F.col("n") > F.size("heads") + 1).alias("several"))
    linked_heads = F.filter("heads", lambda p: _linked(p, F.col("print")))
    crowded, crowded_in = placed(members.join(further, "key").select("key", "side", "print", "several", linked_heads.alias("heads")))
    removed(spark, members_in)
    among_heads = buckets.select(F.explode("among").alias("pair")).select("pair.a", "pair.b")
    with_heads = crowded.select(F.col("print").alias("a"), F.explode("heads").alias("b"))
    links, links_in = placed(among_heads.union(with_heads).distinct())
    removed(spark, buckets_in)
    known = connected_components(links)

    # Buckets that still hold several components, and the largest component of each.
    names = known.select(F.col("node").alias("print"), F.col("component").alias("named"))
    placed_in_comp = crowded.where("several").select("key", "side", "print").join(names, "print", "left").select("key", "side", "print", F.coalesce("named", "print").alias("comp"))
    sorted_out, sorted_in = placed(placed_in_comp)
    removed(spark, crowded_in)
    shares = sorted_out.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "comp")).alias("most"), F.count("*").alias("comps"))
    mixed = sorted_out.join(shares.where("comps > 1").select("key", F.col("most.comp").alias("major")), "key")
    blocks = _rest_blocks(F.shiftright("key", 24).cast("int"), F.col("print"))
    fine = mixed.select("key", "side", "print", "comp", (F.col("comp") == F.col("major")).alias("in_major"), F.posexplode(blocks).alias("nth", "block"))
    open_, open_in = placed(fine)
    removed(spark, sorted_in)

    def side(which: int, tag: str) -> DataFrame:
        rows = open_.where(F.col("side").bitwiseAND(which) != 0)
        return rows.select("key", "nth", "block", *[F.col(c).alias(f"{c}_{tag}") for c in ("print", "comp", "in_major")])

    # Those outside of the largest component on side A with all, and those inside with the ones outside.
    # In buckets of whole segments all are on both sides, so the second would repeat the first.
    a, b = side(SIDE_A, "a"), side(SIDE_B, "b")
    apart = (F.col("comp_a") != F.col("comp_b")) & _linked(F.col("print_a"), F.col("print_b"))
    met = a.where("not in_major_a").join(b, ["key", "nth", "block"]).where(apart)
    inside = a.where(F.col("in_major_a") & (F.shiftright("key", 24) >= len(SEGMENTS)))
    met_inside = inside.join(b.where("not in_major_b"), ["key", "nth", "block"]).where(apart)
    found = met.union(met_inside).select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b"))
    more, more_in = placed(found.distinct())
    removed(spark, open_in)
    if not more.isEmpty():
        # The further links run between components, so only these are put together.
        joined = connected_components(more).select(F.col("node").alias("old"), F.col("component").alias("new"))
        moved = known.join(joined, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
        alone = joined.join(known, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("component"))
        known = moved.union(alone)
    result = written(known)
    removed(spark, links_in, more_in)
    return result


def near_duplicates(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fingerprint, component_id`` for each row of ``docs``; components by links of any length, named by their smallest id."""
    kind = dict(docs.dtypes)[id_col]
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = written(slim.mapInArrow(_printing(width), f"id {kind}, print long"))
    nodes = written(signed.groupBy("print").agg(F.min("id").alias("first")))
    known = fingerprint_links(nodes)
    grouped = nodes.join(known.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    least = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    final = written(grouped.join(least, "component").select("print", "component_id"))
    return signed.join(final, "print").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
