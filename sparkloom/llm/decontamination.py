"""Verbatim overlap of training documents with benchmark items, by suffix arrays.

The corpus is cut into shards (slices of Spark partitions). A shard's words are
numbered by the benchmark's vocabulary; runs of known words long enough to hold
a window are laid end to end and their suffix array is built by prefix doubling,
to the depth of a window. Runs with unknown words cannot hold a window, so leaving
them out loses no match. Every suffix of every item that starts a window is then
binary-searched in the array; its range gives all places where the window stands.
Neighbouring places on one diagonal (document place minus item place) join to the
longest verbatim matches. An item that repeats one of its own windows could match at
very many diagonals; for it the longest match from every document place is found, and
of these the fewest that cover all its hit words are reported, so nothing grows with
the product of both sides.

The benchmark is read in blocks of bounded size. Each block is broadcast and
searched by one pass over the corpus; there is no shuffle of documents, and a
passage shared by very many of them costs each shard only its own occurrences.
Between blocks rows are cut to the shared checkpoint folder, so that no task holds
more than one block.

Defined cases: null and wordless texts have no words, no hits and are clean; an
item with fewer words than a window is one window, an item without words none;
equal items are each reported; repeated rows give repeated rows; very long texts are
handled whole, one at a time; empty tables give no rows or clean documents; further
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, kept_columns, named_back, pieces
from .shingles import blank_bytes, hashed_words

#: Words are runs of 0-9, a-z and anything beyond ASCII.
WORD_BREAKS = blank_bytes((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


class Block:
    """The windows of some benchmark items, numbered by their own vocabulary."""

    def __init__(self, ids: list, texts: list[str | None], window: int):
        words, bounds = hashed_words(texts, WORD_BREAKS)
        self.vocabulary = np.unique(words)
        numbers = (np.searchsorted(self.vocabulary, words) + 1).astype(np.uint32)
        self.ids = ids
        self.groups: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        lengths = np.diff(bounds)
        for size in np.unique(np.minimum(lengths[lengths > 0], window)).tolist():
            owners = np.flatnonzero(lengths >= window if size == window else lengths == size)
            counts = lengths[owners] - size + 1
            item = np.repeat(owners, counts)
            start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            rows = numbers[(bounds[item] + start)[:, None] + np.arange(size)]
            distinct, inverse = np.unique(rows, axis=0, return_inverse=True)
            inverse = inverse.ravel()
            order = np.argsort(inverse, kind="stable")
            at = np.searchsorted(inverse[order], np.arange(len(distinct) + 1))
            self.groups.append((size, _keys(distinct), at, item[order], start[order]))
        #: Items that hold one window several times, with the numbers (of group and window) of all their windows in order.
        self.repeating = {}
        for g, (_, _, at, item, start) in enumerate(self.groups):
            window = np.repeat(np.arange(len(at) - 1), np.diff(at))
            again = np.zeros(len(item), bool)
            by = np.lexsort((window, item))
            again[by[1:]] = (item[by[1:]] == item[by[:-1]]) & (window[by[1:]] == window[by[:-1]])
            for own in np.unique(item[again]).tolist():
                places = np.flatnonzero(item == own)
                self.repeating[own] = g, window[places][np.argsort(start[places])]
        self.single = [~np.isin(group[3], list(self.repeating)) for group in self.groups]
        self.shortest = min((g[0] for g in self.groups), default=0)
        self.longest = max((g[0] for g in self.groups), default=0)


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings of the same order."""
    big = np.ascontiguousarray(rows, ">u4")
    return big.view(f"S{4 * rows.shape[1]}").ravel()


def suffix_array(sequence: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes, compared over ``depth`` words at least."""
    rank, reach = sequence.astype(np.int64), 1
    while reach < depth:
        after = np.zeros_like(rank)
        after[:-reach] = rank[reach:] + 1
        _, rank = np.unique(rank * (int(after.max(initial=0)) + 1) + after, return_inverse=True)
        reach *= 2
    return np.argsort(rank, kind="stable")


def shard_matches(block: Block, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Longest matches as arrays: text number, item number, first word in the text, first word in the item, words."""
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if not block.groups or not len(words):
        return none
    place = np.minimum(np.searchsorted(block.vocabulary, words), len(block.vocabulary) - 1)
    known = block.vocabulary[place] == words
    # Runs of known words within one text.
    edge = np.ones(len(words) + 1, bool)
    edge[1:-1] = ~known[1:] | ~known[:-1]
    edge[bounds] = True
    firsts = np.flatnonzero(edge)
    lengths = np.diff(firsts)
    keep = (lengths >= block.shortest) & known[firsts[:-1]]
    firsts, lengths = firsts[:-1][keep], lengths[keep]
    if not len(firsts):
        return none
    # Laid end to end with one stop (zero) after each run.
    total = int(lengths.sum())
    source = np.repeat(firsts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(total)
    spot = np.arange(total) + np.repeat(np.arange(len(lengths)), lengths)
    sequence = np.zeros(total + len(lengths) + block.longest, np.uint32)
    sequence[spot] = place[source] + 1
    origin = np.zeros(len(sequence), np.int64)
    origin[spot] = source
    order = suffix_array(sequence, block.longest)

    at_words, items, starts, sizes = [], [], [], []
    more = [np.zeros((4, 0), np.int64)]
    for g, (size, keys, at, item, start) in enumerate(block.groups):
        fit = order[order <= len(sequence) - size]
        suffixes = _keys(np.lib.stride_tricks.sliding_window_view(sequence, size)[fit])
        low, high = np.searchsorted(suffixes, keys, "left"), np.searchsorted(suffixes, keys, "right")
        met = np.flatnonzero(high > low)
        for k in met.tolist():
            uses = at[k] + np.flatnonzero(block.single[g][at[k] : at[k + 1]])
            if not len(uses):
                continue
            where = origin[fit[low[k] : high[k]]]
            at_words.append(np.repeat(where, len(uses)))
            items.append(np.tile(item[uses], len(where)))
            starts.append(np.tile(start[uses], len(where)))
            sizes.append(np.full(len(where) * len(uses), size))
        for own, (group, windows) in block.repeating.items():
            if group == g:
                here = np.intersect1d(windows, met)
                if len(here):
                    spots = np.concatenate([fit[low[k] : high[k]] for k in here.tolist()])
                    names = np.repeat(here, (high - low)[here])
                    first, begin, n = _covering(spots, names, windows, size)
                    more.append(np.stack([origin[first], np.full(len(first), own), begin, n]))
    none_ = np.zeros(0, np.int64)
    word, item, start, size = (np.concatenate([none_, *x]) for x in (at_words, items, starts, sizes))
    # Places that follow each other on one diagonal of one item are one match.
    diagonal = word - start
    by = np.lexsort((word, diagonal, item))
    word, item, start, size, diagonal = word[by], item[by], start[by], size[by], diagonal[by]
    new = np.ones(len(word), bool)
    new[1:] = (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (word[1:] != word[:-1] + 1)
    begin = np.flatnonzero(new)
    last = np.concatenate((begin[1:], [len(word)])) - 1 if len(begin) else begin
    found = np.concatenate([np.stack([word[begin], item[begin], start[begin], word[last] + size[last] - word[begin]]), *more], axis=1)
    text = np.searchsorted(bounds, found[0], "right") - 1
    return text, found[1], found[0] - bounds[text], found[2], found[3]


def _covering(spots: np.ndarray, names: np.ndarray, windows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one item's matches, the fewest longest ones that cover all places: first place, place in the item, words.

    ``spots`` are the places of its windows in the sequence and ``names`` the windows; ``windows`` are the item's, in order.
    """
    by = np.argsort(spots)
    spots, names = spots[by], names[by]
    follows = np.append(spots[1:] == spots[:-1] + 1, False)
    best, best_at = np.zeros(len(spots), np.int64), np.zeros(len(spots), np.int64)
    run = np.zeros(len(spots) + 1, np.int64)
    for k in range(len(windows) - 1, -1, -1):  # windows that agree from each place and from the item's k-th window on
        run = np.append(np.where(names == windows[k], 1 + np.where(follows, run[1:], 0), 0), 0)
        longer = run[:-1] >= best
        best[longer], best_at[longer] = run[:-1][longer], k
    # From the first place on, always the match that begins within the last one (or right behind it) and reaches farthest.
    chosen, k, n = [], 0, len(spots)
    reach = spots + best + size - 1
    farthest = np.maximum.accumulate(reach)
    holder = np.maximum.accumulate(np.where(reach == farthest, np.arange(n), 0))
    while k < n:
        chosen.append(k)
        end = int(reach[k])
        last = int(np.searchsorted(spots, end, "right")) - 1
        if farthest[last] > end:
            k = int(holder[last])
        else:
            k = last + 1
    chosen = np.array(chosen, np.int64)
    return spots[chosen], best_at[chosen], best[chosen] + size - 1


def _searching(handle, last: bool, id_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the matches of one block; with ``last`` also the counts, and drops the text."""
    match = pa.list_(pa.struct([("item_id", id_type), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = handle.value
        for batch in pieces(batches, 1, 2 << 20):
            texts = batch.column(1).to_pylist()
            words, bounds = hashed_words(texts, WORD_BREAKS)
            found = batch.column(2).to_pylist()
            for text, item, at, start, n in zip(*(x.tolist() for x in shard_matches(block, words, bounds))):
                found[text] = [*(found[text] or []), {"item_id": block.ids[item], "doc_word": at, "item_word": start, "n_words": n}]
            matches = pa.array([f or [] for f in found], match)
            if not last:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), matches, *batch.columns[3:]], names=["id", "text", "matches", *batch.schema.names[3:]])
                continue
            n_words = np.diff(bounds)
            hits = []
            for n, own in zip(n_words.tolist(), found):
                if own:
                    spans = np.zeros(n + 1, np.int64)
                    np.add.at(spans, [m["doc_word"] for m in own], 1)
                    np.add.at(spans, [m["doc_word"] + m["n_words"] for m in own], -1)
                    hits.append(int((np.cumsum(spans)[:n] > 0).sum()))
                else:
                    hits.append(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(hits, pa.int64()), matches, *batch.columns[3:]],
                names=["id", "n_words", "n_hit", "matches", *batch.schema.names[3:]],
            )

    return run


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    one_in: int = 20,
    block_bytes: int = 16 << 20,
    id_col: str = "doc_id",
    item_col: str = "item_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``id_col, n_words, n_hit, items, matches, longest_match, contaminated`` and ``keep`` for each document.

    ``matches`` holds the longest verbatim matches with their places. A document is
    contaminated if at least one word in ``one_in`` lies inside a match.
    """
    spark = docs.sparkSession
    item_type = dict(benchmark.dtypes)[item_col]
    arrow_type = benchmark.select(item_col).limit(0).toArrow().schema.field(0).type
    total = benchmark.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    match_type = f"array<struct<item_id: {item_type}, doc_word: long, item_word: long, n_words: long>>"
    id_type = dict(docs.dtypes)[id_col]
    more, kept = kept_columns(docs, keep)
    state = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(None).cast(match_type).alias("matches"), *more)
    part = F.pmod(F.xxhash64(item_col, text_col), F.lit(n_blocks))
    for k in range(n_blocks):
        # One block is about block_bytes of text; the next is read only after this one is compiled.
        rows = benchmark.where(part == k).select(item_col, text_col).toArrow()
        handle = spark.sparkContext.broadcast(Block(rows.column(0).to_pylist(), rows.column(1).to_pylist(), window))
        last = k == n_blocks - 1
        fields = "n_words long, n_hit long" if last else "text string"
        state = state.mapInArrow(_searching(handle, last, arrow_type), f"id {id_type}, {fields}, matches {match_type}{kept}")
        if not last:
            state = cut(state)
            handle.unpersist()
    own = [] if id_col in keep else [F.col("id").alias(id_col)]
    return state.select(
        *own,
        "n_words",
        "n_hit",
        F.array_distinct(F.transform("matches", lambda m: m["item_id"])).alias("items"),
        "matches",
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["n_words"])), F.lit(0).cast("long")).alias("longest_match"),
        ((F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        *named_back(keep),
    )
