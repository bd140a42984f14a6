"""SentencePiece encoding, decoding, and sampled segmentations without replacement.

A word here is a run of space marks and what follows up to the next run. A model with
a piece that crosses the start of a word is refused, so a text's encoding is that of its
words in order: the library encodes each distinct word once and decodes whole texts.
For sampling, a text's lattice holds every way to write it in vocabulary pieces (bytes
for characters without a piece); it is a chain of word lattices, which a task keeps from
slice to slice in a store of bounded size. A segmentation's probability is in proportion
to the product of its pieces' weights, (rank + 2) ** -theta. These weights are chosen
here, as the given model merges pairs (BPE) and holds ranks instead of probabilities.

Gumbel top-k: one Gumbel variable for each segmentation is added to its log
probability and the k largest sums are taken, without listing segmentations. The
search is best first over prefixes: the whole lattice has a Gumbel-distributed
maximum; the segmentation that attains it is drawn word by word; what is left
falls into one set for each word (same words before it, this word cut otherwise),
whose maxima are Gumbel variables bounded by the one just used; the set of largest
maximum is next. All texts of a batch advance together. The (k + 1)-th maximum is the threshold of the inclusion scores
``1 - exp(-exp(log_p - threshold))``. All random numbers are a hash of the row key
and the place, so results don't depend on batches or tasks.

Defined cases: null and empty texts have no pieces, and one empty segmentation of
probability 1; texts with fewer than k segmentations give all of them, each with
score 1; a score below the range of doubles is 0; equal keys with equal texts give equal samples; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces as slices
from .shingles import _powers, mix64

SPACE = "▁"
BASE = 0xD1342543DE82EF95
FILTER_BITS = 20
MASK = np.uint64((1 << FILTER_BITS) - 1)
#: So many words are given to the library as one text.
TOGETHER = 32
#: Words kept from slice to slice have so many characters together, at about 85 bytes each.
KEPT_CHARS = 3 << 18


class Vocabulary:
    """The pieces that sampling may use, found by the hash of their characters."""

    def __init__(self, path: str, theta: float):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.model = model
        usable = [
            i
            for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        words = [model.id_to_piece(i) for i in usable]
        if any(SPACE in w.lstrip(SPACE) for w in words):
            raise ValueError("pieces with a space mark after another character are not supported")
        rank = np.minimum(-np.array([model.get_score(i) for i in usable]), model.get_piece_size())  # a lone space mark has no rank of its own
        self.longest, self.n_ids = max(map(len, words)), model.get_piece_size()
        hashes = _hashes(words)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(usable)[order]
        self.weights = -theta * np.log(rank[order] + 2)
        self.byte_weight = -theta * np.log(len(usable) + 2.0)
        self.first_byte = model.piece_to_id("<0x00>")
        #: The characters of each id; of a character's bytes only the first counts.
        self.chars = np.array([len(model.id_to_piece(i)) for i in range(self.n_ids)])
        self.chars[self.first_byte : self.first_byte + 256] = (np.arange(256) & 0xC0) != 0x80
        #: What a space mark without anything after it adds to a text's pieces.
        self.lone_mark = np.array(model.encode("a ")[len(model.encode("a")) :], np.int32)
        if model.normalize("ﬁ ½") != SPACE + "ﬁ" + SPACE + "½":
            raise ValueError("models that change characters before they split are not supported")
        # One place for each low part of a hash: the only piece there, or a mark that there are several.
        low = (self.hashes & MASK).astype(np.int64)
        self.table = np.full(1 << FILTER_BITS, -1, np.int32)
        self.table[low] = np.arange(len(low))
        self.table[np.flatnonzero(np.bincount(low, minlength=1 << FILTER_BITS) > 1)] = -2
        #: Whether a longer piece may begin with the characters of this hash.
        self.more = np.zeros(1 << FILTER_BITS, bool)
        self.more[(_hashes(list({w[:n] for w in words for n in range(1, len(w))})) & MASK).astype(np.int64)] = True

    def encode(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of words whose characters are laid end to end, and how many ids each word has."""
        begins, ends = np.cumsum(sizes) - sizes, np.cumsum(sizes)
        cut = np.arange(len(sizes)) % TOGETHER == 0
        cut[1:] |= points[ends[:-1] - 1] == ord(SPACE)  # a word of marks alone would be one with the next
        line, cuts = points.tobytes().decode("utf-32-le").replace(SPACE, " "), [*begins[cut].tolist(), len(points)]
        ids = self.model.encode_as_numpy([line[a + 1 : b] for a, b in zip(cuts, cuts[1:])], num_threads=1)
        ids = np.concatenate([i if len(i) else self.lone_mark for i in ids])
        return ids, np.diff(np.searchsorted(np.cumsum(self.chars[ids]), ends, "right"), prepend=0)

    def look_up(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which hashes are pieces, the pieces' numbers, and which may go on to a longer piece."""
        low = (found & MASK).astype(np.int64)
        index = self.table[low]
        fit = np.flatnonzero(index != -1)
        index = index[fit].astype(np.int64)
        several = np.flatnonzero(index == -2)
        index[several] = np.minimum(np.searchsorted(self.hashes, found[fit[several]]), len(self.hashes) - 1)
        same = self.hashes[index] == found[fit]
        return fit[same], index[same], self.more[low]


def _hashes(words: list[str]) -> np.ndarray:
    """The hash of each word's characters; no word is empty."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    begins = np.cumsum(sizes) - sizes
    powers = _powers(BASE, int(sizes.max(initial=0)))[np.arange(len(points)) - np.repeat(begins, sizes)]
    return mix64(np.add.reduceat(mix64(points) * powers, begins) + sizes.astype(np.uint64))


def _spread(values: np.ndarray, at: np.ndarray, n: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``n`` values from each place ``at``, laid end to end, and the bounds of groups of runs in them."""
    ends = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
    return values[np.repeat(at - ends[:-1], n) + np.arange(int(ends[-1]))], ends[bounds]


@functools.lru_cache(maxsize=2)
def vocabulary(path: str, theta: float) -> Vocabulary:
    return Vocabulary(path, theta)


class Store:
    """Word lattices by the hash of the word, kept from slice to slice up to a bounded number of characters.

    Nodes are places in words, edges are pieces; the ends of all words are node 0. Arrays
    grow at their ends, so a word's numbers stay until the store shrinks. An edge's ids
    stand in ``pool``, which begins with every id at its own place; the bytes of
    characters without a piece follow.
    """

    NODES = {"first": np.int64, "log_plain": float, "log_left": float, "log_others": float, "p_first": float, "owner": np.int32}
    EDGES = {"target": np.int32, "log_p": float, "count": np.int8, "offset": np.int32}
    WORDS = {"start": np.int64, "uses": np.int64, "code_at": np.int64, "code_n": np.int32, "plain_at": np.int64, "plain_n": np.int32}
    IDS = {"pool": np.int32, "codes": np.int32, "plains": np.int32}

    def __init__(self):
        self.arrays = {name: np.zeros(0, kind) for kinds in (self.NODES, self.EDGES, self.WORDS, self.IDS) for name, kind in kinds.items()}
        self.clear()

    def clear(self) -> None:
        """Forgets all words but keeps the arrays' room. Lattices made before may not be used after."""
        self.hashes, self.numbers, self.chars = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        self.sizes = dict.fromkeys(self.arrays, 0)
        # Node 0, and the bound of its edges.
        for name, value in (("first", [0, 0]), ("log_plain", [0.0]), ("log_left", [-np.inf]), ("log_others", [-np.inf]), ("p_first", [1.0]), ("owner", [0])):
            self.append(name, np.array(value))

    def shrink(self, most: int, n_ids: int) -> None:
        """Keeps the words used most often, of those used again, up to ``most`` characters; older uses count half.

        ``n_ids`` is the size of the vocabulary. Lattices made before may not be used after.
        """
        if not self.chars:
            return
        uses, owner = self.get("uses"), self.get("owner")
        order = np.argsort(-uses, kind="stable")
        fits = np.cumsum(np.bincount(owner[1:], minlength=len(uses))[order]) <= most
        word = np.zeros(len(uses), bool)
        word[order[fits]] = True
        word &= uses > 1
        node = word[owner]
        node[0] = True
        word_to, node_to = np.cumsum(word, dtype=np.int32) - 1, np.cumsum(node, dtype=np.int32) - 1
        word, node = np.flatnonzero(word), np.flatnonzero(node)
        first = self.get("first")[node]
        degree = self.get("first")[node + 1] - first
        ends = np.concatenate(([0], np.cumsum(degree)))
        edge = np.repeat(first - ends[:-1], degree) + np.arange(int(ends[-1]))
        # One array after the other, so that little is held twice.
        self.put("first", ends)
        self.put("owner", np.maximum(word_to[owner[node]], 0))
        for name in ("log_plain", "log_left", "log_others", "p_first"):
            self.put(name, self.get(name)[node])
        for name in ("log_p", "count", "offset", "target"):
            self.put(name, self.get(name)[edge])
        self.put("target", node_to[self.get("target")])
        offset = self.get("offset")
        bare = np.flatnonzero(offset >= n_ids)
        raw, at = _spread(self.get("pool"), offset[bare], self.get("count")[bare], np.arange(len(bare)))
        offset[bare] = n_ids + at
        self.put("pool", np.concatenate((self.get("pool")[:n_ids], raw)))
        self.put("start", node_to[self.get("start")[word]])
        self.put("uses", uses[word] >> 1)
        for ids, n, begin in (("codes", "code_n", "code_at"), ("plains", "plain_n", "plain_at")):
            self.put(n, self.get(n)[word])
            values, bounds = _spread(self.get(ids), self.get(begin)[word], self.get(n), np.arange(len(word) + 1))
            self.put(ids, values)
            self.put(begin, bounds[:-1])
        known = np.flatnonzero(np.isin(self.numbers, word))
        self.hashes, self.numbers, self.chars = self.hashes[known], word_to[self.numbers[known]], len(node) - 1

    def put(self, name: str, values: np.ndarray) -> None:
        """Puts values, no more than there are, in an array's place."""
        self.arrays[name][: len(values)] = values
        self.sizes[name] = len(values)

    def append(self, name: str, values: np.ndarray, drop: int = 0) -> int:
        """Puts values at the end of an array, over its last ``drop`` ones; where they begin."""
        at, held = self.sizes[name] - drop, self.arrays[name]
        if at + len(values) > len(held):
            self.arrays[name] = np.empty(max(at + len(values), len(held) + (len(held) >> 1)), held.dtype)
            self.arrays[name][:at] = held[:at]
        self.arrays[name][at : at + len(values)] = values
        self.sizes[name] = at + len(values)
        return at

    def get(self, name: str) -> np.ndarray:
        return self.arrays[name][: self.sizes[name]]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 where it is not kept."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.numbers[at], -1)

    def name(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers for further words, whose hashes are sorted."""
        numbers = len(self.hashes) + np.arange(len(hashes))
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.numbers = np.insert(self.hashes, at, hashes), np.insert(self.numbers, at, numbers)
        return numbers


class Lattice:
    """The word lattices of a batch of texts. Nodes are places in distinct words, edges are pieces."""

    def __init__(self, texts: list[str], known: Vocabulary, store: Store | None = None):
        line = "".join([SPACE + t.replace(" ", SPACE) for t in texts])
        points = np.frombuffer(line.encode("utf-32-le"), np.uint32)
        at = np.cumsum([0] + [len(t) + 1 for t in texts])
        mark = points == ord(SPACE)
        begin_ = mark.copy()
        begin_[1:] &= ~mark[:-1]
        begin_[at[:-1]] = True
        begins = np.flatnonzero(begin_)
        sizes = np.diff(np.append(begins, len(points)))
        powers = _powers(BASE, len(points) + 1)
        inverse = _powers(pow(BASE, -1, 1 << 64), len(points) + 1)
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(mix64(points.astype(np.uint64)) * powers[:-1], out=sums[1:])
        words = mix64((sums[begins + sizes] - sums[begins]) * inverse[begins] + sizes.astype(np.uint64))
        distinct, first, which = np.unique(words, return_index=True, return_inverse=True)
        #: Words of each text, in order: their numbers and the lattice node each begins at.
        self.bounds = np.searchsorted(begins, at)
        self.store = store = Store() if store is None else store
        number = store.find(distinct)
        new = number < 0
        if new.any():
            first = first[new]
            number[new] = store.name(distinct[new])
            self._build(points, sums, inverse, begins[first], sizes[first], known)
        which = which.ravel()
        store.get("uses")[number] += np.bincount(which, minlength=len(number))
        self.words = number[which]
        self.starts = store.get("start")[self.words]
        for name in (*Store.NODES, *Store.EDGES, "pool"):
            setattr(self, name, store.get(name))

    def _build(self, points: np.ndarray, sums: np.ndarray, inverse: np.ndarray, begins: np.ndarray, size: np.ndarray, known: Vocabulary) -> None:
        """Adds words of a batch, given by where they begin and their sizes, to the store."""
        store = self.store
        chars = int(size.sum())
        begin = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(size)), size)
        offset = np.arange(chars) - begin[owner]
        place = begins[owner] + offset  # of each character in the text
        left = size[owner] - offset  # characters to the end of the word
        # Nodes by distance from the end, so that each level stands together; the ends are one node, 0.
        longest = int(size.max(initial=0))
        by = np.argsort(left.astype(np.int16) if longest < 1 << 15 else left, kind="stable")
        n_nodes = chars + 1
        node = np.empty(chars + 1, np.int64)
        node[by], node[chars] = np.arange(1, n_nodes), 0
        after = np.arange(1, chars + 1)
        after[begin + size - 1] = chars
        starts = node[begin]
        levels = np.concatenate(([1], 1 + np.cumsum(np.bincount(left, minlength=longest + 1)[1:])))
        sources, targets, weights, ids = [], [], [], []
        alive = np.arange(chars)
        for length in range(1, known.longest + 1):
            if length > 1:
                alive = alive[left[alive] >= length]
            if not len(alive):
                break
            where = place[alive]
            found = mix64((sums[where + length] - sums[where]) * inverse[where] + np.uint64(length))
            fit, index, more = known.look_up(found)
            fit, alive = alive[fit], alive[more]
            sources.append(node[fit])
            targets.append(node[np.where(left[fit] == length, chars, fit + length)])
            weights.append(known.weights[index])
            ids.append(known.ids[index])
        # A character without a piece is one edge of its bytes.
        covered = np.zeros(n_nodes, bool)
        if sources:
            covered[sources[0]] = True
        bare = np.flatnonzero(~covered[node[:chars]])
        spelled = points[place]
        raw = [chr(p).encode() for p in points[place[bare]].tolist()]
        widths = np.array([len(b) for b in raw], np.int64)
        sources.append(node[bare])
        targets.append(node[after[bare]])
        weights.append(known.byte_weight * widths)
        n_plain = sum(map(len, ids))
        if not store.sizes["pool"]:
            store.append("pool", np.arange(known.n_ids))
        pool_at = store.append("pool", known.first_byte + np.frombuffer(b"".join(raw), np.uint8).astype(np.int32))
        offsets = np.concatenate([*ids, pool_at + np.cumsum(widths) - widths])
        counts = np.concatenate([np.ones(n_plain, np.int8), widths.astype(np.int8)])

        # Edges of a node stand together; each length adds at most one to a node, so places are counted, not sorted.
        degree = np.zeros(n_nodes, np.int64)
        spots = []
        for own in sources:
            spots.append(degree[own])
            degree[own] += 1
        firsts = np.concatenate(([0], np.cumsum(degree)))
        n_edges = int(firsts[-1])
        spot = np.concatenate([firsts[own] + rank for own, rank in zip(sources, spots)])
        target, weight, count, offset = np.empty(n_edges, np.int64), np.empty(n_edges), np.empty(n_edges, np.int8), np.empty(n_edges, np.int32)
        target[spot], weight[spot], count[spot], offset[spot] = np.concatenate(targets), np.concatenate(weights), counts, offsets
        owner = owner[by]
        del sources, targets, weights, ids, spots, spot, counts, offsets, place, left, by, after, node  # the most memory of a slice is held here

        # Log sums of all ways from each node to its word's end, level by level; the likeliest edge goes first.
        total = np.zeros(n_nodes)
        log_p = np.empty(n_edges)
        log_plain, log_left = np.zeros(n_nodes), np.full(n_nodes, -np.inf)
        log_others, p_first = np.full(n_nodes, -np.inf), np.ones(n_nodes)
        with np.errstate(divide="ignore"):
            for low, high in zip(levels.tolist(), levels[1:].tolist()):
                if low == high:
                    continue
                begin_, end = firsts[low], firsts[high]
                heads, n = firsts[low:high] - begin_, degree[low:high]
                ways = weight[begin_:end] + total[target[begin_:end]]
                top = np.maximum.reduceat(ways, heads)
                share = np.exp(ways - np.repeat(top, n))
                sums_ = np.add.reduceat(share, heads)
                total[low:high] = top + np.log(sums_)
                log_p[begin_:end] = ways - np.repeat(total[low:high], n)
                # Exchange the likeliest with the head.
                best = np.flatnonzero(share == 1.0)
                if len(best) > high - low:  # ties: the first stays
                    owner = np.searchsorted(heads, best, "right") - 1
                    best = best[np.concatenate(([True], owner[1:] != owner[:-1]))]
                moved = np.flatnonzero(best != heads)
                best_, head_ = begin_ + best[moved], begin_ + heads[moved]
                for column in (target, log_p, count, offset):
                    column[head_], column[best_] = column[best_], column[head_]
                share[best[moved]], share[heads] = share[heads[moved]], 0.0
                head = begin_ + heads
                log_others[low:high] = np.log(np.add.reduceat(share, heads) / sums_)
                # The plain way takes the first edge everywhere; its log probability, and that of all other ways.
                own, after_ = log_p[head], target[head]
                p_first[low:high] = np.exp(own)
                log_plain[low:high] = own + log_plain[after_]
                log_left[low:high] = np.logaddexp(log_others[low:high], own + log_left[after_])

        # Into the store: nodes and edges behind those that it has.
        edges_at = store.sizes["target"]
        shift = store.sizes["log_p"], store.sizes["log_plain"] - 1
        store.append("first", edges_at + firsts[1:], drop=1)
        for name, values in (("log_plain", log_plain), ("log_left", log_left), ("log_others", log_others), ("p_first", p_first)):
            store.append(name, values[1:])
        store.append("target", np.where(target > 0, target + shift[1], 0))
        store.append("log_p", log_p)
        store.append("count", count)
        store.append("offset", offset)
        store.append("owner", owner + store.sizes["start"])
        store.append("start", starts + shift[1])
        store.append("uses", np.zeros(len(size), np.int64))
        store.chars += chars
        # The library's pieces of each word, and those of the plain way.
        codes, n_codes = known.encode(spelled, size)
        at = store.append("codes", codes)
        store.append("code_at", at + np.cumsum(n_codes) - n_codes)
        store.append("code_n", n_codes)
        self.first, self.target = store.get("first"), store.get("target")
        edges, n = self.plain(starts + shift[1])
        ends = np.concatenate(([0], np.cumsum(n)))
        ids_, bounds = _spread(store.get("pool"), store.get("offset")[edges], store.get("count")[edges], ends)
        store.append("plain_at", store.append("plains", ids_) + bounds[:-1])
        store.append("plain_n", np.diff(bounds))

    def _other(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge from each node that is not its first, by probability."""
        edge, last = self.first[node] + 1, self.first[node + 1] - 1
        aim = u * np.exp(self.log_others[node])
        edge = np.minimum(edge, last)
        ahead = np.flatnonzero(edge < last)
        while len(ahead):
            aim[ahead] -= np.exp(self.log_p[edge[ahead]])
            ahead = ahead[aim[ahead] >= 0]
            edge[ahead] += 1
            ahead = ahead[edge[ahead] < last[ahead]]
        return edge

    def walk(self, starts: np.ndarray, key: np.ndarray, left: bool) -> tuple[np.ndarray, np.ndarray]:
        """Edges drawn from each start to its word's end, laid end to end, and how many each has.

        With ``left`` the plain way is left out.
        """
        n, active, node, parts, step = np.zeros(len(starts), np.int64), np.arange(len(starts)), starts, [], 0
        bound = np.full(len(starts), left)
        while len(active):
            u, edge = uniform(key[active], step), self.first[node]
            chance = self.p_first[node]
            tied = np.flatnonzero(bound)
            chance[tied] = 1 - np.exp(self.log_others[node[tied]] - self.log_left[node[tied]])
            turn = np.flatnonzero(u >= chance)
            if len(turn):
                edge[turn] = self._other(node[turn], (u[turn] - chance[turn]) / np.maximum(1 - chance[turn], 1e-300))
                bound[turn] = False
            parts.append((active, edge))
            n[active] += 1
            node = self.target[edge]
            open_ = node > 0
            active, node, bound, step = active[open_], node[open_], bound[open_], step + 1
        begin = np.cumsum(n) - n
        out = np.empty(int(n.sum()), np.int64)
        for step, (which, edge) in enumerate(parts):
            out[begin[which] + step] = edge
        return out, n

    def plain(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of the plain way from each start, laid end to end, and how many each has."""
        n, active, node, parts, step = np.zeros(len(starts), np.int64), np.arange(len(starts)), starts, [], 0
        while len(active):
            edge = self.first[node]
            parts.append((active, edge))
            n[active] += 1
            node = self.target[edge]
            open_ = node > 0
            active, node = active[open_], node[open_]
        begin = np.cumsum(n) - n
        out = np.empty(int(n.sum()), np.int64)
        for step, (which, edge) in enumerate(parts):
            out[begin[which] + step] = edge
        return out, n

    def otherwise(self, start: int, used: list[tuple[int, ...]], key: int) -> tuple[tuple[int, ...], float]:
        """One way from ``start`` that is not in ``used``, and the log probability of all that are left after it."""
        left = _Left(self, start, used)
        node, at, way, taken = start, 0, [], 0.0
        while node:  # 0 is the end of every word
            first = self.first.item(node)
            logs = self.log_p[first : self.first.item(node + 1)].tolist()
            mass = left.masses[at] if at >= 0 else list(map(math.exp, logs))
            key, u = _next_uniform(key)
            u *= sum(mass)
            for place, m in enumerate(mass):
                u -= m
                if u < 0 and m > 0:
                    break
            taken += logs[place]
            way.append(first + place)
            node, at = self.target.item(first + place), left.below[at].get(first + place, -1) if at >= 0 else -1
        taken = math.exp(taken)
        if taken < 0.9 * left.total[0]:
            return tuple(way), math.log(left.total[0] - taken)
        rest = _Left(self, start, [*used, tuple(way)]).total[0]  # without cancellation
        return tuple(way), math.log(rest) if rest > 0 else -math.inf


class _Left:
    """Probability of the ways through one word that are not in ``used``, by the tree of these."""

    def __init__(self, lattice: Lattice, start: int, used: list[tuple[int, ...]]):
        self.below, nodes = [{}], [start]
        for way in used:
            at = 0
            for edge in way:
                if edge not in self.below[at]:
                    self.below[at][edge] = len(nodes)
                    nodes.append(lattice.target.item(edge))
                    self.below.append({})
                at = self.below[at][edge]
        self.total, self.masses = [0.0] * len(nodes), [[] for _ in nodes]  # masses: of each edge of a tree node, in order
        for at in range(len(nodes) - 1, -1, -1):  # a tree node stands before those below it
            if not nodes[at]:
                continue  # the end of a used way
            first = lattice.first.item(nodes[at])
            mass = list(map(math.exp, lattice.log_p[first : lattice.first.item(nodes[at] + 1)].tolist()))
            for edge, below in self.below[at].items():
                mass[edge - first] *= self.total[below]
            self.masses[at], self.total[at] = mass, sum(mass)


def _next_uniform(key: int) -> tuple[int, float]:
    """A further key and a number in (0, 1) from it."""
    key = (key + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    x = ((key ^ key >> 30) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return key, (((x ^ x >> 31) >> 12) + 0.5) / (1 << 52)


def uniform(key: np.ndarray, step: int) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit keys."""
    bits = mix64(key + np.uint64((step + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    return ((bits >> np.uint64(12)).astype(float) + 0.5) / (1 << 52)


def _joined(key: np.ndarray, number: np.ndarray) -> np.ndarray:
    return mix64(key ^ mix64(number.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)))


class Samples:
    """Segmentations of all texts of a batch, drawn in the order of their perturbed log probabilities.

    ``chosen[r][w]`` is how the r-th segmentation cuts word w: -1 the plain way,
    else a number in ``ways``, the list of other ways laid end to end.
    """

    def __init__(self, lattice: Lattice, keys: np.ndarray, k: int):
        bounds, starts = lattice.bounds, lattice.starts
        n_texts, n_words = len(keys), len(starts)
        text = np.repeat(np.arange(n_texts), np.diff(bounds))
        word = np.arange(n_words) - bounds[:-1][text]
        full = np.flatnonzero(np.diff(bounds))
        self.lattice, self.bounds = lattice, bounds
        self.chosen: list[np.ndarray] = []
        self.ways: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.n_ways, self.ends, self.other_ids = 0, None, None
        self.drawn = np.zeros((k, n_texts), bool)
        self.log_p = np.zeros((k, n_texts))
        log_of = np.zeros((k, n_words))
        maxima: list[np.ndarray] = []
        used: dict[tuple[int, int], list[tuple[int, ...]]] = {}  # by text and segmentation: ways left out where it turned off
        turns: dict[tuple[int, int], int] = {}
        value = -np.log(-np.log(uniform(keys, 0)))
        live, parent, turn = np.zeros(n_texts, bool), np.zeros(n_texts, np.int64), np.full(n_texts, -1)
        live[full] = True
        for r in range(k):
            self.drawn[r] = live
            branch = _joined(keys, np.full(n_texts, r + 1))
            fresh = live[text] & (word > turn[text])
            cut = np.full(n_words, -1)
            log_w = np.zeros(n_words)
            if r:  # words before the turn are as in the parent
                kept = np.flatnonzero(live[text] & ~fresh)
                source = parent[text[kept]]
                for a in range(r):
                    own = kept[source == a]
                    cut[own], log_w[own] = self.chosen[a][own], log_of[a][own]
            at = np.flatnonzero(fresh)
            key = _joined(branch[text[at]], word[at])
            log_w[at] = lattice.log_plain[starts[at]]
            left = lattice.log_left[starts].copy()
            other = uniform(key, 0) >= np.exp(log_w[at])
            at, key = at[other & np.isfinite(left[at])], key[other & np.isfinite(left[at])]
            edges, sizes = lattice.walk(starts[at], mix64(key), True)
            if len(at):
                cut[at] = self._add(edges, sizes)
                log_w[at] = np.add.reduceat(lattice.log_p[edges], np.cumsum(sizes) - sizes)
            custom = np.flatnonzero(cut >= 0)
            with np.errstate(divide="ignore"):
                left[custom] = np.log1p(-np.minimum(np.exp(log_w[custom]), 1.0))
            for t in np.flatnonzero(live).tolist() if r else ():
                w, a = int(bounds[t] + turn[t]), int(parent[t])
                # What the set leaves out: the parent's way and, if the parent turned off here too, what it left out.
                gone = [*(used[t, a] if turns.get((t, a)) == w else []), self.way(a, w)]
                way, left[w] = lattice.otherwise(int(starts[w]), gone, int(branch[t]))
                used[t, r], turns[t, r] = gone, w
                cut[w] = self._add(np.array(way), np.array([len(way)]))[0]
                log_w[w] = lattice.log_p[list(way)].sum()
            self._store()
            self.chosen.append(cut)
            log_of[r] = log_w
            run = np.concatenate(([0.0], np.cumsum(log_w)))
            self.log_p[r] = run[bounds[1:]] - run[bounds[:-1]]
            mass = run[:-1] - run[bounds[:-1]][text] + left
            at = np.flatnonzero((word >= turn[text]) & live[text] & ~np.isneginf(mass))
            own, top = text[at], np.full(n_words, -np.inf)
            with np.errstate(divide="ignore", over="ignore"):
                noise = np.log(-np.log(uniform(_joined(branch[own], word[at] + (1 << 40)), 0)))
            top[at] = -np.logaddexp(-value[own], noise - mass[at])
            maxima.append(top)
            # The next set of each text, among all segmentations so far.
            best = np.full(n_texts, -np.inf)
            for a, sets in enumerate(maxima):
                most = np.full(n_texts, -np.inf)
                if len(full):
                    most[full] = np.maximum.reduceat(sets, bounds[:-1][full])
                parent = np.where(most > best, a, parent) if a else np.zeros(n_texts, np.int64)
                best = np.maximum(best, most)
            value = best
            live = np.isfinite(best)
            turn = np.full(n_texts, -1)
            for a, sets in enumerate(maxima):
                hit = np.flatnonzero((sets == best[text]) & live[text] & (parent[text] == a))
                turn[text[hit[::-1]]] = word[hit[::-1]]
                taken = np.flatnonzero(live & (parent == a))
                sets[bounds[taken] + turn[taken]] = -np.inf
        self.threshold = value

    def _add(self, edges: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        self.ways.append(edges)
        self.sizes.append(sizes)
        self.n_ways += len(sizes)
        return np.arange(self.n_ways - len(sizes), self.n_ways)

    def _store(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ways so far, their sizes and ends."""
        if len(self.ways) != 1:
            none = np.zeros(0, np.int64)
            self.ways, self.sizes = [np.concatenate([none, *self.ways])], [np.concatenate([none, *self.sizes])]
            self.ends = np.cumsum(self.sizes[0])
        elif self.ends is None:
            self.ends = np.cumsum(self.sizes[0])
        return self.ways[0], self.sizes[0], self.ends

    def way(self, r: int, w: int) -> tuple[int, ...]:
        """The edges of one word in an earlier segmentation."""
        number = self.chosen[r][w]
        if number < 0:
            way, node = [], self.lattice.starts.item(w)
            while node:
                way.append(self.lattice.first.item(node))
                node = self.lattice.target.item(way[-1])
            return tuple(way)
        return tuple(self.ways[0][self.ends[number] - self.sizes[0][number] : self.ends[number]].tolist())

    def ids(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of the r-th segmentation of all texts, laid end to end, and the bounds of the texts."""
        lattice, cut, store = self.lattice, self.chosen[r], self.lattice.store
        if self.other_ids is None:
            edges, sizes, _ = self._store()
            self.other_ids = _spread(lattice.pool, lattice.offset[edges], lattice.count[edges], np.concatenate(([0], np.cumsum(sizes))))
        ids, ends = self.other_ids
        # Plain ways stand in the store, the others here.
        live = np.repeat(self.drawn[r], np.diff(self.bounds))
        n, at = store.get("plain_n")[lattice.words], store.get("plain_at")[lattice.words]
        n[~live] = 0
        own = np.flatnonzero((cut >= 0) & live)
        values, base = store.get("plains"), store.sizes["plains"]
        if len(own):
            values = np.concatenate([values, ids])
            at[own], n[own] = base + ends[cut[own]], ends[cut[own] + 1] - ends[cut[own]]
        return _spread(values, at, n, self.bounds)

    def scores(self) -> np.ndarray:
        """Inclusion scores by the threshold, 1 where nothing is left."""
        with np.errstate(over="ignore"):
            gap = np.minimum(self.log_p - np.where(np.isfinite(self.threshold), self.threshold, 0), 700)
            return np.where(np.isfinite(self.threshold), -np.expm1(-np.exp(gap)), 1.0)


def _coded(batch: pa.RecordBatch, known: Vocabulary, store: Store, k: int, seed: int) -> pa.RecordBatch:
    """The encoding of one slice; whatever else it needs is free again before the next."""
    texts = [t or "" for t in batch.column(1).to_pylist()]
    lattice = Lattice(texts, known, store)
    empty = np.array([not t for t in texts])
    n_codes = store.get("code_n")[lattice.words]
    n_codes[np.repeat(empty, np.diff(lattice.bounds))] = 0
    codes, code_bounds = _spread(store.get("codes"), store.get("code_at")[lattice.words], n_codes, lattice.bounds)
    best = pa.ListArray.from_arrays(code_bounds.astype(np.int32), pa.array(codes))
    ends = code_bounds.tolist()
    decoded = known.model.decode([codes[i:j] for i, j in zip(ends, ends[1:])], num_threads=1)
    keys = np.array([xxhash.xxh3_64_intdigest(f"{seed}/{row}") for row in batch.column(2).to_pylist()], np.uint64)
    drawn = Samples(lattice, keys, k)
    parts = [drawn.ids(r) for r in range(k)]
    # Sample r of text t stands at row t * k + r of a k times longer list.
    kept = drawn.drawn.T & ~(empty[:, None] & (np.arange(k) > 0))
    values = np.concatenate([v for v, _ in parts])
    base = np.cumsum([0] + [len(v) for v, _ in parts[:-1]])
    low = np.stack([b[:-1] + s for (_, b), s in zip(parts, base)], axis=1)
    size = np.stack([np.diff(b) for _, b in parts], axis=1)
    size[empty], low[empty] = 0, 0
    low, size = low[kept], size[kept]
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    ids = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(size))).astype(np.int32), pa.array(values[np.repeat(low, size) + inside], pa.int32()))
    rows = np.concatenate(([0], np.cumsum(kept.sum(axis=1)))).astype(np.int32)
    samples = pa.ListArray.from_arrays(rows, ids)
    log_p, score = drawn.log_p.T.copy(), drawn.scores().T.copy()
    log_p[empty], score[empty] = 0.0, 1.0
    log_ps = pa.ListArray.from_arrays(rows, pa.array(log_p[kept]))
    scores = pa.ListArray.from_arrays(rows, pa.array(score[kept]))
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0),
            best,
            pa.array(decoded, pa.string()),
            samples,
            log_ps,
            scores,
        ],
        names=["id", "ids", "decoded", "samples", "log_p", "inclusion"],
    )


def _encoding(path: str, k: int, theta: float, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, store = vocabulary(path, theta), Store()
        for batch in slices(batches, 1, 256 << 10):
            if store.chars > KEPT_CHARS:
                store.shrink(KEPT_CHARS // 2, known.n_ids)
            yield _coded(batch, known, store, k, seed)

    return run


def encode(docs: DataFrame, model_path: str, k: int = 3, theta: float = 1.0, seed: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids, decoded, samples, log_p, inclusion`` for each row; one narrow pass over whole texts.

    ``ids`` is the library's encoding and ``decoded`` the text got back from it.
    ``samples`` are distinct segmentations as piece ids, with natural log
    probabilities and inclusion scores; the row key is ``id_col`` as text.
    """
    kind = dict(docs.dtypes)[id_col]
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    schema = f"id {kind}, ids array<int>, decoded string, samples array<array<int>>, log_p array<double>, inclusion array<double>"
    found = docs.select(F.col(id_col), F.col(text_col), key).mapInArrow(_encoding(model_path, k, theta, seed), schema)
    return found.withColumnRenamed("id", id_col)


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """All columns of ``rows`` with ``text``, the decoding of ``ids_col`` (null stays null)."""

    @F.pandas_udf("string")
    def to_text(ids):
        model = vocabulary(model_path, 1.0).model
        return ids.map(lambda x: None if x is None else model.decode([int(i) for i in x]))

    return rows.withColumn("text", to_text(F.col(ids_col)))
