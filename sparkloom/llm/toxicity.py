"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Lexicons. From at most ``sample`` labelled rows (smallest hash of the id) words are
mined that stand in toxic texts far more often than in others, and then beginnings of
other words than these, for their further forms; no word list is given. The ``most_terms`` best by lift and frequency make up the
model, which bounds its size.
Voters. Each voter fires or not: the mined words and the mined beginnings in ranges
of lift, two mined terms at once, and typographic patterns.
Label model. P(toxic) and, for each class, a tree over the voters (each voter
depends on the class and on one other voter) give accuracies and correlations.
They are estimated by EM from how often every combination of votes occurs in all
documents, with the sampled labels held fixed. At most 2**16 combinations exist.
Classifier. Logistic regression over the terms and voters is trained on the label
model's posteriors alone, of the labelled sample and of up to ``sample`` further rows
that may be learned from, labelled or not. It scores every whole text.

Defined cases: null, empty and wordless texts get the score of a text without
any term; without labelled rows of both kinds every text gets the same score, the
share of toxic labels (0 if there are none); repeated labels of one document
count once, toxic if any is; null labels are skipped; of rows with one id the smallest
text is learned from, but each is scored; a score equal to the threshold is toxic;
very long texts are handled whole, one at a time; an empty table gives no rows;
further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, kept_columns, named_back, pieces
from .decontamination import WORD_BREAKS
from .shingles import BYTE_BASE, BYTE_VALUES, _powers, mix64

#: Lengths in UTF-8 bytes of the word beginnings that are looked at, besides whole words.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
#: A mined term stands in so many toxic texts at least, its log lift is over the second value, and the
#: log-likelihood ratio against chance (which few of many thousands of harmless terms reach) over the third.
LEAST_TOXIC, LEAST_LIFT, LEAST_EVIDENCE = 4, 2.3, 20.0
#: Mined terms of one range of lifts form one voter.
LIFT_RANGES = (3.0, 3.7, 4.4, 5.1)
N_PATTERNS = 5
FILTER_BITS = 20


def _spans(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of all words, hash sums and inverse powers, and the word bounds of each text."""
    raw = [(t or "").lower().encode() for t in texts]
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    blank = WORD_BREAKS[data]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    begins, ends = edges[0::2], edges[1::2]
    powers = _powers(BYTE_BASE, len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers[:-1], out=sums[1:])
    inverse = _powers(pow(BYTE_BASE, -1, 1 << 64), len(data) + 1)
    at = np.cumsum([0] + [len(r) + 1 for r in raw])
    return begins, ends, sums, inverse, np.searchsorted(begins, at)


class Hashes:
    """A set of 64-bit hashes with a fast test."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.values & np.uint64((1 << FILTER_BITS) - 1)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``hashes`` are in the set, and their numbers there."""
        maybe = np.flatnonzero(self.filter[hashes & np.uint64((1 << FILTER_BITS) - 1)])
        at = np.minimum(np.searchsorted(self.values, hashes[maybe]), len(self.values) - 1)
        same = self.values[at] == hashes[maybe] if len(maybe) else np.zeros(0, bool)
        return maybe[same], at[same]


def terms(texts: list[str | None], known: Hashes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of words, then of the beginnings of each length of words that are not ``known``, with the number of the text each is in."""
    begins, ends, sums, inverse, bounds = _spans(texts)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    scale = inverse[begins]
    words = mix64((sums[ends] - sums[begins]) * scale + np.uint64(1))
    yield words, text
    other = np.ones(len(words), bool)
    other[known.find(words)[0]] = False
    for size in BEGINNINGS:
        long = (ends - begins > size) & other
        first = begins[long]
        yield mix64((sums[first + size] - sums[first]) * scale[long] + np.uint64(2 * size)), text[long]


def patterns(texts: list[str | None]) -> np.ndarray:
    """Typographic patterns of each text: mostly capitals; repeated exclamation marks; one for every other word; mixed or repeated question marks; few words."""
    out = np.zeros((len(texts), N_PATTERNS), bool)
    capitals, small = bytes(range(65, 91)), bytes(range(97, 123))
    for row, text in zip(out, texts):
        raw = (text or "").encode()
        upper = len(raw) - len(raw.translate(None, capitals))
        row[0] = upper > 20 and upper > len(raw) - len(raw.translate(None, small))
        row[1] = raw.count(b"!!") > 2
        spaces = raw.count(b" ")
        row[2] = 2 * raw.count(b"!") > spaces + 1
        row[3] = b"?!" in raw or b"!?" in raw or b"??" in raw
        row[4] = spaces < 8
    return out


class Terms:
    """The mined terms, looked up by hash, and the voters they belong to."""

    def __init__(self, mined: np.ndarray, whole: np.ndarray, lift: np.ndarray):
        """``lift``: log of how much more often a mined term stands in toxic texts; voters go by its ranges."""
        n_ranges = len(LIFT_RANGES) + 1
        self.n_voters = 2 * n_ranges + 1 + N_PATTERNS
        voter = np.where(whole, 0, n_ranges) + np.searchsorted(LIFT_RANGES, lift)
        self.every, first = np.unique(mined, return_index=True)
        self.all, self.words = Hashes(mined), Hashes(mined[whole])
        self.voters = (1 << voter)[first]

    def found(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of text and term number, each once."""
        pairs = [np.zeros(0, np.int64)]
        for hashes, text in terms(texts, self.words):
            own, at = self.all.find(hashes)
            pairs.append(text[own] * len(self.every) + at)
        both = np.unique(np.concatenate(pairs))
        return both // max(len(self.every), 1), both % max(len(self.every), 1)

    def votes(self, texts: list[str | None], text: np.ndarray, term: np.ndarray) -> np.ndarray:
        """One bit for each voter; ``text`` and ``term`` are what was found."""
        out = np.zeros(len(texts), np.int64)
        np.bitwise_or.at(out, text, self.voters[term])
        several = np.bincount(text, minlength=len(texts)) > 1
        first = self.n_voters - N_PATTERNS - 1
        out |= several.astype(np.int64) << first
        for k, column in enumerate(patterns(texts).T, first + 1):
            out |= column.astype(np.int64) << k
        return out


class LabelModel:
    """P(class) and, within each class, a tree of dependent voters."""

    def __init__(self, votes: np.ndarray, clean: np.ndarray, toxic: np.ndarray, unknown: np.ndarray, n_voters: int, rounds: int = 15):
        """Each combination in ``votes`` occurs so often with either label and without one."""
        bits = (votes[:, None] >> np.arange(n_voters) & 1).astype(np.int64)
        self.n_voters = n_voters
        self.parents = self._tree(bits, clean, toxic)
        self._update(bits, clean + 1e-9, toxic + 1e-9)
        for _ in range(rounds):
            share = self._share(bits)
            self._update(bits, clean + unknown * (1 - share), toxic + unknown * share)
        #: How often each voter fires in toxic texts and stays silent in clean ones.
        weights = np.stack([clean + unknown * (1 - self._share(bits)), toxic + unknown * self._share(bits)])
        fires = weights @ bits / np.maximum(weights.sum(axis=1, keepdims=True), 1e-9)
        self.accuracies = np.stack([1 - fires[0], fires[1]])

    def _tree(self, bits: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> np.ndarray:
        """The parent of each voter in the tree of largest mutual information given the class; -1 at the root."""
        total, n = clean.sum() + toxic.sum(), self.n_voters
        gain = np.zeros((n, n))
        for weight in (clean, toxic):
            size = weight.sum()
            if not size:
                continue
            for a in (0, 1):
                for b in (0, 1):
                    joint = ((bits == a) * weight[:, None]).T @ (bits == b) / size
                    alone = np.outer(weight @ (bits == a), weight @ (bits == b)) / size**2
                    gain += size / total * np.where(joint > 0, joint * np.log(np.maximum(joint, 1e-12) / np.maximum(alone, 1e-12)), 0)
        parents, inside = np.full(n, -1), [0]
        self.order = [0]
        while len(inside) < n:
            outside = [j for j in range(n) if j not in inside]
            block = gain[np.ix_(inside, outside)]
            i, j = np.unravel_index(block.argmax(), block.shape)
            parents[outside[j]] = inside[i]
            inside.append(outside[j])
        return parents

    def _update(self, bits: np.ndarray, *weights: np.ndarray) -> None:
        """Shares of firing, by class and by the parent's vote, smoothed by one half."""
        self.prior = weights[1].sum() / (weights[0].sum() + weights[1].sum())
        self.fires = np.zeros((2, 2, self.n_voters))
        for y, weight in enumerate(weights):
            for j, parent in enumerate(self.parents):
                for value in (0, 1):
                    own = weight * (bits[:, parent] == value) if parent >= 0 else weight
                    self.fires[y, value, j] = (own @ bits[:, j] + 0.5) / (own.sum() + 1)

    def _share(self, bits: np.ndarray) -> np.ndarray:
        above = np.where(self.parents >= 0, bits[:, self.parents], 0)
        logs = []
        for y, prior in enumerate((1 - self.prior, self.prior)):
            p = self.fires[y][above, np.arange(self.n_voters)]
            logs.append(np.log(max(prior, 1e-9)) + np.log(np.where(bits == 1, p, 1 - p)).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic | votes)."""
        return self._share((votes[:, None] >> np.arange(self.n_voters) & 1).astype(np.int64))


class Classifier:
    """A linear model over terms and voters."""

    def __init__(self, known: Terms | None, weights: np.ndarray, bias: float, labels: LabelModel | None = None):
        self.known, self.weights, self.bias, self.labels = known, weights, bias, labels

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.known is None:
            return np.full(len(texts), self.bias)
        text, term = self.known.found(texts)
        sums = self.bias + np.bincount(text, self.weights[term], minlength=len(texts))
        n = self.known.n_voters
        sums += (self.known.votes(texts, text, term)[:, None] >> np.arange(n) & 1) @ self.weights[-n:]
        return 1 / (1 + np.exp(-np.clip(sums, -500, 500)))


def logistic(rows: np.ndarray, columns: np.ndarray, n: int, width: int, target: np.ndarray, ridge: float = 0.5, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Weights and bias by adaptive gradient steps on soft targets; ones stand at ``rows, columns``."""
    values = np.zeros(width + 1)  # the bias is last and not shrunk
    values[-1] = np.log((target.mean() + 1e-4) / (1 - target.mean() + 1e-4))
    first, second = np.zeros_like(values), np.zeros_like(values)
    for k in range(1, rounds + 1):
        sums = values[-1] + np.bincount(rows, values[columns], minlength=n)
        error = 1 / (1 + np.exp(-np.clip(sums, -500, 500))) - target
        slope = np.append(np.bincount(columns, error[rows], minlength=width) + ridge * values[:-1], error.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        pace = 0.1 * (1 - k / (rounds + 1))
        values = values - pace * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-9)
    return values[:-1], float(values[-1])


def _mining(known: Hashes, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each slice: every word, or every beginning of words that are not known, and its clean and toxic texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1, 1 << 20):
            label = np.array(batch.column(2).to_pylist(), np.int64)
            for hashes, text in itertools.islice(terms(batch.column(1).to_pylist(), known), *((1,) if whole else (1, None))):
                order = np.lexsort((text, hashes))
                hashes, text = hashes[order], text[order]
                once = np.ones(len(hashes), bool)
                once[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
                hashes, text = hashes[once], text[once]
                distinct, at = np.unique(hashes, return_index=True)
                if not len(distinct):
                    continue
                toxic = np.add.reduceat(label[text], at)
                both = np.diff(np.append(at, len(hashes)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(distinct.view(np.int64)), pa.array(both - toxic), pa.array(toxic)],
                    names=["term", "clean", "toxic"],
                )

    return run


def _voting(handle) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How often each combination of votes occurs in a task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = handle.value, {}
        for batch in pieces(batches, 0, 1 << 20):
            texts = batch.column(0).to_pylist()
            for vote, n in zip(*np.unique(known.votes(texts, *known.found(texts)), return_counts=True)):
                counts[int(vote)] = counts.get(int(vote), 0) + int(n)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["votes", "n"])

    return run


def _featuring(handle) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The features and votes of labelled texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = handle.value
        for batch in pieces(batches, 1, 1 << 20):
            texts = batch.column(1).to_pylist()
            text, term = known.found(texts)
            votes = known.votes(texts, text, term)
            bits = votes[:, None] >> np.arange(known.n_voters) & 1
            cells = np.split(term, np.searchsorted(text, np.arange(1, len(texts))))
            cells = [np.concatenate([c, len(known.every) + np.flatnonzero(b)]) for c, b in zip(cells, bits)]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(votes), pa.array(cells, pa.list_(pa.int64()))], names=["label", "votes", "cells"])

    return run


def _hash_bound(share: float) -> int:
    """The 64-bit value under which this share of all hashes lies."""
    return int((1 << 63) * (2 * share - 1)) if share < 1 else (1 << 63) - 1


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learnable: Column,
    sample: int = 12_000,
    most_terms: int = 3000,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Classifier:
    """Fits on labels of rows for which ``learnable`` (over ``id_col``) holds; the model has a fixed size."""
    context = docs.sparkSession.sparkContext
    usable = labels.where(learnable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    labelled = (
        usable.groupBy(F.col(id_col).alias("id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("label"))
        .withColumn("order", F.xxhash64(F.col("id").cast("string")))
    )
    # Hashes are even, so those under this bound hold the sample and little more; else each task would send ``sample`` rows on.
    bound = _hash_bound((1.5 * sample + 100) / max(usable.count(), 1))
    chosen = labelled.where(F.col("order") <= bound).orderBy("order", "id").limit(sample).select("id", "label")
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # Texts of one id combine before the exchange.
    rows = cut(slim.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text")).select("id", "text", "label"))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_clean, n_toxic = sizes.get(0, 0), sum(n for k, n in sizes.items() if k)
    if not n_clean or not n_toxic:
        return Classifier(None, np.zeros(0), n_toxic / max(n_clean + n_toxic, 1))

    toxic_share = (F.col("toxic") + 0.5) / (n_toxic + 1)
    clean_share = (F.col("clean") + 0.5) / (n_clean + 1)
    lift = F.log(toxic_share / clean_share)
    share = n_toxic / (n_toxic + n_clean)
    both = F.col("toxic") + F.col("clean")
    surprise = lambda n, expected: F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)
    evidence = 2 * (surprise(F.col("toxic"), both * share) + surprise(F.col("clean"), both * (1 - share)))
    labelled_texts = rows.select("id", "text", F.least("label", F.lit(1)).alias("label"))

    # Copies of one text are no further evidence.
    distinct_texts = labelled_texts.groupBy("text").agg(F.min("id").alias("id"), F.max("label").alias("label")).select("id", "text", "label")

    def mined(known: Hashes, whole: bool) -> tuple[np.ndarray, np.ndarray]:
        counts = distinct_texts.mapInArrow(_mining(known, whole), "term long, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        telling = counts.withColumn("lift", lift).where(f"toxic >= {LEAST_TOXIC} and lift > {LEAST_LIFT}").where(evidence > LEAST_EVIDENCE)
        best = telling.orderBy((F.col("lift") * F.sqrt("toxic")).desc(), "term").limit(most_terms // 2).toPandas()
        return best["term"].to_numpy(np.int64).view(np.uint64), best["lift"].to_numpy(float)

    words, word_lifts = mined(Hashes(np.zeros(0, np.uint64)), True)
    heads, head_lifts = mined(Hashes(words), False)
    known = Terms(np.concatenate([words, heads]), np.arange(len(words) + len(heads)) < len(words), np.concatenate([word_lifts, head_lifts]))

    handle = context.broadcast(known)
    # Further rows without a label: those under a hash bound, about ``sample`` of them.
    free = docs.where(learnable).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    bound = _hash_bound(sample / max(free.count(), 1))
    free = free.where(F.xxhash64(F.col("id").cast("string"), F.lit("unlabelled")) <= bound).groupBy("id").agg(F.min("text").alias("text"))
    learned = labelled_texts.union(free.select("id", "text", F.lit(None).cast("int")))
    featured = learned.mapInArrow(_featuring(handle), "label int, votes long, cells array<long>").toPandas()
    # All texts that may be learned from, as counts of vote combinations (2**16 at most).
    seen = docs.where(learnable).select(text_col).mapInArrow(_voting(handle), "votes long, n long").groupBy("votes").agg(F.sum("n").alias("n")).toPandas()

    label, votes = featured["label"].fillna(-1).to_numpy(np.int64), featured["votes"].to_numpy(np.int64)
    combos, at = np.unique(np.concatenate([votes, seen["votes"].to_numpy(np.int64)]), return_inverse=True)
    own = at[: len(votes)]
    clean = np.bincount(own, label == 0, minlength=len(combos))
    toxic = np.bincount(own, label == 1, minlength=len(combos))
    unknown = np.bincount(at[len(votes) :], seen["n"].to_numpy(float), minlength=len(combos))
    unknown = np.maximum(unknown - clean - toxic, 0)
    # The labelled rows weigh as much as all others together, however many these are.
    unknown *= min(1.0, (n_clean + n_toxic) / max(unknown.sum(), 1))
    model = LabelModel(combos, clean, toxic, unknown, known.n_voters)

    cells = featured["cells"].tolist()
    row = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
    column = np.concatenate([np.asarray(c, np.int64) for c in cells]) if len(row) else np.zeros(0, np.int64)
    weights, bias = logistic(row, column, len(cells), len(known.every) + known.n_voters, model.posterior(votes))
    return Classifier(known, weights, bias, model)


def _scoring(handle) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1, 1 << 20):
            scores = handle.value.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), *batch.columns[2:]], names=["id", "score", *batch.schema.names[2:]])

    return run


def score(
    docs: DataFrame, model: Classifier, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """``id_col, score, predicted`` and the columns ``keep`` for each row; one narrow pass over whole texts."""
    handle = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]
    more, fields = kept_columns(docs, keep)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *more)
    found = slim.mapInArrow(_scoring(handle), f"id {kind}, score double{fields}")
    own = [] if id_col in keep else [F.col("id").alias(id_col)]
    return found.select(*own, "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *named_back(keep))
