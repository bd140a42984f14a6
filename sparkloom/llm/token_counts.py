"""Exact token counts of a byte-level BPE by finite-state transduction.

Two deterministic machines are compiled from the tokenizer file.

* The outer machine splits text into pre-tokens. It reads character classes,
  has thirteen states, and each transition says where a pre-token begins. A text
  is cut into equal chunks; every chunk yields a map from each start state to
  its end state; the maps compose associatively, so a parallel prefix scan gives
  each chunk its true start state. All chunks of a batch advance together.
* The inner machine reads the bytes of one pre-token. Its states are determinised
  lazily: a state holds the number of tokens of the prefix read so far and the
  last of them, so each transition carries a (signed) change of the count. The
  last token of a prefix is the longest vocabulary entry that ends there and may
  stand after the last token of what precedes it; a BPE encoding is valid exactly
  if all neighbouring pairs are. A bounded memo keeps whole pre-tokens.

Defined cases: null and empty texts have no tokens; strings of special tokens
inside a text count as that one token, as the library does by default; repeated
rows give repeated rows; further columns of the input are ignored. Texts of any
length take memory in proportion to the longest one.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

END, SPACE, BLANK, QUOTE, OTHER, DIGIT, LETTER, LETTER_STMD, LETTER_RV, LETTER_L, LETTER_E = range(11)
N_CLASSES = 11
(S_START, S_LETTERS, S_DIGITS, S_OTHERS, S_SPACE, S_BLANK, S_SPACES, S_BLANKS, S_QUOTE, S_QUOTE_RV, S_QUOTE_L, S_DONE) = range(12)
N_STATES = 12
HERE, BACK = 1, 2  # a pre-token begins at this character; at the one before


@functools.cache
def character_classes() -> np.ndarray:
    """Class of every code point, for the split into letters, digits, blanks and the rest."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": DIGIT}
    for point in range(sys.maxunicode + 1):
        kind = kinds.get(unicodedata.category(chr(point))[0])
        if kind:
            table[point] = kind
    # Characters with the Unicode property White_Space.
    for first, last in ((0x09, 0x0D), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        table[first : last + 1] = BLANK
    table[ord(" ")] = SPACE
    table[ord("'")] = QUOTE
    for letters, kind in (("stmd", LETTER_STMD), ("rv", LETTER_RV), ("l", LETTER_L), ("e", LETTER_E)):
        for letter in letters:
            table[ord(letter)] = kind
    return table


@functools.cache
def split_machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks, both indexed by ``state * N_CLASSES + class``."""
    step = np.zeros((N_STATES, N_CLASSES), np.uint8)
    mark = np.zeros((N_STATES, N_CLASSES), np.uint8)
    body = {DIGIT: S_DIGITS, OTHER: S_OTHERS, QUOTE: S_OTHERS}
    body |= dict.fromkeys((LETTER, LETTER_STMD, LETTER_RV, LETTER_L, LETTER_E), S_LETTERS)
    fresh = body | {QUOTE: S_QUOTE, SPACE: S_SPACE, BLANK: S_BLANK, END: S_START}

    def begin(state: int, kind: int, extra: int = 0) -> None:
        step[state, kind], mark[state, kind] = fresh[kind], HERE | extra

    for state in range(N_STATES):
        for kind in range(N_CLASSES):
            begin(state, kind)
    for kind, state in body.items():
        step[state, kind], mark[state, kind] = state, 0
        step[S_SPACE, kind], mark[S_SPACE, kind] = state, 0  # one space belongs to what follows
        step[S_SPACES, kind], mark[S_SPACES, kind] = state, BACK
        begin(S_BLANKS, kind, BACK)
    for state in (S_SPACE, S_BLANK, S_SPACES, S_BLANKS):
        step[state, SPACE], mark[state, SPACE] = S_SPACES, 0
        step[state, BLANK], mark[state, BLANK] = S_BLANKS, 0
    # An apostrophe at the start of a pre-token may open a contraction.
    step[S_QUOTE, OTHER] = step[S_QUOTE, QUOTE] = S_OTHERS
    mark[S_QUOTE, OTHER] = mark[S_QUOTE, QUOTE] = 0
    for kind, state in ((LETTER_STMD, S_DONE), (LETTER_RV, S_QUOTE_RV), (LETTER_L, S_QUOTE_L)):
        step[S_QUOTE, kind], mark[S_QUOTE, kind] = state, 0
    for state, last in ((S_QUOTE_RV, LETTER_E), (S_QUOTE_L, LETTER_L)):
        for kind in range(N_CLASSES):  # no contraction after all: the letter began a word
            step[state, kind], mark[state, kind] = step[S_LETTERS, kind], mark[S_LETTERS, kind] | BACK
        step[state, last], mark[state, last] = S_DONE, 0
    return step.ravel(), mark.ravel()


def pretoken_starts(classes: np.ndarray, chunk: int = 1024) -> np.ndarray:
    """Positions where pre-tokens begin; ``classes`` must end with END."""
    step, mark = split_machine()
    n = len(classes)
    rows = -(-n // chunk)
    padded = np.full(rows * chunk, END, np.uint8)
    padded[:n] = classes
    columns = np.ascontiguousarray(padded.reshape(rows, chunk).T).astype(np.intp)
    maps = np.repeat(np.arange(N_STATES, dtype=np.intp)[:, None], rows, axis=1)
    for column in columns:  # every chunk from every start state at once
        maps = step[maps * N_CLASSES + column].astype(np.intp)
    shift = 1
    while shift < rows:  # prefix scan: maps[:, i] becomes the map of chunks 0 to i
        maps[:, shift:] = np.take_along_axis(maps[:, shift:], maps[:, :-shift], axis=0)
        shift *= 2
    state = np.concatenate(([S_START], maps[S_START, :-1]))
    marks = np.empty((chunk, rows), np.uint8)
    for i, column in enumerate(columns):
        at = state * N_CLASSES + column
        marks[i] = mark[at]
        state = step[at].astype(np.intp)
    flat = marks.T.ravel()[:n]
    begins = (flat & HERE).astype(bool)
    begins[:-1] |= (flat[1:] & BACK).astype(bool)
    return np.flatnonzero(begins)


class CountMachine:
    """The inner machine: byte transitions annotated with changes of the token count."""

    def __init__(self, vocabulary: dict[str, int], merges: list, most_states: int = 600_000):
        letters = _byte_letters()
        raw = {char: value for value, char in enumerate(letters)}
        self.tokens = {bytes(raw[c] for c in word) for word in vocabulary if all(c in raw for c in word)}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        self.rank = {(bytes(raw[c] for c in a), bytes(raw[c] for c in b)): i for i, (a, b) in enumerate(pairs)}
        self.made = {a + b: (i, a, b) for (a, b), i in reversed(self.rank.items())}
        self.tokens = {t for t in self.tokens if self.merged(t) == [t]}  # those an encoding can contain
        self.longest = max(map(len, self.tokens))
        self.most_states = most_states
        self.forget()

    def forget(self) -> None:
        """Drops all states but the first; they are rebuilt when met again."""
        self.steps: dict[int, int] = {}
        self.counts: list[int] = [0]
        self.lasts: list[bytes] = [b""]

    def merged(self, word: bytes) -> list[bytes]:
        """Lowest merge first, as the tokenizer defines it; only used to find the entries that can be reached."""
        parts = [word[i : i + 1] for i in range(len(word))]
        rank = self.rank
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def neighbours(self, left: bytes, right: bytes) -> bool:
        """Whether ``right`` may follow ``left``.

        The history of the two is undone from the latest merge on. They stay apart
        if the two pieces at the border never had a merge that was due before one
        of them was taken up by its own side; at equal rank the left merge is first.
        """
        rank, made, due = self.rank, self.made, 1 << 60
        while True:
            if rank.get((left, right), due) < due:
                return False
            before, after = made.get(left), made.get(right)
            if before is None and after is None:
                return True
            if after is None or before is not None and before[0] > after[0]:
                due, left = before[0], before[2]
            else:
                due, right = after[0] + 1, after[1]

    def count(self, word: bytes) -> int:
        """Tokens of one pre-token: a walk from the first state, making states where none are yet."""
        if len(self.counts) > self.most_states:
            self.forget()
        path, steps, state = [0], self.steps, 0
        tokens, lasts, longest = self.tokens, self.lasts, self.longest
        for end, byte in enumerate(word, 1):
            key = state << 8 | byte
            after = steps.get(key)
            if after is None:
                for begin in range(max(0, end - longest), end):
                    token = word[begin:end]
                    if token in tokens and (not begin or self.neighbours(lasts[path[begin]], token)):
                        break
                after = steps[key] = len(self.counts)
                self.counts.append(self.counts[path[begin]] + 1)
                lasts.append(token)
            path.append(after)
            state = after
        return self.counts[state]


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [letters[b] for b in range(256)]


class Counter:
    """Counts for batches of texts; one for each Python worker."""

    def __init__(self, path: str, most_words: int = 400_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("only byte-level BPE without normaliser is compiled")
        self.machine = CountMachine(model["vocab"], model["merges"])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.words: dict[str, int] = {}
        self.most_words = most_words

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        special, extra, parts, owner = self.special, np.zeros(len(texts), np.int64), [], []
        for i, text in enumerate(texts):
            found = special.split(text) if special and special.search(text) else [text]
            extra[i] += len(found) - 1
            for part in found:
                if part:
                    parts.append(part)
                    owner.append(i)
        if not parts:
            return extra
        joined = "\n".join(parts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        classes = character_classes()[points]
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        classes[ends] = END
        starts = pretoken_starts(classes)
        known, words = self.words, starts.tolist()
        counts = np.zeros(len(words), np.int64)
        words.append(len(joined))
        if len(known) > self.most_words:
            known.clear()
        get, machine = known.get, self.machine
        values = []
        for begin, end in zip(words, words[1:]):
            word = joined[begin:end]
            value = get(word)
            if value is None:
                value = known[word] = machine.count(word.encode())
            values.append(value)
        counts[:] = values
        counts[np.searchsorted(starts, ends)] = 0  # the separators
        sums = np.add.reduceat(counts, np.searchsorted(starts, np.concatenate(([0], ends[:-1] + 1))))
        np.add.at(extra, owner, sums)
        return extra


@functools.lru_cache(maxsize=1)
def _counter(path: str) -> Counter:
    return Counter(path)


def _counting(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in pieces(batches, 1, 2 << 20):
            counts = counter.count([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts)], names=["id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` for each row; one narrow pass, no shuffle."""
    kind = dict(docs.dtypes)[id_col]
    n_bytes = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    slim = docs.select(F.col(id_col), F.col(text_col), n_bytes)
    counted = slim.mapInArrow(_counting(tokenizer_path), f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
