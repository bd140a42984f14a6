"""Repair of conversations whose turns were lost, repeated, cut off or put under wrong roles.

Faults. Each row's first fault counts: ``blank`` (nothing but ASCII white space), ``duplicate``
(role and text stand earlier), ``truncated`` (the last character that is no white space is none of
``.!?``). Rows stand in order of turn, nulls first; rows of one turn by role and then by the MD5 of
role and text, so equal rows are adjacent.

Retained-subsequence DP. A repair chooses the rows that stay, as they are or with another role. The
rows between two that stay are deleted, which costs a difference of prefix sums; the two roles say
which empty turns are inserted between them. So the cheapest way on from a row needs only, for each
role, the running minimum of (prefix sum + cost from there) over the rows behind it. One pass
backwards gives the cost from every place and role; one pass forwards takes, of all edits that
keep the whole at least cost, the one with the least initial, so ties go to the ASCII-least audit.

Spark exchanges and sorts every row twice by conversation: without its text first, then with it.
A task reads the codes of a conversation, repairs it, and then hashes the texts as they
stream by. It holds some 70 bytes a turn (the audit itself has one character a turn), and never
the texts. As the SHA-256 of a conversation goes from its first to its last character, one
conversation is one task's work, however long it is.

Defined cases: a null role or text is one space; a null conversation id is a conversation of its
own; null turns come first and don't count for gaps; all turns null, or no rows after the damage,
give 0 gaps; a conversation of which nothing is left has zeros, an empty audit and the hash of the
empty string; roles other than user, assistant and system are judged by their first character; an
empty role has none, so its neighbours are illegal; repeated rows are damaged alike and are duplicates;
rows of one turn with different texts have a fixed order (above); very long texts are hashed one at a
time; an empty table gives no rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Costs of edits, and of a truncated row that is not deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States of the repaired conversation: empty, after a system, a user and an assistant turn; what each takes next.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Turns inserted between a state and a following turn of a role, and between a state and the end; -1: not allowed.
BETWEEN = {SYSTEM: (0, -1, -1, -1), USER: (0, 0, 1, 0), ASSISTANT: (1, 1, 0, 1)}
TO_END = (0, 2, 1, 0)
NEVER = 1 << 60
#: Codes of rows: fault, and the initial's state (EMPTY: none that fits).
FINE, BLANK, DUPLICATE, CUT_OFF = range(4)
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
LEGAL = ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))


def costs_onward(faults: Sequence[int], initials: Sequence[int]) -> list[array]:
    """For each state, the least cost of repairing rows i, i + 1, ... from that state on."""
    n = len(faults)
    onward = [array("q", bytes(8 * (n + 1))) for _ in NEXT]
    # Deleting rows i to j - 1 costs prefix[j] - prefix[i]; here prefix[i] = DELETE * i.
    ahead = {SYSTEM: NEVER, USER: NEVER, ASSISTANT: NEVER}  # running minima of prefix + cost from a row that stays in a role
    end = DELETE * n
    for i in range(n, -1, -1):
        if i < n and faults[i] in (FINE, CUT_OFF):
            edit = DELETE * i + (TRUNCATED if faults[i] == CUT_OFF else 0)
            for role in (SYSTEM, USER, ASSISTANT):
                if initials[i] == role:
                    stays = edit
                elif role in ROLE:
                    stays = edit + REROLE
                else:
                    continue
                ahead[role] = min(ahead[role], stays + onward[role][i + 1])
        for state in range(len(NEXT)):
            best = end + INSERT * TO_END[state]
            for role, inserts in BETWEEN.items():
                if inserts[state] >= 0:
                    best = min(best, ahead[role] + INSERT * inserts[state])
            onward[state][i] = best - DELETE * i
    return onward


def repair(faults: Sequence[int], initials: Sequence[int]) -> tuple[int, str]:
    """Least cost, and the ASCII-least audit of edits of that cost."""
    onward = costs_onward(faults, initials)
    n, i, state, audit = len(faults), 0, EMPTY, bytearray()
    while i < n or TO_END[state]:
        left = onward[state][i]
        after = NEXT[state]
        if i < n and DELETE + onward[state][i + 1] == left:
            audit += b"D"
            i += 1
        elif INSERT + onward[after][i] == left:
            audit += b"I"
            state = after
        else:
            own = initials[i]
            fits = own == after or own == SYSTEM and state == EMPTY
            kept = (TRUNCATED if faults[i] == CUT_OFF else 0) + onward[own][i + 1] if fits else NEVER
            audit += b"K" if kept == left else b"R"
            state = own if kept == left else after
            i += 1
    return onward[EMPTY][0], audit.decode()


class _Conversation:
    """One conversation as its rows stream by: first their codes, then their texts."""

    def __init__(self, conv):  # noqa: ANN001
        self.conv = conv
        self.blank, self.cut_off, self.initials = bytearray(), bytearray(), bytearray()
        self.tells = bytearray()  # 16 bytes a row
        self.low = self.high = self.before = None
        self.distinct = 0
        self.audit: str | None = None
        self.hash = hashlib.sha256()

    def code(self, turn: int | None, initial: str, blank: bool, cut_off: bool, tell: bytes) -> None:
        self.blank.append(blank)
        self.cut_off.append(cut_off)
        self.initials.append(INITIALS.get(initial, EMPTY))
        self.tells += tell
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.distinct += turn != self.before
            self.before = turn

    def decide(self) -> None:
        """After the last code."""
        n = len(self.initials)
        tells = np.frombuffer(bytes(self.tells), [("a", "u8"), ("b", "u8")])
        self.tells.clear()
        again = np.ones(n, bool)
        again[np.unique(tells, return_index=True)[1]] = False
        blank, cut_off = (np.frombuffer(bytes(x), bool) for x in (self.blank, self.cut_off))
        self.faults = bytes(np.select([blank, again, cut_off], [BLANK, DUPLICATE, CUT_OFF], FINE).astype(np.uint8))
        self.illegal = sum((a, b) not in LEGAL for a, b in zip(self.initials, self.initials[1:]))
        self.cost, self.audit = repair(self.faults, self.initials)
        self.edit, self.state, self.first = 0, EMPTY, True

    def _put(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first = False

    def _insert(self) -> None:
        while self.edit < len(self.audit) and self.audit[self.edit] == "I":
            self.state = NEXT[self.state]
            self._put(ROLE[self.state], "")
            self.edit += 1

    def text(self, role: str, text: str) -> None:
        self._insert()
        edit = self.audit[self.edit]
        self.edit += 1
        if edit == "D":
            return
        self.state = INITIALS[role[0]] if edit == "K" else NEXT[self.state]
        self._put(role if edit == "K" else ROLE[self.state], text)

    def row(self) -> tuple:
        if self.audit is None:
            self.decide()
        self._insert()
        gaps = self.high - self.low + 1 - self.distinct if self.low is not None else 0
        counts = [self.faults.count(f) for f in (BLANK, DUPLICATE, CUT_OFF)]
        return self.conv, gaps, *counts, self.illegal, self.cost, self.audit, self.hash.hexdigest()


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_NAMES = ["conv", *_COUNTS, "audit", "repaired_sha256"]


def _repairing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of conversation, step (dropped rows, codes, texts) and place."""
    current: _Conversation | None = None
    done: list[tuple] = []
    conv_type = None

    def out() -> pa.RecordBatch:
        columns = list(zip(*done)) or [[] for _ in _NAMES]
        done.clear()
        types = [conv_type, *[pa.int64()] * len(_COUNTS), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=_NAMES)

    for batch in batches:
        conv_type = batch.schema.field(0).type
        for conv, step, turn, role, blank, cut_off, tell, text in zip(*(c.to_pylist() for c in batch.columns)):
            if current is None or conv != current.conv:
                if current is not None:
                    done.append(current.row())
                current = _Conversation(conv)
            if step == 1:
                current.code(turn, role[:1], blank, cut_off, tell)
            elif step == 2:
                if current.audit is None:
                    current.decide()
                current.text(role, text)
        if done:
            yield out()
    if current is not None:
        done.append(current.row())
        yield out()


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, turn, role, text, dropped``: rows damaged by the CRC-32 of ``conv:turn``; a repeated row stands twice, a dropped one is marked."""
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_col, turn_col)]
    fate = F.crc32(F.concat(spaced[0], F.lit(":"), spaced[1]).cast("binary")) % 20
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit(" ")).alias("role"), F.coalesce(text_col, F.lit(" ")).alias("text"), fate.alias("fate")
    )
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("fate") == 0).alias("dropped"),
        F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def repaired(rows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """``conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` for each conversation of ``rows(conv, turn, role, text, dropped)``."""
    kind = dict(rows.dtypes)["conv"]
    tell = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    judged = rows.select(
        "conv", F.when(~F.col("dropped"), F.col("turn")).cast("long").alias("turn"), "dropped", "role", "text", tell.alias("tell"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut_off"),
    )
    none = F.lit(None).cast("string")
    steps = F.when(F.col("dropped"), F.array(F.lit(0))).otherwise(F.array(F.lit(1), F.lit(2)))
    both = judged.select("conv", F.explode(steps).alias("step"), "turn", "role", "blank", "cut_off", "tell", "text")
    slim = F.col("step") == 2
    sorted_ = (
        both.select("conv", "step", "turn", "role", "blank", "cut_off", "tell", F.when(slim, F.col("text")).otherwise(none).alias("text"))
        .repartition("conv")
        .sortWithinPartitions("conv", "step", F.asc_nulls_first("turn"), "role", "tell")
    )
    found = sorted_.mapInArrow(_repairing, f"conv {kind}, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, repaired_sha256 string")
    return found.withColumnRenamed("conv", conv_col)
