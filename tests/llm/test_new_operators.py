"""Sort-means, fuzzy hashing and conversation repair against plain rewritings of their definitions."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import centroids, conversation_repair, fuzzy_prints, golay

# --- centroid clustering


def plain_kmeans(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(x)) if abs(x) < 1e300 else int(x) * 1024 for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    tell = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    middle = [v for _, v in tell[:k]]
    if not middle:
        return []
    away = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(middle))
    for _ in range(rounds):
        groups = [[] for _ in middle]
        for _, v in kept:
            groups[away(v)[1]].append(v)
        middle = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, middle)]
    last = [(i, *reversed(away(v))) for i, v in kept]
    spread = [sum(d for _, c, d in last if c == n) for n in range(len(middle))]
    long = lambda x: x if x < 1 << 63 else None
    return [(i, c, long(d), long(spread[c]), long(sum(spread)), hashlib.sha256(",".join(map(str, middle[c])).encode()).hexdigest()) for i, c, d in last]


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def vectors(seed, n, scale=1.0):
    r = np.random.default_rng(seed)
    return [(i, (scale * (r.normal(size=64) + 3 * (i % 5 == 0))).tolist()) for i in range(n)]


ODD = [(900, None), (901, [1.0] * 63), (902, [1.0] * 63 + [None]), (903, [math.nan] + [0.0] * 63), (904, [0.0] * 63 + [math.inf]), (None, [0.5] * 64), (905, []), (906, [0.0] * 64), (906, [0.0] * 64), (906, [1.0] * 64)]


@pytest.mark.parametrize(
    "rows",
    [vectors(1, 120), vectors(2, 40) + ODD, vectors(3, 5), ODD, [], [(None, [1.0] * 64)], vectors(4, 30) + [(500, [1e300] + [-1e200] * 63), (501, [3e15] * 64)], [(i, [float(i % 2)] * 64) for i in range(40)]],
    ids=["plain", "odd rows", "fewer than k", "odd rows only", "empty", "no seed", "beyond 64 bits", "ties and repeats"],
)
def test_clusters_equal_plain_kmeans(spark, rows):
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, id string")
    assert as_rows(centroids.cluster(table)) == sorted(plain_kmeans(rows), key=str)


def test_sort_means_skips_but_finds_the_nearest():
    r = np.random.default_rng(5)
    points, middle = r.integers(-40, 40, (400, 3)), r.integers(-40, 40, (9, 3))
    wanted = ((points[:, None] - middle[None]) ** 2).sum(axis=2)
    for start in range(9):
        found, best = centroids.assigned(points, np.full(400, start), middle)
        assert (found == wanted.argmin(axis=1)).all() and (best == wanted.min(axis=1)).all()


# --- fuzzy hashing


def test_golay_code_is_perfect_and_covers_one_more_error():
    words = np.random.default_rng(7).integers(0, 1 << 23, 4000)
    near, further = golay.indices(words)
    assert sorted(np.unique((further >= 0).sum(axis=1))) == [0, 5]
    for bit in range(23):
        own, _ = golay.indices(words ^ (1 << bit))
        assert ((own == near) | (further == own[:, None]).any(axis=1)).all()
    codewords = [w for w in range(0, 1 << 23, 1 << 11) for w in [w ^ int(golay._UPPER[w >> 11])]]
    assert min(bin(a ^ b).count("1") for a, b in itertools.combinations(random.Random(1).sample(codewords, 400), 2)) >= 7


def plain_fingerprint(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    of = {n: n for n in nodes}

    def root(n):
        while of[n] != n:
            n = of[n]
        return n

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            of[root(a)] = root(b)
    return {n: root(n) for n in nodes}


def plain_near(rows):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    comp = components(sorted({p for _, p in prints}), lambda a, b: bin(a ^ b).count("1") <= 4)
    least = {}
    for i, p in prints:
        if i is not None:
            least[comp[p]] = min(i, least.get(comp[p], i))
    return [(i, f"{p:016x}", least.get(comp[p])) for i, p in prints]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aAbB é\t\n\x0b\x85 x"), max_size=60))
def test_fingerprint_equals_plain(text):
    assert fuzzy_prints.fingerprint(text) == plain_fingerprint(text)


def test_blocks_of_long_texts_give_the_same_fingerprint(monkeypatch):
    text = " ".join(random.Random(2).choices("ab cd ef gh ij kl".split(), k=3000))
    monkeypatch.setattr(fuzzy_prints, "BLOCK", 64)
    assert fuzzy_prints.fingerprint(text) == plain_fingerprint(text)


def test_near_duplicates_equal_all_pairs(spark):
    r = random.Random(4)
    words = ["".join(r.choices("abcdefgh", k=4)) for _ in range(300)]
    texts = []
    for _ in range(25):
        base = r.choices(words, k=120)
        for _ in range(r.randint(1, 6)):
            copy = list(base)
            for _ in range(r.randint(0, 6)):
                copy[r.randrange(len(copy))] = r.choice(words)
            texts.append(" ".join(copy))
    rows = [(100 + k, t) for k, t in enumerate(texts)] + [(7, None), (8, ""), (9, " \n"), (10, "two Words"), (11, "TWO words"), (100, "x y z"), (None, texts[0]), (None, "only a null id here"), (3, texts[5]), (3, texts[5]), (5, texts[9] * 200)]
    table = spark.createDataFrame([(i, t, "p", 1) for i, t in rows], "doc_id long, text string, print string, component long")
    assert as_rows(fuzzy_prints.near_duplicates(table)) == sorted(plain_near(rows), key=str)
    assert as_rows(fuzzy_prints.near_duplicates(table.limit(0))) == []


@pytest.mark.parametrize("spread", [2, 4, 7])
def test_links_of_crowded_fingerprints(spark, spread):
    """Balls of fingerprints that share most buckets, chains included, and random ones."""
    r = np.random.default_rng(spread)
    prints = set(r.integers(-(1 << 63), 1 << 63, 150).tolist())
    for centre in list(prints)[:6]:
        for _ in range(60):
            x = centre & ((1 << 64) - 1)
            for bit in r.choice(64, r.integers(0, spread + 1), replace=False):
                x ^= 1 << int(bit)
            prints.add(x - (1 << 64) if x >> 63 else x)
    prints = sorted(prints)
    want = components(prints, lambda a, b: bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 4)
    found = {row["node"]: row["component"] for row in fuzzy_prints.fingerprint_links(spark.createDataFrame([(p,) for p in prints], "print long")).collect()}
    groups = lambda of: sorted(sorted(g) for g in _grouped(of) if len(g) > 1)
    assert groups(found) == groups(want)


def _grouped(of):
    out = {}
    for n, c in of.items():
        out.setdefault(c, []).append(n)
    return out.values()


# --- conversation repair


def plain_repair(rows):
    """Every edit sequence that could be cheapest, by search over prefixes."""
    faults = [(role[:1], fault) for role, _, fault in rows]
    best = None
    stack = [(0, "", 0, "")]
    most = 4 * len(rows)
    while stack:
        i, roles, cost, audit = stack.pop()
        if cost > most or best and (cost, audit) > best and cost > best[0]:
            continue
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
            best = (cost, audit)
        for role in "ua":
            if re.fullmatch("s?(ua)*u?", roles + role) and not audit.endswith("III"):
                stack.append((i, roles + role, cost + 3, audit + "I"))
        if i < len(rows):
            stack.append((i + 1, roles, cost + 4, audit + "D"))
            own, fault = faults[i]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if re.fullmatch("s?(ua)*u?", roles + own) and own in ("s", "u", "a"):
                    stack.append((i + 1, roles + own, cost + more, audit + "K"))
                for role in "ua":
                    if re.fullmatch("s?(ua)*u?", roles + role):
                        stack.append((i + 1, roles + role, cost + 3 + more, audit + "R"))
    return best


def plain_conversations(rows):
    md5 = lambda role, text: hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
    out = []
    for conv in {c for c, *_ in rows}:
        turns = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            turns += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], md5(*t[1:])))
        judged, seen = [], set()
        for _, role, text in turns:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
        numbers = [t for t, *_ in turns if t is not None]
        cost, audit = plain_repair(judged)
        lines, rest, roles = [], iter(judged), ""
        for edit in audit:
            role, text, _ = next(rest) if edit != "I" else ("", "", "")
            if edit == "D":
                continue
            new = "assistant" if roles.endswith("u") else "user"
            role = role if edit == "K" else new
            roles += role[0]
            lines.append(f"{role}:{text}")
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        counts = [sum(f == kind for *_, f in judged) for kind in ("blank", "duplicate", "truncated")]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def mended(spark, rows):
    table = spark.createDataFrame([(*r, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, conv string, step int")
    return as_rows(conversation_repair.repaired(conversation_repair.damaged(table)))


def test_repairs_equal_plain_search(spark):
    r = random.Random(11)
    texts = ["Fine.", "Also fine!", "cut off", "", " \n", "Well? ", "a. ", "b. ", "é!", None]
    rows = []
    for conv in range(160):
        for turn in range(r.randint(0, 6)):
            rows.append((conv, r.choice((turn, turn * 2, None)), r.choice(("user", "assistant", "user", "assistant", "system", "tool", "", None, "Assistant", "ux")), r.choice(texts)))
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Yes.")] + [(500, 1, "user", "Same.")] * 5 + [(501, 3, "user", t) for t in ("b.", "a.", "c.")]
    dropped = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "Gone."))
    found = mended(spark, rows)
    assert found == plain_conversations(rows)
    assert [row for row in found if row[0] == dropped] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert mended(spark, []) == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suax"), st.sampled_from(["", "", "blank", "duplicate", "truncated"])), max_size=6))
def test_audits_are_cheapest_and_least(rows):
    codes = {"": conversation_repair.FINE, "blank": conversation_repair.BLANK, "duplicate": conversation_repair.DUPLICATE, "truncated": conversation_repair.CUT_OFF}
    found = conversation_repair.repair([codes[f] for _, f in rows], [conversation_repair.INITIALS.get(i, 0) for i, _ in rows])
    assert found == plain_repair([(i, "", f) for i, f in rows])


def test_long_conversation_in_linear_time():
    r = random.Random(3)
    n = 60_000
    cost, audit = conversation_repair.repair([r.choice((0, 0, 1, 3)) for _ in range(n)], [r.choice((1, 2, 3)) for _ in range(n)])
    assert len(audit) - audit.count("I") == n and cost > 0
