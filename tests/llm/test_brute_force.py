"""Operators against plain rewritings of their definitions, the tokenizer libraries, and held-out labels."""

import itertools
import math
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from sparkloom.llm import decontamination, graph, html_text, licences, near_dups, pieces, queries, token_counts  # noqa: E402
from sparkloom.llm.labelled_pages import labelled_pages  # noqa: E402

SF = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", queries.ORACLE)
def test_queries_equal_sql(name, spark, duck):
    found, want = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLE[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    plain = lambda t: sorted(map(str, t[sorted(want.columns)].astype(object).where(t[sorted(want.columns)].notna(), None).itertuples(index=False)))
    assert plain(found) == plain(want)


@pytest.fixture(scope="module")
def tokens():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.Counter(path), Tokenizer.from_file(path)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'stmdrvleé 你\n\t12 !?<|>endoftxX😀 ​٣")), max_size=5), st.text(max_size=80))
def test_token_counts_equal_library(tokens, texts, other):
    texts = [*texts, other, "a<|endoftext|>  'll " + other, " " * len(other)]
    assert tokens[0].count(texts).tolist() == [len(x.ids) for x in tokens[1].encode_batch(texts, add_special_tokens=False)]


def test_chunks_of_any_size_split_alike():
    classes = np.random.default_rng(3).integers(1, token_counts.N_CLASSES, 5000).astype(np.uint8)
    classes[-1] = token_counts.END
    whole = token_counts.pretoken_starts(classes, 8192)
    assert all((token_counts.pretoken_starts(classes, n) == whole).all() for n in (1, 7, 64, 1000))


def plain_groups(texts, width):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return [root(i) for i in range(len(texts))]


def test_near_duplicates_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(12):  # chains of small edits: neighbours are linked, ends often are not
        words = [f"w{k}" for k in rng.integers(0, 500, rng.integers(4, 160))]
        for _ in range(12):
            texts.append(" ".join(words))
            words = list(words)
            for k in rng.integers(0, len(words), max(1, len(words) // 60)):
                words[k] = f"w{rng.integers(0, 500)}"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = {r.doc_id: r.component_id for r in near_dups.near_duplicates(docs).collect()}
    assert [found[i] for i in range(len(texts))] == plain_groups(texts, 5)


def test_long_chains_are_one_component(spark):
    order = np.random.default_rng(1).permutation(300).tolist()
    edges = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    found = graph.connected_components(edges).collect()
    assert {r.node for r in found} == set(order) and {r.component for r in found} == {0}


def test_contamination_in_several_blocks_equals_one(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    one = decontamination.contamination(docs, items).select("doc_id", "n_words", "n_hit", "longest_match")
    many = decontamination.contamination(docs, items, block_bytes=1000).select("doc_id", "n_words", "n_hit", "longest_match")
    assert sorted(one.collect()) == sorted(many.collect())


def test_suffix_order():
    line = np.random.default_rng(2).integers(1, 4, 300)
    order = decontamination.suffix_array(np.append(line, [0] * 20), 16)
    padded = [*line.tolist(), *[0] * 40]
    keys = [padded[i : i + 16] for i in order.tolist()]
    assert keys == sorted(keys)


def test_shards_are_even_and_gapless(spark):
    rows = queries.op5_sharding(spark, SF).toPandas()
    size = rows.groupby("shard")["size"].sum()
    assert len(size) == 16 and abs(size - size.mean()).max() <= rows["size"].max()
    for _, own in rows.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    order = rows.sort_values("doc_id")
    assert order.shard.is_monotonic_increasing
    texts = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id").text
    assert all(zlib.crc32(texts[i].encode()) == c for i, c in zip(rows.doc_id, rows.text_crc32))


def test_neighbours_recall(spark):
    sf = "/root/testdata/sf0.1"
    data = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    ids, m = data.vec_id.to_numpy(), np.stack(data.embedding).astype(float)
    found, hits, n = queries.op6_nearest_neighbours(spark, sf).toPandas(), 0, 0
    for q, own in found.groupby("query_id"):
        d = np.sqrt(((m - m[ids == q]) ** 2).sum(axis=1))
        best = [i for i in ids[np.lexsort((ids, d))] if i != q][:10]
        hits, n = hits + len({*best} & {*own.vec_id}), n + 10
        own = own.sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11)) and abs(own.score.to_numpy() - d[[int(np.flatnonzero(ids == v)[0]) for v in own.vec_id]]).max() < 1e-9
    assert n == 10 * (ids % 100 == 0).sum() and hits / n >= 0.9


def test_language_and_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet").toPandas() for t in ("documents", "labels"))
    langs = queries.op7_language_id(spark, sf).toPandas().merge(docs, on="doc_id").query("held_out")
    assert (langs.lang_pred == langs.lang).mean() > 0.98
    toxic = queries.op10_toxicity(spark, sf).toPandas().merge(labels, on="doc_id").query("held_out")
    hit, clean = toxic[toxic.toxic == 1], toxic[toxic.toxic == 0]
    assert (hit.predicted == 1).mean() > 0.8 and (clean.predicted == 1).mean() < 0.02


def test_html_model_on_unseen_labelled_pages(spark):
    model = html_text.fit(spark.createDataFrame(labelled_pages(800), "page_id long, html string"))
    right = both = 0
    for _, html in labelled_pages(150, seed=99):
        trees = html_text.Trees()
        trees.read(html)
        label, chance = html_text._labels(trees), model.marginals(trees)
        for node in trees.text:
            both, right = both + 1, right + (label[node] == (chance[node] >= 0.5))
    assert right / both > 0.95


def test_html_messages_equal_enumeration(spark):
    model = html_text.fit(spark.createDataFrame(labelled_pages(100), "page_id long, html string"))
    trees = html_text.Trees()
    trees.read("<body><nav><a>Home</a></nav><div class=content><p>Some text here.</p><p>More</p></div></body>")
    n, weight = len(trees.parent), {}
    nodes, features = trees.features()
    of = dict(zip(nodes.tolist(), features.tolist()))
    for labels in itertools.product((0, 1), repeat=n):
        log = sum(model.edge[trees.kind[v], labels[trees.parent[v]], labels[v]] for v in range(1, n)) + sum(model.evidence[f, labels[v]] for v, f in of.items())
        weight[labels] = math.exp(log)
    total = sum(weight.values())
    want = [sum(w for k, w in weight.items() if k[v]) / total for v in range(n)]
    assert np.allclose(model.marginals(trees), want)


def test_html_texts(spark):
    model = html_text.default_model(spark)
    html = "<html><head><title>no</title><script>no()</script></head><body><nav><ul><li><a href=x>no</a></li></ul></nav><article><h1>Yes&nbsp;&amp;  title</h1><p>First <b>bold</b>\n text.</p><p>Second one.</p></article><div class='comments'><p>I do not agree at all with this.</p></div><footer>no</footer></body></html>"
    assert html_text.main_texts([html, None, ""], model) == ["Yes & title First bold text. Second one.", "", ""]


def test_patience_alignment_is_increasing_and_full_on_equal_lists():
    rng = np.random.default_rng(8)
    for _ in range(200):
        a, b = rng.integers(0, 12, rng.integers(0, 25)).tolist(), rng.integers(0, 12, rng.integers(0, 25)).tolist()
        pairs = licences.patience_alignment(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        assert len(licences.patience_alignment(a, a)) == len(a)


def test_pieces_equal_library_and_samples_are_distinct(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pieces.encode(docs, PIECES, k=3).collect()
    for r in rows:
        assert r.ids == model.encode(texts[r.doc_id]) and len({tuple(s) for s in r.samples}) == len(r.samples)
        assert all(0 <= x <= 1 for x in r.inclusion) and all(model.decode(s) == r.decoded for s in r.samples)
    back = pieces.decode(spark.createDataFrame([(r.doc_id, r.ids) for r in rows[:20]], "doc_id long, ids array<int>"), PIECES).collect()
    assert all(b.text == model.decode(b.ids) for b in back)


def test_samples_follow_their_probabilities():
    """First samples are drawn by probability; without replacement, all of a small lattice come out once."""
    known = pieces.vocabulary(PIECES, 1.0)
    n = 4000
    keys = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    drawn = pieces.Samples(pieces.Lattice(["ab c"] * n, known), keys, 3)
    ids, bounds = drawn.ids(0)
    seen = {}
    for i in range(n):
        way = tuple(ids[bounds[i] : bounds[i + 1]].tolist())
        seen.setdefault(way, [0, math.exp(drawn.log_p[0, i])])[0] += 1
    for count, p in seen.values():
        assert abs(count / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-9
    every = pieces.Samples(pieces.Lattice(["ab c"], known), keys[:1], 40)
    ways = [tuple(every.ids(r)[0].tolist()) for r in range(40) if every.drawn[r, 0]]
    assert len(set(ways)) == len(ways) and abs(sum(math.exp(every.log_p[r, 0]) for r in range(len(ways))) - 1) < 1e-6


@pytest.mark.parametrize("text", ["a   b", "  x", "    if x:\n        return  y", "   ", "a "])
def test_library_segmentation_of_spaces_is_a_way(text):
    """The library's ids are one way through the lattice, and the text's only words are runs of spaces with what follows."""
    known = pieces.vocabulary(PIECES, 1.0)
    lattice, want = pieces.Lattice(["b", text, "  c"], known), known.model.encode(text)
    log_p, at = 0.0, 0
    for node in lattice.starts[lattice.bounds[1] : lattice.bounds[2]].tolist():
        while node:
            edges = range(lattice.first[node], lattice.first[node + 1])
            edge = next(e for e in edges if at < len(want) and lattice.pool[lattice.offset[e] : lattice.offset[e] + lattice.count[e]].tolist() == want[at : at + lattice.count[e]])
            log_p, at, node = log_p + lattice.log_p[edge], at + lattice.count[edge], int(lattice.target[edge])
    assert at == len(want) and log_p > -math.inf


def texts_of(html):
    trees = html_text.Trees()
    trees.read(html)
    return list(trees.text.values())


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p title=it's>First paragraph, it's long.</p><p>Second</p>", ["First paragraph, it's long.", "Second"]),
        ("<p title=\"a>b\" data='it\"s'>x</p>y", ["x", "y"]),
        ('<p title="unclosed>lost? </p><p>kept', ["lost?", "kept"]),
        ('text <div class="cut', ["text"]),
        ("a <!-- open", ["a"]),
        ("a<!-->b<!-- x > y -->c<!-- q --!>d", ["abcd"]),
        ("a < b and c > d, a<3", ["a < b and c > d, a<3"]),
        ("<script src=/a/>var no=1;</script x>yes</ bogus></>!", ["yes!"]),
        ("<p class=a\"b>one</p><p = 'x>y'>two</p><p data=>three</p>", ["one", "two", "three"]),
        ("<div>" * 5000 + "deep" + "<b a='" * 5000, ["deep"]),
        ("<p>" + "long word " * 100_000, [("long word " * 100_000).strip()]),
    ],
)
def test_html_markup_is_read_as_browsers_do(html, want):
    assert texts_of(html) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab  ▁é你😀\n\tThe 12\x00ﬁ½​"), max_size=60), min_size=1, max_size=4))
def test_words_encode_as_the_library_encodes_texts(texts):
    import pyarrow as pa

    known = pieces.vocabulary(PIECES, 1.0)
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string()), pa.array([str(i) for i in range(len(texts))], pa.string())], names=["id", "text", "key"])
    found = pa.Table.from_batches(pieces._encoding(PIECES, 2, 1.0, 5)(iter([rows]))).to_pylist()
    assert [r["ids"] for r in found] == [known.model.encode(t) for t in texts]
    assert all(known.model.decode(s) == r["decoded"] == known.model.decode(r["ids"]) for r in found for s in r["samples"])


def test_samples_do_not_depend_on_what_was_kept():
    known, keys = pieces.vocabulary(PIECES, 1.0), np.arange(1, 9, dtype=np.uint64)
    texts = ["the cat sat on a mat", "un deux trois", "the cat", "a", "été 你好 the", "zzz qqq", "mat mat mat", "x"]
    store = pieces.Store()
    pieces.Lattice(["some words kept before: trois cat qqq"], known, store)
    one, two = (pieces.Samples(lattice, keys, 3) for lattice in (pieces.Lattice(texts, known), pieces.Lattice(texts, known, store)))
    assert all((one.ids(r)[0] == two.ids(r)[0]).all() for r in range(3)) and np.allclose(one.log_p, two.log_p)
    store.clear()
    three = pieces.Samples(pieces.Lattice(texts, known, store), keys, 3)
    assert all((one.ids(r)[0] == three.ids(r)[0]).all() for r in range(3))


def plain_windows(texts, items, window=13):
    """For each text its hit words and the items with a window in it, word by word."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    out = []
    for text in map(words, texts):
        hit, found = set(), set()
        for name, item in items:
            item = words(item)
            size = min(window, len(item))
            spans = {tuple(item[i : i + size]) for i in range(len(item) - size + 1)} if item else set()
            for i in range(len(text) - size + 1):
                if tuple(text[i : i + size]) in spans:
                    hit |= set(range(i, i + size))
                    found.add(name)
        out.append((len(text), len(hit), sorted(found)))
    return out


def test_contamination_equals_word_by_word(spark):
    """Items that repeat their own windows, short items, equal items and overlapping matches."""
    rng = np.random.default_rng(12)
    items = [(k, " ".join(rng.choice(["a", "b", "c"][: 1 + k % 3], rng.integers(1, 40)))) for k in range(25)] + [(90, "a " * 30), (91, "a " * 30), (92, None), (93, "a b " * 20)]
    texts = [" ".join(rng.choice(["a", "b", "c"][: 1 + k % 3], rng.integers(0, 120))) for k in range(40)] + ["x " + "a " * 50 + "y " + "a " * 13, None, "", "a b " * 30 + "c " + "b a " * 12]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r for r in decontamination.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    bodies = {k: re.findall(r"\w+", t or "") for k, t in items}
    for k, (n, hit, names) in enumerate(plain_windows(texts, items)):
        assert (found[k].n_words, found[k].n_hit, sorted(found[k]["items"])) == (n, hit, names)
        own = re.findall(r"\w+", texts[k] or "")
        for m in found[k].matches:  # each is verbatim
            assert own[m.doc_word : m.doc_word + m.n_words] == bodies[m.item_id][m.item_word : m.item_word + m.n_words]


def test_contamination_of_a_million_equal_words_is_bounded():
    import tracemalloc

    block = decontamination.Block([1], ["word " * 200], 13)
    tracemalloc.start()
    words, bounds = decontamination.hashed_words(["word " * 1_000_000], decontamination.WORD_BREAKS)
    text, item, at, start, n = decontamination.shard_matches(block, words, bounds)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(at) == 5000 and at[0] == 0 and (n == 200).all() and peak < 500e6


def test_licences_are_found_where_they_stand_and_nowhere_else(spark):
    """Exact and worn notices among other words, against where they were put."""
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for k, template in enumerate(licences.TEMPLATES):
        words = template.text.split()
        worn = [w for i, w in enumerate(words) if len(words) < 25 or i % 12 != 5 or set(re.findall(r"\w+", w.lower())) & set(template.telling.split())]
        before = [f"other{x}" for x in rng.integers(0, 99, rng.integers(0, 40))]
        rows.append((3 * k, " ".join([*before, *words, "after", "that"])))
        rows.append((3 * k + 1, " ".join([*before, *worn])))
        rows.append((3 * k + 2, " ".join(words[: len(words) // 3])))
        want[3 * k] = (template.licence, len(before))
        want[3 * k + 1] = (template.licence, len(before))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in licences.scan(docs).collect():
        if r.doc_id in want:
            assert want[r.doc_id] in [(m.licence, m.first_word) for m in r.matches], rows[r.doc_id]
            assert r.doc_id % 3 or max(m.coverage for m in r.matches) == 1.0
    clean = spark.createDataFrame([(1, "the licence of all things that are reserved for a public matter"), (2, None), (3, "rights all reserved")], "doc_id long, text string")
    assert all(r.matches == [] for r in licences.scan(clean).collect())


def longest_increasing(values):
    best = []
    for k, v in enumerate(values):
        best.append(1 + max([best[j] for j in range(k) if values[j] < v], default=0))
    return max(best, default=0)


def test_patience_alignment_of_distinct_words_is_the_longest_increasing_run():
    """Where all words are distinct, every alignment is a run of anchors, so its size is known."""
    rng = np.random.default_rng(10)
    for _ in range(300):
        a, b = rng.permutation(16)[: rng.integers(0, 16)].tolist(), rng.permutation(16).tolist()
        values = [b.index(w) for w in a]
        assert len(licences._increasing(list(enumerate(values)))) == longest_increasing(values)
        same = sum(1 for x, y in itertools.takewhile(lambda p: p[0] == p[1], zip(a, b)))
        inner = licences.patience_alignment(a, b)
        assert same <= len(inner) <= longest_increasing(values)
        edited = [w for w in b if rng.random() > 0.3]
        assert len(licences.patience_alignment(edited, b)) == len(edited)


def test_many_notices_take_time_in_proportion():
    import time

    scanner = licences.Scanner(licences.TEMPLATES, 0.8, 0.25)
    began = time.process_time()
    found = scanner.matches(["Released under the MIT License. " * 8000])[0]
    assert len(found) == 8000 and time.process_time() - began < 20


def test_one_id_on_two_texts_loses_only_the_copy(spark, tmp_path):
    import corpus_pipeline

    a, b = (" ".join(f"{c}{k}" for k in range(n)) for c, n in (("a", 60), ("b", 70)))
    rows = [(1, a, 0), (5, a, 1), (5, b, 2), (6, b + " more", 3), (None, a, 4), (7, None, 5), (8, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `x.y` int").repartition(3)
    kept = corpus_pipeline.one_of_each_group(spark, docs, str(tmp_path)).collect()
    assert sorted(r["x.y"] for r in kept) == [0, 2, 4, 5, 6]


def test_wide_shingles(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(60)))), (2, " ".join(map(str, range(61)))), (3, "1 2")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dups.near_duplicates(docs, width=20).collect()} == {1: 1, 2: 1, 3: 3}


def test_every_text_of_an_id_is_linked_and_roots_are_found(spark):
    def words(letter, changed=()):
        return " ".join(f"{letter}{i}x" if i in changed else f"{letter}{i}" for i in range(60))

    # Id 5 stands on two texts of equally many shingles; each is near another text.
    rows = [(5, words("a")), (5, words("b")), (5, words("b")), (7, words("a", {59})), (8, words("b", {59})), (9, words("c")), (None, words("c", {0}))]
    found = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=5, percent=80)
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in found.collect()) == [(0, 0), (5, 5), (5, 5), (5, 5), (7, 5), (8, 5), (9, 9)]

    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 40)] + [(100, 50)], "node long, parent long")
    assert {(r.node, r.component) for r in graph.tree_roots(chain).collect()} == {(i, 0) for i in range(1, 40)} | {(100, 50)}
