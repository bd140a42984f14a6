"""Fitted models against plain recomputations, and what they reject or find."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from sparkloom.llm import languages, neighbours, toxicity  # noqa: E402

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def language_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, languages.fit(docs, ~languages.held_out())


def test_language_weights_and_scores_equal_a_plain_computation(language_model):
    """Document frequencies over all learnable rows and cosines of TF-IDF vectors, with sets and dictionaries."""
    docs, model = language_model
    rows = docs.withColumn("held", languages.held_out()).toPandas()
    column = lambda gram: int(languages.mix64(np.array([sum(p << 21 * i for i, p in enumerate(reversed(gram))) * 4 + len(gram)], np.uint64))[0] % np.uint64(len(model.idf)))

    def counts(text):
        line = [0]
        for c in (text or "").lower():
            if c.isalpha():
                line.append(ord(c))
            elif line[-1]:
                line.append(0)
        line += [0] if line[-1] else []
        found = {}
        for n in (1, 2, 3):
            for i in range(len(line) - n + 1):
                if n > 1 or line[i]:
                    found[column(line[i : i + n])] = found.get(column(line[i : i + n]), 0) + 1
        return found

    short = rows[rows.text.str.len() < 300]
    for text in short.text.head(8):
        mine = {int(c): int(n) for c, n in zip(*next(languages.gram_counts([text], len(model.idf))))}
        want = counts(text)
        assert {c: n for c, n in mine.items()} == want
        weight = {c: (1 + math.log(n)) * model.idf[c] for c, n in want.items()}
        norm = math.sqrt(sum(w * w for w in weight.values()))
        cosines = [sum(w * float(centre[c]) for c, w in weight.items()) / norm for centre in model.centres]
        name, score, _ = model.predict([text], 0.8)
        assert name[0] == model.languages[int(np.argmax(cosines))] and abs(score[0] - max(cosines)) < 1e-5
    learnable = rows[~rows.held]
    in_rows = np.zeros(len(model.idf))
    for c, _ in languages.gram_counts(learnable.text.tolist(), len(model.idf)):
        in_rows[c] += 1
    assert np.allclose(model.idf, np.log((1 + len(learnable)) / (1 + in_rows)) + 1)
    assert np.allclose(np.linalg.norm(model.centres, axis=1), 1, atol=1e-5)


JUNK = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    "xkcd qwrt zxcv bnmk lkjh gfds qwpt zzxx " * 10,
    "Все люди рождаются свободными и равными в своем достоинстве и правах.",
    "人人生而自由,在尊严和权利上一律平等。",
    "12345 67890 !!! ### 3.14",
    "",
    None,
]


def test_unlearned_languages_and_junk_are_rejected_and_others_stay(spark, language_model, tmp_path):
    import corpus_pipeline

    docs, model = language_model
    assert all(model.predict(JUNK, 0.8)[2])
    junk = spark.createDataFrame([(10_000_000 + i, t, None, None, None) for i, t in enumerate(JUNK)], docs.schema)
    kept = corpus_pipeline.identified_language(spark, docs.union(junk), str(tmp_path))
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert not any(i >= 10_000_000 for i in ids) and len(ids) >= 0.99 * docs.count()


def test_too_many_labels_are_refused(spark):
    rows = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.col("id").cast("string").alias("lang"))
    with pytest.raises(ValueError):
        languages.fit(rows, F.lit(True), most_labels=20)


def test_label_model_equals_plain_em():
    """The same EM with dictionaries, vote by vote."""
    rng = np.random.default_rng(4)
    n, rounds = 4, 5
    votes = np.arange(1 << n)
    clean, toxic, unknown = (rng.integers(0, 30, 1 << n).astype(float) for _ in range(3))
    model = toxicity.LabelModel(votes, clean, toxic, unknown, n, rounds)
    bit = lambda v, j: int(v) >> j & 1

    def update(weights):
        prior = sum(weights[1].values()) / (sum(weights[0].values()) + sum(weights[1].values()))
        fires = {}
        for y in (0, 1):
            for j in range(n):
                for value in (0, 1):
                    own = {v: w for v, w in weights[y].items() if model.parents[j] < 0 or bit(v, model.parents[j]) == value}
                    fires[y, value, j] = (sum(w for v, w in own.items() if bit(v, j)) + 0.5) / (sum(own.values()) + 1)
        return prior, fires

    def share(prior, fires, v):
        p = [1 - prior, prior]
        for y in (0, 1):
            for j in range(n):
                f = fires[y, bit(v, model.parents[j]) if model.parents[j] >= 0 else 0, j]
                p[y] *= f if bit(v, j) else 1 - f
        return p[1] / (p[0] + p[1])

    state = update([{v: clean[v] + 1e-9 for v in votes}, {v: toxic[v] + 1e-9 for v in votes}])
    for _ in range(rounds):
        s = {v: share(*state, v) for v in votes}
        state = update([{v: clean[v] + unknown[v] * (1 - s[v]) for v in votes}, {v: toxic[v] + unknown[v] * s[v] for v in votes}])
    assert np.allclose(model.posterior(votes), [share(*state, v) for v in votes], atol=1e-9)


def test_toxicity_finds_planted_insults_and_their_forms(spark):
    """Words are learned from labels alone; a text is scored by the words it holds."""
    rng = np.random.default_rng(6)
    plain, bad = [f"mot{k}" for k in range(80)], ["grumbel", "snarf", "blorch"]
    docs, labels = [], []
    for i in range(1200):
        words = rng.choice(plain, 30).tolist()
        if i % 5 == 0:
            words[int(rng.integers(30))] = bad[i // 5 % 3]
            words[int(rng.integers(30))] = bad[i // 7 % 3]
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.col("doc_id") < 900)
    found = toxicity.score(docs.where("doc_id >= 900"), model).toPandas()
    assert ((found.doc_id % 5 == 0) == (found.predicted == 1)).mean() > 0.99
    assert model.scores(["mot1 mot2 GRUMBEL mot3 snarf", "mot1 mot2", "", None]).round().tolist() == [1, 0, 0, 0]


def recall(spark, vectors, kind):
    kept = vectors.astype(np.float32).astype(float) if kind == "float" else vectors
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(kept)], f"vec_id long, embedding array<{kind}>")
    found, hits, n = neighbours.search(neighbours.build_index(rows), rows.where("vec_id % 100 = 0")).toPandas(), 0, 0
    for q, own in found.groupby("query_id"):
        d = np.sqrt(((kept - kept[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hits, n = hits + len({*np.lexsort((np.arange(len(d)), d))[:10].tolist()} & {*own.vec_id}), n + 10
    assert n == 10 * -(-len(vectors) // 100)
    return hits / n


@pytest.mark.parametrize("name", ["large", "small", "mixed", "tight"])
def test_recall_at_any_scale(spark, name):
    data = np.stack(spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").toPandas().embedding).astype(float)[:1200]
    magnitudes = 10.0 ** np.random.default_rng(2).integers(-6, 7, len(data))
    rows, kind = {"large": (data * 1e6, "float"), "small": (data * 1e-9, "float"), "mixed": (data * magnitudes[:, None], "float"), "tight": (1 + data * 1e-9, "double")}[name]
    assert recall(spark, rows, kind) >= 0.9


def test_repeated_ids_take_one_rank(spark):
    rows = [(0, [1.0, 0.0])] * 3 + [(1, [1.0, 0.1])] * 20 + [(2, [1.0, 5.0]), (2, [1.0, 0.2]), (3, [9.0, 9.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.search(neighbours.build_index(vectors), vectors.where("vec_id = 0")).collect()
    assert [(r.rank, r.vec_id) for r in sorted(found, key=lambda r: r["rank"])] == [(1, 1), (2, 2), (3, 3)] and re.match(r"0\.1|0\.09", str(found[0].score))
