"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from sparkloom.llm import decontamination, html_text, languages, licences, near_dups, neighbours, pieces, sharding, token_counts, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, score double, _k0 string, kept string, matches string, rep long"
LONG = "wort und " * 60_000
TEXTS = ["", None, "   \n", "one two", "the cat sat on the mat and then it ran away from the dog again", "the cat sat on the mat and then it ran away from the dog again", LONG, "x" * 200_000, "😀 é 你好", "Released under the MIT License."]
ROWS = [(i, t, ("en", "de", None)[i % 3], None if i % 4 == 0 else "s", None, 7, None, "k", None, "m", i) for i, t in enumerate(TEXTS)]
ROWS += [ROWS[4], (None, "no id at all", None, None, None, None, None, None, None, None, None)]
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "cat sat on the mat and then it ran away from the dog"), (2, None), (3, ""), (4, "one two"), (4, "one two"), (None, "zz")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, None if i == 3 else 1, (i % 2 if i != 5 else None)) for i in range(9)] * 2 + [(None, 1, 1)], "doc_id long, quality int, toxic int")


def operators(spark, docs, benchmark, labels):
    pages = docs.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html").withColumn("url", F.lit(None).cast("string"))
    yield "html", lambda: html_text.extract(pages, html_text.default_model(spark, 50))
    yield "licences", lambda: licences.scan(docs)
    yield "tokens", lambda: token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    yield "contamination", lambda: decontamination.contamination(docs, benchmark)
    yield "shards", lambda: sharding.byte_shards(docs)
    yield "languages", lambda: languages.identify(docs, languages.fit(docs, ~languages.held_out()))
    yield "near duplicates", lambda: near_dups.near_duplicates(docs)
    yield "pieces", lambda: pieces.encode(docs, PIECES)
    yield "toxicity", lambda: toxicity.score(docs, toxicity.fit(docs, labels, ~languages.held_out()))


def test_operators_give_a_row_for_each_row(spark, docs, none, benchmark, labels):
    for name, run in operators(spark, docs, benchmark, labels):
        assert len(run().collect()) == len(ROWS), name
    for name, run in operators(spark, none, benchmark.limit(0), labels.limit(0)):
        assert run().collect() == [], name
    for name, run in operators(spark, docs, benchmark.limit(0), labels.limit(0)):
        assert len(run().collect()) == len(ROWS), name


def test_defined_results(spark, docs, benchmark):
    found = {r.doc_id: r for r in decontamination.contamination(docs, benchmark).collect()}
    assert found[4].n_hit == 13 and set(found[4].items) == {1} and set(found[3].items) == {4} and found[1].n_words == 0
    dups = {r.doc_id: r for r in near_dups.near_duplicates(docs).collect()}
    assert dups[5].component_id == 4 and not dups[5].kept and dups[4].kept and dups[0].component_id == 0 and dups[0].n_shingles == 0 and dups[None].component_id is None
    langs = {r.doc_id: r for r in languages.identify(docs, languages.fit(docs, F.lit(True))).collect()}
    assert langs[1].lang_pred == langs[0].lang_pred == "und" and langs[0].rejected and langs[6].lang_pred in ("en", "de")
    coded = {r.doc_id: r for r in pieces.encode(docs, PIECES).collect()}
    assert coded[0].ids == [] and coded[1].samples == [[]] and coded[1].inclusion == [1.0]
    matches = {r.doc_id: r.matches for r in licences.scan(docs).collect()}
    assert [m.licence for m in matches[9]] == ["mit"] and matches[9][0].coverage == 1.0 and matches[4] == []


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [3.0, 4.0]), (7, [1.0]), (100, [1.0, 0.5]), (200, None)]
    vectors = spark.createDataFrame([(*r, "extra", 9) for r in rows], "vec_id long, embedding array<float>, node string, id long")
    found = neighbours.search(neighbours.build_index(vectors), vectors.where("vec_id % 100 = 0")).collect()
    of = {q: [(r.rank, r.vec_id, round(r.score, 9)) for r in sorted(found, key=lambda r: r.rank) if r.query_id == q] for q in (0, 100)}
    assert of[0] == [(1, 1, 0.0), (2, 100, 0.5), (3, 6, round(20**0.5, 9))] and [x[1] for x in of[100]] == [0, 1, 6]
    assert neighbours.search(neighbours.build_index(vectors.limit(0)), vectors.limit(0)).collect() == []


def test_pipeline_stages_on_odd_rows(spark, docs, none, benchmark, labels, tmp_path):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for start in (docs, none):
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, start, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert rows.columns == docs.columns, name
            assert rows.count() <= start.count(), name
