"""From raw documents to encoded training text, in five stages.

Each stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of
``docs`` and only the rows that they keep. A stage works on whole texts and on all
rows that it is given.

Defined cases of all stages: an empty table gives no rows; columns beside ``doc_id`` and
``text``, whatever their names and nulls, are carried along untouched; repeated rows are
judged alike; very long texts are handled whole, one at a time; a row with a null id is
judged by its text. Each stage states its own cases.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontamination, languages, near_dups, pieces, toxicity
from sparkloom.llm.common import cut, packed, read, unpacked


def identified_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and texts far from every language's centroids.

    Null, empty and letterless texts go. Languages are learned from the rows given that
    have a label and are not held out; if there are none, every row goes. Of languages
    equally near the smaller name counts, which changes nothing for the row.
    """
    model = languages.fit(docs, ~languages.held_out())
    found = languages.identify(packed(docs, "doc_id", "text"), model, keep=("_row",))
    return unpacked(found.where("not rejected"), docs.columns)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that the classifier scores at 0.3 or more.

    Null and empty texts get the score of a text without any term. Without labelled rows
    of both kinds every text gets the share of toxic labels (0 without labels). A score of
    exactly 0.3 goes.
    """
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), ~languages.held_out())
    found = toxicity.score(packed(docs, "doc_id", "text"), model, keep=("_row",))
    return unpacked(found.where("predicted = 0"), docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near copies (five-word shingles, similarity 0.8).

    Null and wordless texts have no copies and stay. Rows go by id and text, so one id
    on two texts loses only the text that is a copy; repeated rows of the kept id stay.
    Rows with a null id are in no group and stay.
    """
    found = near_dups.near_duplicates(docs, width=5, percent=80, keep_hash=True)
    # Cut, so that the exchanges of the search can be given up before the texts are exchanged.
    gone = cut(found.where("not kept").select(F.col("doc_id").alias("gone_id"), "text_hash").distinct())
    rows = packed(docs, "doc_id", "text")
    same = (F.col("doc_id") == F.col("gone_id")) & (F.xxhash64("text") == F.col("text_hash"))
    return unpacked(rows.join(gone, same, "left_anti"), docs.columns)


def not_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which one word in twenty or more lies in benchmark passages.

    Null and wordless texts are clean. Exactly one word in twenty is contaminated.
    """
    found = decontamination.contamination(packed(docs, "doc_id", "text"), read(spark, sf_dir, "benchmark"), keep=("_row",))
    return unpacked(found.where("not contaminated"), docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids, and three sampled segmentations with log probabilities and inclusion scores.

    Null and empty texts have no ids and one empty segmentation. The samples of a row
    depend on its id and text alone, so repeated rows get equal ones; texts with fewer
    than three segmentations give all of them.
    """
    found = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), k=3)
    return found.select("doc_id", "ids", "samples", "log_p", "inclusion")


STAGES = [
    ("language_id", identified_language),
    ("toxicity", not_toxic),
    ("near_dedup", one_of_each_group),
    ("decontamination", not_contaminated),
    ("sentencepiece", encoded),
]

#: The stages train classifiers and sample, which SQL can't express; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Between stages rows are cut to the shared checkpoint folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
