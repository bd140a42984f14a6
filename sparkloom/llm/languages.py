"""Language identification by nearest centroids of TF-IDF character n-grams.

Fitting. Letters are lower-cased, everything else between them becomes one
boundary, and n-grams of one to three symbols are hashed to ``dims`` columns.
Document frequencies come from every row that may be learned from. At most
``sample`` labelled ids a language (those with the smallest hash) are clustered
into ``clusters`` centroids by spherical k-means, one language a task.

Prediction. A text's normalised vector is compared with all centroids by cosine;
the nearest one names the language.

Rejection. The cosine to the right centroid depends on how much text there is, so
every language has a limit for each power of two of n-grams: ``slack`` times the
``quantile`` of the best cosines of its own sampled texts of that length. Beginnings
of ``calibration`` of these texts (1, 4, 16, ... words) stand for shorter ones. A
text whose best cosine is under the limit of its language and length is rejected.
A quantile is used because a smallest value would fall with the size of the sample.

Defined cases: null texts and those without a letter are ``und``, score 0 and
rejected; if nothing can be learned from, every text is; ties go to the
language of smaller name; rows with null labels are predicted but not learned
from; rows of one id give one text to the sample (the smallest label, then text)
but each counts in the document frequencies and is predicted; very long texts are
handled whole, a text at a time; a label column with more than ``most_labels``
values is refused; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept_columns, named_back, pieces
from .shingles import mix64

UNKNOWN = "und"
#: Lengths are powers of two of the number of n-grams, up to this one.
LENGTHS = 24


@functools.cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    table = np.zeros(sys.maxunicode + 1, bool)
    for point in range(sys.maxunicode + 1):
        table[point] = unicodedata.category(chr(point))[0] == "L"
    return table


def gram_counts(texts: list[str | None], dims: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the columns of its n-grams and their counts."""
    for text in texts:
        points = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
        is_letter = letters()[points]
        # A boundary (zero) before each run of letters and one after the last.
        points = np.where(is_letter, points, 0)
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]
        line = np.concatenate(([0], points[keep], [0][: int(is_letter[-1:].any())])).astype(np.uint64)
        if not is_letter.any():
            yield np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        grams = [line[line > 0], line[:-1] << np.uint64(21) | line[1:], line[:-2] << np.uint64(42) | line[1:-1] << np.uint64(21) | line[2:]]
        columns = np.concatenate([mix64(g * np.uint64(4) + np.uint64(n)) for n, g in enumerate(grams, 1)]) % np.uint64(dims)
        counts = np.bincount(columns.astype(np.int64), minlength=dims)
        found = np.flatnonzero(counts)
        yield found, counts[found]


def vectors(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised TF-IDF rows (zeros for a text without letters) and each text's length, a power of two of n-grams."""
    out, lengths = np.zeros((len(texts), len(idf)), np.float32), np.zeros(len(texts), np.int64)
    for k, (columns, counts) in enumerate(gram_counts(texts, len(idf))):
        weights = (1 + np.log(counts)) * idf[columns]
        out[k, columns] = weights / (np.sqrt((weights**2).sum()) or 1)
        lengths[k] = min(int(counts.sum()).bit_length(), LENGTHS - 1)
    return out, lengths


def _frequencies(dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row a column for each task: the number of its texts with that column, and of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(dims + 1, np.int64)
        for batch in pieces(batches, 0):
            for columns, _ in gram_counts(batch.column(0).to_pylist(), dims):
                seen[columns] += 1
                seen[dims] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims + 1)), pa.array(seen)], names=["at", "n"])

    return run


def spherical_kmeans(rows: np.ndarray, clusters: int, rounds: int = 12, least: float = 0.05, seed: int = 3) -> np.ndarray:
    """Unit centroids of at least the share ``least`` of the rows, as smaller ones are often wrongly labelled texts.

    Seeds are drawn with a chance by their squared distance to the seeds before (k-means++).
    """
    draw = np.random.default_rng(seed)
    centres = rows[draw.integers(len(rows))][None]
    for _ in range(min(clusters, len(rows)) - 1):
        gap = np.maximum(1 - (rows @ centres.T).max(axis=1), 0).astype(float)
        if gap.sum() < 1e-6:
            break
        centres = np.vstack([centres, rows[draw.choice(len(rows), p=gap / gap.sum())]])
    for _ in range(rounds):
        nearest = (rows @ centres.T).argmax(axis=1)
        sums = np.stack([rows[nearest == k].sum(axis=0) for k in range(len(centres))])
        norms = np.linalg.norm(sums, axis=1)
        centres = sums[norms > 0] / norms[norms > 0][:, None]
    members = np.bincount((rows @ centres.T).argmax(axis=1), minlength=len(centres))
    return centres[(members >= least * len(rows)) | (members == members.max())]


def beginnings(text: str) -> list[str]:
    """The first 1, 4, 16, ... words, as long as that leaves something out."""
    ends = [m.end() for m in re.finditer(r"\S+", text)]
    return [text[: ends[4**k - 1]] for k in range(LENGTHS) if 4**k < len(ends)]


def length_limits(cosines: np.ndarray, lengths: np.ndarray, quantile: float, least: int = 20) -> np.ndarray:
    """A low quantile of the cosines of each length; lengths with fewer than ``least`` take that of the next shorter one."""
    limits = np.zeros(LENGTHS)
    for k in range(1, LENGTHS):
        own = cosines[lengths == k]
        limits[k] = np.quantile(own, quantile) if len(own) >= least else limits[k - 1]
    return limits


class Centroids:
    """A fitted model: column weights, unit centroids, their languages, and limits by language and length."""

    def __init__(self, idf: np.ndarray, languages: list[str], centres: np.ndarray, limits: np.ndarray):
        self.idf, self.languages, self.centres, self.limits = idf, languages, centres, limits

    def predict(self, texts: list[str | None], slack: float) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, cosines in 0 to 1, and whether each text is rejected."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        rows, lengths = vectors(texts, self.idf)
        cosines = rows @ self.centres.T
        nearest = cosines.argmax(axis=1)  # centroids stand in the order of names
        score = np.clip(cosines[np.arange(len(texts)), nearest].astype(float), 0, 1)
        empty = ~rows.any(axis=1)
        names = [UNKNOWN if e else self.languages[k] for e, k in zip(empty, nearest)]
        return names, np.where(empty, 0, score), empty | (score < slack * self.limits[nearest, lengths])


def cluster(texts: list[str], idf: np.ndarray, clusters: int, calibration: int, quantile: float) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and limits by length of one language's sampled texts."""
    found, lengths = vectors(texts, idf)
    lengths = lengths[found.any(axis=1)]
    found = found[found.any(axis=1)]
    if not len(found):
        return np.zeros((0, len(idf)), np.float32), np.zeros(LENGTHS)
    centres = spherical_kmeans(found, clusters)
    cosines = [(found @ centres.T).max(axis=1)]
    sizes = [lengths]
    for text in texts[:calibration]:
        for begin in range(0, len(cuts := beginnings(text)), 8):
            rows, n = vectors(cuts[begin : begin + 8], idf)
            cosines.append((rows @ centres.T).max(axis=1)[n > 0])
            sizes.append(n[n > 0])
    return centres, length_limits(np.concatenate(cosines), np.concatenate(sizes), quantile)


def fit(
    docs: DataFrame,
    learnable: Column,
    dims: int = 1 << 14,
    clusters: int = 3,
    sample: int = 1000,
    calibration: int = 250,
    quantile: float = 0.01,
    most_labels: int = 1000,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
) -> Centroids:
    """Fits on the rows of ``docs`` for which ``learnable`` holds; the model has a fixed size for each language."""
    spark = docs.sparkSession
    own = docs.where(learnable).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"))
    counts = own.select("text").mapInArrow(_frequencies(dims), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros(dims + 1)
    seen[counts["at"].to_numpy(dtype=int)] = counts["n"].to_numpy()
    idf = np.log((1 + seen[dims]) / (1 + seen[:dims])) + 1

    labelled = own.where("label is not null and text is not null and id is not null")
    sizes = labelled.groupBy("label").agg(F.approx_count_distinct("id").alias("n")).limit(most_labels + 1).collect()
    if len(sizes) > most_labels:
        raise ValueError(f"more than {most_labels} languages in {label_col}")
    # Hashes are even, so those under a label's bound hold its sample and little more, and no task gets all ids of a label.
    share = {r["label"]: (1.5 * sample + 100) / max(r["n"], 1) for r in sizes}
    bounds = [(label, int((1 << 63) * (2 * s - 1)) if s < 1 else (1 << 63) - 1) for label, s in share.items()]
    bounds = spark.createDataFrame(bounds, "label string, bound long")
    ordered = labelled.select("id", "label", F.xxhash64(F.col("id").cast("string")).alias("order")).join(F.broadcast(bounds), "label")
    ordered = ordered.where("order <= bound").select("id", "label", "order").distinct()
    nth = F.row_number().over(Window.partitionBy("label").orderBy("order", "id"))
    chosen = ordered.withColumn("nth", nth).where(F.col("nth") <= sample).select("id").distinct()
    # At most ``sample`` ids a language are sent to all tasks, so that the corpus itself isn't exchanged; repeated ids combine before the exchange.
    rows = labelled.join(F.broadcast(chosen), "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "text")).alias("row")).select("id", "row.label", "row.text")

    def clustered(group: pd.DataFrame) -> pd.DataFrame:
        centres, limits = cluster(group.sort_values("id")["text"].tolist(), idf, clusters, calibration, quantile)
        return pd.DataFrame({"label": group["label"].iloc[0], "centre": list(centres), "limits": [limits] * len(centres)})

    # clusters rows of dims numbers for each language reach the driver.
    model = rows.groupBy("label").applyInPandas(clustered, "label string, centre array<float>, limits array<double>").toPandas()
    model = model.sort_values("label", kind="stable")
    centres = np.stack(model["centre"].tolist()).astype(np.float32) if len(model) else np.zeros((0, dims), np.float32)
    limits = np.stack(model["limits"].tolist()).astype(float) if len(model) else np.zeros((0, LENGTHS))
    return Centroids(idf, model["label"].tolist(), centres, limits)


def _predicting(handle, slack: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = handle.value
        for whole in pieces(batches, 1, 1 << 20):
            for begin in range(0, whole.num_rows, 128):
                batch = whole.slice(begin, 128)
                names, score, rejected = model.predict(batch.column(1).to_pylist(), slack)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(names), pa.array(score), pa.array(rejected), *batch.columns[2:]],
                    names=["id", "lang_pred", "score", "rejected", *batch.schema.names[2:]],
                )

    return run


def identify(docs: DataFrame, model: Centroids, slack: float = 0.8, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col, lang_pred, score, rejected`` and the columns ``keep`` for each row; one narrow pass over whole texts."""
    handle = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]
    more, fields = kept_columns(docs, keep)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *more)
    found = slim.mapInArrow(_predicting(handle, slack), f"id {kind}, lang_pred string, score double, rejected boolean{fields}")
    own = [] if id_col in keep else [F.col("id").alias(id_col)]
    return found.select(*own, "lang_pred", "score", "rejected", *named_back(keep))


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Rows kept apart from learning: the checksum of the id as text gives remainder ``part``."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))
