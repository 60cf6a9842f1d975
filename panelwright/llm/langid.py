"""Language identification by nearest centroid.

A text is a vector of hashed byte n-grams (two and three bytes of the lower-cased text, everything but
letters read as one space), weighted by 1 + log of its count times the inverse document
frequency over all training documents, scaled to length one.  Every language has several
centroids, found by spherical k-means; a text gets the language of the nearest centroid
by cosine.  It is rejected when it lies more than ``SLACK`` further from that centroid than nearly all
texts of the language's sample of about its length (by distinct n-grams, in powers of two) lie from centroids that were
fitted without them, or when it has no letter.  The sample's distinct vectors are dealt into two folds; each is measured
against centroids of the other, so a text that is repeated never vouches for its own copies.  A language with fewer than
``LEAST_TEXTS`` distinct vectors rejects only beyond ``WIDE``.

Document frequencies come from every training document.  Centroids are fitted on at most
``SAMPLE`` documents of each language, chosen by hashes of their ids.

Null text, or text without a letter, is not learnt from.  It is ``und`` with score 0 and rejected; without any training document
everything is.  A null doc_id is held out.  Rows that repeat are predicted once each; of texts that share a doc_id and a
language the sample holds the least; an empty table gives no rows; other columns, whatever their names, are carried or
ignored.  Equally near centroids: the first in order of language.  Texts of any length are read whole, a long one alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.storage import free_name, keep
from panelwright.llm.words import batches

UNKNOWN = "und"
DIMENSIONS = 4096
SAMPLE = 1000
CENTROIDS = 4
ROUNDS = 12
SLACK = 0.1
#: The radius is this quantile of the out-of-sample distances, over so many texts at least; with fewer it is ``WIDE``.
QUANTILE, LEAST_TEXTS, WIDE = 0.99, 20, 0.85
CLASSES = DIMENSIONS.bit_length()
TEXTS_AT_ONCE = 256

_LETTER = np.full(256, 0x20, np.uint32)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)
_SHIFT = np.uint32(32 - DIMENSIONS.bit_length() + 1)


def counts(texts: list[bytes]) -> np.ndarray:
    """Texts x dimensions counts of hashed n-grams."""
    data = _LETTER[np.frombuffer(b" ".join(texts) + b"   ", np.uint8)]
    sizes = np.array([len(t) + 1 for t in texts])
    row = np.repeat(np.arange(len(texts)) * DIMENSIONS, sizes)
    n = len(row)
    pair = data[:n] << np.uint32(8) | data[1 : n + 1]
    last = np.cumsum(sizes) - 1  # the joint itself starts no n-gram
    used = pair != 0x2020
    used[last] = False
    triple = (pair << np.uint32(8) | data[2 : n + 2]) + np.uint32(1 << 24)
    triple[last - 1] = pair[last - 1]  # do not look into the next text
    total = np.zeros(len(texts) * DIMENSIONS, np.int64)
    for code in (pair, triple):
        bucket = (code * np.uint32(0x9E3779B1)) >> _SHIFT
        total += np.bincount((row + bucket)[used], minlength=len(total))
    return total.reshape(len(texts), DIMENSIONS)


def vectors(texts: pd.Series) -> Iterator[np.ndarray]:
    """Counts for groups of lower-cased texts in their order."""
    for group in batches((t.lower() if t else t for t in texts), TEXTS_AT_ONCE):
        yield counts(group)


def weighted(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors; an empty text is all zero."""
    out = np.zeros(count.shape, np.float32)
    at = np.nonzero(count)
    out[at] = (1 + np.log(count[at])) * idf[at[1]]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def spherical_means(points: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids; starts are points at even ranks of closeness to the mean of all."""
    order = np.argsort(-(points @ points.mean(axis=0)), kind="stable")
    means = points[order[np.arange(min(k, len(points))) * len(points) // min(k, len(points))]]
    for _ in range(rounds):
        owner = np.argmax(points @ means.T, axis=1)
        sums = np.stack([points[owner == j].sum(axis=0) if (owner == j).any() else means[j] for j in range(len(means))])
        means = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return means


def length_class(points: np.ndarray) -> np.ndarray:
    """Floor of the binary logarithm of the number of distinct n-grams."""
    return np.log2(np.maximum((points > 0).sum(axis=1), 1)).astype(int)


def outer_cosines(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct points, and the cosine of each to the nearest of the centroids fitted on the other fold.

    Points are dealt in an order that hashes of their bytes give, so the folds do not depend on ids.
    """
    distinct = np.unique(points, axis=0)
    distinct = distinct[np.argsort([zlib.crc32(p.tobytes()) for p in distinct], kind="stable")]
    cosine = np.zeros(len(distinct))
    for fold in range(2 if len(distinct) > 1 else 0):
        cosine[fold::2] = (distinct[fold::2] @ spherical_means(distinct[1 - fold :: 2], CENTROIDS).T).max(axis=1)
    return distinct, cosine


def radii_of(points: np.ndarray) -> list[float]:
    """Distance from which a text of each length class is rejected; always below 1.

    A class with few texts borrows from the classes nearest to it.  Below the shortest text seen, the cosine falls with the
    root of the number of n-grams.
    """
    distinct, cosine = outer_cosines(points)
    if len(distinct) < LEAST_TEXTS:
        return [WIDE] * CLASSES
    own = length_class(distinct)
    out = []
    for c in range(CLASSES):
        at = max(c, own.min())
        apart = np.abs(own - at)
        width = np.sort(apart)[LEAST_TEXTS - 1]
        least = float(np.quantile(cosine[apart <= width], 1 - QUANTILE)) * 2 ** ((c - at) / 2)
        out.append(min(1 - max(least - SLACK, least / 2), 1 - 1e-6))
    return out


@dataclass
class Model:
    """Inverse document frequencies, and unit centroids with their languages and, by length class, radii."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    radii: np.ndarray


def held_out(folds: int = 3) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == 1, F.lit(True))


def fit(training: DataFrame) -> Model:
    """Learn from rows of doc_id, text and lang; rows with null lang, or without a letter, are left out."""
    training = training.select("doc_id", "text", "lang").where(F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull())

    def frequencies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(DIMENSIONS + 1, np.int64)
        for frame in frames:
            for count in vectors(frame["text"]):
                total[:-1] += (count > 0).sum(axis=0)
                total[-1] += len(count)
        yield pd.DataFrame({"bucket": np.arange(DIMENSIONS + 1), "n": total})

    # one row per bucket, whatever the number of documents
    found = dict(training.select("text").mapInPandas(frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect())
    n = np.array([found.get(i, 0) for i in range(DIMENSIONS + 1)], float)
    idf = (np.log((1 + n[-1]) / (1 + n[:-1])) + 1).astype(np.float32)

    # a share of each language by hash, about three times the sample, before any rows meet in one task
    sizes = keep(training.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    share = training.select("doc_id", "lang").join(sizes, "lang").where(place * F.col("n") < 3 * SAMPLE)
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id")
    sample = share.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= SAMPLE)
    # SAMPLE ids a language; Spark broadcasts the table by its measured size
    sample = keep(sample.select("doc_id", F.col("lang").alias("sample_lang")).distinct())

    def place_points(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            start = 0
            for count in vectors(frame["text"]):
                points = weighted(count, idf)
                part = frame.iloc[start : start + len(count)]
                start += len(count)
                yield pd.DataFrame({"lang": part["lang"].to_numpy(), "doc_id": part["doc_id"].to_numpy(), "point": [p.tobytes() for p in points]})

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "point"])
        points = np.stack([np.frombuffer(p, np.float32) for p in rows["point"]])
        means = spherical_means(points, CENTROIDS)
        radii = radii_of(points)
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "centroid": [m.astype(np.float32).tobytes() for m in means], "radii": [radii] * len(means)})

    points = training.join(sample, (training["doc_id"] == sample["doc_id"]) & (training["lang"] == sample["sample_lang"]), "left_semi")
    points = points.groupBy("lang", "doc_id").agg(F.min("text").alias("text"))  # a doc_id that repeats is one text of the sample
    model = points.mapInPandas(place_points, "lang string, doc_id long, point binary").groupBy("lang").applyInPandas(cluster, "lang string, centroid binary, radii array<double>")
    rows = sorted(model.collect(), key=lambda r: (r.lang, r.centroid))  # CENTROIDS rows a language
    centroids = np.stack([np.frombuffer(r.centroid, np.float32) for r in rows]) if rows else np.zeros((0, DIMENSIONS), np.float32)
    return Model(idf, centroids, [r.lang for r in rows], np.array([r.radii for r in rows]))


def predict(docs: DataFrame, model: Model, out: str = "found") -> DataFrame:
    """``docs`` with a struct ``out`` of lang_pred, score (cosine to the nearest centroid) and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def nearest(text: pd.Series) -> pd.DataFrame:
        m = shared.value
        langs, scores, rejected = [], [], []
        if len(m.langs):
            for count in vectors(text):
                points = weighted(count, m.idf)
                near = points @ m.centroids.T
                best = np.argmax(near, axis=1)
                score = np.clip(near[np.arange(len(near)), best].astype(float), 0, 1)
                langs += [m.langs[b] for b in best]
                scores += score.tolist()
                rejected += (1 - score > m.radii[best, length_class(points)]).tolist()
        else:
            langs, scores, rejected = [UNKNOWN] * len(text), [0.0] * len(text), [True] * len(text)
        for i, t in enumerate(text):
            if not t or not any(map(str.isalpha, t)):
                langs[i], scores[i], rejected[i] = UNKNOWN, 0.0, True
        return pd.DataFrame({"lang_pred": langs, "score": scores, "rejected": rejected})

    return docs.withColumn(out, nearest(F.col("text").cast("string")))


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the documents that are not held out, predict all: doc_id, held_out, lang_pred, score, rejected."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "found.*")


def accepted_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    model = fit(docs.where(~held_out()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")))
    out = free_name(docs)
    return predict(docs, model, out).where(~F.col(f"{out}.rejected")).drop(out)
