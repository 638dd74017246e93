"""Language identification by the nearest of several clustered centroids per language.

Texts become normalised TF-IDF vectors of hashed letter n-grams; a language's sample is clustered by cosine
and the language of the nearest centroid is the prediction. A text far from all centroids is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import slices
from ledgerloom.llm.grams import gram_counts

DIM = 4096
NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> bytes:
    """Lower-cased letters, words apart by one space; empty if there is no letter."""
    kept = NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return f" {kept} ".encode("utf-8", "replace") if any(map(str.isalpha, kept)) else b""


def in_fold(doc_id: str, of: int, which: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder; false for null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % of == which, F.lit(False))


def drawn(seed: int = 3, on: tuple[str, ...] = ("doc_id", "text")) -> Column:
    """A number from 0 to 1 by a hash of the row."""
    return F.pmod(F.xxhash64(*on, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def bounded_sample(rows: DataFrame, key: str, most: int, seed: int = 3, sizes: dict | None = None, on: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """At most `most` rows of each key, chosen by a hash of the row; all, or nearly all, of a key with fewer.

    Rows that are alike are drawn alike; the rank after the draw holds the bound for them, too. One count per key,
    unless given, comes to the driver.
    """
    if sizes is None:
        sizes = {r[0]: r[1] for r in rows.groupBy(key).count().collect()}
    share = F.lit(0.0)
    for k, n in sizes.items():
        share = F.when(F.col(key) == F.lit(k), F.lit(1.1 * most / n)).otherwise(share)
    turn = F.row_number().over(Window.partitionBy(key).orderBy(drawn(seed, on), *on))
    return rows.filter(drawn(seed, on) < share).withColumn("_turn", turn).filter(F.col("_turn") <= most).drop("_turn")


def vectors(texts: list[bytes], idf: np.ndarray | None = None) -> np.ndarray:
    v = np.log1p(gram_counts(texts, DIM).astype(np.float32))
    if idf is not None:
        v *= idf
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    return v


def cluster(v: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Spherical k-means."""
    centres = v[rng.choice(len(v), min(k, len(v)), replace=False)]
    for _ in range(rounds):
        own = (v @ centres.T).argmax(1)
        centres = np.array([v[own == j].sum(0) if (own == j).any() else centres[j] for j in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return centres


def fit_languages(labelled: DataFrame, per_language: int = 400, clusters: int = 4, seed: int = 5) -> dict | None:
    """Centroids from (doc_id, text, lang): a sample of at most `per_language` texts of each language, whole; None without any.

    Rows without a text or a language don't count, nor texts without letters; a null doc_id is as good as any.
    Repeated rows count as often as they are drawn; ties among centroids go to the language that sorts first.
    What comes to the driver is that sample, thus one row of the count, and `clusters` centroids, per language label.
    """
    sample = bounded_sample(labelled.filter("lang is not null and text is not null").select("doc_id", "text", "lang"), "lang", per_language)
    rows = sorted((r["lang"], r["doc_id"] is None, r["doc_id"] or 0, t) for r in sample.collect() if (t := letters(r["text"])))
    rows = [(r[0], r[2], r[3]) for r in rows]
    if not rows:
        return None
    v = np.concatenate([vectors([r[2] for r in rows[lo:hi]]) for lo, hi in slices([len(r[2]) for r in rows], 1_000_000)])
    idf = (np.log((1 + len(v)) / (1 + (v > 0).sum(0))) + 1).astype(np.float32)
    v *= idf
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    langs, rng = np.array([r[0] for r in rows]), np.random.default_rng(seed)
    centres, names, floor = [], [], {}
    for lang in sorted(set(langs)):
        own = v[langs == lang]
        c = cluster(own, clusters, rng)
        centres.append(c)
        names += [lang] * len(c)
        floor[lang] = float(np.quantile((own @ c.T).max(1), 0.01)) / 2
    return {"idf": idf, "centres": np.concatenate(centres).astype(np.float32), "names": names, "floor": floor}


def predict_languages(docs: DataFrame, model: dict | None, reject_as: str | None = None) -> DataFrame:
    """docs' doc_id with lang_pred, score (cosine to the nearest centroid, 0 to 1) and rejected (farther than any of its own).

    Null text, text without letters and a missing model give `und`, score 0 and rejected. A rejected text
    keeps its nearest language unless `reject_as` names another label. Whole texts are read, nothing else: other
    columns, whatever their names, are left out. A row per row, repeated ones and null ids included; none of an empty table.
    """

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [letters(t) for t in b.column(1).to_pylist()]
            langs, scores, far = [], [], []
            for lo, hi in slices([len(t) + 4000 for t in texts], 1_000_000):
                near = vectors(texts[lo:hi], model["idf"]) @ model["centres"].T if model else np.zeros((hi - lo, 1))
                for t, j, s in zip(texts[lo:hi], near.argmax(1).tolist(), near.max(1).tolist(), strict=True):
                    lang = model["names"][j] if model and t else "und"
                    out = lang == "und" or s < model["floor"][lang]
                    langs.append(reject_as if out and reject_as else lang)
                    scores.append(min(1.0, max(0.0, s)) if t else 0.0)
                    far.append(out)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(far, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double, rejected boolean")
