"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation over
the distinct vote patterns, with their counts over all documents, estimates each labeller's accuracy and
the posterior of every pattern; posteriors label a sample that trains a hashed linear scorer, which scores
every document by its text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import slices, texts_of, word_pattern
from ledgerloom.llm.grams import gram_counts
from ledgerloom.llm.language import bounded_sample, drawn

DIM = 2048


#: What is counted in a text, as the pattern of all other characters.
COUNTED = {"letters": "[^\\p{L}]+", "uppers": "[^\\p{Lu}]+", "signs": "[^#*$%&|<>]+", "shouts": "[^!?]+"}


def measures(text: Column) -> dict[str, Column]:
    """Counts of a text. Characters are counted by deleting runs of all others, which makes no list of matches."""
    lines = F.filter(F.split(text, "\n"), lambda s: s != "")
    return {
        **{name: F.length(F.regexp_replace(text, rest, "")) for name, rest in COUNTED.items()},
        "chars": F.greatest(F.length(text), F.lit(1)),
        "words": F.greatest(F.regexp_count(text, F.lit(word_pattern)), F.lit(1)),
        "stops": F.regexp_count(text, F.lit("[.](?=[\\x20\\x09-\\x0D]|$)")),
        "lines": F.size(lines),
        "line_kinds": F.size(F.array_distinct(lines)),
    }


def labellers() -> dict[str, Column]:
    """Votes 1 (good), -1 (bad) or 0 from a text's measures, each a column."""
    m = F.col
    vote = lambda good, bad: F.when(bad, -1).when(good, 1).otherwise(0)
    words, letters = m("words"), F.greatest(m("letters"), F.lit(1))
    signs, upper, mean = m("signs") / words, m("uppers") / letters, m("chars") / words
    repeat, stops, shouts = 1 - m("line_kinds") / F.greatest(m("lines"), F.lit(1)), m("stops") / words, m("shouts") / words
    return {
        "length": vote(words >= 40, words < 15),
        "signs": vote(signs == 0, signs > 0.1),
        "upper": vote(upper < 0.1, upper > 0.3),
        "word_size": vote((mean > 4) & (mean < 9), (mean > 14) | (mean < 3)),
        "repeats": vote((repeat == 0) & (m("lines") > 1), repeat > 0.3),
        "sentences": vote((stops > 0.02) & (stops < 0.3), stops < 0.005),
        "shouts": vote(shouts < 0.02, shouts > 0.2),
    }


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, dict]:
    """EM over vote patterns (rows, labellers): P(good) of each pattern, and the estimated tables and accuracies.

    Labellers are taken as independent given the class, each with its own chance of every vote under
    either class, smoothed; starts from a majority vote.
    """
    hot = np.stack([patterns == v for v in (-1, 0, 1)], -1).astype(float)
    post = 1 / (1 + np.exp(-patterns.sum(1).astype(float)))
    prior, tables = 0.5, None
    for _ in range(rounds):
        weigh = np.stack([1 - post, post]) * counts
        prior = min(0.999, max(0.001, weigh[1].sum() / counts.sum()))
        tables = np.einsum("cp,plv->clv", weigh, hot) + 0.5
        tables /= tables.sum(-1, keepdims=True)
        like = np.log([1 - prior, prior])[:, None] + np.einsum("plv,clv->cp", hot, np.log(tables))
        new = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    right = (1 - prior) * tables[0, :, 0] + prior * tables[1, :, 2]
    said = right + (1 - prior) * tables[0, :, 2] + prior * tables[1, :, 0]
    return post, {"prior": prior, "tables": tables, "accuracy": right / np.maximum(said, 1e-9)}


def features(texts: list[bytes]) -> np.ndarray:
    """Hashed byte n-gram shares and length, on a damped scale."""
    n = gram_counts(texts, DIM, (1, 2)).astype(np.float32)
    size = np.maximum(n.sum(1, keepdims=True), 1)
    return np.column_stack([np.sqrt(n / size), np.log1p(size) / 10, np.ones(len(texts), np.float32)])


def fit_linear(x: np.ndarray, soft: np.ndarray, ridge: float = 1e-4, rounds: int = 300) -> np.ndarray:
    x = x.astype(np.float64)  # once, not in every product
    w, m, v = (np.zeros(x.shape[1]) for _ in range(3))
    for t in range(1, rounds + 1):
        g = x.T @ (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - soft) / len(x) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def weak_quality(docs: DataFrame, per_side: int = 3000, threshold: float = 0.5) -> DataFrame:
    """A row per document: doc_id, label_prob (posterior of its votes), score (0 to 1, of the trained scorer) and kept (score >= threshold).

    Null text counts as empty, null ids are kept; repeated rows score alike, and are drawn for training as often as
    they come, within the bound; an empty table gives no rows; only doc_id and text are read, other columns, whatever
    their names, are left out. At most 3 ** labellers vote patterns with their counts come to the driver, and at most
    `per_side` whole texts of either side of the posterior train the scorer.
    """
    named = labellers()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    code = sum(((v + 1) * 3**i for i, v in enumerate(named.values())), F.lit(0)).cast("int")

    def voted(part: DataFrame) -> DataFrame:
        # columns of their own, since a struct of them is taken apart and each count repeated wherever it is used
        return part.select("*", *(c.alias(name) for name, c in measures(F.coalesce(F.col("text"), F.lit(""))).items())).select("doc_id", "text", code.alias("votes"))

    votes = voted(rows)
    seen = sorted(votes.groupBy("votes").count().collect())
    table = {c: [c // 3**i % 3 - 1 for i in range(len(named))] for c, _ in seen}
    post = dict(zip(table, fit_votes(np.array(list(table.values())), np.array([n for _, n in seen], float))[0].tolist(), strict=True)) if seen else {}
    model = None
    if seen:
        sides = {0: 0, 1: 0}
        for c, n in seen:
            sides[int(post[c] >= 0.5)] += n
        sides = {side: n for side, n in sides.items() if n}
        good = F.col("votes").isin([c for c, p in post.items() if p >= 0.5])
        # rows that neither side can draw are left out before their votes are counted
        near = voted(rows.filter(drawn() < 1.1 * max(per_side / n for n in sides.values())))
        sample = bounded_sample(near.withColumn("side", good.cast("int")), "side", per_side, sizes=sides).select("doc_id", "votes", "text").collect()
        sample = sorted(sample, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["votes"]))
        if sample:
            texts = [(r["text"] or "").encode() for r in sample]
            x = np.concatenate([features(texts[lo:hi]) for lo, hi in slices([len(t) + 2000 for t in texts], 1_000_000)])
            model = fit_linear(x, np.array([post[r["votes"]] for r in sample]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = texts_of(b.column(1)), []
            for lo, hi in slices([len(t) + 2000 for t in texts], 1_000_000):
                out += (1 / (1 + np.exp(-np.clip(features(texts[lo:hi]) @ model, -30, 30)))).tolist()
            given = [post[c] for c in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(given, pa.float64()), pa.array(out, pa.float64()), pa.array([s >= threshold for s in out], pa.bool_())], names=["doc_id", "label_prob", "score", "kept"])

    return votes.select("doc_id", "text", "votes").mapInArrow(score, "doc_id long, label_prob double, score double, kept boolean")
