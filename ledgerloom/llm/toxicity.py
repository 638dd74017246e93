"""Toxicity by a counterfactual-regularised linear classifier.

Features are words and their 4- and 5-letter pieces, kept where their document frequency differs clearly
between the labels, and those of the identity terms. Besides the usual loss, training penalises any change of
score between a labelled text and its counterfactuals: identity terms that it holds are swapped for those of
other groups; and, since few texts hold any, a term is put into every text, against another of its group and
against none. So naming a group moves no score, also by letter pieces that its name shares with other words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import stage
from ledgerloom.llm.language import bounded_sample

WORD = re.compile(r"[^\W\d_]+")
BITS = 22
#: Identity terms that are swapped among each other, in the corpus's languages; a parameter.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("christians", "muslims", "jews", "hindus"), ("christian", "muslim", "jewish", "hindu"), ("gay", "straight"), ("black", "white", "asian"), ("immigrants", "natives"), ("old", "young"),
    ("frauen", "männer"), ("frau", "mann"), ("christen", "muslime", "juden", "hinduisten"), ("christlich", "muslimisch", "jüdisch", "hinduistisch"), ("schwul", "hetero"), ("schwarze", "weiße", "asiatische"), ("einwanderer", "einheimische"), ("alte", "junge"),
    ("femmes", "hommes"), ("femme", "homme"), ("chrétiens", "musulmans", "juifs", "hindous"), ("chrétien", "musulman", "juif", "hindou"), ("homosexuel", "hétérosexuel"), ("noirs", "blancs", "asiatiques"), ("immigrés", "autochtones"), ("vieux", "jeunes"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("cristianos", "musulmanes", "judíos", "hindúes"), ("cristiano", "musulmán", "judío", "hindú"), ("homosexual", "heterosexual"), ("negros", "blancos", "asiáticos"), ("inmigrantes", "nativos"), ("viejos", "jóvenes"),
)


def hashed(piece: str) -> int:
    return zlib.crc32(piece.encode("utf-8", "surrogatepass")) >> (32 - BITS)


def pieces(word: str) -> set[int]:
    return {hashed(p) for p in {f"={word}"} | {word[i : i + n] for n in (4, 5) for i in range(len(word) - n + 1)}}


def swapped(text: str, groups: tuple[tuple[str, ...], ...] = IDENTITY) -> str:
    """Each identity term replaced by the next of its group."""
    turn = {t: g[(i + 1) % len(g)] for g in groups for i, t in enumerate(g)}
    return re.sub("|".join(rf"\b{re.escape(t)}\b" for t in turn), lambda m: turn[m[0].lower()], text, flags=re.I)


class Featuriser:
    """Counts of selected features; what a word holds is remembered."""

    def __init__(self, selected: list[int]) -> None:
        self.index = {f: i for i, f in enumerate(selected)}
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> dict[int, int]:
        out: dict[int, int] = {}
        if len(self.known) > 300_000:
            self.known.clear()
        for w in WORD.findall((text or "").lower()):
            at = self.known.get(w)
            if at is None:
                at = self.known[w] = tuple(self.index[f] for f in pieces(w) if f in self.index)
            for i in at:
                out[i] = out.get(i, 0) + 1
        return out


def counterfactuals(text: str, own: dict[int, int], features: Featuriser, groups: tuple[tuple[str, ...], ...], turn: int) -> list[dict[int, float]]:
    """Changes of a text's features: its own terms swapped; a term put in against another of its group; and against none."""
    out = []
    if (other := swapped(text, groups)) != text:
        out.append((own, features(other)))
    g = groups[turn % len(groups)]
    k = turn // len(groups) % len(g)
    with_one, with_other = ({i: own.get(i, 0) + n for i, n in features(t).items()} for t in (g[k], g[(k + 1) % len(g)]))
    out += [({**own, **with_one}, {**own, **with_other}), ({**own, **with_one}, own)]
    return [{i: c for i in a.keys() | b.keys() if (c := float(np.log1p(a.get(i, 0)) - np.log1p(b.get(i, 0))))} for a, b in out]


def fit(x: np.ndarray, changes: np.ndarray, y: np.ndarray, swap: float = 5.0, ridge: float = 1e-3, rounds: int = 400) -> np.ndarray:
    """Weights and bias by Adam: weighted logistic loss + swap * w'Cw + ridge, with C (features, features) the mean outer product of counterfactual changes."""
    x = np.column_stack([x, np.ones(len(x), np.float32)]).astype(np.float32)
    c = np.zeros((x.shape[1], x.shape[1]))
    c[:-1, :-1] = 2 * swap * changes
    share = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w, m, v = (np.zeros(x.shape[1]) for _ in range(3))
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip((x @ w.astype(np.float32)).astype(float), -30, 30)))
        g = (share * (p - y)).astype(np.float32) @ x + ridge * np.append(w[:-1], 0) + c @ w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit_toxicity(labels: DataFrame, docs: DataFrame, per_label: int = 4000, most_features: int = 2000, groups: tuple[tuple[str, ...], ...] = IDENTITY, swap: float = 5.0) -> dict | None:
    """Train on labels (doc_id, toxic) and the whole texts of docs (doc_id, text): at most `per_label` documents of each label; None if one is missing.

    Rows with a null id, label or text teach nothing. A doc_id counts once: of several labels the larger, of several
    texts the smallest by code point. Ids are drawn among the labels, by a hash, before any text is touched; the drawn
    ones, 2 * per_label at most, are broadcast, and only their texts are gathered. Ties in the selection of features
    go by number. An empty table teaches nothing.
    """
    marked = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    drawn = bounded_sample(marked, "toxic", per_label, on=("doc_id",))
    texts = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = stage(texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "labelled")
    sizes = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(1 << BITS, np.int32) for _ in range(2)]
        known: dict[str, set[int]] = {}
        for b in batches:
            for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                own: set[int] = set()
                for w in set(WORD.findall(t.lower())):
                    if w not in known:
                        if len(known) > 100_000:
                            known.clear()
                        known[w] = pieces(w)
                    own |= known[w]
                seen[y][list(own)] += 1
        at = np.flatnonzero(seen[0] + seen[1] > 0)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[1][at].astype(np.int64)), pa.array(seen[0][at].astype(np.int64))], names=["f", "bad", "good"])

    bad, good = sizes[1], sizes[0]
    counts = sample.mapInArrow(tally, "f long, bad long, good long").groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).filter(F.col("bad") + F.col("good") >= 5)
    pooled = (F.col("bad") + F.col("good")) / (bad + good)
    z = (F.col("bad") / bad - F.col("good") / good) / F.sqrt(pooled * (1 - pooled) * (1 / bad + 1 / good) + 1e-9)
    chosen = {r["f"] for r in counts.withColumn("z", z).filter(F.abs("z") > 3).orderBy(F.desc(F.abs("z")), "f").limit(most_features).collect()}
    chosen |= {f for g in groups for t in g for f in pieces(t)}
    selected = sorted(chosen)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Featuriser(selected)
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            own = [features(t) for t in texts]
            changes = [counterfactuals(t, x, features, groups, zlib.crc32(str(i).encode())) for i, t, x in zip(ids, texts, own, strict=True)]
            lists = [pa.array([list(side(x)) for x in own], pa.list_(pa.int64())) for side in (dict.keys, dict.values)]
            lists += [pa.array([[list(side(c)) for c in cs] for cs in changes], pa.list_(pa.list_(kind))) for side, kind in ((dict.keys, pa.int64()), (dict.values, pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), *lists], names=["doc_id", "toxic", "i", "n", "ci", "cv"])

    got = sorted(sample.mapInArrow(rows, "doc_id long, toxic int, i array<long>, n array<long>, ci array<array<long>>, cv array<array<double>>").collect(), key=lambda r: r["doc_id"])
    x, gram, pairs = np.zeros((len(got), len(selected)), np.float32), np.zeros((len(selected), len(selected))), 0
    for k, r in enumerate(got):
        x[k, r["i"]] = np.log1p(r["n"])
        for i, c in zip(r["ci"], r["cv"], strict=True):
            gram[np.ix_(i, i)] += np.outer(c, c)
            pairs += 1
    y = np.array([r["toxic"] for r in got], float)
    return {"selected": selected, "weights": fit(x, gram / max(1, pairs), y, swap), "pairs": pairs, "changes": gram / max(1, pairs)}


def swap_gap(model: dict) -> float:
    """Root mean squared change of the raw score over the training counterfactuals."""
    w = model["weights"][:-1]
    return float(np.sqrt(max(0.0, w @ model["changes"] @ w)))


def score_toxicity(docs: DataFrame, model: dict | None, threshold: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1) and predicted of every row's whole text; null or empty text scores by the bias alone, and a missing model gives 0.

    A row per row, repeated ones (which score alike) and null ids included; an empty table gives none. Other columns,
    whatever their names, are left out.
    """

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Featuriser(model["selected"] if model else [])
        w = model["weights"] if model else np.array([-30.0])
        for b in batches:
            z = np.array([sum(w[i] * np.log1p(n) for i, n in features(t).items()) + w[-1] for t in b.column(1).to_pylist()], float)
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(predict, "doc_id long, score double, predicted int")
