"""Operators that SQL can't express against the same arithmetic in plain Python, a document and a number at a time."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from ledgerloom.llm.language import DIM, fit_languages, letters, predict_languages
from ledgerloom.llm.mixing import EPS, mix_sources
from ledgerloom.llm.toxicity import BITS, WORD, fit_toxicity, score_toxicity
from ledgerloom.llm.weak_labels import weak_quality

LANGS = {"en": "the of and to in was for that with his", "de": "der die und das nicht mit von ist auf für", "fr": "le la et les des est dans pour que où"}


def prose(rng, lang, n):
    return " ".join(rng.choice(LANGS[lang].split()) if rng.random() < 0.6 else "".join(rng.choice("aeinorstéü") for _ in range(rng.randrange(3, 9))) for _ in range(n))


def votes_of(text):
    """The seven labellers, one count after another."""
    t = text or ""
    words = max(1, len(re.findall(r"[^\x20\x09-\x0D]+", t)))
    real, upper = len(regex.findall(r"\p{L}", t)), len(regex.findall(r"\p{Lu}", t))
    lines = [x for x in t.split("\n") if x]
    kept = max(1, real)
    repeat, stops = 1 - len(set(lines)) / max(1, len(lines)), len(re.findall(r"[.](?=[\x20\x09-\x0D]|\Z)", t)) / words
    signs, shouts, mean = sum(t.count(c) for c in "#*$%&|<>") / words, sum(t.count(c) for c in "!?") / words, max(1, len(t)) / words
    vote = lambda good, bad: -1 if bad else 1 if good else 0
    return (
        vote(words >= 40, words < 15), vote(signs == 0, signs > 0.1), vote(upper / kept < 0.1, upper / kept > 0.3), vote(4 < mean < 9, mean > 14 or mean < 3),
        vote(repeat == 0 and len(lines) > 1, repeat > 0.3), vote(0.02 < stops < 0.3, stops < 0.005), vote(shouts < 0.02, shouts > 0.2),
    )


def posteriors(rows):
    """Expectation-maximisation over documents, without patterns or arrays."""
    post = [1 / (1 + math.exp(-sum(v))) for v in rows]
    for _ in range(100):
        prior = min(0.999, max(0.001, sum(post) / len(rows)))
        chance = []
        for c in (0, 1):
            own = []
            for i in range(7):
                n = {v: 0.5 for v in (-1, 0, 1)}
                for v, p in zip(rows, post, strict=True):
                    n[v[i]] += p if c else 1 - p
                own.append({v: x / sum(n.values()) for v, x in n.items()})
            chance.append(own)
        new = []
        for v in rows:
            bad, good = (math.log(x) + sum(math.log(t[i][v[i]]) for i in range(7)) for x, t in zip((1 - prior, prior), chance, strict=True))
            new.append(1 / (1 + math.exp(min(50, max(-50, bad - good)))))
        done = max(abs(a - b) for a, b in zip(new, post, strict=True)) < 1e-9
        if done:
            break
        post = new
    return post


def weak_rows(rng, good, bad):
    texts = ["\n".join(prose(rng, "en", 30) + "." for _ in range(2)) for _ in range(good)] + [" ".join(rng.choice(["BUY!", "#NOW", "$$$", "x"]) for _ in range(rng.randrange(3, 30))) for _ in range(bad)]
    return [(i, t) for i, t in enumerate([*texts, None, "", texts[0], "Ünïcode ÄÖÜ. " * 20])]


@pytest.mark.parametrize("good, bad", [(40, 25), (30, 0)])
def test_weak_labels_are_the_plain_posterior(spark, good, bad):
    rows = weak_rows(random.Random(good), good, bad)
    want = dict(zip((i for i, _ in rows), posteriors([votes_of(t) for _, t in rows]), strict=True))
    got = weak_quality(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows) and max(abs(r.label_prob - want[r.doc_id]) for r in got) < 1e-6


def test_weak_labels_of_one_side_only(spark):
    rows = [(i, prose(random.Random(i), "en", 60) + ".") for i in range(20)]
    got = weak_quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 20 and len({r.kept for r in got}) == 1 and all(0 <= r.score <= 1 for r in got)


def grams(text):
    out = Counter()
    for n in (2, 3):
        for i in range(len(text) - n + 1):
            h = n
            for b in text[i : i + n]:
                h = (h ^ b) * 16_777_619 % 2**32
            out[(h ^ h >> 15) % DIM] += 1
    return out


def test_languages_are_the_nearest_centroid(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, lang, 40), lang) for i, lang in enumerate(["en", "de", "fr"] * 20)]
    model = fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = [(100 + i, prose(rng, rng.choice(list(LANGS)), rng.choice([1, 5, 50]))) for i in range(30)] + [(200, None), (201, "12 ... 7"), (202, "東京 タワー"), (None, prose(rng, "de", 9)), (203, prose(rng, "fr", 20_000))]
    got = {r.doc_id: r for r in predict_languages(spark.createDataFrame(asked, "doc_id long, text string").repartition(3), model).collect()}
    for i, text in asked:
        own = letters(text)
        if not own:
            assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
            continue
        v = {k: math.log1p(n) * float(model["idf"][k]) for k, n in grams(own).items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        near = [sum(x * float(c[k]) for k, x in v.items()) / length for c in model["centres"]]
        best = max(range(len(near)), key=lambda j: near[j])
        assert abs(got[i].score - max(0.0, min(1.0, near[best]))) < 1e-4
        if sorted(near)[-1] - max(x for x, n in zip(near, model["names"], strict=True) if n != model["names"][best]) > 1e-4:
            assert got[i].lang_pred == model["names"][best]
        if abs(near[best] - model["floor"][got[i].lang_pred]) > 1e-4:
            assert got[i].rejected == (near[best] < model["floor"][got[i].lang_pred])


def test_toxicity_is_the_linear_score(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, "en", 30) + (" vile scum filth" if i % 3 == 0 else "")) for i in range(120)]
    docs = spark.createDataFrame(rows + [(500, None), (501, ""), (None, "vile men"), (502, "Vile WOMEN " * 3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(100)], "doc_id long, toxic int")
    model = fit_toxicity(labels, docs)
    at = {f: k for k, f in enumerate(model["selected"])}
    for r in score_toxicity(docs, model).join(docs.withColumnRenamed("doc_id", "own"), F.expr("doc_id <=> own")).collect():
        seen = Counter()
        for w in WORD.findall((r.text or "").lower()):
            pieces = {f"={w}"} | {w[i : i + n] for n in (4, 5) for i in range(len(w) - n + 1)}
            seen.update(f for f in {zlib.crc32(p.encode()) >> (32 - BITS) for p in pieces} if f in at)
        z = sum(model["weights"][at[f]] * math.log1p(n) for f, n in seen.items()) + model["weights"][-1]
        score = 1 / (1 + math.exp(-max(-30, min(30, z))))
        assert abs(r.score - score) < 1e-9 and r.predicted == (score >= 0.7)


def flown(sizes, chances, rng):
    """The flight and the landing of one block with lists."""
    p, left, stuck = list(chances), [i for i, c in enumerate(chances) if EPS < c < 1 - EPS], []
    while len(left) > 2:
        first, rest = left[0], left[1:]
        n, s1, s2 = len(rest), sum(sizes[i] for i in rest), sum(sizes[i] ** 2 for i in rest)
        det = n * s2 - s1 * s1
        if det > 1e-9 * max(1.0, s1 * s1):
            slope = (s1 - n * sizes[first]) / det
            d = [-(1 + slope * s1) / n + slope * sizes[i] for i in rest]
        elif s1 > 0:
            d = [-sizes[first] / s1] * n
        elif sizes[first] > 0:
            stuck.append(first)
            left = rest
            continue
        else:
            d = [-1 / n] * n
        v = [1.0, *(0.0 if abs(x) < 1e-15 else x for x in d)]
        up = min((1 - p[i]) / x if x > 0 else -p[i] / x for i, x in zip(left, v, strict=True) if x)
        down = min(p[i] / x if x > 0 else (p[i] - 1) / x for i, x in zip(left, v, strict=True) if x)
        step = up if rng.random() * (up + down) < down else -down
        for i, x in zip(left, v, strict=True):
            q = p[i] + x * step
            p[i] = 0.0 if q < EPS else 1.0 if q > 1 - EPS else q
        left = [i for i in left if 0 < p[i] < 1]
    last = sorted([*stuck, *left])
    due = sum(p[i] * sizes[i] for i in last)
    for k, i in enumerate(last):
        rest = sum(sizes[j] for j in last[k:])
        p[i] = float(rng.random() < (min(1.0, max(0.0, due / rest)) if rest else p[i]))
        due -= p[i] * sizes[i]
    return p


def test_mixing_is_the_plain_flight(spark):
    """Sources of one block each: counts, targets, chances, the flight and the landing."""
    rng = random.Random(11)
    rows = [(i, "w " * rng.randrange(0, 50), ["a", "b", None][i % 3]) for i in range(150)] + [(7, "w w", "a"), (None, "w w w", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    # the order of a block hangs on a hash that only Spark has
    mark = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    size = F.when(F.col("text") == "", 0).otherwise(F.size(F.split(F.rtrim("text"), " "))).cast("long")
    turns = df.select("doc_id", "source", size.alias("size"), F.xxhash64(mark, size, F.lit(7)).alias("turn")).collect()
    total, own = sum(r["size"] for r in turns), {}
    for r in turns:
        own.setdefault(r.source, []).append(r)
    weight, free, target = {"a": 1, "b": 2, None: 3}, {"a", "b", None}, {}
    while True:
        f = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = [s for s in free if f * weight[s] > 3 * sum(r["size"] for r in own[s])]
        if not over:
            break
        target |= {s: 3 * sum(r["size"] for r in own[s]) for s in over}
        free -= set(over)
    target |= {s: f * weight[s] for s in free}
    want = Counter()
    for source, units in own.items():
        ratio = target[source] / sum(r["size"] for r in units)
        units = sorted(units, key=lambda r: (-r["size"], r.turn, math.inf if r.doc_id is None else r.doc_id))
        draw = np.random.default_rng([7, 0, *(b"null" if source is None else f"s{source}".encode())])
        chance = ratio - math.floor(ratio)
        p = flown([float(r["size"]) for r in units], [chance] * len(units), draw) if EPS < chance < 1 - EPS else [round(chance)] * len(units)
        want.update((r.doc_id, r["size"], math.floor(ratio) + round(x)) for r, x in zip(units, p, strict=True))
    got = Counter((r.doc_id, r["size"], r.copies) for r in mix_sources(df.repartition(4)).collect())
    assert got == want
