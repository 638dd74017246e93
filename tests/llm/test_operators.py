"""Each operator against a plain model, with nulls, blanks, repeated rows, clashing columns and empty tables."""

import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm.common import shared_dir
from ledgerloom.llm.encoding import Encoder
from ledgerloom.llm.exact import exact_dedup
from ledgerloom.llm.exchange import rice_decode, rice_encode
from ledgerloom.llm.language import fit_languages, in_fold, predict_languages
from ledgerloom.llm.mixing import fly, mix_sources
from ledgerloom.llm.packing import hilbert_key, pack_on_curve
from ledgerloom.llm.quality import quality_rules
from ledgerloom.llm.repeats import remove_repeats
from ledgerloom.llm.shingles import shingle_groups, shingles
from ledgerloom.llm.simhash import fingerprint, links, simhash_groups
from ledgerloom.llm.token_files import read_token_files, write_token_files
from ledgerloom.llm.toxicity import fit, fit_toxicity, score_toxicity, swap_gap, swapped
from ledgerloom.llm.weak_labels import fit_votes, weak_quality

SCHEMA = "doc_id long, text string, lang string, source string, words string, row long, key string, sha string, size long, kept string, n long"
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def corpus():
    rng = random.Random(3)
    words = ["the", "of", "and"] * 4 + ["".join(rng.choice("abcdeou") for _ in range(rng.randrange(3, 9))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = [text(rng.randrange(1, 200)) for _ in range(40)]
    shared = text(60)
    out += [f"{text(20)} {shared} {text(20)}", f"{text(5)}\n{shared}", out[0], out[0].replace(" ", "\n"), out[1].upper(), "a " * 120, text(8000), None, "", " \n\t", "# $ %", "één ça naïve 東京 😀"]
    rows = [(i, t, ["en", "fr", None][i % 3], ["s", "t", None, ""][i % 4]) for i, t in enumerate(out)]
    return [*rows, rows[2], (None, out[3], None, "s"), (None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *[None] * 7) for r in corpus()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_every_operator_takes_an_empty_table(spark, empty):
    folder = shared_dir(spark, "t")
    write_token_files(empty, folder, WORD)
    for out in (read_token_files(spark, folder), quality_rules(empty), simhash_groups(empty), weak_quality(empty), exact_dedup(empty), predict_languages(empty, fit_languages(empty)), remove_repeats(empty), mix_sources(empty), pack_on_curve(empty, BYTE), score_toxicity(empty, None)):
        assert out.count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t\r\x0b\x0c\x1c\x85\xa0\u2003\u3000aAbéÉ×÷'sß.,109𝒳<|>ÀÿĀ")), st.characters(codec="utf-8"))), max_size=5))
def test_parts_encode_like_the_whole(texts):
    for path in (WORD, BYTE):
        ids, n = ENCODERS[path].encode_column(pa.array(texts, pa.string()), 7)
        want = [[*PLAIN[path].encode(t, add_special_tokens=False).ids, 7] for t in texts]
        assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]


ENCODERS, PLAIN = {p: Encoder(p) for p in (WORD, BYTE)}, {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}


def test_token_files(spark, docs):
    folder = shared_dir(spark, "t")
    write_token_files(docs, folder, WORD)
    got = sorted(map(tuple, read_token_files(spark, folder).collect()), key=lambda r: r[1])
    want = sorted(((r[0], [*PLAIN[WORD].encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in corpus()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == np.cumsum([0, *(g[2] for g in got)])[:-1].tolist()
    assert Counter((g[0], g[2], g[3]) for g in got) == Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want)


def test_quality_counts(docs):
    got = Counter((r.doc_id, r.n_words, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules(docs).collect())
    want = Counter()
    for i, t, *_ in corpus():
        w = (t or "").encode().split()
        n = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        cover = {k + j for k in range(len(w) - 2) if n[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        want[(i, len(w), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w))] += 1
    assert got == want


def bits(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    n = [sum(xxhash.xxh64_intdigest(x, 42) >> b & 1 for x in s) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * n[b] > len(s))


def test_fingerprint():
    assert all(fingerprint((t or "").encode()) == bits(t) for _, t, *_ in corpus())


def test_simhash_links_lose_nothing():
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    prints = np.unique(np.concatenate([c ^ np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(60)], np.uint64) for c in centres]))
    from ledgerloom.llm.simhash import BITS, variants

    keys = variants(prints, 4).ravel()
    order = np.argsort(keys, kind="stable")
    a, b = links(keys[order], np.repeat(prints, BITS)[order], 4)
    assert (np.bitwise_count(a ^ b) <= 4).all()

    def groups(pairs):
        own = {int(p): int(p) for p in prints}

        def find(x):
            while own[x] != x:
                x = own[x]
            return x

        for x, y in pairs:
            x, y = sorted((find(int(x)), find(int(y))))
            own[y] = x
        return {p: find(p) for p in own}

    near = [(x, y) for i, x in enumerate(prints) for y in prints[i + 1 :][np.bitwise_count(prints[i + 1 :] ^ x) <= 4]]
    assert groups(zip(a, b, strict=True)) == groups(near)


def test_simhash_components(docs):
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash_groups(docs).collect())
    rows = [(i, bits(t)) for i, t, *_ in corpus()]
    own = {b: b for _, b in rows}

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    for x in list(own):
        for y in list(own):
            if (x ^ y).bit_count() <= 4:
                p, q = sorted((find(x), find(y)))
                own[q] = p
    low = {}
    for i, b in rows:
        if i is not None:
            low[find(b)] = min(low.get(find(b), i), i)
    assert got == Counter((i, f"{b:016x}", low.get(find(b))) for i, b in rows)


def test_exact(docs):
    out = exact_dedup(docs).collect()
    groups = {}
    for i, t, *_ in corpus():
        groups.setdefault(b"".join((t or "").encode().split()), []).append((-len(t or ""), i is None, i or 0))
    for r in out:
        own = next(g for k, g in groups.items() if hashlib.sha256(k).hexdigest() == r.text_sha256)
        assert (r.group_size, r.keep_id) == (len(own), min(own)[2] if not min(own)[1] else None)
    assert len(out) == len(corpus()) and sum(r.kept for r in out) == len(groups)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1), min_size=1, max_size=300, unique=True))
def test_rice_codes(values):
    v = np.array(sorted(values), np.uint64)
    assert rice_decode(rice_encode(v)).tolist() == v.tolist()


def test_repeats(docs):
    rows = [(i, (t or "").encode().split()) for i, t, *_ in corpus()]
    n = Counter(tuple(w[k : k + 35]) for _, w in rows for k in range(len(w) - 34))
    want = Counter()
    for i, w in rows:
        gone = {k + j for k in range(len(w) - 34) if n[tuple(w[k : k + 35])] > 1 for j in range(35)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want[(i, len(w), len(gone), hashlib.sha256(kept).hexdigest())] += 1
    assert Counter(map(tuple, remove_repeats(docs).collect())) == want


def test_repeats_with_runs_and_small_alphabets(spark):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        core = [rng.choice("xy") for _ in range(rng.randrange(20, 90))]
        rows += [(2 * i, " ".join([rng.choice("xyz") for _ in range(rng.randrange(9))] + core)), (2 * i + 1, " ".join(core + [rng.choice("xyz") for _ in range(rng.randrange(9))]))]
    n = Counter(tuple(w[k : k + 35]) for _, t in rows for w in [t.split()] for k in range(len(w) - 34))
    want = {i: len({k + j for w in [t.split()] for k in range(len(w) - 34) if n[tuple(w[k : k + 35])] > 1 for j in range(35)}) for i, t in rows}
    assert {r.doc_id: r.n_removed for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_mixing(docs):
    out = mix_sources(docs).collect()
    again = mix_sources(docs.repartition(5)).collect()
    ids = lambda rows: Counter((r.doc_id, r.source, r.taken) for r in rows)
    assert ids(out) == ids(again) and len(out) == len(corpus())
    sizes = {}
    for _, t, _, s in corpus():
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, target, free = {s: k % 3 + 1 for k, s in enumerate(names)}, {}, set(names)
    while True:
        f = (sum(sizes.values()) - sum(target.values())) / sum(weight[s] for s in free)
        over = [s for s in free if f * weight[s] > 3 * sizes[s]]
        if not over:
            break
        target |= {s: 3 * sizes[s] for s in over}
        free -= set(over)
    target |= {s: f * weight[s] for s in free}
    assert all(abs(r.target - target[r.source]) < 1e-6 and r.source_size == sizes[r.source] and r.taken <= 3 * r["size"] for r in out)


def test_mixing_draws_alike_in_any_layout(spark):
    """Ids that repeat or are null, and rows that repeat, with more rows than a block holds."""
    rng = random.Random(8)
    rows = [(rng.choice([None, i, i, 3]), "w " * rng.randrange(1, 40) + str(i % 200), rng.choice(["a", "b", None])) for i in range(1500)]
    df = spark.createDataFrame(rows + rows[:100], "doc_id long, text string, source string")
    drawn = [Counter((r.doc_id, r.source, r["size"], r.copies) for r in mix_sources(df.repartition(k)).collect()) for k in (3, 5)]
    assert drawn[0] == drawn[1] and sum(drawn[0].values()) == 1600


def test_quality_takes_any_column_names(spark):
    df = spark.createDataFrame([(1, "a b " * 40, "en", 1, 2, 3)], "doc_id long, text string, lang string, `a``b` int, `c.d` int, kept int")
    out = quality_rules(df)
    assert {"a`b", "c.d"} <= set(out.columns) and out.first()["a`b"] == 1
    carried = quality_rules(df.withColumn("row", F.struct("doc_id")), keep_text=False, carry=["a`b", "row", "c.d"]).first()
    assert (carried["a`b"], carried["c.d"], carried["row"].doc_id) == (1, 2, 1)


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    size = np.sort(rng.lognormal(5, 1, 400))[::-1]
    p = fly(size, np.full(400, 0.37), np.random.default_rng(2), True)
    assert set(p) <= {0.0, 1.0} and abs(p.sum() - 148) <= 3 and abs((p * size).sum() / (0.37 * size.sum()) - 1) < 0.005


def test_packing(docs):
    rows = pack_on_curve(docs, BYTE).collect()
    want = Counter((r[0], tuple([*PLAIN[BYTE].encode(r[1] or "", add_special_tokens=False).ids, 0])) for r in corpus())
    spans = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    own, docs_seen = [], Counter()
    for r in spans:
        own += np.frombuffer(r.ids, "<u2").tolist()
        if r.start + r.length == r.doc_tokens:
            docs_seen[(r.doc_id, tuple(own))] += 1
            own = []
    assert docs_seen == want
    fill = Counter()
    for r in spans:
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
    assert all(n == 1024 or n & (n - 1) == 0 for n in fill.values())


def test_hilbert_neighbours_touch():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    key = hilbert_key(grid, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_language(spark):
    rng = random.Random(5)
    make = {"en": "the and thing of with", "fr": "le des où très être", "de": "und nicht über die straße"}
    rows = [(i, " ".join(rng.choice(make[g].split()) for _ in range(30)), g) for i in range(120) for g in [list(make)[i % 3]]]
    model = fit_languages(spark.createDataFrame(rows[:90], "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in predict_languages(spark.createDataFrame([*rows[90:], (500, None, ""), (501, "12 !", ""), (502, "東京東京", "")], "doc_id long, text string, lang string"), model).collect()}
    assert all(got[i].lang_pred == g and 0 <= got[i].score <= 1 for i, _, g in rows[90:])
    assert got[500].lang_pred == got[501].lang_pred == "und" and got[502].rejected


def test_toxicity(spark):
    rng = random.Random(6)
    plain = ["mild", "rain", "falls", "over", "hills", "today", "again", "women", "men"]
    rows = [(i, " ".join(rng.choice(plain) for _ in range(25)) + (" utter vermin " if i % 3 == 0 else "") + (" women" if i % 3 == 0 else "")) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows] + [(None, 1), (5000, 0), (3, 0), (1, None)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(*r, "x") for r in rows] + [(None, "vermin", None), (4, None, None), rows[0] + (None,)], "doc_id long, text string, toxic string")
    model = fit_toxicity(labels, docs)
    assert model == model and fit_toxicity(labels.filter("toxic = 0"), docs) is None and fit_toxicity(labels, docs.limit(0)) is None
    got = {r.doc_id: r for r in score_toxicity(spark.createDataFrame([(1, "rain over hills, vermin!", 1), (2, "women women rain", 1), (3, None, 1), (4, "men men rain", 1), (None, "utter vermin " * 9000, 1)], "doc_id long, text string, score int"), model).collect()}
    assert got[1].predicted == got[None].predicted == 1 and got[2].predicted == got[3].predicted == got[4].predicted == 0
    assert abs(got[2].score - got[4].score) < 0.2
    assert swapped("Women and men") == "men and women" and swapped("Viele Frauen") == "Viele männer"


def test_toxicity_draws_at_most_so_many_of_a_label(spark):
    rows = [(i % 900, ("vermin" if i % 9 < 3 else "rain") + " falls") for i in range(3000)]
    labels = spark.createDataFrame([(i % 900, int(i % 9 < 3)) for i in range(9000)], "doc_id long, toxic int")
    model = fit_toxicity(labels, spark.createDataFrame(rows, "doc_id long, text string"), per_label=50)
    assert 2 * 60 < model["pairs"] <= 2 * 100


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_toxicity_of_the_query_s_model(spark, sf):
    """Held-out quality on the given tables, the fold rule, and that the penalty acts on the very model."""
    if not os.path.exists(sf):
        pytest.skip("no tables")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    assert labels.filter(~in_fold("doc_id", 3, 1)).count() == len(train)
    own, free = (fit_toxicity(labels.filter(~in_fold("doc_id", 3, 1)), docs, swap=s) for s in (5.0, 0.0))
    assert swap_gap(own) < 0.3 * swap_gap(free) and own["pairs"] > 500
    got = score_toxicity(docs, own).join(labels.filter(in_fold("doc_id", 3, 1)), "doc_id").collect()
    bad = [r.predicted for r in got if r.toxic == 1]
    assert sum(bad) >= 0.7 * len(bad) and sum(r.predicted for r in got if r.toxic == 0) <= 0.02 * len(got)


def test_counterfactual_penalty_shrinks_the_swap_gap():
    x = np.array([[1, 1, 0], [1, 1, 0], [0, 0, 1], [0, 0, 1]], np.float32)
    d, y = x - x[:, [0, 2, 1]], np.array([1, 1, 0, 0], float)
    gap = lambda w: abs(w[1] - w[2])
    assert gap(fit(x, d.T @ d / 4, y, swap=5)) < 0.2 * gap(fit(x, d.T @ d / 4, y, swap=0))


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_languages_held_out(spark, sf):
    if not os.path.exists(sf):
        pytest.skip("no tables")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = fit_languages(docs.filter(~in_fold("doc_id", 4, 2)))
    got = predict_languages(docs.filter(in_fold("doc_id", 4, 2)).withColumnRenamed("lang", "rejected"), model).join(docs.select("doc_id", "lang"), "doc_id").filter("lang is not null and lang_pred <> 'und'").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)


def test_language_takes_null_ids_and_repeated_rows(spark):
    rows = [(None, "the and of", "en"), (1, "le des une", "fr"), (None, "the of", "en"), (1, "le des une", "fr"), (2, None, "fr"), (3, "x", None)]
    model = fit_languages(spark.createDataFrame(rows * 30, "doc_id long, text string, lang string"), per_language=5)
    out = predict_languages(spark.createDataFrame(rows * 2, "doc_id long, text string, score string"), model)
    assert out.columns == ["doc_id", "lang_pred", "score", "rejected"] and out.count() == 12


def test_votes_find_the_good_labeller():
    rng = np.random.default_rng(0)
    truth = rng.choice([-1, 1], 4000)
    votes = np.stack([np.where(rng.random(4000) < a, truth, -truth) * (rng.random(4000) < 0.8) for a in (0.95, 0.8, 0.8, 0.6)], 1)
    patterns, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, found = fit_votes(patterns, counts.astype(float))
    assert ((post[back.ravel()] > 0.5) == (truth > 0)).mean() > 0.9 and np.allclose(found["accuracy"], (0.95, 0.8, 0.8, 0.6), atol=0.06)


CLASHING = ["words", "kept", "copies", "_row", "row", "_doc", "_copies", "_turn", "group", "first", "n", "key", "rid", "sha", "size", "n_words", "text_sha256", "turn", "place", "component"]


def pipeline_rows():
    """Clean prose, copies exact and near, junk, blanks, repeated rows and ids, null in every column."""
    rng = random.Random(21)
    clean = prose(rng, 40)
    near = [" ".join(w if k != 7 else "zzz" for k, w in enumerate(t.split())) for t in clean[:6]]
    texts = [*clean, *near, *[t.replace(" ", "\n") for t in clean[:4]], clean[9], " ".join(clean[:30]), "spam " * 200, "short", None, "", " \n"]
    rows = [(i, t, "en", ["s", "t", None][i % 3]) for i, t in enumerate(texts)]
    return [*rows, rows[2], (None, clean[3], None, None), (None, clean[12], "xx", "s")]


def jaccard_groups(sets):
    own = list(range(len(sets)))

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                own[b] = a
    return [find(i) for i in range(len(sets))]


def test_pipeline_stages_against_brute_force_with_clashing_columns(spark):
    import corpus_pipeline as P
    import duckdb

    from ledgerloom.llm.quality import oracle

    rows = pipeline_rows()
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASHING)
    d = spark.createDataFrame([(*r, *(f"{c}{k}" if k % 2 else None for c in CLASHING)) for k, r in enumerate(rows)], schema).repartition(3)
    marks = lambda x: Counter(tuple(r) for r in x.collect())
    every = marks(d)

    def stage(name):
        out = P.stage(dict(P.STAGES)[name](spark, d, ""), "t")
        if name != "packing":
            assert out.columns == d.columns
        return out

    # quality: the SQL over the same rows, told apart by their place
    c = duckdb.connect()
    frame = d.select("text", "lang").toPandas().reset_index(names="doc_id")
    c.register("documents", frame)
    kept = {r[0] for r in c.sql(oracle()).fetchall() if r[-1]}
    want = Counter((t, g) for k, (t, g) in enumerate(zip(frame["text"], frame["lang"], strict=True)) if k in kept)
    out = stage("quality rules")
    assert Counter((r.text, r.lang) for r in out.collect()) == want and not marks(out) - every and sum(want.values()) > 40
    d = out

    out, groups = stage("exact dedup"), {}
    for r in d.collect():
        groups.setdefault("".join((r.text or "").split()), []).append((-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
    assert Counter((-len(r.text), r.doc_id is None, r.doc_id or 0) for r in out.collect()) == Counter(min(g) for g in groups.values())
    assert not marks(out) - marks(d)
    d = out

    out, before = stage("near dedup"), d.collect()
    best = {}
    for r, g in zip(before, jaccard_groups([five(r.text) for r in before]), strict=True):
        best[g] = min(best.get(g, (True, 1 << 60)), (r.doc_id is None, r.doc_id or 0))
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == Counter(best.values()) and len(best) < len(before)
    assert not marks(out) - marks(d)
    d = out

    out = stage("mixing")
    taken = {(r.doc_id, r.source): r for r in mix_sources(d).collect()}
    got = Counter((r.doc_id, r.source) for r in out.collect())
    assert all(got[k] == r.copies and r.copies <= 3 for k, r in taken.items()) and not set(marks(out)) - set(marks(d))
    target, real, most = {}, Counter(), {}
    for (_, s), r in taken.items():
        target[s], most[s] = r.target, max(most.get(s, 0), r["size"])
        real[s] += r.taken
    assert all(abs(real[s] - target[s]) <= most[s] for s in target)
    d = out

    packed = stage("packing").collect()
    tokens = Counter()
    for r in packed:
        tokens[r.doc_id] += r.length
    plain = Counter()
    for r in d.collect():
        plain[r.doc_id] += len(PLAIN[BYTE].encode(r.text or "", add_special_tokens=False).ids) + 1
    assert tokens == plain
    fill = Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    assert all(n == 1024 or n & (n - 1) == 0 for n in fill.values())


def test_pipeline_stages_take_empty_tables(spark):
    import corpus_pipeline as P

    d = spark.createDataFrame([], "doc_id long, text string, lang string, source string, kept string")
    for name, step in P.STAGES:
        out = step(spark, d, "")
        assert out.count() == 0 and (name == "packing" or out.columns == d.columns)


def test_run_is_its_stages(spark, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame(pipeline_rows(), "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, step in P.STAGES:
        d = P.stage(step(spark, d, str(tmp_path)), "t")
    tokens = lambda x: sum(r.length for r in x.collect())
    assert tokens(P.run(spark, str(tmp_path))) == tokens(d) > 0


def test_flight_in_chunks_keeps_totals():
    from ledgerloom.llm.mixing import fly_in_chunks

    rng = np.random.default_rng(4)
    size = np.sort(rng.lognormal(5, 1, 5000))[::-1]
    p = fly_in_chunks(size, np.full(5000, 0.4), np.random.default_rng(2), True)
    assert set(p) <= {0.0, 1.0} and abs(p.sum() - 2000) <= 3 and abs((p * size).sum() / (0.4 * size.sum()) - 1) < 0.001


def test_mixing_comes_near_its_targets(spark):
    rng = random.Random(2)
    rows = [(i, "w " * max(1, int(rng.lognormvariate(4, 1))), rng.choice("abc")) for i in range(3000)]
    out = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in "abc":
        own = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in own) / own[0].target - 1) < 0.01


def test_simhash_of_one_hot_text_and_long_lists(spark):
    from ledgerloom.llm import simhash as H

    rows = [(i, "one two three four five six") for i in range(400)] + [(1000 + i, f"text {i} is {i * 7} of {i * 3}") for i in range(200)]
    got = simhash_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == 600 and {r.component_id for r in got if r.doc_id < 400} == {0}
    rng = np.random.default_rng(5)
    prints = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64) & np.uint64((1 << 18) - 1))
    a, b = H.links(np.zeros(len(prints), np.int64), prints, 4)
    c, e = H.links(np.zeros(len(prints), np.int64), prints, 4, split=False)

    def parts(x, y):
        own = {int(p): int(p) for p in prints}

        def find(k):
            while own[k] != k:
                k = own[k]
            return k

        for p, q in zip(x, y, strict=True):
            p, q = sorted((find(int(p)), find(int(q))))
            own[q] = p
        return {p: find(p) for p in own}

    assert len(prints) > H.LONG and parts(a, b) == parts(c, e)


def test_exact_with_a_hot_group(spark):
    rows = [(i, "same text") for i in range(500)] + [(1000 + i, f"t{i % 150}") for i in range(300)]
    out = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(out) == 800 and sum(r.kept for r in out) == 151 and {(r.keep_id, r.group_size) for r in out if r.doc_id < 500} == {(0, 500)}
    assert all(r.group_size == 2 and r.keep_id == 1000 + (r.doc_id - 1000) % 150 for r in out if r.doc_id >= 1000)


def test_weak_quality_tells_sides_apart_in_any_layout(spark):
    good, bad = prose(random.Random(3), 60), [" ".join(f"#{i}$ AAA|" for _ in range(9)) for i in range(30)]
    rows = [(i, t, "x") for i, t in enumerate(good + bad)] + [(None, None, None), (5, good[5], "y"), (900, "", None), (901, "long " * 9000, None)]
    got = weak_quality(spark.createDataFrame(rows, "doc_id long, text string, votes string").repartition(3)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and 0 <= r.label_prob <= 1 for r in got)
    kept = Counter((r.doc_id, r.kept) for r in got)
    assert sum(kept[(i, True)] for i in range(60)) >= 58 and sum(kept[(i, False)] for i in range(60, 90)) >= 28
    again = {r.doc_id: round(r.label_prob, 9) for r in weak_quality(spark.createDataFrame(rows, "doc_id long, text string, votes string").repartition(2)).collect()}
    assert all(again[r.doc_id] == round(r.label_prob, 9) for r in got)


def test_quality_passes_other_columns_through(spark):
    rows = [(i, t, "en", "w", "k", "h") for i, t in enumerate(prose(random.Random(8), 25))] + [(None, None, None, None, None, None)]
    out = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, words string, kept string, _h string"))
    assert out.columns[:5] == ["doc_id", "text", "lang", "words", "_h"] and {r.words for r in out.collect()} == {"w", None}


def prose(rng, n, common=("the", "of", "and", "to", "in", "was")):
    rare = ["".join(rng.choice("abcdefgilmnorstu") for _ in range(rng.randrange(3, 10))) for _ in range(400)]
    return [" ".join(rng.choice(common) if rng.random() < 0.35 else rng.choice(rare) for _ in range(90)) + "." for _ in range(n)]


def kept_by_pipeline(spark, rows):
    import corpus_pipeline as P

    return {r.doc_id for r in P.quality(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "").collect()}


def test_pipeline_quality_keeps_clean_documents_beside_copies_of_junk(spark):
    clean = [(i, t, "en", "s") for i, t in enumerate(prose(random.Random(4), 60))]
    for junk in ("spam " * 3000, " ".join(f"{i}# ${i}" for i in range(400))):
        rows = clean + [(1000 + i, junk, "en", "s") for i in range(30)]
        assert kept_by_pipeline(spark, rows) - {r[0] for r in rows[60:]} == {r[0] for r in clean}


def test_pipeline_quality_does_not_hang_on_a_language_s_share(spark):
    rng = random.Random(9)
    many = [(i, t, "en", "s") for i, t in enumerate(prose(rng, 3200))]
    few = [(10_000 + i, t, "fr", "s") for i, t in enumerate(prose(rng, 25, ("le", "la", "des", "et", "une", "dans")))]
    rare = [(20_000 + i, t, "de", "s") for i, t in enumerate(prose(rng, 3, ("der", "und", "das", "nicht", "mit", "ein")))]
    out = kept_by_pipeline(spark, many + few + rare + [(30_000, "short", "de", "s")])
    assert {r[0] for r in few + rare} <= out and 30_000 not in out


def test_pipeline_quality_has_no_most_languages(spark):
    rng = random.Random(7)
    rows = [(i, t, f"l{i % 120}", "s") for i, t in enumerate(prose(rng, 120 * 20))]
    assert len(kept_by_pipeline(spark, rows)) > 2300


def five(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def test_pipeline_near_dedup_against_brute_force(spark):
    import corpus_pipeline as P

    rng = random.Random(12)
    rows = []
    for t in prose(rng, 12):
        w = t.split()
        for _ in range(6):
            w = list(w)
            for _ in range(rng.randrange(1, 3)):
                w[rng.randrange(len(w))] = rng.choice("xyz") + str(rng.randrange(50))
            rows.append(" ".join(w))
    rows += [None, "", "a b", "A b", " \n"]
    rng.shuffle(rows)
    rows = [(i, t, "en", "s") for i, t in enumerate(rows)] + [(None, rows[0], "en", "s")]
    own, sets, far = list(range(len(rows))), [five(r[1]) for r in rows], 0

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                far += (bits(rows[i][1]) ^ bits(rows[j][1])).bit_count() > 4
                a, b = sorted((find(i), find(j)))
                own[b] = a
    assert far > 10
    out = P.near(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3), "").collect()
    assert Counter(r.doc_id for r in out) == Counter(rows[i][0] for i in range(len(rows)) if own[i] == i)


def test_an_owner_tells_windows_apart_that_share_one_hash(spark):
    from ledgerloom.llm.exchange import BLOBS, grouped, owner_starts, repeated, sent

    starts, rows = owner_starts(2, 64), []
    for sender, (keys, checks) in enumerate([([5, 5, 9, 1 << 63], [1, 2, 1, 4]), ([5, 9, 7, 1 << 63], [3, 1, 1, 4])]):
        k, c, _, n = grouped(np.array(keys, np.uint64), np.array(checks, np.uint64))
        rows += [(sender, o, m, code, twice, check) for o, m, code, twice, check in sent(k, n, starts, c)]
    got = {(r.sender, r.owner): r.bits for r in repeated(spark.createDataFrame(rows, BLOBS)).collect()}
    # of sender 0 the third of (5, 1) (5, 2) (9, 1), of sender 1 the third of (5, 3) (7, 1) (9, 1), and both top keys
    assert got == {(0, 0): [4], (0, 1): [1], (1, 0): [4], (1, 1): [1]}


def test_near_groups_in_blocks_are_those_of_one_task(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    texts = []
    shared = rng.sample(words, 150)
    for g in range(4):  # groups that share three quarters of their words, so that candidates chain them
        base = shared + rng.sample(words, 50)
        for _ in range(40):
            copy = list(base)
            for at in rng.sample(range(150, 200), rng.randrange(4)):
                copy[at] = rng.choice(words)
            texts.append(" ".join(copy))
    drift = rng.sample(words, 200)
    for i in range(30):  # a chain whose ends are unlike
        drift[i * 6 : i * 6 + 6] = rng.sample(words, 6)
        texts.append(" ".join(drift))
    texts += [None, "", "x y", "x y", *(" ".join(rng.sample(words, 100)) for _ in range(30))]
    rng.shuffle(texts)
    rows = spark.createDataFrame([(i // 2 if i % 9 else None, i, t) for i, t in enumerate(texts)], "doc_id long, row long, text string").repartition(4)
    whole = sorted(tuple(r) for r in shingle_groups(rows, "row").select("row", "group", "doc_id").collect())
    sets = [shingles((t or "").encode()) for t in texts]
    own = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9 and own[i] != own[j]:
                keep, drop = sorted((own[i], own[j]))
                own = [keep if x == drop else x for x in own]
    sizes = Counter(own)
    assert [(r, g) for r, g, _ in whole] == [(i, g) for i, g in enumerate(own) if sizes[g] > 1]
    assert max(sizes.values()) > 30
    for most in (7, 25):
        assert sorted(tuple(r) for r in shingle_groups(rows, "row", block_rows=most).select("row", "group", "doc_id").collect()) == whole
    assert sorted(tuple(r) for r in shingle_groups(rows, "row", block_bytes=20_000, broadcast_rows=0).select("row", "group", "doc_id").collect()) == whole
