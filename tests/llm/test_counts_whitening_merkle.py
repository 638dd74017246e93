"""Token counts against the library, whitening against exact sums, manifests against a tree built by hand."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm import exact_spectrum as X
from ledgerloom.llm import token_counts as C
from ledgerloom.llm.merkle import changed_text, merkle_proofs
from ledgerloom.llm.token_counts import chunk_map, token_counts
from ledgerloom.llm.token_machine import TokenMachine
from ledgerloom.llm.whitening import whiten

WORD = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(WORD)
MACHINE = TokenMachine(WORD)
ODD = ["a", "e", "t", "h", "s", "don't", "'", "'r", "'ve", "'l", " ", "\n", "\t", "7", "!", "...", "É", "é", "́", "ß", "Σ", "İ", "東京", "٣", "½", "　", "​", "🙂", "<|endoftext|>", "<|endof", "haha", "ing", "the"]


def library(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=30).map("".join))
def test_machine_counts_as_the_library_does(text):
    assert MACHINE.count_column(pa.array([text]))[0] == library(text)
    if "<|" not in text:
        assert MACHINE.run(text) == library(text)  # character by character, without stretches


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_machine_counts_any_text(text):
    assert MACHINE.count_column(pa.array([text.replace("\x00", "")]))[0] == library(text.replace("\x00", ""))


def test_machine_forgets_and_goes_on():
    small, rng = TokenMachine(WORD, most=50), random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("abcdeé' 1!") for _ in range(30))
        assert small.count_column(pa.array([text]))[0] == library(text)


def test_runs_of_one_letter_keep_their_pairs_from_the_left():
    for c in "ah!=":
        for n in range(1, 70):
            assert MACHINE.run(c * n) == library(c * n)


def test_chunk_map_composes_wherever_it_is_cut():
    text = "it's 12 o'clock <|endoftext|> haha  x\n" * 3
    count = lambda t: int(MACHINE.count_column(pa.array([t]))[0])
    for at in range(len(text) + 1):
        h1, n1, t1, solid1 = chunk_map(text[:at], count)
        h2, n2, t2, solid2 = chunk_map(text[at:], count)
        meets = [h1, t1 + h2, t2] if solid1 and solid2 else [h1 + h2, t2] if solid2 else [h1, t1 + h2]
        assert n1 + n2 + sum(map(count, meets)) == library(text)


@pytest.mark.parametrize("chunk", [5, 40, 65_536])
def test_token_counts_of_whole_texts(spark, chunk):
    rows = [(1, "hello world's <|endoftext|>x " * 9), (2, None), (2, ""), (None, "x" * 300), (3, "ab " * 200 + "q" * 90 + " z"), (3, "é́ <|endof text|>" * 20), (3, "é́ <|endof text|>" * 20), (5, " \n" * 50), (None, None)]
    docs = spark.createDataFrame([(*r, 7, "k") for r in rows], "doc_id long, text string, n_tokens long, seq string").repartition(3)
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, WORD, limit=100, chunk_chars=chunk).collect())
    assert got == sorted((i or -1, len((t or "").encode()), library(t), library(t) > 100) for i, t in rows)


def test_token_counts_of_an_empty_table_and_of_other_tokenizers(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), WORD).count() == 0
    with pytest.raises(ValueError, match="fixed split pattern"):
        TokenMachine(public_tokenizers.path("byte_bpe_50k.json"))


def test_only_long_texts_are_cut(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d " * 50)], "doc_id long, text string")
    plan = token_counts(docs, WORD, chunk_chars=100)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 4 and C.SLICE > 100


def char_poly(m):
    """Faddeev and LeVerrier over fractions, lowest first."""
    d = len(m)
    out, b = [Fraction(1)], [[Fraction(0)] * d for _ in range(d)]
    for k in range(1, d + 1):
        b = [[sum(m[i][t] * b[t][j] for t in range(d)) + (out[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        out.append(-sum(sum(m[i][t] * b[t][i] for t in range(d)) for i in range(d)) / k)
    return [int(x) for x in reversed(out)]


def gram(rng, d, n):
    x = [[rng.randrange(-50, 50) for _ in range(d)] for _ in range(n)]
    return [[sum(r[i] * r[j] for r in x) for j in range(d)] for i in range(d)]


@pytest.mark.parametrize("d,n", [(1, 3), (2, 1), (4, 9), (6, 3), (7, 20)])
def test_polynomial_is_exact(d, n):
    m = gram(random.Random(d), d, n)
    mods = X.primes_for(sum(m[i][i] for i in range(d)), d)
    got = X.remainder((p, [int(x) for x in r]) for p, r in zip(mods, X.residues(m, mods), strict=True))
    assert got == char_poly(m)


def test_hessenberg_swaps_where_a_pivot_is_zero():
    m = [[2, 0, 0, 1], [0, 3, 0, 0], [0, 0, 5, 1], [1, 0, 1, 7]]
    mods = X.primes_for(17, 4)
    assert X.remainder((p, [int(x) for x in r]) for p, r in zip(mods, X.residues(m, mods), strict=True)) == char_poly(m)


def test_roots_with_their_multiplicity_and_vectors():
    m = [[4, 0, 0, 0], [0, 4, 0, 0], [0, 0, 1, 0], [0, 0, 0, 0]]
    roots = X.largest_roots(char_poly(m), 9, 8)
    assert [(at / 2**bits, times) for at, bits, times in roots] == [(4.0, 2), (1.0, 1)]  # zero is none
    two = np.array(X.null_vectors(m, roots[0][0], roots[0][1], 2))
    assert np.allclose(two @ two.T, np.eye(2), atol=1e-15) and np.abs(two[:, 2:]).max() < 1e-15
    close = [[10**15, 1], [1, 10**15 + 1]]  # eigenvalues that doubles cannot tell apart well
    r = X.largest_roots(char_poly(close), 2 * 10**15 + 1, 2)
    v = [X.null_vectors(close, at, bits, 1)[0] for at, bits, _ in r]
    slope = (1 + 5**0.5) / 2
    assert abs(abs(v[0][1] / v[0][0]) - slope) < 1e-14 and abs(v[0] @ v[1]) < 1e-15


@settings(max_examples=25, deadline=None)
@given(st.integers(2, 8), st.integers(1, 30), st.integers(0, 10**6))
def test_spectrum_agrees_with_doubles(d, n, seed):
    m = gram(random.Random(seed), d, n)
    trace = sum(m[i][i] for i in range(d))
    w = np.linalg.eigvalsh(np.array(m, float))[::-1]
    if not trace:
        return
    got = [at / 2**bits for at, bits, times in X.largest_roots(char_poly(m), trace, d) for _ in range(times)]
    assert np.allclose(got, w[: len(got)], rtol=1e-9, atol=1e-9 * trace) and np.abs(w[len(got) :]).max(initial=0) < 1e-9 * trace


def test_whitening_against_exact_sums(spark):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12))).astype(np.float32)
    rows = [(i if i % 50 else None, v) for i, v in enumerate(x.tolist())] + [(7, x[7].tolist())] * 5
    bad = [(900, None), (901, [1.0, None] + [0.0] * 10), (902, [float("inf")] + [0.0] * 11), (903, [float("nan")] + [0.0] * 11), (904, []), (905, [1.0])]
    df = spark.createDataFrame([(*r, "c", 1.0) for r in rows + bad], "vec_id long, embedding array<float>, component string, n double").repartition(4)
    got = whiten(df).toPandas()
    ints = np.floor(np.array([v for _, v in rows], float) * 1024).astype(np.int64).astype(object) + 100_000
    n, s = len(rows), ints.sum(0)
    dev = sorted(int(((n * r - s) ** 2).sum()) for r in ints)
    assert len(got) == 8 * n and sorted(got[got.component == 1].deviation) == dev and set(got.n) == {n}
    c = (ints - Fraction(0)).astype(float) - ints.astype(float).mean(0)
    w, u = np.linalg.eigh(c.T @ c / n)
    z = np.sort(np.abs(c @ u[:, ::-1][:, :8] / np.sqrt(w[::-1][:8])), axis=0)
    mine = np.sort(np.abs(np.array([got[got.component == k].whitened for k in range(1, 9)]).T), axis=0)
    assert np.allclose(z, mine, atol=1e-9) and got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1
    assert np.allclose(got.groupby("component").explained.first(), w[::-1][:8] / w.sum(), rtol=1e-9)


def test_whitening_of_few_and_of_equal_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)]):
        assert whiten(spark.createDataFrame(rows, schema)).count() == 0
    line = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 5.0]), (2, [3.0, 5.0]), (3, [5.0])], schema)).collect()
    assert sorted((r.vec_id, r.component, r.n) for r in line) == [(1, 1, 3), (2, 1, 3), (2, 1, 3)] and {r.explained for r in line} == {1.0}
    huge = whiten(spark.createDataFrame([(1, [1e30, 2.0]), (2, [0.0, 5.0])], schema)).collect()
    assert [r.deviation for r in huge] == [None, None] and sorted(r.whitened for r in huge) == [-1.0, 1.0]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_hand(rows):
    """Every result row from trees built in memory."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: digest("".join(map(field, (*r[:4], text))))

    def tree(level):
        proofs, under = [[] for _ in level], [[i] for i in range(len(level))]
        while len(level) > 1:
            runs = [(level[i : i + 16], under[i : i + 16]) for i in range(0, len(level), 16)]
            for run, own in runs:
                for k, members in enumerate(own):
                    for i in members:
                        proofs[i].append((run[:k], run[k + 1 :]))
            level, under = [digest("".join(run)) for run, _ in runs], [sum(own, []) for _, own in runs]
        return level[0] if level else None, proofs

    groups = []
    for source in sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted((r for r in rows if r[1] == source), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        groups.append((own, *tree([leaf(r, r[4]) for r in own])))
    root, above = tree([g[1] for g in groups])
    out = []
    for (own, sub, proofs), more in zip(groups, above, strict=True):
        for r, proof in zip(own, proofs, strict=True):
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            h, steps = leaf(r, text), proof + more
            for a, b in steps:
                h = digest("".join(a) + h + "".join(b))
            out.append((str(r[0]), leaf(r, r[4]), sub, root, digest("".join("".join(a + b) for a, b in steps)), h, h == root))
    return sorted(out)


S, LONG = "doc_id long, source string, lang string, n_chars long, text string, level string, node string, idx string", [None] * 3
MANIFESTS = {
    "empty": [],
    "one row": [(1, "a", None, 3, "ABC")],
    "a run and one more": [(i, "s", "en", i, "ÀBC" * i) for i in range(17)],
    "many sources of one row": [(i, f"s{i}", None, 3, "ABC") for i in range(280)],
    "nulls, blanks and repeats": [(None, None, None, None, None)] * 3 + [(i % 7, ["s", "", "=", None][i % 4], "de", 1, "T" * (i % 3)) for i in range(150)],
    "a hot source": [(i, "hot" if i % 3 else f"x{i % 20}", "e", 2, "Ab " * 300 if i == 9 else "Tx") for i in range(900)],
}


@pytest.mark.parametrize("case", MANIFESTS)
def test_manifest_is_the_tree_built_by_hand(spark, case):
    rows = MANIFESTS[case]
    docs = spark.createDataFrame([(*r, *LONG) for r in rows], S).repartition(3)
    got = [(str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in merkle_proofs(docs, changed_text()).collect()]
    assert sorted(got) == by_hand(rows)


def test_proofs_carry_their_siblings_and_the_row(spark):
    docs = spark.createDataFrame([(i, "s", None, 1, "t", i) for i in range(40)], "doc_id long, source string, lang string, n_chars long, text string, own long")
    out = merkle_proofs(docs, row="own").collect()
    assert all(r.verified and r.own == r.doc_id and [len(s["kids"]) // 32 for s in r.proof] == [16 if r.doc_id < 32 else 8, 3] for r in out)
    assert all(r.proof[0]["kids"][32 * r.proof[0]["at"] :][:32].hex() == r.leaf for r in out)
