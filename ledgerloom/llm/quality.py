"""Quality rules by distribution divergence, in DataFrame functions only.

Base rules count words, repeated lines and repeated three-word windows. The verdict compares a document's
histograms of character classes and of common words with references of the corpus's languages, by
Jensen-Shannon distance; it is kept if some language accepts both. A language's reference is the mean of the
shares of its distinct texts that pass the base rules, each weighing alike, so neither copies nor length nor
junk weigh; its common words are the COMMON ones with the largest mean share.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import stage

#: What counts as a symbol, as blank and as a break between words in the contract.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"
BREAKS = r"[\x20\x09-\x0D]+"
#: Character classes of the histogram, besides blanks, letters and whatever is left.
CLASSES = {"upper": r"\p{Lu}", "stop": r".,;:!?'\"()\-", "sign": r"#$%&*+/<=>@\[\]^_`{|}~\\"}
NAMES = ["upper", "stop", "sign", "blank", "rest"]
COMMON = 12
#: Distances accepted: at `WORD_BASE` for long texts, more for short ones, whose histograms are rough.
WORD_BASE, WORD_SHORT, CHAR_MOST = 0.14, 1.9, 0.25
MIN_WORDS = 50
#: Distinct texts that pass the base rules, from which on a language has a reference.
MIN_DOCS = 20
#: Up to so many kinds of repeated windows are looked for one by one; the positions of more are sorted out. Both ways give the same.
FEW = 24
NEW = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "js_words", "js_chars", "kept"]


def count_of(text: Column, chars: str) -> Column:
    """How many characters of a class a text has: what is left when runs of all others go."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def base_counts(docs: DataFrame) -> DataFrame:
    """docs with `text` (not null) plus words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    bare = F.trim(F.col("text"), F.lit(BLANKS))
    d = docs.withColumn("words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BREAKS))).withColumn("_lines", F.split("text", "\n"))
    d = d.withColumn("n_words", F.size("words").cast("long"))
    hashes = F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    d = d.withColumn("_h", F.when(F.col("n_words") >= 3, F.slice(hashes, F.lit(1), F.size("words") - 2)))
    # most texts repeat no window; their hashes need no sorting
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array("_h")))
    d = d.withColumn("_twice", F.array_distinct(F.filter("_s", lambda h, i: F.coalesce(F.get("_s", i + 1) == h, F.lit(False)))))
    few = F.filter(F.transform("_h", lambda h, i: F.when(F.array_contains("_twice", h), i)), lambda i: i.isNotNull())
    d = d.withColumn("_o", F.when(F.size("_twice") > FEW, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    beside = F.filter("_o", lambda x, i: F.coalesce(F.get("_o", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_o", i + 1)["h"] == x["h"], F.lit(False)))
    many = F.sort_array(F.transform(beside, lambda x: x["i"]))
    d = d.withColumn("_p", F.when(F.size("_twice") > FEW, many).when(F.size("_twice") > 0, few))
    steps = F.transform("_p", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("_p", i + 1) - x, F.lit(3))))
    filled = F.filter("_lines", lambda s: F.trim(s, F.lit(BLANKS)) != "")
    again = F.size("_lines") - F.size(F.array_distinct("_lines"))
    return (
        d.withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
        .withColumn("n_symbols", count_of(F.col("text"), SYMBOLS))
        .withColumn("n_dup_lines", F.when(again == 0, 0).otherwise(F.size(filled) - F.size(F.array_distinct(filled))).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .drop("_lines", "_h", "_s", "_o", "_p", "_twice")
    )


def facts(docs: DataFrame) -> DataFrame:
    """docs with `text` (not null) and `lang` plus the base counts, _chars (the shares of NAMES among the characters), _low (the words in lower case, apart by a space, as which they are written in half the room) and _h (a hash of the words)."""
    size = F.length("text").cast("long")
    d = base_counts(docs).withColumns({f"_{n}": count_of(F.col("text"), c) for n, c in CLASSES.items()})
    counts = [*(F.col(f"_{n}") for n in CLASSES), size - F.col("word_chars"), F.col("word_chars") - reduce(lambda a, b: a + b, (F.col(f"_{n}") for n in CLASSES))]
    low = F.lower(F.array_join("words", " "))
    d = d.withColumns({"_chars": F.transform(F.array(*counts), lambda c: c / F.greatest(size, F.lit(1))), "_low": low, "_h": F.xxhash64("words")})
    return d.drop("words", *(f"_{n}" for n in CLASSES))


def references(known: DataFrame, broadcast_copies: int = 1_000_000) -> list[dict]:
    """Per language with MIN_DOCS distinct texts (as words) that pass the base rules: the mean shares of its common words and of character classes.

    `known` holds the facts of such rows. At most `broadcast_copies` groups of copies are broadcast to them; more are
    joined. What comes to the driver is COMMON words for each of at most (distinct texts / MIN_DOCS) languages.
    """
    copies = known.groupBy("lang", "_h").agg(F.count("*").alias("copies")).filter("copies > 1")
    d = known.join(F.broadcast(copies) if copies.count() <= broadcast_copies else copies, ["lang", "_h"], "left").withColumn("w", 1 / F.coalesce("copies", F.lit(1)))
    # rounded, so that the order of summing decides nothing
    mean = lambda x: F.round(F.sum(F.col("w") * x) / F.sum("w"), 9)
    classes = d.groupBy("lang").agg(F.sum("w").alias("n"), *(mean(F.get("_chars", F.lit(i))).alias(c) for i, c in enumerate(NAMES))).filter(F.round("n", 6) >= MIN_DOCS)
    classes = stage(classes, "classes")
    words = d.select("lang", (F.col("w") / F.col("n_words")).alias("x"), F.explode(F.split("_low", " ")).alias("word")).groupBy("lang", "word").agg(F.sum("x").alias("x"))
    shares = words.join(F.broadcast(classes.select("lang", "n")), "lang").select("lang", "word", F.round(F.col("x") / F.col("n"), 9).alias("x")).filter("x > 0.001")
    ranked = shares.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("x"), "word"))).filter(F.col("r") <= COMMON)
    common: dict[str, dict[str, float]] = {}
    for r in ranked.orderBy("lang", "r").collect():
        common.setdefault(r["lang"], {})[r["word"]] = r["x"]
    return [{"lang": r["lang"], "words": common.get(r["lang"], {}), "chars": [r[c] for c in NAMES]} for r in classes.orderBy("lang").collect()]


def distance(own: Column, reference: list[float] | Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of a histogram, an array of shares, and a reference's shares."""
    part = lambda x, m: F.when(x > 0, x * F.log(2 * x / m)).otherwise(0.0)
    terms = F.zip_with(own, reference if isinstance(reference, Column) else F.array(*map(F.lit, reference)), lambda p, q: part(p, p + q) + part(q, p + q))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / (2 * 0.6931471805599453)))


def compared(d: DataFrame, refs: list[dict]) -> DataFrame:
    """d plus _best: of all references the one that accepts the row best, (worst ratio to what is accepted, words, chars)."""
    vocabulary = sorted({w for r in refs for w in r["words"]})
    at = {w: i for i, w in enumerate(vocabulary)}
    table = [{"at": [at[w] for w in r["words"]], "words": [*r["words"].values(), max(0.0, 1 - sum(r["words"].values()))], "chars": r["chars"]} for r in refs]
    # literals, folded once; they grow with the number of languages only
    table = F.from_json(F.lit(json.dumps(table)), "array<struct<at: array<int>, words: array<double>, chars: array<double>>>")
    names = F.from_json(F.lit(json.dumps(vocabulary)), "array<string>")
    n = F.greatest(F.col("n_words"), F.lit(1))
    # a set decides which words are common before any is looked for in the list
    d = d.withColumn("_at", F.transform(F.filter(F.split("_low", " "), lambda w: w.isin(vocabulary)), lambda w: F.array_position(names, w).cast("int")))
    # sorted behind one mark of each number: a number's count is the distance of two marks, less one
    d = d.withColumn("_at", F.sort_array(F.concat("_at", F.sequence(F.lit(1), F.lit(len(vocabulary) + 1)))))
    d = d.withColumn("_start", F.filter(F.transform("_at", lambda x, i: F.when((i == 0) | (F.get("_at", i - 1) != x), i)), lambda i: i.isNotNull()))
    d = d.withColumn("_own", F.transform(table, lambda r: F.struct(r.alias("r"), F.transform(r["at"], lambda k: (F.get("_start", k + 1) - F.get("_start", k) - 1) / n).alias("p"))))
    whole = lambda p: F.concat(p, F.array(F.greatest(F.lit(0.0), 1 - F.aggregate(p, F.lit(0.0), lambda a, x: a + x))))
    d = d.withColumn("_js", F.transform("_own", lambda o: F.struct(distance(whole(o["p"]), o["r"]["words"]).alias("w"), distance(F.col("_chars"), o["r"]["chars"]).alias("c"))))
    ways = F.transform("_js", lambda j: F.struct(F.greatest(j["w"] / (WORD_BASE + WORD_SHORT / F.sqrt(n)), j["c"] / CHAR_MOST).alias("worst"), j["w"].alias("w"), j["c"].alias("c")))
    return d.withColumn("_best", F.array_min(ways))


def quality_rules(docs: DataFrame, keep_text: bool = True, carry: list[str] | None = None) -> DataFrame:
    """docs' own columns plus NEW: the base counts, base_failed, js_words, js_chars and kept; a column of docs of one of those names gives way.

    docs has text and lang. Null text counts as empty and fails the base rules, as does any text of under MIN_WORDS
    words. js_words and js_chars are those of the language that accepts the document best, its own or another. They
    are null, and the base rules alone decide, if it is too short to compare, or its language has no reference;
    a null lang is compared with all. Ties in the ranking of common words go by code point. Repeated rows are judged
    one by one and weigh in a reference like one; an empty table gives no rows; other columns, whatever their names,
    pass through; of several `carry` names those that do. Facts of rows are written once, without texts, to the shared folder; with keep_text they are found
    again when rows are judged, so that no text is written; without it text is not among the columns, and the written ones serve.
    """
    names = carry or [c for c in docs.columns if c not in NEW and (keep_text or c != "text")]
    row = F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in names)).alias("row")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    every = facts(docs.select(row, F.col("lang"), F.col("text").isNotNull().alias("_has"), text))
    light = every.drop("row", "text") if keep_text else every.drop("text")
    # a column that differs by row keeps a filter above the expressions, which it would otherwise repeat many times over
    light = light.withColumn("_turn", F.monotonically_increasing_id())
    good = ~F.col("base_failed") & F.col("lang").isNotNull() & F.col("_has") & (F.col("_turn") >= 0)
    light = stage(light.filter(good) if keep_text else light, "facts")
    refs = references(light.filter(good))
    d = every if keep_text else light.drop("_turn")
    if refs:
        own = F.col("lang").isNull() | F.col("lang").isin([r["lang"] for r in refs])
        d = compared(d, refs)
        d = d.withColumn("_best", F.when((F.col("n_words") >= MIN_WORDS) & own, F.col("_best")))
    else:
        d = d.withColumn("_best", F.lit(None).cast("struct<worst:double,w:double,c:double>"))
    d = d.withColumn("_turn", F.monotonically_increasing_id())
    d = d.withColumn("js_words", F.round("_best.w", 6)).withColumn("js_chars", F.round("_best.c", 6))
    d = d.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("_best.worst") <= 1, F.lit(True)) & (F.col("_turn") >= 0))
    return d.select(*(F.col("row").getField(c).alias(c) for c in names), *NEW)


def oracle() -> str:
    """The query's result in DuckDB SQL."""
    q = lambda p: "'[^" + p.replace("'", "''") + "]+'"
    counts = ", ".join(f"length(regexp_replace(t, {q(p)}, '', 'g')) AS c{i}" for i, p in enumerate(CLASSES.values()))
    ks, k = range(len(NAMES)), len(CLASSES)
    js = "sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / (2 * ln(2))))"
    return rf"""
WITH d AS (SELECT doc_id, lang, text IS NOT NULL AS has, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, i, words[i:i + 2] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM rep, range(3) AS r(o) GROUP BY doc_id),
lin AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
b AS (SELECT d.*, {counts}, len(words)::BIGINT AS n, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS wc, coalesce(cov.n, 0)::BIGINT AS rw, coalesce(lin.n, 0)::BIGINT AS dl FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN lin USING (doc_id)),
c AS (SELECT *, n < {MIN_WORDS} OR 100 * rw > 50 * n AS bad, length(t) - wc AS c{k}, wc - ({" + ".join(f"c{i}" for i in range(k))}) AS c{k + 1} FROM b),
f AS (SELECT *, 1 / count(*) OVER (PARTITION BY lang, words) AS w FROM c WHERE has AND lang IS NOT NULL AND NOT bad),
tot AS (SELECT lang, sum(w) AS n, {", ".join(f"round(sum(w * (c{i} / greatest(length(t), 1))) / sum(w), 9) AS q{i}" for i in ks)} FROM f GROUP BY lang HAVING round(sum(w), 6) >= {MIN_DOCS}),
fw AS (SELECT f.lang, lower(x) AS word, w / n AS s FROM (SELECT lang, w, n, unnest(words) AS x FROM f) f),
ref AS (SELECT fw.lang, word, round(sum(s) / any_value(tot.n), 9) AS q FROM fw JOIN tot ON fw.lang = tot.lang GROUP BY fw.lang, word HAVING q > 0.001 QUALIFY row_number() OVER (PARTITION BY fw.lang ORDER BY q DESC, word) <= {COMMON}),
own AS (SELECT doc_id, lower(x) AS word, count(*) AS k FROM (SELECT doc_id, unnest(words) AS x FROM d) GROUP BY ALL),
able AS (SELECT * FROM c WHERE n >= {MIN_WORDS} AND (lang IS NULL OR lang IN (SELECT lang FROM tot))),
pair AS (SELECT a.doc_id, a.n, ref.lang, ref.q, coalesce(own.k, 0) / a.n AS p FROM able a CROSS JOIN ref LEFT JOIN own ON own.doc_id = a.doc_id AND own.word = ref.word),
rest AS (SELECT doc_id, n, lang, p, q FROM pair UNION ALL SELECT doc_id, n, lang, greatest(0, 1 - sum(p)), greatest(0, 1 - sum(q)) FROM pair GROUP BY ALL),
jw AS (SELECT doc_id, n, lang, {js} AS js FROM rest GROUP BY ALL),
cp AS (SELECT a.doc_id, tot.lang, unnest([{", ".join(f"a.c{i} / greatest(length(t), 1)" for i in ks)}]) AS p, unnest([{", ".join(f"tot.q{i}" for i in ks)}]) AS q FROM able a CROSS JOIN tot),
jc AS (SELECT doc_id, lang, {js} AS js FROM cp GROUP BY ALL),
best AS (SELECT jw.doc_id, min(greatest(jw.js / ({WORD_BASE} + {WORD_SHORT} / sqrt(jw.n)), jc.js / {CHAR_MOST})) AS worst FROM jw JOIN jc ON jw.doc_id = jc.doc_id AND jw.lang = jc.lang GROUP BY ALL)
SELECT doc_id, n AS n_words, wc AS word_chars, length(regexp_replace(t, '[^{SYMBOLS}]+', '', 'g'))::BIGINT AS n_symbols, dl AS n_dup_lines, rw AS n_repeat_words, bad AS base_failed, NOT bad AND coalesce(worst <= 1, true) AS kept
FROM c LEFT JOIN best USING (doc_id)
"""
