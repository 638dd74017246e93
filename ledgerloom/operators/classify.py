"""Ordered-rule classification, verdict parsing, and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.rules import EVENT_RULES, REJECTED_KINDS
from ledgerloom.functions.text import match_text, row_quality
from ledgerloom.operators.integrity import HEDGE, VAGUE


def bound(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is worked out once a row, however many expressions read it.

    A plain projection would be written out again wherever the column stands, for a rule chain dozens of times; what a
    generator gives is a column of its own to the optimizer.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def first_match(text: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The outcome of the first (pattern, outcome) that is found; the order of rules decides."""
    outcome = F.lit(default)
    for pattern, name in reversed(rules):
        outcome = F.when(text.rlike(pattern), F.lit(name)).otherwise(outcome)
    return outcome


def contains_any(text: Column, parts: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, parts)), lambda p: text.contains(p))


def event_rule(text: Column, rules: list[tuple] = EVENT_RULES) -> Column:
    """struct(company, industry, verdict, notes) of the first rule that is found, null without any. Letters of any script match in either case.

    One alternation of all rules is tried first: a text that no rule can find, as most are, is read once.
    """
    some = text.rlike("(?iu)" + "|".join(f"(?:{r[0]})" for r in rules)) if rules else F.lit(False)
    first = F.coalesce(*(F.when(text.rlike(f"(?iu){r[0]}"), F.lit(i)) for i, r in enumerate(rules)), F.lit(None).cast("int"))
    table = F.array(*(F.struct(*(F.lit(x).cast("string").alias(n) for n, x in zip(("company", "industry", "verdict", "notes"), r[1:], strict=True))) for r in rules))
    return F.get(table, F.when(some, first))


def triage(candidates: DataFrame, reject: list[str], rules: list[tuple] = EVENT_RULES, overrides: DataFrame | None = None) -> DataFrame:
    """candidates (row_idx, company, source_link, ...) with rule (struct), verdict, route and reason, before any comparison with others.

    A manual override (row_idx, override) decides, else the first event rule, else a phrase that marks commentary, else the queue.
    """
    text = F.col("_text")
    d = bound(candidates, "_text", match_text(F.col("company"), F.col("source_link")))
    d = bound(d, "rule", event_rule(text, rules))
    d = d.join(overrides, "row_idx", "left") if overrides is not None else d.withColumn("override", F.lit(None).cast("string"))
    d = d.withColumn("rule", F.when(F.col("override").isNull(), F.col("rule")))
    manual, low = F.col("override").isNotNull(), F.lower(text)
    no = F.lit(False) if not reject else contains_any(low, [p.lower() for p in reject])
    d = d.withColumn("verdict", F.coalesce("override", "rule.verdict", F.when(no, "rejected"), F.lit("queue")))
    reason = F.when(manual, "manual override").when(F.col("rule").isNotNull(), "event rule").when(F.col("verdict") == "rejected", "commentary, statistics or policy").otherwise("unclassified")
    return d.withColumn("route", F.when(manual, "manual").otherwise("rule")).withColumn("reason", reason).drop("override", "_text")


def canonical_score() -> Column:
    """Which candidate of a cluster stands for it: an event rule above all, then the quality of what a candidate has (jobs_cut, source_link), then a working address."""
    q = row_quality(fields={"status": F.lit(None).cast("string"), "jobs_cut_sg": F.col("jobs_cut"), "jobs_cut_global": F.lit(None).cast("double"), "pct_workforce": F.lit(None).cast("double")})
    return q * 10 + F.when(F.col("rule_matched"), 1000).otherwise(0) + F.when(F.col("broken_url"), 0).otherwise(1)


def routed(rows: DataFrame) -> dict[str, DataFrame]:
    """The four outputs of rows with final_verdict."""
    return {v: rows.filter(F.col("final_verdict") == v) for v in ("confirmed", "rumored", "rejected", "queue")}


def rejected_kind(kinds: list[tuple[str, str, tuple[str, ...]]] = REJECTED_KINDS) -> Column:
    """The first kind of rejection that company, source_link and notes show, else `other`."""
    at = lambda columns: F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in columns))
    return F.coalesce(*(F.when(at(columns).rlike(f"(?iu){p}"), name) for name, p, columns in kinds), F.lit("other"))


def polluted_accept() -> Column:
    """Accepted rows that no evaluation should count: a vague company, or confirmed with hedged notes."""
    return F.coalesce(F.col("company").rlike(VAGUE), F.lit(False)) | ((F.col("status") == "confirmed") & F.coalesce(F.col("notes").rlike(HEDGE), F.lit(False)))


def reject_pool(rejected: DataFrame) -> DataFrame:
    """Rejected rows fit for evaluation: with a company and an address, and not rejected as duplicates."""
    return rejected.filter("coalesce(company, '') <> '' and coalesce(source_link, '') <> ''").filter(~F.coalesce("notes", F.lit("")).rlike("(?i)duplicate"))


def tier_metrics(rows: DataFrame) -> DataFrame:
    """One row of (expected_verdict, verdict, global_figure, headcount_scope, expected_scope) cases: right verdicts, tiers, and how scopes were kept apart. No accepted pair counts as a tier match of 1."""
    yes = lambda c: F.col(c).isin("confirmed", "rumored")
    same, both = F.col("verdict") == F.col("expected_verdict"), yes("verdict") & yes("expected_verdict")
    pair = lambda e, v: F.count_if(both & (F.col("expected_verdict") == e) & (F.col("verdict") == v))
    ratio = lambda n, d, empty: F.coalesce(F.try_divide(n, d), F.lit(empty))
    is_global = F.coalesce(F.col("global_figure"), F.lit(False))
    return rows.agg(
        F.count("*").alias("cases"), ratio(F.count_if(same), F.count("*"), 0.0).alias("verdict_accuracy"), ratio(F.count_if(yes("verdict") == yes("expected_verdict")), F.count("*"), 0.0).alias("accept_accuracy"),
        F.count_if(both).alias("tier_cases"), ratio(F.count_if(both & same), F.count_if(both), 1.0).alias("tier_match"), pair("rumored", "confirmed").alias("over_confident"), pair("confirmed", "rumored").alias("under_confident"),
        F.count_if(is_global).alias("global_cases"), F.count_if(is_global & (F.col("verdict") == "confirmed") & (F.col("headcount_scope") == "singapore")).alias("scope_leaks"),
        F.count_if(is_global & F.col("headcount_scope").isin("global", "partial")).alias("scope_recognised"), F.count_if(F.col("expected_scope").isNotNull()).alias("scope_labelled"),
        F.count_if(F.col("expected_scope") == F.col("headcount_scope")).alias("scope_exact"),
    )


def pre_classify(rows: DataFrame, text: Column, rules: list[tuple[str, str]], reject: list[str], overrides: DataFrame | None = None) -> DataFrame:
    """rows with verdict and route: a manual override (row_idx, override), else an event rule, else rejection, else the queue."""
    verdict = F.coalesce(first_match(text, rules), F.when(contains_any(text, reject), "rejected"), F.lit("queue"))
    if overrides is not None:
        rows = rows.join(overrides, "row_idx", "left")
        return rows.withColumn("verdict", F.coalesce("override", verdict)).withColumn("route", F.when(F.col("override").isNotNull(), "manual").otherwise("rule")).drop("override")
    return rows.withColumn("verdict", verdict).withColumn("route", F.lit("rule"))


def resolve_clusters(rows: DataFrame) -> DataFrame:
    """rows (row_idx, cluster, kind, score, date_announced, verdict, route) with final_verdict.

    A cluster with an anchor rejects its candidates; else its canonical row (best score, earliest, first) rejects
    the rest. Rejected rows stay so, and manual verdicts win.
    """
    w = Window.partitionBy("cluster")
    rank = F.row_number().over(w.orderBy(F.desc("score"), F.asc_nulls_last("date_announced"), "row_idx"))
    anchored = F.bool_or(F.col("kind") == "anchor").over(w)
    several = F.count("*").over(w) > 1
    d = rows.withColumn("_rank", rank).withColumn("_anchored", anchored).withColumn("_several", several)
    keep = (F.col("kind") == "anchor") | (F.col("route") == "manual") | (F.col("verdict") == "rejected") | ~F.col("_several") | (~F.col("_anchored") & (F.col("_rank") == 1))
    return d.withColumn("final_verdict", F.when(keep, F.col("verdict")).otherwise("rejected")).drop("_rank", "_anchored", "_several")


def month_guard(rows: DataFrame, key: Column) -> DataFrame:
    """Only the first confirmed or rumored row of each company and month keeps its verdict; later ones are rejected."""
    hot = F.col("final_verdict").isin("confirmed", "rumored")
    r = F.row_number().over(Window.partitionBy(key, hot).orderBy("row_idx"))
    return rows.withColumn("final_verdict", F.when(hot & (r > 1), "rejected").otherwise(F.col("final_verdict")))


def parse_verdict(raw: Column, labels: list[str], text_fields: list[str], number_fields: list[str], label: str = "verdict") -> list[Column]:
    """The label (null unless in the list) and soft fields of a JSON object; a field of another type is null, bad JSON gives nulls."""
    v = F.try_parse_json(raw)
    kind = lambda f: F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant"))
    text = lambda f: F.when(kind(f) == "STRING", F.try_variant_get(v, f"$.{f}", "string"))
    number = lambda f: F.when(kind(f).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, f"$.{f}", "double"))
    own = text(label)
    return [F.when(own.isin(labels), own).alias(label), *(text(f).alias(f) for f in text_fields), *(number(f).alias(f) for f in number_fields)]


#: What a recheck of a rumor may find.
RECHECKED = ["confirmed", "denied", "expired", "still-rumored"]


def parse_recheck(raw: Column, statuses: list[str] = RECHECKED) -> list[Column]:
    """new_status (null unless in the list), evidence_url and note (blank if no text) and headcount of a recheck's JSON; without a status all are null."""
    status, url, note, count = parse_verdict(raw, statuses, ["evidence_url", "note"], ["headcount"], label="new_status")
    blank = lambda c, n: F.when(status.isNotNull(), F.coalesce(c, F.lit(""))).alias(n)
    return [status, blank(url, "evidence_url"), blank(note, "note"), F.when(status.isNotNull(), count).alias("headcount")]


def confusion(rows: DataFrame, truth: str, guess: str, *by: str) -> DataFrame:
    """Counts, precision, recall, F1 and accuracy of a 0/1 guess; undefined ratios are 0."""
    n = lambda t, g: F.count_if((F.col(truth) == t) & (F.col(guess) == g))
    c = rows.groupBy(*by).agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c = c.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    c = c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return c.withColumn("accuracy", ratio(F.col("tp") + F.col("tn"), reduce(lambda a, b: a + b, map(F.col, ("tp", "fp", "fn", "tn")))))


def stratified(rows: DataFrame, category: str, key: str, n: int, seed: int = 1234) -> DataFrame:
    """floor(n / categories) rows of each category, at least one, by a seeded order; filled up from the rest and cut at n.

    The order is that of md5 of key and seed, the same in any engine and layout. Ranks are cut at n in every task before
    the shuffle, so a category with any number of rows moves n a task.
    """
    kinds = rows.select(category).distinct().count()
    d = rows.withColumn("_o", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")))
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy(category).orderBy("_o", key))).filter(F.col("_r") <= n)
    own = F.col("_r") <= max(1, n // max(1, kinds))
    return d.orderBy(F.desc(own), "_o", key).limit(n).drop("_o", "_r")
