"""Guards that keep a change from adding findings.

A finding depends on rows that share something with one another: a company's first word, an address, a title
fingerprint, an event, or a rare token. So a batch is judged on the rows that its candidates can touch, and
candidates that share nothing are judged together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import Aliases, append_evidence, gn_fingerprint, normalize_url, with_company_key
from ledgerloom.operators.audit import fingerprint, regression
from ledgerloom.operators.components import connected_components, stage
from ledgerloom.operators.integrity import STOPWORDS, event_or_row, significant_tokens
from ledgerloom.operators.linking import to_first
from ledgerloom.operators.names import company_names

#: Findings of a ledger, given the rejected rows too if there are any.
Audit = Callable[..., DataFrame]
APPLIED = ["confirmed", "denied", "expired"]


def touching(rows: DataFrame, aliases: Aliases, rejected: bool = False, stopwords: list[str] = STOPWORDS) -> DataFrame:
    """(row_idx, key): what a row's findings may share with other rows; of rejected rows, address and fingerprint only."""
    mark = lambda kind, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{kind}:"), c))
    shared = [mark("url", normalize_url(F.col("source_link"))), mark("gn", gn_fingerprint(F.col("notes")))]
    if rejected:
        return rows.select("row_idx", F.explode(F.array_compact(F.array(*shared))).alias("key"))
    tokens = F.transform(significant_tokens(F.col("company"), stopwords), lambda t: F.concat(F.lit("token:"), t))
    first = F.concat(F.lit("name:"), F.substring_index("_k", " ", 1))
    every = F.concat(F.array_compact(F.array(first, mark("event", event_or_row()), *shared)), tokens)
    return with_company_key(rows, "_k", aliases=aliases).select("row_idx", F.explode(F.array_distinct(every)).alias("key"))


def screen_batch(ledger: DataFrame, candidates: DataFrame, audit: Audit, rejected: DataFrame | None = None, aliases: Aliases = None, rare: int = 5) -> tuple[DataFrame, DataFrame]:
    """(kept, held back) of candidate rows: all if together they add no finding, else one after another those that add none.

    Candidates have the ledger's columns and follow it in row_idx; those whose `target`, a column they may have, is
    `rejected` would join the rejected rows. Held-back rows carry the fingerprints they add, in `added`. An empty batch is
    kept whole.

    Candidates that share a key, directly or over others, are judged in order; the n-th of every such group together,
    in one audit a level, and one more if any of them is held back. Audits see the rows within two keys of a candidate, which decide every
    finding within one; tokens of more than `rare` ledger rows, which no finding uses any more, are no keys. Only fingerprints
    of level candidates and counts come to the driver.
    """
    columns, spark = ledger.columns, ledger.sparkSession
    c = candidates if "target" in candidates.columns else candidates.withColumn("target", F.lit("ledger"))
    c = stage(c, "candidates")
    names = company_names(ledger.select("company"), c.select("company"), aliases=aliases)
    out = F.col("target") == "rejected"
    keys = touching(c.filter(~out), names).unionByName(touching(c.filter(out), names, rejected=True))
    of_ledger = touching(ledger, names)
    common = of_ledger.filter("startswith(key, 'token:')").groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > rare).select("key")
    common = stage(common, "common")
    keys = stage(keys.join(common, "key", "left_anti"), "keys")
    of_ledger = stage(of_ledger.join(common, "key", "left_anti"), "ledger-keys")
    near_keys = of_ledger.join(of_ledger.join(keys.select("key").distinct(), "key", "left_semi").select("row_idx").distinct(), "row_idx", "left_semi")
    near_keys = stage(near_keys, "near-keys")
    near = stage(near_keys.select("row_idx").unionByName(c.select("row_idx")).distinct(), "near")
    wide_keys = stage(near_keys.select("key").unionByName(keys.select("key")).distinct(), "wide")
    around = stage(ledger.join(of_ledger.join(wide_keys, "key", "left_semi").select("row_idx").distinct(), "row_idx", "left_semi").select(columns), "around")
    also = None
    if rejected is not None or not c.filter(out).isEmpty():
        also = (rejected if rejected is not None else ledger.limit(0)).select(columns)
        also = stage(also.join(touching(also, names, rejected=True).join(wide_keys, "key", "left_semi").select("row_idx").distinct(), "row_idx", "left_semi").select(columns), "also")

    def findings(with_: DataFrame) -> DataFrame:
        """Findings within one key of the candidates, if the rows of with_ (row_idx) are let in."""
        let = c.join(with_, "row_idx", "left_semi")
        rows = around.unionByName(let.filter(~out).select(columns))
        found = audit(rows) if also is None else audit(rows, also.unionByName(let.filter(out).select(columns)))
        found = stage(found, "findings")
        own = found.withColumn("fingerprint", fingerprint()).select("fingerprint", "type", "rows", F.explode("rows").alias("r"))
        return stage(own.join(near.select((F.col("row_idx") + 1).alias("r")), "r", "left_semi").select("fingerprint", "type", "rows").distinct(), "touched")

    def added(now: DataFrame, before: DataFrame) -> DataFrame:
        return now.join(before.select("fingerprint").distinct(), "fingerprint", "left_anti")

    ids = c.select("row_idx")
    current = findings(ids.limit(0))
    held = spark.createDataFrame([], "row_idx long, added array<string>")
    kept = ids
    if not added(findings(ids), current).isEmpty():
        groups = connected_components(to_first(keys, "key"))
        turn = F.row_number().over(Window.partitionBy("group").orderBy("row_idx"))
        order = stage(c.join(groups, c["row_idx"] == groups["node"], "left").select("row_idx", "target", F.coalesce("component", "row_idx").alias("group")).withColumn("turn", turn), "order")
        kept = ids.limit(0)
        for level in range(1, (order.agg(F.max("turn")).first()[0] or 0) + 1):
            mine = order.filter(F.col("turn") == level)
            trial = findings(kept.unionByName(mine.select("row_idx")))
            new = added(trial, current)
            # a candidate's own row is in what it adds; what a rejected one adds lies on ledger rows that share a key with it
            at = F.explode(F.transform("rows", lambda r: r - 1))
            direct = new.select("fingerprint", at.alias("row_idx")).join(mine.select("row_idx"), "row_idx")
            over = new.filter("type = 'cross-file-contradiction'").select("fingerprint", at.alias("at"))
            theirs = keys.join(mine.filter(out).select("row_idx"), "row_idx", "left_semi")
            there = of_ledger.unionByName(keys).select(F.col("row_idx").alias("at"), "key")
            over = over.join(there, "at").join(theirs, "key").select("row_idx", "fingerprint")
            bad = stage(direct.select("row_idx", "fingerprint").unionByName(over).groupBy("row_idx").agg(F.array_sort(F.collect_set("fingerprint")).alias("added")), "held")
            kept = stage(kept.unionByName(mine.select("row_idx").join(bad, "row_idx", "left_anti")), "kept")
            held = held.unionByName(bad)
            current = trial if bad.isEmpty() else findings(kept)
    return candidates.join(kept, "row_idx", "left_semi"), candidates.join(held, "row_idx")


def apply_results(rows: DataFrame, results: DataFrame, aliases: Aliases = None) -> DataFrame:
    """Ledger rows with the results (row_idx, company, date_announced, new_status, evidence_url) applied: result_idx, previous_status and previous_notes tell where.

    Each result that changes a status claims the next unclaimed row of its company and date; only status and notes change.
    """
    date = F.trim(F.coalesce("date_announced", F.lit("")))
    turn = F.row_number().over(Window.partitionBy("_k", "_d").orderBy("row_idx"))
    keyed = lambda x: with_company_key(x, "_k", aliases=aliases).withColumn("_d", date).withColumn("_n", turn)
    own = keyed(results.filter(F.col("new_status").isin(APPLIED))).select("_k", "_d", "_n", F.col("row_idx").alias("result_idx"), "new_status", "evidence_url")
    d = keyed(rows).join(own, ["_k", "_d", "_n"], "left")
    hit = F.col("result_idx").isNotNull()
    changed = {"status": F.col("new_status"), "notes": append_evidence(F.col("notes"), F.col("evidence_url"))}
    return d.select(*(F.when(hit, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in rows.columns), "result_idx", F.when(hit, F.col("status")).alias("previous_status"), F.when(hit, F.col("notes")).alias("previous_notes"))


def apply_results_safely(rows: DataFrame, results: DataFrame, audit: Audit, max_rounds: int = 50, aliases: Aliases = None) -> tuple[DataFrame, list[int]]:
    """(rows, result_idx of results held back): changes whose rows appear in new findings are taken back until none are; if new findings remain, all are."""
    base = stage(audit(rows), "baseline")
    done = stage(apply_results(rows, results, aliases), "applied")
    undone: list[int] = []

    def state() -> DataFrame:
        back = F.col("result_idx").isin(undone)
        return done.select(*(F.when(back, F.col(f"previous_{c}")).otherwise(F.col(c)).alias(c) if c in ("status", "notes") else F.col(c) for c in rows.columns), F.when(~back, F.col("result_idx")).alias("result_idx"))

    for _ in range(max_rounds):
        new = regression(audit(state().select(rows.columns)), base)[0]
        flagged = new.select(F.explode("rows").alias("r")).select((F.col("r") - 1).alias("row_idx")).distinct()
        hit = [r[0] for r in state().filter("result_idx is not null").join(flagged, "row_idx").select("result_idx").collect()]
        if not hit:
            break
        undone += hit
    left = [r[0] for r in state().filter("result_idx is not null").select("result_idx").collect()]
    if left and regression(audit(state().select(rows.columns)), base)[0].limit(1).count():
        undone += left
    return state(), sorted(undone)
