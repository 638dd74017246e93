"""The triage of a batch: classify, cluster with the ledger, keep one row an event, and deal the rest to their outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.rules import EVENT_RULES
from ledgerloom.functions.text import Aliases, iso_date, with_company_key
from ledgerloom.operators.classify import canonical_score, triage
from ledgerloom.operators.components import stage
from ledgerloom.operators.linking import cluster, company_tokens
from ledgerloom.operators.names import company_names
from ledgerloom.operators.projections import to_entry

OUTPUTS = ["confirmed", "rumored", "rejected", "queue"]


def node_frame(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """Candidates, then the ledger's rows as anchors, in one frame with `node`, the order of both: row_idx of candidates, and of anchors behind the last candidate's."""
    own = ["company", "date_announced", "source_link", "notes"]
    first = (candidates.agg(F.max("row_idx")).first()[0] or 0) + 1
    side = lambda df, kind, at: df.select(F.lit(kind).alias("kind"), "row_idx", at.cast("long").alias("node"), *own)
    return side(candidates, "candidate", F.col("row_idx")).unionByName(side(ledger, "anchor", F.col("row_idx") + first))


def clustered(candidates: DataFrame, ledger: DataFrame, aliases: Aliases = None) -> DataFrame:
    """(kind, row_idx, cluster) of candidates and anchors; companies are looked for by the spellings of the ledger's names."""
    nodes = stage(node_frame(candidates, ledger), "nodes")
    names = company_names(nodes.select("company"), aliases=aliases)
    found = cluster(nodes.withColumn("row_idx", F.col("node")), tokens=company_tokens(ledger.select("company", "row_idx"), aliases), aliases=names)
    return nodes.select("kind", "row_idx", "node").join(found.select(F.col("row_idx").alias("node"), "cluster"), "node").select("kind", "row_idx", "cluster")


def settled(classified: DataFrame, clusters: DataFrame, ledger: DataFrame) -> DataFrame:
    """classified candidates with final_verdict and reason once duplicates within their cluster are rejected.

    The first anchor of a cluster rejects all its candidates; without one the canonical candidate (best score, earliest,
    first) rejects the others, but for those rejected already. Manual verdicts stay. Whoever is rejected as a duplicate
    loses what its rule said. Of a cluster, however large, one combined row is joined back.
    """
    anchors = clusters.filter("kind = 'anchor'").join(ledger.select("row_idx", "company", "date_announced"), "row_idx")
    label = F.concat(F.coalesce("company", F.lit("")), F.lit(" ("), F.coalesce("date_announced", F.lit("")), F.lit(")"))
    anchors = anchors.groupBy("cluster").agg(F.min_by(label, "row_idx").alias("_anchor"))
    own = stage(classified.join(clusters.filter("kind = 'candidate'").select("row_idx", "cluster"), "row_idx"), "classified")
    scored = own.withColumns({"rule_matched": F.col("rule").isNotNull() & (F.col("route") != "manual"), "broken_url": F.coalesce("notes", F.lit("")).rlike("(?i)BROKEN URL"), "jobs_cut": F.coalesce("jobs_cut_sg", "jobs_cut_global")})
    day = iso_date(F.col("date_announced"))
    order = F.struct((-canonical_score()).alias("s"), day.isNull().alias("undated"), day.alias("day"), "row_idx")
    best = scored.groupBy("cluster").agg(F.min_by("row_idx", order).alias("_best"))
    d = own.join(best, "cluster").join(anchors, "cluster", "left")
    free = F.col("route") != "manual"
    by_anchor = free & F.col("_anchor").isNotNull()
    by_mate = free & F.col("_anchor").isNull() & (F.col("row_idx") != F.col("_best")) & (F.col("verdict") != "rejected")
    reason = F.when(by_anchor, F.concat(F.lit("Duplicate of existing "), "_anchor")).when(by_mate, F.concat(F.lit("Intra-batch duplicate of row "), F.col("_best").cast("string")))
    return _rejected(d, by_anchor | by_mate, reason).drop("_best", "_anchor", "cluster")


def _rejected(d: DataFrame, who: Column, reason: Column) -> DataFrame:
    before = F.col("final_verdict") if "final_verdict" in d.columns else F.col("verdict")
    return d.withColumns({"final_verdict": F.when(who, "rejected").otherwise(before), "reason": F.when(who, reason).otherwise(F.col("reason")), "rule": F.when(~who, F.col("rule"))})


def one_a_month(d: DataFrame, aliases: Aliases = None) -> DataFrame:
    """The first row of each company and month that is still confirmed or rumored keeps its verdict; rows without a company or date are not compared."""
    d = d.withColumn("_named", F.coalesce(F.nullif("rule.company", F.lit("")), "company"))
    month = F.nullif(F.substring("date_announced", 1, 7), F.lit(""))
    d = stage(with_company_key(d, "_k", "_named", aliases).withColumn("_month", F.when(F.coalesce("_named", F.lit("")) != "", month)), "named")
    hot = F.col("final_verdict").isin("confirmed", "rumored") & F.col("_month").isNotNull()
    first = d.filter(hot).groupBy("_k", "_month").agg(F.min("row_idx").alias("_first"))
    d = d.join(first, ["_k", "_month"], "left")
    reason = F.concat(F.lit("Duplicate (same canonical "), "_named", F.lit(", "), "_month", F.lit(") already added this run"))
    return _rejected(d, hot & (F.col("row_idx") != F.col("_first")), reason).drop("_k", "_month", "_named", "_first")


def triage_run(candidates: DataFrame, ledger: DataFrame, reject: list[str], rules: list[tuple] = EVENT_RULES, overrides: DataFrame | None = None, aliases: Aliases = None) -> DataFrame:
    """A row per candidate: final_verdict, reason, and the ledger row that it becomes. candidates and ledger have the ledger's columns and a row_idx each.

    An empty ledger rejects nothing; an empty batch gives no rows. Every row comes out once, and `dealt` splits them.
    """
    names = company_names(candidates.select("company"), ledger.select("company"), candidates.sparkSession.createDataFrame([(r[1],) for r in rules], "company string"), aliases=aliases)
    classified = stage(triage(candidates, reject, rules, overrides), "triaged")
    d = one_a_month(settled(classified, clustered(candidates, ledger, names), ledger), names)
    d = stage(d, "settled")
    return d.select("row_idx", "final_verdict", "reason").join(to_entry(d, names), "row_idx")


def dealt(run: DataFrame) -> dict[str, DataFrame]:
    """The four outputs of a run: ledger rows confirmed and rumored, rejected ones with the reason as notes where they had none, and what stays queued."""
    return {v: run.filter(F.col("final_verdict") == v).drop("final_verdict", "reason") for v in OUTPUTS}
