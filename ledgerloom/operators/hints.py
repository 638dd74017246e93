"""Known events as hints for candidates, and one event for candidates that cluster together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import Aliases, with_company_key
from ledgerloom.operators.names import company_names


def event_index(ledger: DataFrame, aliases: Aliases = None) -> DataFrame:
    """(k, event_id, date_announced, company, row_idx): the first row of each company's events."""
    e = with_company_key(ledger.filter("coalesce(event_id, '') <> ''"), "k", aliases=aliases)
    first = F.min(F.struct("row_idx", "date_announced", "company")).alias("f")
    return e.groupBy("k", "event_id").agg(first).select("k", "event_id", "f.date_announced", "f.company", "f.row_idx")


def first_events(events: DataFrame, key: str, most: int) -> DataFrame:
    """(key, ids): the first `most` of events (key, event_id, at) of each key, in order.

    The rank is cut in every task before the shuffle, so of a key with any number of events only `most` a task move on.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy("at", "event_id"))
    kept = events.withColumn("_r", rank).filter(F.col("_r") <= most)
    return kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "event_id"))), lambda x: x["event_id"]).alias("ids"))


def select_hints(candidates: DataFrame, ledger: DataFrame, clusters: DataFrame, most: int = 12, aliases: Aliases = None) -> DataFrame:
    """(row_idx, primary_event_id, listed): per candidate the event of its cluster's first anchor, and up to `most` other known events.

    candidates (row_idx, company), ledger (row_idx, company, date_announced, event_id), clusters (kind, row_idx, cluster)
    of candidates and anchors. Events of the candidate's company come first, in file order, then those of its cluster.
    Companies and clusters get a bounded list each, once: with one more than `most` of its own, a company needs none of
    the cluster's; with fewer, all of them are in its list, and the cluster's list has `most` more than they and the primary
    can take away. A candidate meets the two lists, never the events.
    """
    names = company_names(candidates.select("company"), ledger.select("company"), aliases=aliases)
    known = event_index(ledger, names).select("k", "event_id", F.col("row_idx").alias("at"))
    anchors = clusters.filter("kind = 'anchor'").select("cluster", "row_idx").join(ledger.select("row_idx", "event_id"), "row_idx")
    primary = anchors.groupBy("cluster").agg(F.min_by("event_id", "row_idx").alias("primary_event_id"))
    near = anchors.filter("coalesce(event_id, '') <> ''").groupBy("cluster", "event_id").agg(F.min("row_idx").alias("at"))
    own = clusters.filter("kind = 'candidate'").select("row_idx", "cluster")
    lists = primary.join(first_events(near, "cluster", 2 * most + 1).withColumnRenamed("ids", "_near"), "cluster", "left")
    d = with_company_key(candidates.select("row_idx", "company"), "k", aliases=names).join(own, "row_idx", "left")
    d = d.join(first_events(known, "k", most + 1).withColumnRenamed("ids", "_own"), "k", "left").join(lists, "cluster", "left")
    none = F.array().cast("array<string>")
    every = F.array_distinct(F.concat(F.coalesce("_own", none), F.coalesce("_near", none)))
    others = F.filter(every, lambda x: ~x.eqNullSafe(F.col("primary_event_id")))
    return d.select("row_idx", F.nullif("primary_event_id", F.lit("")).alias("primary_event_id"), F.slice(others, 1, most).alias("listed"))


def pick_hinted(verdicts: DataFrame, hints: DataFrame) -> DataFrame:
    """verdicts (row_idx, proposed) with event_id, the proposal if it is one of the candidate's hints word for word, and discarded_event_id."""
    own = F.nullif(F.trim("proposed"), F.lit(""))
    ids = F.array_compact(F.concat(F.array("primary_event_id"), F.coalesce("listed", F.array().cast("array<string>"))))
    d = verdicts.join(hints, "row_idx", "left").withColumn("event_id", F.when(F.array_contains(ids, own), own))
    return d.select(*verdicts.columns, "event_id", F.when(F.col("event_id").isNull(), own).alias("discarded_event_id"))


def align_events(rows: DataFrame) -> DataFrame:
    """rows (row_idx, cluster, kind, score, date_announced, accepted, event_id) with new_event_id: accepted candidates of a cluster without an anchor adopt the event of its canonical row, if that one is accepted."""
    w = Window.partitionBy("cluster")
    candidate = F.col("kind") == "candidate"
    rank = F.row_number().over(w.orderBy(F.desc(candidate), F.desc("score"), F.asc_nulls_last("date_announced"), "row_idx"))
    d = rows.withColumn("_anchored", F.bool_or(~candidate).over(w)).withColumn("_r", rank)
    lead = F.max(F.when((F.col("_r") == 1) & F.col("accepted"), F.col("event_id"))).over(w)
    d = d.withColumn("_lead", lead)
    return d.withColumn("new_event_id", F.when(candidate & ~F.col("_anchored") & F.col("accepted") & F.col("_lead").isNotNull(), F.col("_lead")).otherwise(F.col("event_id"))).drop("_anchored", "_r", "_lead")
