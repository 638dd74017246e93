"""The audit of past versions of a ledger, and what has changed since."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import Aliases
from ledgerloom.operators.audit import check_integrity, regression
from ledgerloom.operators.components import stage
from ledgerloom.sources.ledger_files import exists, read_snapshots, write_snapshot

#: The tables of a version: the ledger, the rejected rows, and the pairs of events known to be distinct.
ENTRIES, REJECTED, DISTINCT = "entries", "rejected", "distinct"


def save_version(root: str, snapshot: str, entries: DataFrame, rejected: DataFrame | None = None, distinct_pairs: DataFrame | None = None) -> None:
    """Write a version's tables, each to a partition of its own; a table that is None has no such partition."""
    for name, table in ((ENTRIES, entries), (REJECTED, rejected), (DISTINCT, distinct_pairs)):
        if table is not None:
            write_snapshot(table, f"{root}/{name}", snapshot)


def version(spark: SparkSession, root: str, name: str, snapshot: str) -> DataFrame | None:
    """A table as of a version: the scan reads that partition only. None where it has none."""
    if not exists(spark, f"{root}/{name}/snapshot={snapshot}"):
        return None
    return read_snapshots(spark, f"{root}/{name}").filter(F.col("snapshot") == snapshot).drop("snapshot")


def findings_at(spark: SparkSession, root: str, snapshot: str, today: str, allowed: DataFrame | None = None, aliases: Aliases = None) -> DataFrame | None:
    """All findings of a past version, by its own rejected rows and distinct pairs, today's rules, aliases and allowed neighbours; None if there is no such version."""
    entries = version(spark, root, ENTRIES, snapshot)
    if entries is None:
        return None
    return check_integrity(entries, today, version(spark, root, DISTINCT, snapshot), allowed, version(spark, root, REJECTED, snapshot), aliases=aliases)


def since(current: DataFrame, past: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings new since, findings resolved since, one row of counts: then, now, new, resolved). Without a past version all are new."""
    now = stage(current, "now")
    then = stage(past, "then") if past is not None else now.limit(0)
    new, gone = regression(now, then)
    n = lambda df, c: df.agg(F.count("*").alias(c))
    counts = n(then, "then").crossJoin(n(now, "now")).crossJoin(n(new, "new")).crossJoin(n(gone, "resolved"))  # of one row each
    return new, gone, counts
